from annotary.llm import decontamination as dc
from tests.conftest import SF_DIR

ITEM = "A farmer named Alice has 12 sheep and buys 7 more sheep, so Alice counts 12 old sheep and 7 km of fence near the barn."


def found(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in dc.contaminated(docs, bench).collect()}


def test_templates_and_slots(spark):
    again = ITEM.replace("Alice", "Robert").replace("12", "90").replace("7", "31").replace("km", "miles")
    torn = ITEM.replace("counts 12", "counts 55")
    half = " ".join(ITEM.split()[:13])
    other = "Nothing of the kind stands here, only plain words about other things that nobody asked for."
    texts = ["Intro words here. " + ITEM + " And more.", again, torn, half, other, None, "", ITEM, "w " * 50_000 + again]
    got = found(spark, texts)
    assert {k[0] for k in got} == {0, 1, 7, 8}
    assert got[0, 0].exact and got[7, 0].exact and not got[1, 0].exact and not got[8, 0].exact


def test_template_tokens():
    ids, slot, first = dc.template(["Then Bob ran 5 km. The end", "x"])
    assert [int(s != 0) for s in slot] == [0, 1, 0, 1, 1, 0, 0, 0] and list(first) == [0, 7, 8]
    assert ids[5] == dc.template(["the"])[0][0]


def test_edge_tables(spark):
    assert found(spark, [ITEM], ["too short", None, "", ITEM, ITEM]).keys() == {(0, 3), (0, 4)}
    assert found(spark, [ITEM], ["1 2 3 4 5 6 7 8"]) == {}
    docs = spark.createDataFrame([(None, ITEM, "k"), (1, ITEM, "k"), (1, ITEM, "k"), (2, None, None)], "doc_id long, text string, key string")
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id) for r in dc.contaminated(docs, bench).collect()) == [(0, 7), (1, 7)]
    left = dc.decontaminate(docs, bench)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [2]
    assert dc.contaminated(docs.limit(0), bench).count() == 0
    assert dc.decontaminate(docs, bench.limit(0)).count() == 4


def test_finds_what_a_search_for_whole_items_finds(spark):
    docs = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet")
    bench = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/benchmark.parquet")
    items = [(r.item_id, " ".join(r.text.split())) for r in bench.collect()]
    brute = {(d.doc_id, i) for d in docs.collect() for i, t in items if t in " ".join(d.text.split())}
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect()}
    assert brute and brute <= got and len(got) <= 1.2 * len(brute) + 2


def test_names_count_wherever_they_stand_and_in_any_case(spark):
    sheep = "Alice has 12 sheep. Bob buys 7 more sheep. How many sheep do they own?"
    clips = "Natalia sold 48 clips in April. Natalia sold half as many clips in May. How many clips did Natalia sell in all?"
    other = sheep.replace("Alice", "Carol").replace("12", "30").replace("Bob", "Dan").replace("7", "9")
    texts = [
        other, "Intro words here. " + other.lower(), clips.replace("Natalia", "Weng").replace("48", "60"), ITEM.lower(), ITEM.upper(),
        ITEM.replace("Alice", "Mary Ann"), ITEM.replace("Alice", "robert").lower(), sheep.replace("Alice", "Mary Ann"),
        "A farmer named Tom sells eggs. Tom has no sheep, and how many they own is not known.", ITEM.replace("counts 12", "counts 55").lower(),
    ]
    assert found(spark, texts, [sheep, clips, ITEM]).keys() == {(0, 0), (1, 0), (2, 1), (3, 2), (4, 2), (5, 2), (6, 2), (7, 0)}
    assert found(spark, [ITEM, ITEM.replace("Alice", "Mary Ann")], [ITEM.lower()]).keys() == {(0, 0), (1, 0)}


def test_short_items_are_found_whole(spark):
    items = ["Compute 3 + 4 = 7.", "12 x 7 + 5 - 3 = ?", "Mary Ann", "Solve x plus 12", "?!"]
    texts = ["So compute 3 + 4 = 7. Good", "what is 12 X 7 + 5 - 3 = ?", "by mary ann again", "Now solve x plus 31", "Compute 3 + 4 = 8", "12 x 7 + 5 - 4", "Mary, 12"]
    assert found(spark, texts, items).keys() == {(0, 0), (1, 1), (2, 2), (3, 3)}

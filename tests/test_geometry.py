import pytest
from pyspark.sql import functions as F

from annotary.functions import geometry as g
from annotary.functions import naming


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], _schema(values))
    return row.select(column.alias("v")).first()["v"]


def _schema(values):
    kinds = {list: "array<double>", str: "string", int: "int", float: "double"}
    return ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())


@pytest.mark.parametrize(
    "ring, area",
    [
        ([0.0, 0.0, 10.0, 0.0, 10.0, 10.0, 0.0, 10.0], 100.0),
        ([0.0, 10.0, 10.0, 10.0, 10.0, 0.0, 0.0, 0.0], 100.0),
        ([493.0, 458.0, 493.0, 457.0, 493.0, 457.0], 0.0),
        ([1.0, 1.0, 2.0, 2.0], 0.0),
        ([], 0.0),
    ],
)
def test_area(spark, ring, area):
    assert one(spark, g.ring_area("ring"), ring=ring) == area
    assert one(spark, g.is_degenerate("ring"), ring=ring) == (area == 0)


def test_bbox_and_interleave(spark):
    assert one(spark, g.ring_bbox("ring"), ring=[2.0, 3.0, 10.0, 5.0, 6.0, 20.0]) == [2, 3, 8, 17]
    zipped = g.interleave("xs", "ys")
    assert one(spark, zipped, xs=[1.0, 2.0, 3.0], ys=[4.0, 5.0, 6.0]) == [1, 4, 2, 5, 3, 6]
    with pytest.raises(Exception, match="differ in length"):
        one(spark, zipped, xs=[1.0, 2.0], ys=[4.0])


@pytest.mark.parametrize(
    "ring, size, outside",
    [
        ([2142.0, 5.0, 2860.0, 5.0, 2500.0, 50.0], 1632, True),
        ([-5.0, 1.0, 10.0, 1.0, 3.0, 9.0], 20, False),
        ([-5.0, 1.0, 0.0, 1.0, -3.0, 9.0], 20, True),
    ],
)
def test_out_of_frame(spark, ring, size, outside):
    assert one(spark, g.is_out_of_frame("ring", "w", "w"), ring=ring, w=size) == outside
    unknown = g.is_out_of_frame("ring", F.lit(None).cast("int"), "w")
    assert one(spark, unknown, ring=ring, w=size) is False


def test_letterbox_rounds_half_to_even(spark):
    box = one(spark, g.letterbox("w", "h", 64), w=80, h=40)
    assert tuple(box) == (64, 32, 0, 16)
    # 5 * 64 / 128 = 2.5 rounds to 2
    assert one(spark, g.letterbox("w", "h", 64), w=128, h=5)["new_h"] == 2


@pytest.mark.parametrize(
    "name, stem",
    [("a/b/photo.final.jpg", "photo.final"), (".hidden", ".hidden"), ("x/plain", "plain")],
)
def test_stem(spark, name, stem):
    assert one(spark, naming.stem("n"), n=name) == stem


@pytest.mark.parametrize(
    "name, group",
    [
        ("01012020_172204image853193.jpg", "01012020_172204"),
        ("z1692240140997_deadbeef.jpg", "z1692240140997_deadbeef.jpg"),
    ],
)
def test_timestamp_group(spark, name, group):
    assert one(spark, naming.timestamp_group("n"), n=name) == group


def test_group_micros(spark):
    from datetime import datetime, timezone

    def at(*parts):
        return int(datetime(*parts, tzinfo=timezone.utc).timestamp() * 1_000_000)

    def micros(text):
        return one(spark, naming.group_micros("n"), n=text)

    assert micros("06012020_095245") == at(2020, 1, 6, 9, 52, 45)
    assert micros("20200130_190111") == at(2020, 1, 30, 19, 1, 11)
    for bad in ("30022020_101010", "IMG_0042.jpg", "01012020_101060", "1012020_101010"):
        assert micros(bad) is None


def test_labels_and_durations(spark):
    cases = [((None, None), None), ((1, 1), "1"), ((4, None), "4+"), ((2, 5), "2-5")]
    df = spark.createDataFrame([c for c, _ in cases], "lo int, hi int")
    got = [r[0] for r in df.select(naming.bucket_label("lo", "hi")).collect()]
    assert got == [label for _, label in cases]
    keys = df.select(naming.run_key(F.lit(50), F.lit(42), "lo", "hi")).collect()
    assert keys[0][0] == "n50_seed42" and keys[2][0] == "n50_density4+_seed42"
    assert one(spark, naming.duration_text("s"), s=90061.0) == "1 j 01 h 01 min"
    assert one(spark, naming.duration_text("s"), s=-5.0) == "00 h 00 min"

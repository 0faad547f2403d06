import hashlib
import re

from pyspark.sql import functions as F

from annotary.llm import pseudonyms as ps

KEY = "test key"


def keyed(tweak, i, value):
    return int(hashlib.sha256(f"{KEY}|{tweak}|{i}|{value}".encode()).hexdigest()[:15], 16)


def feistel(left, right, a, b, tweak):
    for i in range(1, ps.ROUNDS + 1):
        size = a if i % 2 else b
        left, right = right, (left + keyed(tweak, i, right) % size) % size
    return left, right


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])


def brute_card(digits):
    p, k = digits[:-1], (len(digits) - 1) // 2
    left, right = feistel(int(p[:k]), int(p[k:]), 10**k, 10 ** (len(p) - k), "card")
    p = str(left).zfill(k) + str(right).zfill(len(p) - k)
    return p + str(-luhn(p + "0") % 10)


def run(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in ps.pseudonymise(docs, KEY).orderBy("doc_id").collect()]


def test_feistel_permutes_its_whole_domain(spark):
    pairs = spark.range(77).select((F.col("id") % 7).alias("l"), (F.col("id") / 7).cast("long").alias("r"))
    got = [(r.p.l, r.p.r, r.l, r.r) for r in pairs.select("l", "r", ps.feistel(F.col("l"), F.col("r"), F.lit(7), F.lit(11), KEY, "t").alias("p")).collect()]
    assert {g[:2] for g in got} == {(a, b) for a in range(7) for b in range(11)}
    assert all(g[:2] == feistel(g[2], g[3], 7, 11, "t") for g in got)


def test_cards_addresses_and_links_across_documents(spark):
    card = "4845168114407329"
    first, second, third = run(spark, f"pay {card}, or 4845-1681-1440-7329.", f"{card} from 97.51.17.173", "bad 4845168114407328 and 999.1.1.1")
    fresh = brute_card(card)
    assert first.text == f"pay {fresh}, or {'-'.join(re.findall('....', fresh))}." and luhn(fresh) % 10 == 0
    a, b = feistel(97 * 256 + 51, 17 * 256 + 173, 65536, 65536, "address")
    assert second.text == f"{fresh} from {a // 256}.{a % 256}.{b // 256}.{b % 256}"
    assert third.text == "bad 4845168114407328 and 999.1.1.1" and third.n_cards == third.n_addresses == 0
    assert (first.n_cards, second.n_cards, second.n_addresses) == (2, 1, 1)


def test_dates_keep_their_form_and_meaning(spark):
    (row,) = run(spark, "2024-02-29 is 29/02/2024, 02/29/2024 and 29.02.2024; not 31.04.2024 or 2023-02-29")
    iso, dmy, mdy, dots, *rest = re.findall(r"[0-9]+[-/.][0-9]+[-/.][0-9]+", row.text)
    y, m, d = iso.split("-")
    assert (dmy, mdy, dots) == (f"{d}/{m}/{y}", f"{m}/{d}/{y}", f"{d}.{m}.{y}") and iso != "2024-02-29"
    assert rest == ["31.04.2024", "2023-02-29"] and row.n_dates == 4 and 1800 <= int(y) < 2200


def test_phones_mails_and_numbers_of_persons(spark):
    one, two = run(spark, "+1 (974) 555-3436, jo.34@mail7.example.com, 123-45-6789", "x +1 (974) 555-3436 jo.34@mail7.example.com 666-12-1234")
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}, user\d+@host\d+\.example\.com, \d{3}-\d{2}-\d{4}", one.text)
    assert one.text[:17] == two.text[2:19] and "555-3436" not in one.text and two.text.endswith("666-12-1234")
    assert (one.n_phones, one.n_emails, one.n_ssns, two.n_ssns) == (1, 1, 1, 0)


def test_edge_rows(spark):
    long = "word " * 50_000
    docs = spark.createDataFrame(
        [(None, None, 5), (1, "", 5), (1, "", 5), (2, long + "97.51.17.173", 5), (3, "\\u00e9.5@x.org 1.2.3.4.5", 5)], "doc_id long, text string, n_dates int"
    )
    got = ps.pseudonymise(docs, KEY).collect()
    assert [r.text for r in got[:3]] == [None, "", ""] and all(r.n_dates == 5 for r in got)
    assert got[3].n_addresses == 1 and got[3].text.startswith(long) and got[4].n_addresses == 0
    assert ps.pseudonymise(docs.limit(0), KEY).count() == 0


def test_other_forms_of_phones_and_cards(spark):
    phones = ["+14155550123", "+49 30 1234567", "(415) 555-0123", "415-555-0123", "0044 20 7946 0958", "415.555.0123", "1-415-555-0123", "020 7946 0958", "(030) 1234567", "+1 (415) 555-0123"]
    cards = ["3782 822463 10005", "3782-822463-10005"]
    rows = run(spark, *[f"call {v}, now" for v in phones + cards], "3782 822463 10006, 2024-02-29 x, 12-34")
    for v, r in zip(phones + cards, rows):
        assert v not in r.text and re.sub("[0-9]", "0", r.text) == re.sub("[0-9]", "0", f"call {v}, now")
        assert (r.n_phones, r.n_cards) == ((1, 0) if v in phones else (0, 1))
    digits = [re.sub("[^0-9]", "", r.text) for r in rows]
    assert digits[0] == digits[9] and digits[0][1:] == digits[2] == digits[3] == digits[5]
    assert rows[4].text.startswith("call 0044 ") and rows[-1].text.startswith("3782 822463 10006") and rows[-1].n_phones == 0


def test_no_form_is_lost_where_forms_are_not_tried(spark):
    """Places that no form can begin at are passed over; texts without @ are not searched for mail. Pieces stay the same."""
    plain = "|".join(ps.FORMS.values())
    texts = ["(030) 1234567 a@b.org +49 30 1234567", "x0044 20 7946 0958", "a 4845168114407329 1.2.3.4, 2024-02-29", "no @ number 12", "123-45-6789@x.de", "é1.2.3.4 (415) 555-0123", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same = docs.select((F.split("text", f"(?={plain})") == F.split("text", f"(?={ps.ANY})")).alias("same"))
    assert all(r.same for r in same.collect())
    assert all(form.startswith(ps.EMAIL) or "@" not in form for form in ps.FORMS.values())
    plan = ps.pseudonymise(docs, KEY)._jdf.queryExecution().optimizedPlan().toString()
    assert "(?=[+(0-9])" in plan and "contains(text" in plan.lower()

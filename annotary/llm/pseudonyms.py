"""Personal data replaced by format-preserving Feistel pseudonyms (operator 3).

Card numbers, phone numbers, social security numbers, network addresses and
dates that pass their own validity test are permuted inside their format by a
keyed Feistel network: equal values get equal pseudonyms in all documents, and
different values different ones. Everything is a column expression.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotary.llm.shared import free_name

ROUNDS = 8
#: Days of the 400 years 1800 to 2199, a full cycle of the calendar; 146097 = 189 x 773.
CYCLE_START, CYCLE = "1800-01-01", (189, 773)

EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
#: International, in groups or unseparated; with 00; North American; national with a leading 0.
PHONE = (
    r"(?:(?<![\p{L}\p{N}+])\+(?:[1-9][0-9]{7,14}|[0-9]{1,3}(?:[ .\-]?\([0-9]{1,5}\)|[ .\-][0-9]{1,5})(?:[ .\-]?[0-9]{2,8}){1,5})(?![0-9])"
    r"|(?<![\p{L}\p{N}+.\-/])00[1-9](?:[0-9]{7,14}|[0-9]{0,2}(?:[ .\-]?\([0-9]{1,5}\)|[ .\-][0-9]{1,5})(?:[ .\-][0-9]{2,8}){1,5})(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}+.\-/])(?<!(?:\+|00)[0-9]{1,3}[ .\-]?)(?:(?:1[ .\-])?(?:\([2-9][0-9]{2}\)[ .\-]?[2-9][0-9]{2}[ .\-]|[2-9][0-9]{2}(?<p>[ .\-])[2-9][0-9]{2}\k<p>)[0-9]{4}"
    r"|\(0[0-9]{1,4}\)(?:[ .\-/]?[0-9]{2,8}){1,3}|0[1-9][0-9]{1,4}(?:[ /\-][0-9]{3,8}){1,3})(?![\p{L}\p{N}]|[.\-/][0-9]))"
)
CARD = r"(?<![\p{L}\p{N}])(?:[0-9]{13,19}|(?<![0-9][ \-])[0-9]{4}(?<c>[ \-])[0-9]{4}\k<c>[0-9]{4}\k<c>[0-9]{1,7}|(?<![0-9][ \-])[0-9]{4}(?<e>[ \-])[0-9]{6}\k<e>[0-9]{4,5})(?![\p{L}\p{N}])"
SSN = r"(?<![\p{L}\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}\-])"
ADDRESS = r"(?<![\p{L}\p{N}.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\p{L}\p{N}]|\.[0-9])"
DATE = r"(?<![\p{L}\p{N}/.\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}(?<d>[./])[0-9]{2}\k<d>[0-9]{4})(?![\p{L}\p{N}/\-]|\.[0-9])"
#: In this order; the first kind whose form stands at a place is tried there.
FORMS = {"email": EMAIL, "phone": PHONE, "card": CARD, "ssn": SSN, "address": ADDRESS, "date": DATE}
#: All but mail addresses begin with one of a few marks; at any other place no form and no look-behind need be tried.
NUMBERS = f"(?=[+(0-9])(?:{'|'.join(form for kind, form in FORMS.items() if kind != 'email')})"
ANY = f"{EMAIL}|{NUMBERS}"


def _keyed(key: str, tweak: str, round_, value) -> Column:
    """60 pseudo-random bits of (key, tweak, round, value)."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), round_.cast("string"), value.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(left, right, a, b, key: str, tweak: str) -> Column:
    """Permute the pair (left below a, right below b); a struct (l, r) in the same ranges.

    Each round adds a keyed function of one half to the other, modulo that
    half's size, so every round can be undone, whatever a and b are.
    """
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(pair, i):
        size = F.when(i % 2 == 1, a).otherwise(b).cast("long")
        new = F.pmod(pair["l"] + F.pmod(_keyed(key, tweak, i, pair["r"]), size), size)
        return F.struct(pair["r"].alias("l"), new.alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), fn), 0)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _cut(s: Column, start, size) -> Column:
    return F.substring(s, start, size)


def _number(s: Column) -> Column:
    return F.coalesce(s.try_cast("long"), F.lit(0).cast("long"))


def _pad(n: Column, size: Column) -> Column:
    return F.lpad(n.cast("string"), size, "0")


def permuted_digits(digits: Column, key: str, tweak: str) -> Column:
    """A string of 2 to 18 digits as another of the same length."""

    def halves(s):
        n = F.length(s)
        k = (n / 2).cast("int")
        a, b = F.pow(F.lit(10.0), k), F.pow(F.lit(10.0), n - k)
        pair = feistel(_number(_cut(s, F.lit(1), k)), _number(_cut(s, k + 1, n - k)), a, b, key, tweak)
        return _let(pair, lambda p: F.concat(_pad(p["l"], k), _pad(p["r"], n - k)))

    return _let(digits, halves)


def luhn_sum(digits: Column, shift: int = 0) -> Column:
    """Luhn sum; with ``shift`` 1 as if a check digit 0 followed."""

    def add(total, i):
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        doubled = (i + shift) % 2 == 0
        return total + F.when(doubled, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def refilled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by ``digits``."""

    def at(i):
        here = F.substring(form, i, F.lit(1))
        used = F.length(_digits(F.substring(form, F.lit(1), i)))
        return F.when(here.rlike("[0-9]"), F.substring(digits, used, F.lit(1))).otherwise(here)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), at), "")


def _card(m: Column, key: str) -> Column:
    def fresh(s):
        payload = permuted_digits(F.substring(s, F.lit(1), F.length(s) - 1), key, "card")
        checked = _let(payload, lambda p: F.concat(p, ((10 - luhn_sum(p, 1) % 10) % 10).cast("string")))
        return F.when(luhn_sum(s) % 10 == 0, checked)

    return _let(_digits(m), lambda s: _let(fresh(s), lambda d: F.when(d.isNotNull(), refilled(m, d))))


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^(?:(?:\+|00)(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}|[0-9]{1,2}(?![0-9]))|1(?=[ .\-]))", 0)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    fits = F.length(_digits(F.regexp_replace(m, "^00", ""))).between(8, 15) & (F.length(_digits(rest)) >= 2)
    return F.when(fits, _let(rest, lambda r: F.concat(country, refilled(r, permuted_digits(_digits(r), key, "phone")))))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999: 88902 x 9999 numbers."""
    area, group, serial = (_number(F.split_part(m, F.lit("-"), F.lit(k))) for k in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = area - F.when(area > 666, 2).otherwise(1)
    pair = feistel(rank * 99 + group - 1, serial - 1, F.lit(88902), F.lit(9999), key, "ssn")

    def text(p):
        r = F.floor(p["l"] / 99).cast("long")
        parts = (_pad(r + F.when(r >= 665, 2).otherwise(1), F.lit(3)), _pad(p["l"] % 99 + 1, F.lit(2)), _pad(p["r"] + 1, F.lit(4)))
        return F.concat_ws("-", *parts)

    return F.when(valid, _let(pair, text))


def _address(m: Column, key: str) -> Column:
    def fresh(parts):
        n = F.transform(parts, lambda s: _number(s))
        valid = F.forall(n, lambda x: x <= 255)
        pair = feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536), key, "address")
        text = _let(pair, lambda p: F.concat_ws(".", *[F.floor(h / 256).cast("string") if high else (h % 256).cast("string") for h in (p["l"], p["r"]) for high in (True, False)]))
        return F.when(valid, text)

    return _let(F.split(m, r"\."), fresh)


def _date(m: Column, key: str) -> Column:
    """Year first with dashes; else day, month, year, or month, day, year with slashes if only that is valid."""
    iso = m.rlike("^[0-9]{4}-")
    p = F.transform(F.split(m, "[-./]"), lambda s: _number(s))

    def fresh(p):
        swap = ~iso & (p[1] > 12) & m.contains("/")
        year, month, day = F.when(iso, p[0]).otherwise(p[2]), F.when(swap, p[0]).otherwise(p[1]), F.when(iso, p[2]).when(swap, p[1]).otherwise(p[0])
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        most = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
        valid = year.between(1800, 2199) & month.between(1, 12) & day.between(1, most)
        first = F.lit(CYCLE_START).cast("date")
        index = F.datediff(F.make_date(year.cast("int"), month.cast("int"), day.cast("int")), first)
        pair = feistel(F.floor(index / CYCLE[1]), index % CYCLE[1], F.lit(CYCLE[0]), F.lit(CYCLE[1]), key, "date")
        form = F.when(iso, "yyyyMMdd").when(swap, "MMddyyyy").otherwise("ddMMyyyy")

        def text(d):
            y, mo, da = F.date_format(d, "yyyy"), F.date_format(d, "MM"), F.date_format(d, "dd")
            digits = F.when(form == "yyyyMMdd", F.concat(y, mo, da)).when(form == "MMddyyyy", F.concat(mo, da, y)).otherwise(F.concat(da, mo, y))
            return refilled(m, digits)

        return F.when(valid, _let(_let(pair, lambda q: F.date_add(first, (q["l"] * CYCLE[1] + q["r"]).cast("int"))), text))

    return _let(p, fresh)


def _email(m: Column, key: str) -> Column:
    """The local part as a keyed name; the domain becomes a keyed host of example.com."""
    at = F.instr(m, "@")
    domain = F.substring(m, at + 1, F.length(m))
    return F.concat(
        F.lit("user"), _keyed(key, "local", F.lit(0), F.lower(m)).cast("string"),
        F.lit("@host"), _keyed(key, "domain", F.lit(0), F.lower(domain)).cast("string"), F.lit(".example.com"),
    )


_FRESH = {"email": _email, "phone": _phone, "card": _card, "ssn": _ssn, "address": _address, "date": _date}


def _settle(segment: Column, kind: str, key: str, otherwise: Column):
    """What stands for a match of ``kind`` at the start of a segment."""
    plain = F.struct(F.lit(None).cast("string").alias("kind"), segment.alias("out"))

    def settle(m):
        rest = F.substring(segment, F.length(m) + 1, F.length(segment))
        fresh = F.struct(F.lit(kind).alias("kind"), F.concat(_FRESH[kind](m, key), rest).alias("out"))
        kept = _let(fresh, lambda x: F.when(x["out"].isNotNull(), x).otherwise(plain))
        return F.when(F.length(m) == 0, otherwise).otherwise(kept)

    return settle


def _replaced(segment: Column, key: str) -> Column:
    """A piece of text that may begin with a finding, as (kind, out); kind is null if nothing valid stands there."""
    result = F.struct(F.lit(None).cast("string").alias("kind"), segment.alias("out"))
    for kind, form in reversed(FORMS.items()):
        result = _let(F.regexp_extract(segment, f"^(?:{form})", 0), _settle(segment, kind, key, result))
    return result


def _count(parts: str, kind: str) -> Column:
    return F.coalesce(F.size(F.filter(parts, lambda p: p["kind"] == kind)), F.lit(0)).cast("long")


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and one count a kind of finding (n_emails, ...).

    Null stays null and empty stays empty, with zero counts. Numbers that fail
    their validity test stay. Each row is handled alone, so repeated rows and
    ties need no rule. Count columns whose names ``docs`` already has get
    underscores in front. Equal values become equal pseudonyms under one key.
    """
    pieces, parts = free_name(docs, "pieces"), free_name(docs, "parts")
    text, mail = F.col("text"), F.contains("text", F.lit("@"))
    held = F.when(mail, text.rlike(ANY)).otherwise(text.rlike(NUMBERS))
    found = F.when(mail, F.split(text, f"(?={ANY})")).otherwise(F.split(text, f"(?={NUMBERS})"))
    cut = docs.withColumn(pieces, F.when(held, found))
    cut = cut.withColumn(parts, F.transform(pieces, lambda s: _replaced(s, key)))
    counts = {free_name(docs, f"n_{kind}{'es' if kind.endswith('s') else 's'}"): kind for kind in FORMS}
    out = F.array_join(F.transform(parts, lambda p: p["out"]), "")
    return cut.select(
        *[F.coalesce(out, F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        *[_count(parts, kind).alias(name) for name, kind in counts.items()],
    )

"""Secret scan with a random forest that removes false positives (operator 2).

Token-like strings with letters and digits are candidates. Length, character
transitions, dictionary coverage, path shape and the words around them are
column expressions; a random forest trained on labelled findings decides which
candidates are secrets.
"""

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotary.llm.shared import free_name, text_key, written

TREES, DEPTH, SEED = 30, 7, 11
TRAIN_IDS = 400  # documents whose ids and words fill the templates of the labelled findings
FILLER_CHARS = 400  # of a text, from which template words are taken
OWN_SEEDS = 40
CUT = 0.5
NEAR = 48  # characters of context on each side
MASK = "[SECRET]"

_TOKEN = r"A-Za-z0-9_+/=.~\-"
CANDIDATE = rf"(?<![\p{{L}}{_TOKEN}])(?=[A-Za-z_+/=.~\-]*+[0-9])(?=[0-9_+/=.~\-]*+[A-Za-z])[{_TOKEN}]{{12,}}+(?!\p{{L}})"

#: Words beside a secret, words beside a harmless string, and common parts of identifiers.
SECRET_WORDS = "token secret password passwd pwd passphrase api_key apikey access_key private_key client_secret credential auth bearer"
PLAIN_WORDS = "sha sha1 sha256 md5 checksum digest hash commit revision uuid guid etag version build image file path page id ref sample example test placeholder dummy"
DICTIONARY = (
    "the and for with this that from have not you all are was one our out day get has him his how man new now old see two way "
    "who boy did its let put say she too use file path user name test sample example data info image img photo page index home "
    "main view list item type text doc docs report final draft version release build log backup config default value key mail "
    "com net org www http https html json xml csv pdf jpg png service server client node host port local public static asset "
    "year month week date time en de fr es der die das und ist le la les des est que los las del por una para"
).split()
FEATURES = (
    "length", "digits", "uppers", "others", "transitions", "variety", "covered", "longest_word", "hexadecimal", "slashes",
    "dots", "dashes", "extension", "mail", "uuid", "assigned", "quoted", "secret_left", "plain_left", "secret_right", "plain_right",
)


def _words(words: str) -> str:
    return rf"(?i)(?<![a-z0-9])(?:{'|'.join(sorted(words.split(), key=len, reverse=True))})(?![a-z0-9])"


def candidates(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """One row per candidate: the columns ``keep``, start (1-based), candidate, left and right context.

    A text is cut before every candidate; the context on either side ends at
    the next candidate.
    """
    cut = docs.filter(F.col("text").rlike(CANDIDATE)).select(*keep, F.split("text", f"(?={CANDIDATE})").alias("pieces"))
    sizes = F.transform("pieces", lambda s: F.length(s))
    starts = F.aggregate(
        sizes,
        F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
    )["all"]
    def parts(s):
        """A piece as the candidate at its start and the text behind it."""
        head = F.regexp_extract(s, f"^(?:{CANDIDATE})", 0)
        return F.struct(head.alias("head"), F.substring(s, F.length(head) + 1, F.length(s)).alias("rest"))

    def row(i):
        here, before = F.get("parts", i), F.coalesce(F.get("parts", i - 1)["rest"], F.lit(""))
        return F.struct(
            F.get("starts", i).alias("start"),
            F.regexp_replace(here["head"], r"[.]+$", "").alias("candidate"),
            F.substring(before, F.greatest(F.length(before) - NEAR + 1, F.lit(1)), F.lit(NEAR)).alias("left"),
            F.substring(here["rest"], 1, NEAR).alias("right"),
        )

    rows = F.transform(F.sequence(F.lit(0), F.size("pieces") - 1), row)
    cut = cut.withColumn("starts", starts).withColumn("parts", F.transform("pieces", parts))
    cut = cut.withColumn("rows", F.filter(rows, lambda r: F.length(r["candidate"]) >= 12))
    return cut.select(*keep, F.inline("rows"))


def with_features(found: DataFrame) -> DataFrame:
    """``found`` with the feature columns f_<name>, all from candidate, left and right."""
    s, left, right = F.col("candidate"), F.col("left"), F.col("right")
    n = F.length(s)

    def share(chars: str) -> Column:
        return F.length(F.regexp_replace(s, f"[^{chars}]", "")) / n

    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[^A-Za-z0-9]", "-"), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    letters = F.lower(F.regexp_replace(s, "[^A-Za-z]+", " "))
    known = rf"(?:{'|'.join(sorted(DICTIONARY, key=len, reverse=True))})"
    longest = F.coalesce(F.array_max(F.transform(F.split(letters, " "), lambda w: F.length(w))), F.lit(0))
    values = {
        "length": n,
        "digits": share("0-9"),
        "uppers": share("A-Z"),
        "others": share("+/=_.~-"),
        "transitions": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n,
        "variety": F.size(F.array_distinct(F.split(s, ""))) / F.least(n, F.lit(64)),
        "covered": 1 - F.length(F.regexp_replace(F.regexp_replace(letters, known, ""), " ", "")) / F.greatest(F.length(F.regexp_replace(letters, " ", "")), F.lit(1)),
        "longest_word": longest / n,
        "hexadecimal": s.rlike("^[0-9a-f]+$").cast("int"),
        "slashes": share("/"),
        "dots": share("."),
        "dashes": share("_-"),
        "extension": s.rlike(r"\.[a-z]{2,4}$").cast("int"),
        "mail": (left.rlike("@$") | right.rlike("^@")).cast("int"),
        "uuid": s.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-").cast("int"),
        "assigned": left.rlike(r"""[=:]\s*["'`]?$""").cast("int"),
        "quoted": left.rlike("""["'`]$""").cast("int"),
        "secret_left": left.rlike(_words(SECRET_WORDS)).cast("int"),
        "plain_left": left.rlike(_words(PLAIN_WORDS)).cast("int"),
        "secret_right": right.rlike(_words(SECRET_WORDS)).cast("int"),
        "plain_right": right.rlike(_words(PLAIN_WORDS)).cast("int"),
    }
    return found.select("*", *[values[f].cast("double").alias(f"f_{f}") for f in FEATURES])


def labelled_findings(docs: DataFrame, ids: int = TRAIN_IDS) -> DataFrame:
    """Labelled findings (text, label): templates filled with digests of, and words from, about ``ids`` different texts.

    The words come from the first FILLER_CHARS characters. OWN_SEEDS more sets
    need no text, so that there are always findings to learn from.

    Secrets are random strings in assignments and headers; the others are
    checksums, identifiers, file names, mail hosts and placeholders.
    """
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    some = docs.select(key.alias("key"), F.substring("text", 1, FILLER_CHARS).alias("text"))
    # about ``ids`` of all rows, copies folded; ids play no part, so null ones change nothing
    some = some.filter(F.pmod(F.xxhash64("key"), F.lit(max(1, docs.count() // ids))) == 0)
    some = some.groupBy("key").agg(F.first("text").alias("text"))
    own = docs.sparkSession.range(OWN_SEEDS).select(F.concat(F.lit("seed "), "id").alias("key"), F.lit("").alias("text"))
    some = some.unionByName(own)
    seed = F.col("key")
    sha = lambda salt: F.sha2(F.concat(seed, F.lit(salt)).cast("binary"), 256)
    b64 = lambda salt: F.regexp_replace(F.base64(F.unhex(sha(salt))), "[+=/]", "")
    mixed = lambda salt: F.translate(F.substring(b64(salt), 1, 14), "aeiou", "!4_7-")
    picked = F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit("")) ), r"[^a-z]+", " "), " ")
    word = lambda k: F.coalesce(F.get(F.filter(picked, lambda w: F.length(w) >= 3), k), F.lit("part"))
    year = (2000 + F.pmod(F.crc32(seed.cast("binary")), F.lit(25))).cast("string")
    uuid = F.regexp_replace(F.substring(sha("u"), 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    lead, tail = F.concat(word(0), F.lit(" "), word(1), F.lit(" ")), F.concat(F.lit(" "), word(2), F.lit(" "), word(3), F.lit("."))
    secret = [
        F.concat(F.lit('token = "'), F.substring(sha("a"), 1, 40), F.lit('"')),
        F.concat(F.lit("api_key: "), F.substring(b64("b"), 1, 32)),
        F.concat(F.lit("secret="), b64("c")),
        F.concat(F.lit("password = '"), F.translate(mixed("d"), "!", "8"), F.lit("7x'")),
        F.concat(F.lit("Authorization: Bearer "), b64("e")),
        F.concat(F.lit("access_key "), F.concat(F.lit("AK7"), F.upper(F.substring(b64("f"), 1, 17)))),
        F.concat(F.lit("client_secret => "), F.substring(sha("g"), 1, 32)),
        F.concat(F.lit('auth "'), F.concat_ws(".", F.substring(b64("h"), 1, 20), F.substring(b64("i"), 1, 40)), F.lit('"')),
    ]
    plain = [
        F.concat(F.lit("commit "), F.substring(sha("j"), 1, 40)),
        F.concat(F.lit("sha256: "), sha("k")),
        F.concat(F.lit("md5 checksum = "), F.substring(sha("l"), 1, 32)),
        F.concat(F.lit("uuid "), uuid),
        F.concat(F.lit("token uuid = "), uuid),
        F.concat(F.lit("images/"), word(0), F.lit("/"), word(1), F.lit("-"), year, F.lit(".png")),
        F.concat(word(2), F.lit("@mail"), F.substring(year, 3, 2), F.lit(".example.com")),
        F.concat(word(0), word(1), word(2), F.lit("."), F.substring(year, 3, 2), F.lit("@mail3.example.com")),
        F.concat(word(0), F.lit("-"), word(1), F.lit("-report-"), year, F.lit("-v2")),
        F.concat(F.lit('password = "example-password-1"')),
        F.concat(F.lit("token = your_token_here_"), F.substring(year, 3, 2)),
        F.concat(word(0), F.lit("_"), word(1), F.lit("_test_value_"), year),
        F.concat(F.lit("www."), word(0), word(1), year, F.lit(".example.org/page/"), year),
    ]
    rows = [F.struct(F.concat(lead, t, tail).alias("text"), F.lit(label).alias("label")) for label, group in ((1, secret), (0, plain)) for t in group]
    return some.select(F.inline(F.array(*rows)))


def train(findings: DataFrame):
    """A random forest on the candidates of labelled texts (text, label); None if there are not both labels."""
    table = with_features(candidates(findings, ("label",))).select(F.col("label").cast("double").alias("label"), *[f"f_{f}" for f in FEATURES])
    table = table.distinct().repartition(1).sortWithinPartitions(*[f"f_{f}" for f in FEATURES], "label").cache()  # bounded: TRAIN_IDS x templates
    if table.select("label").distinct().count() < 2:
        return None
    assembled = VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="features").transform(table)
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8).fit(assembled)
    table.unpersist()
    return model


def scored(found: DataFrame, model) -> DataFrame:
    """Candidates with the forest's probability; without a model none counts as a secret."""
    if model is None:
        return found.withColumn("score", F.lit(0.0))
    table = with_features(found)
    table = VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="features").transform(table)
    score = F.round(vector_to_array("probability")[1], 6).alias("score")
    return model.transform(table).select(*found.columns, score)


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, cut: float = CUT) -> DataFrame:
    """One row per candidate: doc_id, start (1-based character), length, sha256, score, is_secret.

    Null and empty texts have none; repeated rows repeat theirs. ``findings``
    are labelled texts (text, label); by default they are made from the
    documents themselves.
    """
    model = train(labelled_findings(docs) if findings is None else findings)
    rows = scored(candidates(docs), model)
    return rows.select(
        "doc_id", "start", F.length("candidate").alias("length"), F.sha2(F.col("candidate").cast("binary"), 256).alias("sha256"),
        "score", (F.col("score") >= cut).alias("is_secret"),
    )


def redact(docs: DataFrame, findings: DataFrame | None = None, cut: float = CUT) -> DataFrame:
    """``docs`` with every secret in ``text`` masked, and n_chars, where present, counted anew.

    All rows stay. Secrets of one text are put together by its content key, so
    copies share them, and masked longest first.
    """
    model = train(labelled_findings(docs) if findings is None else findings)
    key, found = free_name(docs, "key"), free_name(docs, "found")
    texts = docs.select(text_key().alias(key), "text").filter(F.col("text").isNotNull())
    secret = scored(candidates(texts, (key,)), model).filter(F.col("score") >= cut).select(key, "candidate").distinct()
    lists = F.array_sort(F.collect_list(F.struct((-F.length("candidate")).alias("n"), "candidate")))
    secret = written(secret.groupBy(key).agg(lists.alias(found)), "secrets")
    joined = docs.withColumn(key, text_key()).join(secret, key, "left")
    masked = F.aggregate(found, F.col("text"), lambda text, s: F.replace(text, s["candidate"], F.lit(MASK)))
    new = F.when(F.col(found).isNotNull(), masked).otherwise(F.col("text"))
    columns = [new.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    out = joined.select(*columns, found)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(found).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(found)

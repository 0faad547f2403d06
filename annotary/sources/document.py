"""One large JSON document read by many tasks.

The file is read in blocks, cut at every closing brace. Whether such a brace
closes anything depends on what came before: is it inside a string, how deep is
the nesting? A first pass measures each piece for both starts, outside and inside a
string, and adds quotes and depths up to one row a block, from which follows
how each block begins. A second pass cuts the blocks into elements, in their own
tasks; only what crosses the border of two blocks is moved and put together. No task
sees more than a block or an element, and the text is stored once.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annotary import schemas
from annotary.checks import CorpusError
from annotary.session import evaluate_once, settings, sized

MOST_SECTIONS = 1000

_TEXT = r'"(?:[^"\\]++|\\.)*+"'
_HEAD = rf'(?s)^(?:[^{{"]++|{_TEXT})*+'
_SECTION = r'(?s).*"((?:[^"\\]|\\.)*)"\s*:\s*\[\s*$'
_PLACES = 32  # bits of a place that count inside a block


def _count(text, mark):
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))


def _depth(text):
    """Opened minus closed brackets of a text without strings."""
    return _count(text, "{") + _count(text, "[") - _count(text, "}") - _count(text, "]")


def _lines(spark: SparkSession, path, separator) -> DataFrame:
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _pieces(spark: SparkSession, path) -> DataFrame:
    """Pieces before a closing brace, in their order inside a block: file, block, value, quotes, and the change of depth for both starts."""
    rows = _lines(spark, path, "}").select(F.xxhash64("path").alias("file"), "block", "value")
    strings = r'"[^"]*("|$)'
    # each text is made once; a column of it is used several times
    rows = evaluate_once(rows, _bare=F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value")))
    rows = evaluate_once(
        rows,
        _out=F.regexp_replace("_bare", strings, ""),
        _in=F.regexp_replace(F.regexp_replace("_bare", r'^[^"]*("|$)', ""), strings, ""),
    )
    return rows.select(
        "file", "block", "value", _count("_bare", '"').alias("quotes"), _depth("_out").alias("out"), _depth("_in").alias("in")
    )


def _stretches(batch):
    """``batch`` in slices of one block each, with the block's key."""
    file, block = (batch.column(c).to_numpy() for c in ("file", "block"))
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    for start, end in zip([0, *cuts], [*cuts, len(file)]):
        if end > start:
            yield (int(file[start]), int(block[start])), batch.slice(start, end - start)


def _changes(rows, odd, closes):
    """Parity of quotes before each piece that starts after ``odd`` quotes, and its change of depth with the brace behind it."""
    quotes, out, inside = (rows.column(c).to_numpy().astype(np.int64) for c in ("quotes", "out", "in"))
    before = (odd + np.cumsum(quotes) - quotes) % 2
    shut = closes & ((before + quotes) % 2 == 0)
    return np.where(before == 0, out, inside) - shut, shut, (odd + int(quotes.sum())) % 2


def _measured(batches):
    """One row a stretch of a block: pieces, bytes, parity of quotes, depth for both starts, and the share of the last brace in it."""
    for batch in batches:
        found = []
        for key, rows in _stretches(batch):
            closes = np.ones(len(rows), bool)
            (plain, shut, odd), (other, shut_in, _) = (_changes(rows, start, closes) for start in (0, 1))
            size = pc.sum(rows.column("size")).as_py()
            found.append((*key, len(rows), size, odd, int(plain.sum()), int(other.sum()), bool(shut[-1]), bool(shut_in[-1])))
        columns = [pa.array(c) for c in zip(*found)] if found else []
        if columns:
            yield pa.RecordBatch.from_arrays(columns, names=_MEASURES)


_MEASURES = ["file", "block", "n", "size", "odd", "out", "in", "shut_out", "shut_in"]


def _block_starts(spark: SparkSession, path):
    """{(file, block): (number, parity of quotes before, depth before, index of a piece without a brace or -1)}."""
    pieces = _pieces(spark, path).withColumn("size", F.octet_length("value") + 1).drop("value")
    schema = "file long, block long, n long, size long, odd long, out long, `in` long, shut_out boolean, shut_in boolean"
    parts = pieces.mapInArrow(_measured, schema).withColumn("at", F.monotonically_increasing_id())
    # what follows the last brace of a file is no element's end; read by lines a file is one byte longer if a brace ends it
    lines = _lines(spark, path, "\n").groupBy("path").agg(F.sum(F.octet_length("value") + 1).alias("size"))
    files = {row["file"]: row for row in lines.select("path", "size", F.xxhash64("path").alias("file")).collect()}
    blocks = {}
    for row in sized(parts).orderBy("file", "block", "at").toLocalIterator():
        key = (row["file"], row["block"])
        n, size, odd, out, inside, *_ = blocks.get(key, (0, 0, 0, 0, 0))
        ways = (row["out"], row["in"], row["shut_out"], row["shut_in"])
        if odd:
            ways = (ways[1], ways[0], ways[3], ways[2])
        blocks[key] = (n + row["n"], size + row["size"], (odd + row["odd"]) % 2, out + ways[0], inside + ways[1], ways[2], ways[3])
    total, last = {}, {}
    for (file, block), measures in blocks.items():
        total[file] = total.get(file, 0) + measures[1]
        last[file] = max(last.get(file, 0), block)
    starts, odd, depth = {}, 0, 0
    for number, key in enumerate(sorted(blocks, key=lambda k: (files[k[0]]["path"], k[1]))):
        n, _, quotes, out, inside, shut_out, shut_in = blocks[key]
        open_end = last[key[0]] == key[1] and total[key[0]] >= files[key[0]]["size"]
        starts[key] = (number, odd, depth, n - 1 if open_end else -1)
        depth += inside + (open_end and shut_in) if odd else out + (open_end and shut_out)
        odd = (odd + quotes) % 2
    return starts


_STRETCH = "place long, kind int, start int, after int, text string"


def _cut(starts, wanted):
    """Cut the pieces of each block into stretches up to an object that closes at ``wanted`` or further out.

    ``kind`` 0 is a whole stretch, kept if it closes at ``wanted``; 1 the first one of a block, which may
    begin in blocks before, and 2 what is left behind the last one.
    """

    def rest(key, state):
        number, _, _, _ = starts[key]
        return [] if state["start"] is None else [((number << _PLACES) + state["place"], 2, state["start"], 0, "".join(state["texts"]))]

    def cut(batches):
        now, state = None, None
        for batch in batches:
            found = []
            for key, rows in _stretches(batch):
                if key != now:
                    found += rest(now, state) if now else []
                    now, state = key, {"odd": starts[key][1], "depth": starts[key][2], "n": 0, "place": 0, "start": None, "texts": []}
                at = state["n"] + np.arange(len(rows))
                closes = at != starts[key][3]
                change, shut, state["odd"] = _changes(rows, state["odd"], closes)
                after = state["depth"] + np.cumsum(change)
                before = after - change
                ends = np.flatnonzero(shut & (after <= wanted))
                texts = pc.binary_join_element_wise(rows.column("value"), pa.array(np.where(closes, "}", "")), "")
                offsets = np.concatenate([[0], ends + 1, [len(rows)]])
                whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), texts), "").to_pylist()
                for k, end in enumerate(ends.tolist()):
                    start = int(before[offsets[k]]) if state["start"] is None else state["start"]
                    kind = 0 if state["place"] else 1
                    if kind or after[end] == wanted:
                        found.append(((starts[key][0] << _PLACES) + state["place"], kind, start, int(after[end]), "".join([*state["texts"], whole[k]])))
                    state.update(start=None, texts=[], place=state["place"] + 1)
                if offsets[-2] < len(rows):
                    if state["start"] is None:
                        state["start"] = int(before[offsets[-2]])
                    state["texts"].append(whole[-1])
                state["n"], state["depth"] = int(at[-1]) + 1, int(after[-1])
            yield _table(found)
        if now:
            yield _table(rest(now, state))

    return cut


def _table(found):
    places, kinds, starts, ends, texts = zip(*found) if found else ([],) * 5
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((places, kinds, starts, ends, texts), types)], names=["place", "kind", "start", "after", "text"])


def document_elements(spark: SparkSession, path, depth: int, shape=None) -> DataFrame:
    """``(place, start, text)`` of the stretches of a document that end where an object closes at ``depth``.

    ``path`` is a file, or part files that make one document in the order of
    their names; compressed files are read by one task each. ``place`` orders the stretches,
    ``start`` is the depth at which one begins; stretches that close further out are left out.
    ``shape`` adds columns to such rows, which are then returned in place of ``start`` and ``text``.
    """
    kept = ["start", "text"]
    # both passes must see the same blocks, also if executors come and go in between
    with settings(spark, spark_sql_files_minPartitionNum=str(spark.sparkContext.defaultParallelism)):
        starts = _block_starts(spark, path)
        cut = _pieces(spark, path).mapInArrow(_cut(starts, depth), _STRETCH)
        if shape:
            shaped = shape(cut)
            kept = [c for c in shaped.columns if c not in cut.columns]
            cut = shaped.withColumn("text", F.when(F.col("kind") > 0, F.col("text")))
        cut = sized(cut)
    order = Window.orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, -1)  # two rows a block
    pieces = cut.filter("kind > 0").select("place", "kind", "start", "after", "text")
    groups = pieces.select("place", "kind", F.coalesce(F.sum(F.when(F.col("kind") == 1, 1)).over(order), F.lit(0)).alias("element"))
    piece = F.struct("place", "kind", "start", "after", "text")
    across = pieces.join(sized(groups), ["place", "kind"]).groupBy("element").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    end = F.element_at("p", -1)
    across = across.filter((end["kind"] == 1) & (end["after"] == depth)).select(
        end["place"].alias("place"), F.get("p", 0)["start"].alias("start"), F.array_join("p.text", "").alias("text")
    )
    across = sized(shape(across) if shape else across)
    return cut.filter("kind = 0").select("place", *kept).unionByName(across.select("place", *kept))


def _members(cut: DataFrame) -> DataFrame:
    """Add the object in a stretch at depth 2, if there is one, and the name of the section it begins."""
    begin = F.greatest("start", F.lit(1))
    text = F.when(F.col("start") == 0, F.regexp_replace("text", r"^\s*\{", "")).otherwise(F.col("text"))
    parts = evaluate_once(cut, _body=text)
    parts = evaluate_once(parts, _head=F.regexp_extract("_body", _HEAD, 0))
    parts = evaluate_once(parts, _bare=F.regexp_replace("_head", _TEXT, ""), element=F.expr("substring(_body, length(_head) + 1)"))
    found = (begin + _depth(F.col("_bare")) == 2) & F.startswith("element", F.lit("{"))
    named = F.when(F.contains("_head", F.lit("[")), F.regexp_extract("_head", _SECTION, 1)).otherwise("")
    return parts.withColumn("element", F.when(found, F.col("element"))).withColumn("named", named).drop("_body", "_head", "_bare")


def document_sections(spark: SparkSession, path) -> DataFrame:
    """``(section, place, element)``: the objects in the arrays of a root object, each as JSON text."""
    parts = document_elements(spark, path, 2, _members).filter("element is not null")
    heads = parts.filter("named <> ''").select("place", "named").orderBy("place").limit(MOST_SECTIONS + 1).collect()
    if len(heads) > MOST_SECTIONS:
        raise CorpusError(f"more than {MOST_SECTIONS} sections in {path}")
    section = F.lit(None).cast("string")
    for row in heads:
        section = F.when(F.col("place") >= row["place"], F.lit(row["named"])).otherwise(section)
    return parts.select(section.alias("section"), "place", "element")


def document_entries(spark: SparkSession, path) -> DataFrame:
    """``(place, entry)``: the members of a root map whose values are objects, each as a map of one entry in JSON."""
    entry = F.concat(F.lit("{"), F.regexp_replace("text", r"^\s*[,{]", ""), F.lit("}"))
    return document_elements(spark, path, 1, lambda cut: cut.withColumn("entry", entry)).select("place", "entry")


# The members of an exported document, see ``sinks.write_coco_document``.
_IMAGES = (
    "id long, file_name string, width int, height int, source string, origin_image_id string, group_id string, "
    "origin_file_path string, split string"
)
_ANNOTATIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("image_id", T.LongType()),
        T.StructField("category_id", T.IntegerType()),
        T.StructField("segmentation", schemas.RINGS),
        T.StructField("bbox", schemas.RING),
        T.StructField("area", T.DoubleType()),
        T.StructField("iscrowd", T.IntegerType()),
    ]
)
_CATEGORIES = "id int, name string, supercategory string"


def read_coco_document(spark: SparkSession, path):
    """``(images, annotations, categories)`` of an exported document, as ``sinks.write_coco_document`` got them."""
    elements = document_sections(spark, path)
    return tuple(
        elements.filter(F.col("section") == name).select(F.from_json("element", schema).alias("row")).select("row.*")
        for name, schema in (("images", _IMAGES), ("annotations", _ANNOTATIONS), ("categories", _CATEGORIES))
    )

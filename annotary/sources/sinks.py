"""Writers: Parquet triple, one COCO document, statistics, CSV, Markdown."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotary.session import shuffles_freed

INFO = "images of damaged cars with polygon annotations from several sources"
FILE_LINES = 1_000_000


def write_triple(images: DataFrame, annotations: DataFrame, categories: DataFrame, path) -> None:
    for name, table in (("images", images), ("annotations", annotations), ("categories", categories)):
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def coco_document_lines(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """One valid COCO JSON document as ordered lines ``(section, id, value)``.

    Ids are dense, so a line knows from its own id whether a comma follows.
    Sorted by (section, id) the lines concatenate to the document, which is
    written in parallel and never built in one place.
    """
    spark = images.sparkSession
    head = f'{{"info": {{"description": "{INFO}"}}, "licenses": [], "images": ['
    frame = spark.createDataFrame(
        [(0, 0, head), (2, 0, '], "annotations": ['), (4, 0, '], "categories": ['), (6, 0, "]}")],
        "section int, id long, value string",
    )
    for section, table in ((1, images), (3, annotations), (5, categories)):
        last = table.agg(F.max("id")).first()[0] or 0
        body = F.to_json(F.struct(*[F.col(c) for c in table.columns]))
        comma = F.when(F.col("id") < last, ",").otherwise("")
        frame = frame.unionByName(
            table.select(
                F.lit(section).alias("section"),
                F.col("id").cast("long").alias("id"),
                F.concat(body, comma).alias("value"),
            )
        )
    return frame


def write_coco_document(images, annotations, categories, path, compression="none") -> None:
    """Part files whose concatenation in name order is one JSON document."""
    lines = coco_document_lines(images, annotations, categories)
    write_ordered_text(lines, ["section", "id"], path, compression)


def write_ordered_text(lines: DataFrame, order_by, path, compression="none") -> None:
    """Column ``value`` as part files that are in order by name.

    A compressed file is read by one task, so such files have at most
    ``FILE_LINES`` lines.
    """
    ordered = lines.repartitionByRange(*order_by).sortWithinPartitions(*order_by).select("value")
    out = ordered.write.mode("overwrite").option("compression", compression)
    if compression != "none":
        out = out.option("maxRecordsPerFile", FILE_LINES)
    with shuffles_freed(lines.sparkSession):
        out.text(path)


def write_stats(stats: DataFrame, path) -> None:
    stats.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path, columns=None) -> None:
    """CSV with header; ``columns`` fixes their order."""
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).csv(path)


def markdown_lines(df: DataFrame, columns=None) -> DataFrame:
    """Rows of an aggregated table as Markdown table rows, column ``value``."""
    columns = columns or df.columns
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.select(
        F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")
    )


def markdown_head(columns) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]


def write_markdown(df: DataFrame, path, order_by=()) -> None:
    """A table of any size as Markdown part files; in name order they are one table."""
    body = markdown_lines(df.orderBy(*order_by) if order_by else df).withColumn("_section", F.lit(1))
    head = df.sparkSession.createDataFrame([("\n".join(markdown_head(df.columns)), 0)], "value string, _section int")
    head.unionByName(body).select("value").write.mode("overwrite").text(path)


def markdown_table(df: DataFrame, columns=None) -> str:
    """Markdown text of a report table (one row per source, class or split)."""
    columns = columns or df.columns
    rows = markdown_lines(df, columns).collect()
    return "\n".join([*markdown_head(columns), *[r["value"] for r in rows]])

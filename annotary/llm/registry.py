"""Names of the text queries; the same form as the library's own catalog."""

from annotary.llm.shared import small_batches
from annotary.plans.catalog import Query

CATALOG: dict[str, Query] = {}


def query(sql=None):
    def add(fn):
        CATALOG[fn.__name__] = Query(fn, sql)
        return fn

    return add


def table(spark, sf_dir, name):
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

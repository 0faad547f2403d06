"""All registered queries with their SQL counterparts.

Every query reads whole driver tables. ``sql`` is None where plain SQL would
have to repeat an iterative algorithm on all rows; those are checked against
brute force in the tests.
"""

from dataclasses import dataclass
from typing import Callable


@dataclass(frozen=True)
class Query:
    run: Callable
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(sql=None):
    """Register a ``(spark, sf_dir) -> DataFrame`` function under its name."""

    def add(fn):
        CATALOG[fn.__name__] = Query(fn, sql)
        return fn

    return add


def load() -> dict[str, Query]:
    from annotary.plans import (  # noqa: F401
        catalog_corpus,
        catalog_masks,
        catalog_rules,
        catalog_runs,
        catalog_scored,
        catalog_split,
        catalog_streams,
    )

    return CATALOG

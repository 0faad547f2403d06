"""Blocking checks: a violations frame must be empty, else the job stops."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from annotary.session import settings

PREVIEW = 20


class CorpusError(ValueError):
    """Input rows break an invariant of the corpus; ``violations`` holds them all."""


class UnknownSourceError(CorpusError):
    """A source without any taxonomy entry."""


class UnknownClassError(CorpusError):
    """A class the taxonomy of its source does not know."""


class TaxonomyConfigError(CorpusError):
    """The taxonomy tables themselves are inconsistent."""


class LeakError(AssertionError):
    """A group appears in more than one split."""


def require_empty(violations: DataFrame, what: str, error=CorpusError) -> None:
    """Raise ``error`` if there are offending rows.

    The message gives their full number and shows the first of them; the
    error's ``violations`` is the frame of all of them.
    """
    # there are none as a rule, so all partitions are looked at in one job, not a few more at a time
    with settings(violations.sparkSession, spark_sql_limit_initialNumPartitions=str(1 << 30)):
        rows = violations.limit(PREVIEW).collect()
    if rows:
        total = violations.count() if len(rows) == PREVIEW else len(rows)
        detail = "; ".join(str(row.asDict()) for row in rows)
        found = error(f"{what}: {total} in all: {detail}")
        found.violations = violations
        raise found


class Watch:
    """Counts rows that break a rule, in the job that reads the rows anyway.

    ``rules`` has (what, condition, shown column, error) in order of urgency.
    ``on`` gives the frame to go on with; after its first action ``require``
    raises the first broken rule's error. A task that is run again may count
    its rows again, so counts say whether a rule is broken, and about how often.
    """

    def __init__(self, *rules: tuple[str, Column, Column, type[CorpusError]]):
        self.rules = rules
        self.seen = Observation()

    def on(self, df: DataFrame) -> DataFrame:
        metrics = []
        for k, (_, condition, shown, _) in enumerate(self.rules):
            bad = F.coalesce(condition, F.lit(False))
            metrics.append(F.count_if(bad).alias(f"n{k}"))
            metrics.append(F.min(F.when(bad, shown)).alias(f"first{k}"))
        return df.observe(self.seen, *metrics)

    def counts(self) -> dict[str, int]:
        """Rows per rule; waits for the first action on the watched frame."""
        found = self.seen.get
        return {rule[0]: found[f"n{k}"] for k, rule in enumerate(self.rules)}

    def require(self, violations: DataFrame | None = None) -> None:
        found = self.seen.get
        for k, (what, _, _, kind) in enumerate(self.rules):
            if found[f"n{k}"]:
                error = kind(f"{what}: {found[f'n{k}']} rows, the first {found[f'first{k}']}")
                error.violations = violations
                raise error


def stop_if(condition: Column, message: Column, value: Column) -> Column:
    """``value``, unless ``condition`` holds: then the running job stops with ``message``."""
    return F.when(condition, F.raise_error(message)).otherwise(value)

"""Result tables of an experiment campaign, from its run directories."""

from pyspark.sql import SparkSession

from annotary.operators import runs as r
from annotary.session import pinned
from annotary.sources import sinks
from annotary.sources.run_files import finished_runs, run_configs, run_events, run_summaries


def result_tables(spark: SparkSession, root, out=None):
    """Volume, density and ablation tables, run details, campaign summary."""
    done = pinned(finished_runs(spark, root))
    tables = {
        "volume": r.volume_table(done),
        "density": r.density_table(done),
        "ablations": r.ablation_table(done),
        "runs": r.run_details(done),
        "campaigns": r.campaign_summary(done),
    }
    if out:
        for name, table in tables.items():
            sinks.write_csv(table, f"{out}/{name}")
    return tables


def campaign_status(spark: SparkSession, root, elapsed, expected=None):
    """One-row outlook. ``elapsed``: campaign, run, elapsed_seconds so far."""
    keys = ["campaign", "run"]
    summaries = run_summaries(spark, root)
    running = run_configs(spark, root).join(summaries.select(*keys), keys, "left_anti")
    targets = running.select(*keys, "iterations").join(elapsed, keys)
    last = r.last_events(run_events(spark, f"{root}/*/*/history.jsonl"), keys)
    return r.campaign_eta(summaries, r.run_progress(last, targets, keys), expected)

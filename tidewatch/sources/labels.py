"""The append-only label log."""
from pyspark.sql import functions as F

from tidewatch.operators.labels import LABEL_AFTER_HOURS, outcome_counts, recheck
from tidewatch.plans.ranking import keep_first
from tidewatch.schemas import LABEL
from tidewatch.session import settle
from tidewatch.sources.commits import TAG, commit, new_append, read_committed
from tidewatch.sources.snapshots import to_schema


def scan_labels(spark, path):
    """The first label of every post; empty, with its columns, while there are none.

    Appends that were not completed are not seen. Two runs at the same time may both label a post.
    """
    return keep_first(read_committed(spark, path, LABEL), ["id"], [F.col("checked_utc")])


def append_labels(df, path):
    """Adds labels, which are seen once all of them are written."""
    append = new_append()
    to_schema(df, LABEL).withColumn(TAG, F.lit(append)).write.mode("append").parquet(str(path))
    commit(df.sparkSession, path, append)


def record_labels(raw, status, path, now, after_hours=LABEL_AFTER_HOURS):
    """Labels every due post once; returns how many posts got which outcome."""
    fresh = settle(recheck(raw, status, scan_labels(raw.sparkSession, path), now, after_hours))
    if not fresh.isEmpty():
        append_labels(fresh, path)
    return outcome_counts(fresh)


def label_summary(outcomes):
    """Due and labelled posts of one run as a single row."""
    total = F.coalesce(F.sum("n"), F.lit(0))
    return outcomes.agg(total.alias("due"), total.alias("labelled"))

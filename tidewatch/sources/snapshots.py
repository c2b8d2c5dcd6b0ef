"""The raw snapshot store: append-only Parquet, one directory per community, a commit log and a ledger
of the stored ids beside them."""
from functools import reduce

from pyspark.sql import functions as F

from tidewatch.operators.listing import counts_per_community, unseen_posts
from tidewatch.plans.ranking import keep_first
from tidewatch.plans.skew import join_keys
from tidewatch.schemas import RAW_POST
from tidewatch.session import settle
from tidewatch.sources.commits import TAG, IdLedger, commit, new_append, read_committed


ROWS_PER_FILE = 1_000_000


def to_schema(df, schema):
    """The columns of `schema` in order; missing ones become typed nulls."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema])


def scan_snapshots(spark, path):
    """All posts of completed appends; an error when there are none.

    The schema is given, so a community named 123 stays a string and no footer has to be merged.
    """
    posts = read_committed(spark, path, RAW_POST)
    if posts.isEmpty():
        raise FileNotFoundError(f"no collected data under {path}")
    return posts


def scan_parts(spark, paths):
    """Named parts written by other tools, each read with its own schema and then cast.

    A writer that infers types per batch stores an all-null column without its type; such a file
    cannot be read with the string type it should have had.
    """
    parts = [to_schema(spark.read.parquet(str(p)), RAW_POST) for p in paths]
    if not parts:
        raise FileNotFoundError("no parts named")
    return reduce(lambda a, b: a.unionByName(b), parts)


def scan_once(spark, path):
    """Stored posts with ids taken once that a store kept by other means may hold twice."""
    return keep_first(scan_snapshots(spark, path), ["id"],
                      [F.col("snapshot_utc"), F.col("created_utc")])


def _write_posts(df, path, append, rows_per_file):
    rows = to_schema(df, RAW_POST)
    sizes = rows.groupBy("subreddit").agg(
        F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_slices"))
    sliced = join_keys(rows, sizes, ["subreddit"]).withColumn(
        "_slice", F.pmod(F.xxhash64("id"), F.col("_slices")))
    (sliced.repartition("subreddit", "_slice").drop("_slices", "_slice").withColumn(TAG, F.lit(append))
     .write.mode("append").partitionBy("subreddit")
     .option("maxRecordsPerFile", rows_per_file).parquet(str(path)))


def append_snapshots(df, path, rows_per_file=ROWS_PER_FILE):
    """Adds parts under each community's directory; earlier parts are never touched.

    A community's rows are brought together in one task per `rows_per_file` rows it has, so that a
    run leaves few files and a hot community is written by many tasks. Rows are seen once all of them
    are written. The ids go to the store's ledger, if it has one.
    """
    spark, append = df.sparkSession, new_append()
    rows = settle(df)
    _write_posts(rows, path, append, rows_per_file)
    ledger = IdLedger(spark, path)
    if ledger.buckets:
        ledger.append(rows, append)
    commit(spark, path, append)


def incremental_ingest(incoming, path, communities=None, rows_per_file=ROWS_PER_FILE, batch=None):
    """Stores the posts whose id is not stored yet; returns new rows per community.

    The ledger of stored ids is the memory of earlier runs, so a run can be repeated at any time; posts
    and ids become visible together. A store without a ledger gets one from its id column.
    """
    spark = incoming.sparkSession
    if communities is not None:
        incoming = incoming.where(F.col("subreddit").isin(*communities))
    incoming = settle(incoming)
    ledger = IdLedger(spark, path)
    if not ledger.buckets:
        ledger.lay_out(read_committed(spark, path, RAW_POST), incoming.count())
    fresh = settle(unseen_posts(incoming, ledger.known(incoming)))
    n_rows = fresh.count()
    if n_rows:
        append = new_append()
        _write_posts(fresh, path, append, rows_per_file)
        ledger.append(fresh, append)
        commit(spark, path, append, batch, n_rows)
    if communities is None:
        return fresh.groupBy("subreddit").agg(F.count(F.lit(1)).alias("n"))
    return counts_per_community(fresh, communities)

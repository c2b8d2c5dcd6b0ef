"""The two incremental jobs, as file streams that drain what has landed and stop.

Each micro-batch compares with the table it writes to, so a batch that is run again after it was
written adds nothing. What a batch wrote is seen once its commit is in the table's log, so one that
dies half way leaves nothing to be seen and its retry stores everything once.
"""
from tidewatch.operators.labels import LABEL_AFTER_HOURS
from tidewatch.operators.listing import flatten_snapshot, normalise_submissions
from tidewatch.schemas import RAW_POST, SUBMISSION
from tidewatch.sources.labels import record_labels
from tidewatch.sources.snapshots import ROWS_PER_FILE, incremental_ingest, scan_snapshots


def _drain(stream, checkpoint, each_batch):
    return (stream.writeStream.foreachBatch(each_batch)
            .option("checkpointLocation", str(checkpoint))
            .trigger(availableNow=True).start())


def ingest_stream(spark, landing, store, checkpoint, communities=None, files_per_batch=1000,
                  rows_per_file=ROWS_PER_FILE):
    """Stores every post that lands in `landing` (Parquet, RAW_POST) once ever."""
    stream = spark.readStream.schema(RAW_POST).option(
        "maxFilesPerTrigger", files_per_batch).parquet(str(landing))

    def each_batch(batch, number):
        incremental_ingest(batch, store, communities, rows_per_file, number)
    return _drain(stream, checkpoint, each_batch)


def submission_stream(spark, landing, store, checkpoint, clock, communities=None,
                      comments_per_post=0, files_per_batch=1000, rows_per_file=ROWS_PER_FILE):
    """As `ingest_stream`, from source records in JSON lines stamped with `clock()`."""
    stream = spark.readStream.schema(SUBMISSION).option(
        "maxFilesPerTrigger", files_per_batch).json(str(landing))

    def each_batch(batch, number):
        posts = flatten_snapshot(normalise_submissions(batch, clock(), comments_per_post))
        incremental_ingest(posts, store, communities, rows_per_file, number)
    return _drain(stream, checkpoint, each_batch)


def label_stream(spark, status_landing, store, labels, checkpoint, clock,
                 after_hours=LABEL_AFTER_HOURS):
    """Labels due posts against each landed status snapshot (id, removed_by_category).

    One file is one lookup run: posts due at `clock()` that it does not mention are `missing`.
    """
    stream = spark.readStream.schema("id string, removed_by_category string").option(
        "maxFilesPerTrigger", 1).parquet(str(status_landing))

    def each_batch(batch, _):
        # `recheck` takes four columns and the first row of an id: bodies are never read.
        record_labels(scan_snapshots(spark, store), batch, labels, clock(), after_hours)
    return _drain(stream, checkpoint, each_batch)

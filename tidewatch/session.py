"""Session settings the jobs are written for; any session works, these are the defaults."""
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master="local[*]", app_name="tidewatch", **settings):
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark):
    """The shared folder lineage is cut to; the cluster's own setting always wins."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="tidewatch-checkpoint-")
    context.setCheckpointDir(named)
    return named


def new_folder(spark, name):
    """A folder of its own below the shared folder, not yet created."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df):
    """Write `df` to the checkpoint folder once, so that later readers do not recompute it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

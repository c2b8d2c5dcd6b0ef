"""Appends that are seen whole or not at all, and the ledger of ids that have been stored.

Every append tags its rows with a name of its own and is recorded in a commit log beside the data once
all of it is written. Readers take the rows of recorded appends, so what a killed run left behind is
never seen, wherever it died; nothing has to be removed on reading. Rows without a tag (written by other
tools, or before there was a log) are seen. A file holds one append, so the statistics of its tag let a
reader skip the files of a torn one.

The log has one small row per append, however large the append was; its names are the only thing read
to the driver.
"""
import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F, types as T

from tidewatch.session import settle

TAG = "_append"
COMMIT = T.StructType([T.StructField("append", T.StringType()), T.StructField("batch", T.LongType()),
                       T.StructField("n_rows", T.LongType())])

IDS_PER_BUCKET = 2_000_000      # of the first append: some 20 MB a bucket
LEAST_BUCKETS = 16
# Up to so many ids of a batch are given to the scan as literals, which leaves out whole buckets.
LITERAL_IDS = 1_000


def read_or_empty(spark, path, schema, form="parquet"):
    """The table at `path`, or no rows while nothing has been written there."""
    try:
        return spark.read.schema(schema).format(form).load(str(path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def new_append():
    return uuid.uuid4().hex


def commits(spark, path):
    """The log: append, batch (of a stream, else null) and n_rows."""
    return read_or_empty(spark, f"{path}/_commits", COMMIT, "json")


def commit(spark, path, append, batch=None, n_rows=None):
    """Make an append visible. The log's row is one file, which appears when it is complete."""
    spark.createDataFrame([(append, batch, n_rows)], COMMIT).coalesce(1).write.mode("append").json(f"{path}/_commits")


def only_committed(rows, spark, path):
    """Rows of recorded appends and rows without a tag."""
    done = sorted(r["append"] for r in commits(spark, path).select("append").distinct().collect())
    return rows.where(F.col(TAG).isNull() | F.col(TAG).isin(done))


def read_committed(spark, path, schema):
    tagged = T.StructType([*schema.fields, T.StructField(TAG, T.StringType())])
    return only_committed(read_or_empty(spark, path, tagged), spark, path).select(*schema.names)


class IdLedger:
    """The ids stored at `path`, as a table bucketed and sorted by id below it.

    An anti-join with the ledger moves the batch to the ledger's buckets and never the ledger; a batch
    of few ids reads only the buckets those are in. The number of buckets follows from the ids known
    when the ledger is made (`stored`, those of a store that had none); it is kept beside the data and adopted in any
    session. Ledger rows carry the tag of their append and count once the store's log has it, so the
    store and its ledger become visible by the same commit. Null ids are not kept.
    """

    def __init__(self, spark, path, buckets=None):
        self.spark, self.path, self.folder = spark, str(path), f"{path}/_ids"
        self.name = "id_ledger_" + hashlib.sha256(self.folder.encode()).hexdigest()[:40]
        self.planned = self._noted("_layout") or buckets
        self.buckets = self._noted("_complete")
        if self.buckets:
            self._attach()

    def _noted(self, name):
        row = read_or_empty(self.spark, f"{self.folder}/{name}", "buckets int", "json").first()
        return row and row["buckets"]

    def _note(self, name):
        self.spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(
            f"{self.folder}/{name}")

    def _attach(self):
        place = self.folder.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (id STRING, {TAG} STRING) USING parquet "
            f"CLUSTERED BY (id) SORTED BY (id) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        self.spark.catalog.refreshTable(self.name)

    def lay_out(self, stored, expected=0):
        """Make the ledger of a store that has none: `stored` are the ids that are visible in it. The
        layout is noted first; a run that dies before the ledger is complete adds the ids again to the
        same layout, which an anti-join does not mind."""
        if self.buckets:
            return
        ids = settle(stored.select("id").where("id IS NOT NULL").distinct())
        known = ids.count()
        self.buckets = self.planned or max(LEAST_BUCKETS, -(-(known + expected) // IDS_PER_BUCKET))
        self._note("_layout")
        self._attach()
        if known:
            self._write(ids.withColumn(TAG, F.lit(None).cast("string")))
        self._note("_complete")

    def _write(self, rows):
        # Each task writes whole buckets, so a bucket gets one file an append.
        (rows.repartition(self.buckets, "id").write.format("parquet").mode("append")
         .bucketBy(self.buckets, "id").sortBy("id").saveAsTable(self.name))
        self.spark.catalog.refreshTable(self.name)

    def append(self, ids, append):
        self._write(ids.select("id", F.lit(append).alias(TAG)).where("id IS NOT NULL"))

    def known(self, batch):
        """Stored ids to compare `batch` with: all of them, or those of a small batch."""
        ids = only_committed(self.spark.table(self.name), self.spark, self.path).select("id")
        few = batch.select("id").where("id IS NOT NULL").distinct().limit(LITERAL_IDS + 1).collect()
        return ids if len(few) > LITERAL_IDS else ids.where(F.col("id").isin([r["id"] for r in few]))

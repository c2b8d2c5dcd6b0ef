"""Exact deduplication against a persistent digest index, bucketed and sorted by digest.

Equal texts are those with the same SHA-256 of their UTF-8 bytes, unchanged; null counts as empty.
The index has one row per digest ever seen: the digest and the doc_id that stands for it. A batch is
reduced to one row per digest first (counted map-side, so a text that makes up a third of all rows
reaches a reducer as one row per task), anti-joined to the index, and what is new is appended in the
same buckets, so neither side of that join moves the index. The number of buckets follows from the
digests counted in the first batch; it is stored beside the data and adopted by whoever opens the
index later. Rows meet what is decided about their digest by a counted join: the few digests with many
rows are broadcast, the others shuffled.

Defined cases: of equal texts of one batch the largest doc_id stays; a digest that the index already
has keeps its first keeper, and no other row stays (so a batch run again gives the same rows). A null doc_id never stands for a group
unless the whole group has none (then keep_id is null and its rows stay). Repeated rows with the
keeper's id all stay. Other columns, whatever their names, are not looked at.
"""
import hashlib

from pyspark.sql import functions as F

from tidewatch.llm.shared import join_counted, new_folder, text_of, written

DIGESTS_PER_BUCKET = 250_000     # of the first batch: some 20 MB a bucket
LEAST_BUCKETS = 16


def digest_of(column="text"):
    return F.sha2(text_of(column), 256)


def _absent(error):
    return "PATH_NOT_FOUND" in str(error)


class DigestIndex:
    """A bucketed table at `folder`. Opening an existing folder adopts the layout stored with it, in
    any session; a new one is laid out with `buckets`, or by the digests first appended."""

    def __init__(self, spark, folder, buckets=None):
        self.spark, self.folder, self.wanted = spark, folder.rstrip("/"), buckets
        self.name = "digest_index_" + hashlib.sha256(self.folder.encode()).hexdigest()[:40]
        self.buckets = self._stored()
        if self.buckets is not None:
            self._attach()

    def _stored(self):
        try:
            return self.spark.read.schema("buckets int").json(f"{self.folder}/_layout").first()["buckets"]
        except Exception as error:
            if not _absent(error):
                raise
        try:
            lost = not self.spark.read.schema("text_sha256 string").parquet(self.folder).isEmpty()
        except Exception as error:
            if not _absent(error):
                raise
            lost = False
        if lost:
            raise ValueError(f"{self.folder} has digests but no layout")
        return None

    def _attach(self):
        place = self.folder.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (text_sha256 STRING, keep_id BIGINT) "
            f"USING parquet CLUSTERED BY (text_sha256) SORTED BY (text_sha256) "
            f"INTO {self.buckets} BUCKETS LOCATION '{place}'")

    def lay_out(self, n_digests):
        """Give an index without layout one that suits so many digests."""
        if self.buckets is None:
            self.buckets = self.wanted or max(LEAST_BUCKETS, -(-n_digests // DIGESTS_PER_BUCKET))
            self.spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.json(f"{self.folder}/_layout")
            self._attach()

    def table(self):
        return self.spark.table(self.name)

    def append(self, rows):
        """Rows with new digests; each task writes whole buckets, so a bucket has one file a batch."""
        (rows.select("text_sha256", "keep_id").repartition(self.buckets, "text_sha256")
         .write.format("parquet").mode("append")
         .bucketBy(self.buckets, "text_sha256").sortBy("text_sha256")
         .option("path", self.folder).saveAsTable(self.name))
        self.spark.catalog.refreshTable(self.name)


def groups_of(docs):
    """One row per distinct text: digest, largest doc_id, number of rows."""
    return docs.select("doc_id", digest_of().alias("text_sha256")).groupBy("text_sha256").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def dedup_batch(docs, index):
    """Add the digests of `docs` to `index`; a row per row of `docs`: doc_id, text_sha256, keep_id,
    group_size (rows of the batch with that text) and kept."""
    groups = written(groups_of(docs), "digest-groups")
    index.lay_out(groups.count())
    known = index.table()
    new = groups.join(known.hint("merge"), "text_sha256", "left_anti")
    index.append(new)
    fresh = groups.select("text_sha256", "group_size", F.col("keep_id").alias("own_id")).join(
        index.table().hint("merge"), "text_sha256")
    rows = join_counted(docs.select("doc_id", digest_of().alias("text_sha256")), written(fresh, "digest-keepers"),
                        ["text_sha256"], "group_size", ["doc_id"])
    kept = F.col("keep_id").eqNullSafe(F.col("doc_id")) & F.col("keep_id").eqNullSafe(F.col("own_id"))
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def exact_dedup(docs, folder=None):
    """`dedup_batch` with the index at `folder`, or with a new and empty one."""
    spark = docs.sparkSession
    return dedup_batch(docs, DigestIndex(spark, folder or new_folder(spark, "digest-index")))


def keep_unique(docs, folder=None):
    """The rows of `docs` that `exact_dedup` keeps, with all their columns."""
    spark = docs.sparkSession
    index = DigestIndex(spark, folder or new_folder(spark, "digest-index"))
    groups = written(groups_of(docs), "digest-groups")
    index.lay_out(groups.count())
    new = written(groups.join(index.table().hint("merge"), "text_sha256", "left_anti"), "digest-new")
    index.append(new)
    stays = new.select(F.col("text_sha256").alias("_digest"), F.col("keep_id").alias("_keep"))
    same = (digest_of() == stays["_digest"]) & docs["doc_id"].eqNullSafe(stays["_keep"])
    return docs.join(stays, same, "left_semi")

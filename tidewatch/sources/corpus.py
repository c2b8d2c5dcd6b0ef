"""Per-community CSV exports, old and new."""
from functools import reduce

from pyspark.sql import functions as F

from tidewatch.functions.text import or_empty, title_body
from tidewatch.schemas import LEGACY_CSV


def _csv(spark, path, label):
    # Bodies hold line breaks and doubled quotes. Columns are matched by header name.
    header = spark.read.options(header=True, multiLine=True, escape='"')
    names = header.csv(str(path)).columns
    kinds = {f.name: f.dataType for f in LEGACY_CSV}
    df = header.csv(str(path)).select(
        *[F.col(f"`{n}`").try_cast(kinds[n]).alias(n) if n in kinds else F.col(f"`{n}`")
          for n in names])
    return df.withColumn("subreddit", F.lit(label))


def load_corpus(spark, files):
    """One row per post with `text` and `subreddit`; `files` maps label -> CSV path."""
    frames = [_csv(spark, path, label) for label, path in files.items()]
    corpus = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return corpus.withColumn("text", title_body(F.col("title"), F.col("content")))


def from_legacy(spark, files):
    """The old exports under the collector's column names."""
    corpus = load_corpus(spark, files)
    return corpus.select(
        "id", "subreddit", or_empty(F.col("title")).alias("title"),
        or_empty(F.col("content")).alias("body"), "score", "num_comments", "created_utc",
        "upvote_ratio", F.col("subreddit_flair").alias("flair"),
        F.lit("[]").alias("comments_json"))


def export_csv(df, path, by="subreddit"):
    """One directory of CSV files per community."""
    df.write.mode("overwrite").partitionBy(by).options(
        header=True, escape='"', quoteAll=True).csv(str(path))

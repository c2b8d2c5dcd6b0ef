"""Posts, statuses, answers and scored rows derived from the given tables.

Everything is a projection or an equi-join of whole tables; `twins.py` holds the same in SQL.
"""
from pyspark.sql import functions as F

from tidewatch.plans.skew import widen


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts):
    """Zoneless time stamp to seconds, whatever the session time zone."""
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", start, ts) / 1e6


def documents(spark, sf_dir):
    return widen(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").cast("string").alias("id"), "doc_id", "text", "lang", "source")


def posts(spark, sf_dir, comments=False):
    """One post per document; the event of the same number supplies the creation time."""
    n = F.col("doc_id")
    title = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    tail = (F.when(n % 7 == 0, F.concat(F.lit(" crossposting from r/"), F.col("source")))
            .when(n % 11 == 0, F.lit(" love this sub"))
            .when(n % 13 == 0, F.concat(F.lit(" see http://x.example/"), n.cast("string")))
            .otherwise(""))
    born = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"), epoch_seconds(F.col("ts")).alias("created_utc"))
    # Title and body are made before the join, so that a text moves only where its body is wanted.
    cut = widen(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", "source", "lang", title.alias("title"),
        F.concat(F.substring(F.col("text"), F.length(title) + 2, F.length("text")), tail).alias("body"))
    df = cut.join(born, "doc_id").select(
        n.cast("string").alias("id"), "doc_id", F.col("source").alias("subreddit"),
        "lang", "title", "body", "created_utc",
        F.when(n % 17 == 0, F.lit(0.0))
        .otherwise(F.col("created_utc") + (n % 10) * 1800).alias("snapshot_utc"),
        (n % 97).alias("score"), ((n % 100) / 100).alias("upvote_ratio"),
        F.when(n % 3 == 0, F.col("lang")).alias("flair"), (n % 4 != 0).alias("is_self"))
    if not comments:
        return df
    turns = comment_arrays(spark, sf_dir).select(
        F.col("conv_id").alias("doc_id"), F.to_json("comments").alias("comments_json"))
    return df.join(turns, "doc_id", "left")


def comment_arrays(spark, sf_dir):
    """The turns of a conversation as the comments of the post with the same number."""
    turn = F.col("turn")
    comment = F.struct(
        turn.alias("turn"),
        F.when(turn % 7 == 6, "[removed]").otherwise(F.col("text")).alias("body"),
        turn.alias("score"),
        F.when(F.col("role") == "system", "AutoModerator").when(turn % 5 == 4, "helper_bot")
        .otherwise(F.concat(F.lit("u"), turn.cast("string"))).alias("author"),
        (turn == 0).alias("is_stickied"), F.lit(None).cast("string").alias("distinguished"))
    listed = F.sort_array(F.collect_list(comment))
    return (table(spark, sf_dir, "conversations").groupBy("conv_id").agg(listed.alias("listed"))
            .select("conv_id", F.transform("listed", lambda c: F.struct(
                c["body"].alias("body"), c["score"].alias("score"), c["author"].alias("author"),
                c["is_stickied"].alias("is_stickied"),
                c["distinguished"].alias("distinguished"))).alias("comments")))


def labelled(spark, sf_dir):
    return table(spark, sf_dir, "labels").withColumn("id", F.col("doc_id").cast("string"))


def status(spark, sf_dir):
    """Current moderation state of the posts that can still be looked up."""
    n = F.col("doc_id")
    category = (F.when(n % 29 == 0, "quarantined").when(F.col("toxic") == 1, "moderator")
                .when(F.col("quality") == 0, "deleted"))
    return labelled(spark, sf_dir).where(n % 23 != 0).select(
        "id", category.alias("removed_by_category"))


def scored(spark, sf_dir):
    """Labelled rows with a confidence and whether the prediction was right."""
    n = F.col("doc_id")
    confidence = 0.5 + (n * 7919 % 4999) / 10000.0
    right = n * 31 % 100 <= confidence * 100
    truth = F.col("quality")
    return labelled(spark, sf_dir).select(
        "id", "doc_id", truth.cast("string").alias("truth"),
        F.when(right, truth).otherwise(1 - truth).cast("string").alias("predicted"),
        confidence.alias("confidence"), right.alias("correct"))


def answers(spark, sf_dir):
    """Two annotators over the labelled rows."""
    n = F.col("doc_id")
    rows = labelled(spark, sf_dir)

    def annotator(name, answer):
        return rows.select("id", F.lit(name).alias("annotator"), answer.alias("answer"),
                           (1.0 + n % 13).alias("seconds"))
    flipped = F.when(n % 9 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    return annotator("a", F.when(n % 5 == 0, "unsure").otherwise(flipped.cast("string"))) \
        .unionByName(annotator("b", F.when(n % 6 == 0, "unsure")
                               .otherwise((1 - F.col("toxic")).cast("string"))))

"""Collection without a client: source records, overlapping listings, unseen posts."""
from pyspark.sql import functions as F

from tidewatch.functions.text import or_empty
from tidewatch.plans.ranking import keep_first, top_within

NEW_WINDOWS = ("new",)
TOP_WINDOWS = ("all", "year", "month", "week")
LEGACY_WINDOWS = (*TOP_WINDOWS, "day")
LISTINGS = {"new": NEW_WINDOWS, "top": TOP_WINDOWS}


def normalise_submissions(records, snapshot_utc, comments_per_post=0):
    """Landed source records with settled names, defaults and the time they were taken."""
    def flag(name):
        return F.coalesce(F.col(name), F.lit(False)).alias(name)

    first = (F.slice("comments", 1, comments_per_post) if comments_per_post
             else F.slice("comments", 1, 0))
    comments = F.transform(first, lambda c: F.struct(
        or_empty(c["body"]).alias("body"), F.coalesce(c["score"], F.lit(0)).alias("score"),
        or_empty(c["author"]).alias("author"),
        F.coalesce(c["stickied"], F.lit(False)).alias("is_stickied"),
        c["distinguished"].alias("distinguished")))
    return records.select(
        "id", "subreddit", or_empty(F.col("title")).alias("title"),
        or_empty(F.col("selftext")).alias("body"), "score", "num_comments", "created_utc",
        F.coalesce("upvote_ratio", F.lit(float("nan"))).alias("upvote_ratio"),
        F.col("link_flair_text").alias("flair"), "is_self",
        or_empty(F.col("permalink")).alias("permalink"),
        F.lit(float(snapshot_utc)).alias("snapshot_utc"),
        or_empty(F.col("domain")).alias("domain"), flag("over_18"), flag("spoiler"),
        comments.alias("comments"))


def flatten_snapshot(posts):
    """Comments as JSON text plus their number; nothing is filtered."""
    listed = F.coalesce(F.to_json("comments", {"ignoreNullFields": "false"}), F.lit("[]"))
    return posts.select(
        *[c for c in posts.columns if c != "comments"], listed.alias("comments_json"),
        F.coalesce(F.size("comments"), F.lit(0)).alias("n_comments_collected"))


def unseen_posts(incoming, seen, order=("snapshot_utc", "created_utc")):
    """Incoming posts whose id is not stored yet, each id once."""
    order = [F.col(c) for c in order if c in incoming.columns]
    fresh = incoming.join(seen.select("id"), "id", "left_anti").select(*incoming.columns)
    return keep_first(fresh, ["id"], order)


def counts_per_community(posts, communities):
    """New rows for each configured community, zero included."""
    asked = posts.sparkSession.createDataFrame([(c,) for c in communities], "subreddit string")
    counts = posts.groupBy("subreddit").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(counts, "subreddit", "left").select(
        "subreddit", F.coalesce("n", F.lit(0)).alias("n"))


def merged_listing(entries, limit, listing="top", seen=None, windows=None):
    """Overlapping listing windows in order, each id once, up to `limit` ids per community.

    `entries` has subreddit, window, pos and id. Ids already seen count toward the limit but are
    left out of the result.
    """
    if windows is None:
        if listing not in LISTINGS:
            raise ValueError(f"listing must be one of {tuple(LISTINGS)}, got {listing!r}")
        windows = LISTINGS[listing]
    position = F.array_position(F.array(*[F.lit(w) for w in windows]), F.col("window"))
    ranked = entries.where(F.col("window").isin(*windows)).withColumn("_window", position)
    firsts = keep_first(ranked, ["subreddit", "id"], [F.col("_window"), F.col("pos")])
    within = top_within(firsts, ["subreddit"], [F.col("_window"), F.col("pos"), F.col("id")],
                        limit).drop("_window")
    return within if seen is None else within.join(seen.select("id"), "id", "left_anti")


def legacy_listing(entries, limit=1000):
    """The older collection: one more window, no seen set, its own column names."""
    merged = merged_listing(entries, limit, windows=LEGACY_WINDOWS)
    return merged.withColumn("submission_datetime", F.col("created_utc")).withColumn(
        "author", F.coalesce("author", F.lit("Unknown")))

"""Delayed moderation labels: what became of a post some time after it was first seen."""
from pyspark.sql import functions as F

from tidewatch.functions import numeric, text as tx
from tidewatch.plans.ranking import keep_first, top_within

LABEL_AFTER_HOURS = 48
MAX_AGE_AT_SNAPSHOT = 2.0
YOUNG_HOURS = 3

KEPT, REMOVED, DELETED, MISSING = (
    "kept", "removed_by_moderation", "deleted_by_author", "missing")

# Categories in which someone other than the author acted, and the author's own.
MODERATION_CATEGORIES = (
    "moderator", "automod_filtered", "reddit", "anti_evil_ops",
    "content_takedown", "copyright_takedown", "community_ops")
AUTHOR_CATEGORIES = ("deleted", "author")


def outcome(category):
    return (F.when(category.isNull(), KEPT)
            .when(category.isin(*MODERATION_CATEGORIES), REMOVED)
            .when(category.isin(*AUTHOR_CATEGORIES), DELETED)
            .otherwise(F.concat(F.lit("other:"), category)))


def due_for_labelling(raw, labelled, now, after_hours=LABEL_AFTER_HOURS):
    """Posts old enough to label that have no label yet."""
    old_enough = F.col("created_utc") <= F.lit(now - after_hours * 3600.0)
    return raw.where(old_enough).join(labelled.select("id"), "id", "left_anti")


def recheck(raw, status, labelled, now, after_hours=LABEL_AFTER_HOURS):
    """One label row per due post; ids the status does not know are `missing`."""
    snapshot = (F.col("snapshot_utc") if "snapshot_utc" in raw.columns
                else F.lit(None).cast("double"))
    # The age filter commutes with keep-first only if it looks at the kept row, so it comes second.
    posts = keep_first(raw.select("id", "subreddit", "created_utc",
                                  snapshot.alias("snapshot_utc")),
                       ["id"], [F.col("snapshot_utc"), F.col("created_utc")])
    known = status.groupBy("id").agg(F.max("removed_by_category").alias("removed_by_category")) \
        .withColumn("present", F.lit(True))
    due = due_for_labelling(posts, labelled, now, after_hours)
    return due.join(known, "id", "left").select(
        "id", "subreddit", F.lit(float(now)).alias("checked_utc"),
        numeric.hours_between(F.lit(float(now)), F.col("created_utc"))
        .alias("hours_since_creation"),
        numeric.age_at_snapshot(F.col("snapshot_utc"), F.col("created_utc"))
        .alias("hours_old_at_snapshot"),
        "removed_by_category",
        F.when(F.col("present").isNull(), MISSING).otherwise(outcome(F.col("removed_by_category")))
        .alias("outcome"))


def outcome_counts(labels):
    return labels.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def seen_young(labels, max_age=MAX_AGE_AT_SNAPSHOT):
    """Labels of posts first seen early enough not to have survived moderation already."""
    return labels.where(F.col("hours_old_at_snapshot") <= max_age)


def removal_rate(labels, max_age=MAX_AGE_AT_SNAPSHOT):
    """Removal rate per community and, with `scope = 'all'`, over everything."""
    eligible = seen_young(labels, max_age).where(F.col("outcome").isin(KEPT, REMOVED))
    per = eligible.groupBy("subreddit").agg(
        F.count(F.lit(1)).alias("eligible_posts"),
        F.count_if(F.col("outcome") == REMOVED).alias("removed"))
    # The total adds up the communities, so that it exists (as NaN) without any eligible post.
    overall = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c)
                        for c in ("eligible_posts", "removed")])
    rate = numeric.nan_if_null(numeric.share(F.col("removed"), F.col("eligible_posts")))
    columns = ["scope", "subreddit", "eligible_posts", "removed", "rate"]
    named = per.where(F.col("subreddit").isNotNull())
    return named.withColumns({"scope": F.lit("community"), "rate": F.bround(rate, 4)}).select(
        *columns).unionByName(overall.withColumns({
            "scope": F.lit("all"), "subreddit": F.lit(None).cast("string"), "rate": rate})
            .select(*columns))


# --- the removal probe --------------------------------------------------------

def probe_snapshot(posts, now, n=100):
    """The newest `n` posts of every community with their age."""
    newest = top_within(
        posts.select("id", "subreddit", "title", "body", "created_utc"), ["subreddit"],
        [F.col("created_utc").desc(), F.col("id")], n)
    return newest.select(
        "id", "subreddit", "created_utc", F.lit(float(now)).alias("snapshot_utc"),
        numeric.hours_between(F.lit(float(now)), F.col("created_utc")).alias("age_hours"),
        "title", (~tx.is_blank(F.col("body"))).alias("has_body"))


def probe_recheck(snapshot, returned, now):
    """What the later lookup says about the snapshotted posts; unreturned ids drop out."""
    seen = returned.select(
        "id", "removed_by_category", tx.removal_marker(F.col("selftext")).alias("selftext_marker"),
        F.col("author").isNull().alias("author_gone"), "robot_indexable")
    return (snapshot.join(seen, "id")
            .withColumn("checked_utc", F.lit(float(now)))
            .withColumn("hours_observed",
                        numeric.hours_between(F.col("checked_utc"), F.col("snapshot_utc"))))


def is_young(hours=YOUNG_HOURS):
    return F.col("age_hours") < hours


def young_per_community(snapshot, hours=YOUNG_HOURS):
    return snapshot.where(is_young(hours)).groupBy("subreddit").agg(
        F.count(F.lit(1)).alias("n_young"))


def probe_categories(rechecked, hours=YOUNG_HOURS):
    return rechecked.groupBy("removed_by_category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_young(hours)).alias("n_young"))


def probe_markers(rechecked):
    return rechecked.groupBy("selftext_marker").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("author_gone").alias("n_author_gone"),
        F.count_if(F.col("robot_indexable") == F.lit(False)).alias("n_not_indexable"))


def removed_examples(rechecked, n=8, title_chars=70):
    removed = F.coalesce(F.col("removed_by_category"), F.lit("")) != ""
    return rechecked.where(removed).orderBy("id").limit(n).select(
        "id", "subreddit", "removed_by_category",
        F.substring("title", 1, title_chars).alias("title"))

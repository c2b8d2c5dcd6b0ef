"""Explicit schemas for everything read from or written to storage."""
from pyspark.sql import types as T

_S, _D, _L, _B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()


def _struct(*fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


COMMENT = _struct(
    ("body", _S), ("score", _L), ("author", _S), ("is_stickied", _B), ("distinguished", _S))

COMMENTS = T.ArrayType(COMMENT)

# A collected post, one row each, comments kept as JSON text at rest.
RAW_POST = _struct(
    ("id", _S), ("subreddit", _S), ("title", _S), ("body", _S), ("score", _L),
    ("num_comments", _L), ("created_utc", _D), ("upvote_ratio", _D), ("flair", _S),
    ("is_self", _B), ("permalink", _S), ("snapshot_utc", _D), ("domain", _S),
    ("over_18", _B), ("spoiler", _B), ("comments_json", _S),
    ("n_comments_collected", T.IntegerType()))

# A source record as it lands, before names and defaults are settled.
SUBMISSION = _struct(
    ("id", _S), ("subreddit", _S), ("title", _S), ("selftext", _S), ("score", _L),
    ("num_comments", _L), ("created_utc", _D), ("upvote_ratio", _D), ("link_flair_text", _S),
    ("is_self", _B), ("permalink", _S), ("domain", _S), ("over_18", _B), ("spoiler", _B),
    ("comments", T.ArrayType(_struct(
        ("body", _S), ("score", _L), ("author", _S), ("stickied", _B), ("distinguished", _S)))))

LABEL = _struct(
    ("id", _S), ("subreddit", _S), ("checked_utc", _D), ("hours_since_creation", _D),
    ("hours_old_at_snapshot", _D), ("removed_by_category", _S), ("outcome", _S))

ANSWER = _struct(("id", _S), ("annotator", _S), ("answer", _S), ("seconds", _D))

SAMPLE = _struct(("id", _S), ("position", _L))

OPERATING_POINT = _struct(
    ("threshold", _D), ("coverage", _D), ("precision", _D), ("n_covered", _L),
    ("n_errors_covered", _L), ("precision_floor", _D), ("meets_floor", _B))

# The older per-community CSV export.
LEGACY_CSV = _struct(
    ("id", _S), ("title", _S), ("content", _S), ("score", _L), ("num_comments", _L),
    ("author", _S), ("created_utc", _D), ("upvote_ratio", _D), ("subreddit_flair", _S),
    ("submission_datetime", _D), ("post_type", _B), ("entity_recognition", _S),
    ("text_sentiment", _D), ("external_links_count", _L))

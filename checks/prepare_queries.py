"""Preparation: text rules, duplicates, split, report, fingerprint."""
from pyspark.sql import functions as F

from checks import inputs, twins
from tidewatch.functions import numeric, text as tx
from tidewatch.operators import prepare as prep
from tidewatch.plans.ranking import keep_first

QUERIES = {}
SPLIT_COLUMNS = ("id", "subreddit", "created_utc")


def query(name, sql=None):
    def register(function):
        QUERIES[name] = (function, sql)
        return function
    return register


# --- text rules ---------------------------------------------------------------

_RAW = twins.joined()
_TEXT = "raw_text"


@query("strip_leakage", f"""WITH {_RAW}
SELECT id, {twins.count(_TEXT, twins.MENTION)} AS n_mentions,
       {twins.count(twins.unmentioned(_TEXT), twins.SELF)} AS n_self,
       md5({twins.unleaked(_TEXT)}) AS text_md5 FROM joined""")
def strip_leakage(spark, sf_dir):
    df = inputs.posts(spark, sf_dir)
    df = df.withColumn("joined", prep.joined_text(df))
    df = df.withColumn("unmentioned", tx.drop_mentions(F.col("joined")))
    return df.select(
        "id", tx.count_mentions(F.col("joined")).cast("long").alias("n_mentions"),
        tx.count_self_references(F.col("unmentioned")).cast("long").alias("n_self"),
        F.md5(tx.drop_self_references(F.col("unmentioned"))).alias("text_md5"))


@query("normalise", f"""WITH {_RAW}
SELECT id, {twins.normalised(_TEXT)} AS text FROM joined""")
def normalise(spark, sf_dir):
    df = inputs.posts(spark, sf_dir)
    return df.select("id", tx.normalise(prep.joined_text(df)).alias("text"))


@query("title_key", f"""WITH {twins.POSTS}
SELECT id, {twins.title_key("title")} AS title_key FROM posts""")
def title_key(spark, sf_dir):
    return inputs.posts(spark, sf_dir).select("id", tx.title_key(F.col("title"))
                                              .alias("title_key"))


@query("word_count", f"""SELECT CAST(doc_id AS VARCHAR) AS id, {twins.word_count("text")} AS n_words
FROM documents""")
def word_count(spark, sf_dir):
    return inputs.documents(spark, sf_dir).select(
        "id", tx.word_count(F.col("text")).cast("long").alias("n_words"))


@query("is_bot", f"""WITH {twins.COMMENTS}
SELECT doc_id AS conv_id, turn, author, {twins.is_bot("author")} AS is_bot FROM comments""")
def is_bot(spark, sf_dir):
    exploded = inputs.comment_arrays(spark, sf_dir).select("conv_id", F.explode("comments"))
    return exploded.select("conv_id", F.col("col.score").alias("turn"),
                           F.col("col.author").alias("author"),
                           tx.is_bot(F.col("col.author")).alias("is_bot"))


@query("clean_comments", f"""WITH {twins.COMMENTS}
SELECT doc_id AS conv_id, count(*) FILTER (class = 'kept') AS n_kept,
       count(*) FILTER (class = 'bot') AS n_bot,
       count(*) FILTER (class = 'moderator_or_stickied') AS n_moderator,
       count(*) FILTER (class = 'deleted_or_removed') AS n_deleted,
       coalesce(string_agg(body, ' ' ORDER BY turn) FILTER (class = 'kept'), '') AS kept_text
FROM classed GROUP BY doc_id""")
def clean_comments(spark, sf_dir):
    df = inputs.comment_arrays(spark, sf_dir)
    classes = F.transform("comments", tx.comment_class)

    def n(name):
        return F.size(F.filter(classes, lambda c: c == name)).cast("long")
    return df.select(
        "conv_id", n("kept").alias("n_kept"), n("bot").alias("n_bot"),
        n("moderator_or_stickied").alias("n_moderator"),
        n("deleted_or_removed").alias("n_deleted"),
        F.array_join(tx.kept_comments(F.col("comments")), " ").alias("kept_text"))


@query("comment_class_counts", f"""WITH {twins.COMMENTS}
SELECT class, count(*) AS n FROM classed GROUP BY class""")
def comment_class_counts(spark, sf_dir):
    comments = inputs.comment_arrays(spark, sf_dir).select(F.explode("comments").alias("c"))
    return (comments.groupBy(tx.comment_class(F.col("c")).alias("class"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("assemble", f"""WITH {_RAW}
SELECT id, {twins.normalised(twins.unleaked(_TEXT))} AS text FROM joined""")
def assemble(spark, sf_dir):
    return prep.assemble(inputs.posts(spark, sf_dir)).select("id", "text")


@query("assemble_with_comments", f"""WITH {twins.joined(comments=True)}
SELECT id, CAST(n_comments_kept AS INTEGER) AS n_comments_kept,
       {twins.normalised(twins.unleaked(_TEXT))} AS text FROM joined""")
def assemble_with_comments(spark, sf_dir):
    df = prep.assemble(inputs.posts(spark, sf_dir, comments=True), include_comments=True)
    return df.select("id", "n_comments_kept", "text")


@query("apply_contract", f"""WITH {_RAW}
SELECT id, subreddit, created_utc, snapshot_utc, title, body, flair, is_self,
       {twins.normalised(twins.unleaked(_TEXT))} AS text FROM joined""")
def apply_contract(spark, sf_dir):
    return prep.apply_contract(prep.assemble(inputs.posts(spark, sf_dir)))


@query("title_body_text", f"""WITH {twins.POSTS}
SELECT id, {twins.stripped("coalesce(title, '') || ' ' || coalesce(body, '')")} AS text
FROM posts""")
def title_body_text(spark, sf_dir):
    return inputs.posts(spark, sf_dir).select(
        "id", tx.title_body(F.col("title"), F.col("body")).alias("text"))


@query("external_links", f"""WITH {twins.POSTS}
SELECT id, {twins.count("title || ' ' || body", twins.EXTERNAL_LINK)} AS n_links FROM posts""")
def external_links(spark, sf_dir):
    return inputs.posts(spark, sf_dir).select(
        "id", tx.external_links(F.col("title"), F.col("body")).cast("long").alias("n_links"))


@query("page_links", f"""SELECT page_id, {twins.count("url || ' ' || html", twins.EXTERNAL_LINK)}
AS n_links FROM pages""")
def page_links(spark, sf_dir):
    return inputs.table(spark, sf_dir, "pages").select(
        "page_id", tx.external_links(F.col("url"), F.col("html")).cast("long").alias("n_links"))


@query("truncate_for_annotation", """SELECT CAST(doc_id AS VARCHAR) AS id,
       CASE WHEN length(text) > 1200 THEN substr(text, 1, 1200) || ' [...]' ELSE text END AS shown
FROM documents""")
def truncate_for_annotation(spark, sf_dir):
    return inputs.documents(spark, sf_dir).select("id", tx.truncated(F.col("text")).alias("shown"))


@query("blank_body", f"""WITH {twins.POSTS}
SELECT id, {twins.stripped("coalesce(body, '')")} = '' AS empty_body FROM posts""")
def blank_body(spark, sf_dir):
    return inputs.posts(spark, sf_dir).select("id", tx.is_blank(F.col("body"))
                                              .alias("empty_body"))


# Two word lists that do occur in the invented prose, in the roles of the franchise tokens.
PATTERNS = {"first": "tion|ther|hein", "second": "eau|ment|sch"}
_ANY = tx.any_token(PATTERNS)


@query("strip_tokens", f"""SELECT CAST(doc_id AS VARCHAR) AS id,
       regexp_replace(text, '(?i){_ANY}', ' ', 'g') AS text FROM documents""")
def strip_tokens(spark, sf_dir):
    return inputs.documents(spark, sf_dir).select(
        "id", tx.strip_tokens(F.col("text"), _ANY).alias("text"))


@query("has_token", f"""SELECT CAST(doc_id AS VARCHAR) AS id,
       {twins.has_token("text", _ANY)} AS named FROM documents""")
def has_token(spark, sf_dir):
    return inputs.documents(spark, sf_dir).select(
        "id", tx.has_token(F.col("text"), _ANY).alias("named"))


_FIRST, _SECOND = (twins.has_token("text", p) for p in PATTERNS.values())


@query("keyword_rule", f"""SELECT CAST(doc_id AS VARCHAR) AS id,
       CASE WHEN {_FIRST} AND NOT {_SECOND} THEN 'first'
            WHEN {_SECOND} AND NOT {_FIRST} THEN 'second' ELSE 'second' END AS rule
FROM documents""")
def keyword_rule(spark, sf_dir):
    return inputs.documents(spark, sf_dir).select(
        "id", tx.keyword_rule(F.col("text"), PATTERNS, "second").alias("rule"))


_MARVEL, _POTTER = (twins.has_token("text", p) for p in tx.FRANCHISE_TOKENS.values())


@query("franchise_rule", f"""SELECT CAST(doc_id AS VARCHAR) AS id,
       CASE WHEN {_MARVEL} AND NOT {_POTTER} THEN 'marvel' ELSE 'harrypotter' END AS rule,
       regexp_replace(text, '(?i){tx.any_token(tx.FRANCHISE_TOKENS)}', ' ', 'g') AS stripped
FROM documents""")
def franchise_rule(spark, sf_dir):
    return inputs.documents(spark, sf_dir).select(
        "id", tx.keyword_rule(F.col("text"), tx.FRANCHISE_TOKENS, "harrypotter").alias("rule"),
        tx.strip_tokens(F.col("text"), tx.any_token(tx.FRANCHISE_TOKENS)).alias("stripped"))


# --- duplicates ---------------------------------------------------------------

@query("deduplicate", f"""WITH {twins.deduplicated()}
SELECT id, subreddit, title, created_utc FROM kept""")
def deduplicate(spark, sf_dir):
    return prep.deduplicate(inputs.posts(spark, sf_dir)).select(
        "id", "subreddit", "title", "created_utc")


@query("duplicate_counts", f"""WITH {twins.deduplicated()}
SELECT count(*) FILTER (conflict) AS cross_posted_conflict,
       count(*) FILTER (NOT conflict AND nth > 1) AS duplicate_within_subreddit,
       count(*) FILTER (NOT conflict AND nth = 1 AND subreddit IS NULL) AS null_label
FROM flagged""")
def duplicate_counts(spark, sf_dir):
    return prep.duplicate_counts(prep.title_groups(inputs.posts(spark, sf_dir)))


@query("communities_per_title", f"""WITH {twins.deduplicated()}
SELECT title_key, count(DISTINCT subreddit) AS n_communities, count(*) AS n_posts
FROM keyed GROUP BY title_key""")
def communities_per_title(spark, sf_dir):
    keyed = inputs.posts(spark, sf_dir).withColumn("title_key", tx.title_key(F.col("title")))
    return keyed.groupBy("title_key").agg(
        F.count_distinct("subreddit").alias("n_communities"), F.count(F.lit(1)).alias("n_posts"))


@query("keep_first_by_id", f"""WITH {twins.POSTS},
twice AS (SELECT id, snapshot_utc, title FROM posts UNION ALL
          SELECT id, snapshot_utc + 60, upper(title) FROM posts)
SELECT id, snapshot_utc, title FROM twice
QUALIFY row_number() OVER (PARTITION BY id ORDER BY snapshot_utc) = 1""")
def keep_first_by_id(spark, sf_dir):
    seen = inputs.posts(spark, sf_dir).select("id", "snapshot_utc", "title")
    again = seen.select("id", (F.col("snapshot_utc") + 60).alias("snapshot_utc"),
                        F.upper("title").alias("title"))
    return keep_first(seen.unionByName(again), ["id"], [F.col("snapshot_utc")])


# --- split and report ---------------------------------------------------------

@query("prepared_posts", f"""WITH {twins.tagged()}
SELECT id, subreddit, created_utc, snapshot_utc, title, body, flair, is_self, text, split
FROM final""")
def prepared_posts(spark, sf_dir):
    return prep.prepare(inputs.posts(spark, sf_dir)).rows


@query("prepared_with_comments", f"""WITH {twins.tagged(comments=True)}
SELECT id, subreddit, split, text, CAST(n_comments_kept AS INTEGER) AS n_comments_kept
FROM final""")
def prepared_with_comments(spark, sf_dir):
    rows = prep.prepare(inputs.posts(spark, sf_dir, comments=True), include_comments=True).rows
    return rows.select("id", "subreddit", "split", "text", "n_comments_kept")


@query("temporal_split", f"""WITH {twins.tagged()}
SELECT id, subreddit, split FROM tagged""")
def temporal_split(spark, sf_dir):
    kept = prep.deduplicate(inputs.posts(spark, sf_dir), columns=SPLIT_COLUMNS)
    return prep.with_split(kept).select("id", "subreddit", "split")


@query("test_cutoffs", f"""WITH {twins.tagged()}
SELECT subreddit, count(*) AS n_posts, count(*) FILTER (split = 'test') AS n_test,
       min(created_utc) FILTER (split = 'test') AS test_starts_utc FROM tagged GROUP BY subreddit""")
def test_cutoffs(spark, sf_dir):
    kept = prep.deduplicate(inputs.posts(spark, sf_dir), columns=SPLIT_COLUMNS)
    return prep.split_report(prep.with_split(kept))


@query("random_split", f"""WITH {twins.tagged(order="md5('42:' || id), id")}
SELECT id, subreddit, split FROM tagged""")
def random_split(spark, sf_dir):
    kept = prep.deduplicate(inputs.posts(spark, sf_dir), columns=SPLIT_COLUMNS)
    return prep.with_split(kept, method="random", seed=42).select("id", "subreddit", "split")


@query("tied_split", f"""WITH {twins.tagged(order="floor(created_utc / 864000) DESC, md5(id), id")}
SELECT id, subreddit, split FROM tagged""")
def tied_split(spark, sf_dir):
    """Ten-day time stamps: hundreds of posts share the key at the border."""
    kept = prep.deduplicate(inputs.posts(spark, sf_dir), columns=SPLIT_COLUMNS)
    coarse = kept.select("id", "subreddit", F.floor(F.col("created_utc") / 864000)
                         .cast("double").alias("created_utc"))
    return prep.with_split(coarse).select("id", "subreddit", "split")


@query("temporal_split_by_cuts", f"""WITH {twins.tagged()}
SELECT id, subreddit, split FROM tagged""")
def temporal_split_by_cuts(spark, sf_dir):
    """The way taken for communities too large for one task."""
    kept = prep.deduplicate(inputs.posts(spark, sf_dir), columns=SPLIT_COLUMNS)
    return prep.with_split(kept, window_limit=0).select("id", "subreddit", "split")


@query("tied_split_by_cuts", f"""WITH {twins.tagged(order="floor(created_utc / 864000) DESC, md5(id), id")}
SELECT id, subreddit, split FROM tagged""")
def tied_split_by_cuts(spark, sf_dir):
    kept = prep.deduplicate(inputs.posts(spark, sf_dir), columns=SPLIT_COLUMNS)
    coarse = kept.select("id", "subreddit", F.floor(F.col("created_utc") / 864000)
                         .cast("double").alias("created_utc"))
    return prep.with_split(coarse, window_limit=0).select("id", "subreddit", "split")


@query("random_split_by_cuts", f"""WITH {twins.tagged(order="md5('42:' || id), id")}
SELECT id, subreddit, split FROM tagged""")
def random_split_by_cuts(spark, sf_dir):
    kept = prep.deduplicate(inputs.posts(spark, sf_dir), columns=SPLIT_COLUMNS)
    return prep.with_split(kept, method="random", window_limit=0).select(
        "id", "subreddit", "split")


@query("class_balance", f"""WITH {twins.tagged()}
SELECT split, subreddit, count(*) AS n FROM final GROUP BY split, subreddit""")
def class_balance(spark, sf_dir):
    return prep.prepare(inputs.posts(spark, sf_dir)).class_balance


@query("short_posts", f"""WITH {twins.tagged()}
SELECT count(*) FILTER (split = 'train' AND n_words < 20) AS too_short_removed_from_train,
       count(*) FILTER (split = 'test' AND n_words < 20) AS short_posts_kept_in_test FROM worded""")
def short_posts(spark, sf_dir):
    return prep.prepare(inputs.posts(spark, sf_dir), min_words=20).report.select(
        "too_short_removed_from_train", "short_posts_kept_in_test")


@query("mean_words", f"""WITH {twins.tagged()}
SELECT round(avg(n_words), 6) AS mean_words_per_post FROM final""")
def mean_words(spark, sf_dir):
    rows = prep.prepare(inputs.posts(spark, sf_dir)).rows
    return prep.mean_words(rows).select(F.round("mean_words_per_post", 6)
                                        .alias("mean_words_per_post"))


# The ids of a leaf hashed, then the leaves of a branch, from `final`.
_BRANCHES = """leaves AS (
  SELECT split, substr(md5(id), 1, 6) AS bucket, count(*) AS n,
         sha256(string_agg(id, chr(10) ORDER BY id)) AS leaf FROM final GROUP BY split, bucket),
branches AS (
  SELECT split, substr(bucket, 1, 3) AS branch, CAST(sum(n) AS BIGINT) AS n,
         sha256(string_agg(bucket || ':' || leaf, chr(10) ORDER BY bucket)) AS hash FROM leaves GROUP BY split, branch)"""
_ROOT = "substr(sha256(string_agg(split || ':' || branch || ':' || hash, chr(10) ORDER BY split, branch)), 1, 12)"


def _report(comments):
    classes = {"kept": "kept", "bot": "bot", "moderator_or_stickied": "moderator_or_stickied",
               "deleted_or_removed": "deleted_or_removed"}
    counted = ", ".join(
        f"(SELECT count(*) FROM classed c JOIN posts USING (doc_id) WHERE class = '{c}') "
        f"AS comments_{n}" if comments else f"CAST(NULL AS BIGINT) AS comments_{n}"
        for n, c in classes.items())
    return f"""WITH {twins.tagged(comments)},
{_BRANCHES}
SELECT (SELECT count(*) FROM posts) AS input_posts,
  (SELECT CAST(sum({twins.count("raw_text", twins.MENTION)}) AS BIGINT) FROM joined)
    AS subreddit_mentions,
  (SELECT CAST(sum({twins.count(twins.unmentioned("raw_text"), twins.SELF)}) AS BIGINT)
   FROM joined) AS self_references,
  {counted}, {str(comments).lower()} AS comments_included,
  (SELECT count(*) FROM flagged WHERE conflict) AS cross_posted_conflict,
  (SELECT count(*) FROM flagged WHERE NOT conflict AND nth > 1) AS duplicate_within_subreddit,
  (SELECT count(*) FROM kept WHERE subreddit IS NULL) AS null_label,
  count(*) FILTER (split = 'train' AND n_words < 3) AS too_short_removed_from_train,
  count(*) FILTER (split = 'test' AND n_words < 3) AS short_posts_kept_in_test,
  (SELECT count(*) FROM final) AS output_posts,
  (SELECT count(*) FROM final WHERE split = 'train') AS train_posts,
  (SELECT count(*) FROM final WHERE split = 'test') AS test_posts,
  (SELECT round(avg(n_words), 6) FROM final) AS mean_words_per_post,
  (SELECT {_ROOT} FROM branches) AS data_hash
FROM worded"""


def _rounded(report):
    return report.withColumn("mean_words_per_post", F.round("mean_words_per_post", 6))


@query("prep_report", _report(comments=False))
def prep_report(spark, sf_dir):
    return _rounded(prep.prepare(inputs.posts(spark, sf_dir)).report)


@query("prep_report_with_comments", _report(comments=True))
def prep_report_with_comments(spark, sf_dir):
    raw = inputs.posts(spark, sf_dir, comments=True)
    return _rounded(prep.prepare(raw, include_comments=True).report)


@query("data_hash", f"""WITH {twins.tagged()},
{_BRANCHES}
SELECT {_ROOT} AS data_hash, CAST(sum(n) AS BIGINT) AS n_ids FROM branches""")
def data_hash(spark, sf_dir):
    return prep.fingerprint(prep.prepare(inputs.posts(spark, sf_dir)).rows)


@query("train_test_overlap", f"""WITH {twins.tagged()}
SELECT count(*) AS n_shared_ids FROM final a JOIN final b USING (id)
WHERE a.split = 'train' AND b.split = 'test'""")
def train_test_overlap(spark, sf_dir):
    shared = prep.overlap(prep.prepare(inputs.posts(spark, sf_dir)))
    return shared.agg(F.count(F.lit(1)).alias("n_shared_ids"))


@query("hash_order", """SELECT CAST(doc_id AS VARCHAR) AS id, md5('0:' || doc_id) AS sort_key,
       row_number() OVER (ORDER BY md5('0:' || doc_id), CAST(doc_id AS VARCHAR)) AS position
FROM documents""")
def hash_order(spark, sf_dir):
    """The seeded shuffle as a rank, without a global sort in one task."""
    from tidewatch.plans.ranking import rank_within
    df = inputs.documents(spark, sf_dir).select(
        "id", numeric.seeded_hash(F.col("id"), 0).alias("sort_key"))
    return rank_within(df, [], numeric.hash_digits(F.col("sort_key")),
                       [F.col("sort_key"), F.col("id")], "position")

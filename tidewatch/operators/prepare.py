"""Raw posts to a cleaned, split data set in which every removed row is accounted for.

Two passes over the raw posts. The narrow one reads only keys, labels, times and titles and decides
the fate of every title key; the wide one collapses copies map-side, joins the decision on the title
key (unique on both sides) and builds the text. No step gathers a title key, a community or a set of
copies in one task.
"""
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.functions import numeric, text as tx
from tidewatch.plans.ranking import (
    WINDOW_LIMIT, largest_group, rank_within, running_totals)
from tidewatch.plans.skew import join_groups
from tidewatch.schemas import COMMENTS
from tidewatch.session import settle

# Identifiers with the label, and what can be known when a post is submitted.
KEY_COLUMNS = ("id", "subreddit", "created_utc", "snapshot_utc")
SUBMISSION_TIME_FEATURES = (
    "title", "body", "flair", "is_self", "domain", "over_18", "spoiler")
ORDER_COLUMNS = ("snapshot_utc", "created_utc", "id")

NULL_LABEL, CONFLICT, REPEAT, TOO_SHORT = (
    "null_label", "cross_posted_conflict", "duplicate_within_subreddit", "too_short")


# --- text ---------------------------------------------------------------------

def _or_null(df, name, kind):
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def parsed_comments(comments_json):
    return F.coalesce(F.from_json(comments_json, COMMENTS), F.array().cast(COMMENTS))


def joined_text(df, include_comments=False):
    """Title, body and (for analysis only) kept comments, before any cleaning."""
    parts = [F.array(tx.or_empty(F.col("title")), tx.or_empty(_or_null(df, "body", "string")))]
    if include_comments:
        parts.append(tx.kept_comments(parsed_comments(_or_null(df, "comments_json", "string"))))
    return tx.join_parts(*parts)


def assemble(df, include_comments=False):
    """Adds the cleaned `text`, and `n_comments_kept` when comments are included."""
    if include_comments:
        kept = tx.kept_comments(parsed_comments(_or_null(df, "comments_json", "string")))
        df = df.withColumn("n_comments_kept", F.size(kept))
    return df.withColumn(
        "text", tx.normalise(tx.strip_leakage(joined_text(df, include_comments))))


def _total_of_class(classes, name):
    return F.coalesce(F.sum(F.size(F.filter(classes, lambda c: c == name))), F.lit(0))


def cleaning_counts(df, include_comments=False):
    """One row: how much leakage and how many comments of each class the raw posts hold."""
    df = df.withColumn("_joined", joined_text(df, include_comments))
    df = df.withColumn("_unmentioned", tx.drop_mentions(F.col("_joined")))
    aggregates = [
        F.count(F.lit(1)).alias("input_posts"),
        F.coalesce(F.sum(tx.count_mentions(F.col("_joined"))), F.lit(0))
        .alias("subreddit_mentions"),
        F.coalesce(F.sum(tx.count_self_references(F.col("_unmentioned"))), F.lit(0))
        .alias("self_references")]
    classes = ("kept", "bot", "moderator_or_stickied", "deleted_or_removed")
    if include_comments:
        df = df.withColumn("_classes", F.transform(
            parsed_comments(_or_null(df, "comments_json", "string")), tx.comment_class))
    for name in classes:
        n = _total_of_class("_classes", name) if include_comments else F.lit(None).cast("long")
        aggregates.append(n.alias(f"comments_{name}"))
    return df.agg(*aggregates).withColumn("comments_included", F.lit(include_comments))


def contract_columns(columns, include_comments=False):
    keep = [c for c in (*KEY_COLUMNS, *SUBMISSION_TIME_FEATURES) if c in columns] + ["text"]
    if include_comments and "n_comments_kept" in columns:
        keep.append("n_comments_kept")
    return keep


def apply_contract(df, include_comments=False):
    """Identifiers, label and what exists at submission time; nothing measured later."""
    return df.select(*contract_columns(df.columns, include_comments))


def contract_report(columns, include_comments=False):
    kept = contract_columns([*columns, "text", "n_comments_kept"], include_comments)
    added = {"text", "n_comments_kept"} if include_comments else {"text"}
    return {
        "features": [c for c in SUBMISSION_TIME_FEATURES if c in columns] + ["text"],
        "text_includes_comments": include_comments,
        "dropped_columns": sorted(set(columns) - set(kept) - added)}


# --- duplicates ---------------------------------------------------------------

def _order(df, order_by):
    return [F.col(c) for c in order_by if c in df.columns]


def title_groups(df, order_by=ORDER_COLUMNS, empty_key="drop"):
    """One narrow row per title key: size, whether communities disagree, and its first post.

    `empty_key="keep"` exempts titles without any latin letter or digit, which otherwise all share
    the empty key, by giving each of them a key of its own.
    """
    return (_with_title_key(df, empty_key).groupBy("title_key")
            .agg(F.count(F.lit(1)).alias("n_posts"),
                 F.coalesce(F.min("subreddit") != F.max("subreddit"), F.lit(False))
                 .alias("conflict"),
                 F.min(F.struct(*[F.col(c).alias(f"_{i}") for i, c in
                                  enumerate(c for c in order_by if c in df.columns)],
                                "subreddit", F.col("id").alias("post_id"),
                                F.col("created_utc").cast("double").alias("created")))
                 .alias("first"))
            .select("title_key", "n_posts", "conflict", F.col("first.post_id").alias("id"),
                    F.col("first.subreddit").alias("subreddit"),
                    F.col("first.created").alias("created_utc")))


def _with_title_key(df, empty_key):
    if empty_key not in ("drop", "keep"):
        raise ValueError(f"empty_key must be 'drop' or 'keep', got {empty_key!r}")
    key = tx.title_key(F.col("title"))
    if empty_key == "keep":
        key = F.when(key == "", F.concat(F.lit("#"), F.col("id").cast("string"))).otherwise(key)
    return df.withColumn("title_key", key)


def _first_post(df, order_by, columns=None):
    """Aggregate: the first post of a group, as a struct of `columns`, all of them by default.

    Posts equal in the order and the community are told apart by the hash of all columns; columns that
    such posts share need no hash, so that nothing else is read or moved.
    """
    settled = {*order_by, "subreddit"}
    ties = [] if columns and settled.issuperset(columns) else [F.xxhash64(*df.columns)]
    return F.min_by(F.struct(*(columns or df.columns)),
                    F.struct(*_order(df, order_by), F.col("subreddit"), *ties)).alias("_post")


def first_posts(df, order_by=ORDER_COLUMNS, empty_key="drop"):
    """The first post of every title key with all its columns, plus `title_key`."""
    return (_with_title_key(df, empty_key).groupBy("title_key")
            .agg(_first_post(df, order_by)).select("title_key", "_post.*"))


def deduplicate(df, order_by=ORDER_COLUMNS, empty_key="drop", columns=None):
    """Titles used by several communities lose every copy; the others keep their first post.

    `columns` names the columns wanted, all by default; the others are not moved.
    """
    agreed = F.coalesce(F.min("subreddit") == F.max("subreddit"), F.lit(True))
    return (_with_title_key(df, empty_key).groupBy("title_key")
            .agg(agreed.alias("_agreed"), _first_post(df, order_by, columns))
            .where("_agreed").select("_post.*"))


def duplicate_counts(groups):
    """One row of removal counts from `title_groups`."""
    def total(value):
        return F.coalesce(F.sum(value), F.lit(0))
    agreed = ~F.col("conflict")
    return groups.agg(
        total(F.when(F.col("conflict"), F.col("n_posts"))).alias(CONFLICT),
        total(F.when(agreed, F.col("n_posts") - 1)).alias(REPEAT),
        total(F.when(agreed & F.col("subreddit").isNull(), F.lit(1))).alias(NULL_LABEL))


# --- split --------------------------------------------------------------------

def _split_keys(df, method, seed):
    """Adds the ascending sort key of the split (test rows first) and the tie-break hash."""
    if method == "temporal":
        created = F.when(F.isnan("created_utc"), None).otherwise(F.col("created_utc"))
        # Rows without a time sort as the newest.
        key = -F.coalesce(created, F.lit(1e11))
        digits = numeric.time_digits(F.col("_key"))
        tie = F.md5(F.col("id").cast("string"))
    elif method == "random":
        tie = numeric.seeded_hash(F.col("id"), seed)
        key, digits = F.substring(tie, 1, 4), []
    else:
        raise ValueError(f"unknown split method {method!r}")
    return df.withColumn("_tie", tie).withColumn("_key", key), digits


def _test_size(n_posts, test_fraction):
    return F.greatest(F.lit(1), F.bround(n_posts * F.lit(test_fraction))).cast("long")


def split_cuts(df, test_fraction=0.2, method="temporal", seed=42, window_limit=WINDOW_LIMIT):
    """Per community the last row that still belongs to test, found without ranking all rows.

    Rows are counted per (community, sort key) and added up; only the rows that share the key at
    the border are ranked by hash.
    """
    rows, digits = _split_keys(df.where(F.col("subreddit").isNotNull()), method, seed)
    cells = rows.groupBy("subreddit", "_key").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(cells, ["subreddit"], digits, ["n"], [F.col("_key")])
    border = (ranked.withColumn("n_test", _test_size(F.col("total_n"), test_fraction))
              .where((F.col("before_n") < F.col("n_test"))
                     & (F.col("n_test") <= F.col("before_n") + F.col("n")))
              .select("subreddit", "_key", F.col("total_n").alias("n_posts"), "n_test",
                      (F.col("n_test") - F.col("before_n")).alias("_need"),
                      (F.col("n_test") - F.col("before_n") == F.col("n")).alias("_all")))
    partial = border.where(~F.col("_all")).select("subreddit", "_key", "_need")
    tied = join_groups(rows.select("subreddit", "_key", "_tie", "id"), partial,
                       ["subreddit", "_key"])
    last = (rank_within(tied, ["subreddit"], numeric.hash_digits(F.col("_tie")),
                        [F.col("_tie"), F.col("id")], window_limit=window_limit)
            .where(F.col("rn") == F.col("_need"))
            .select("subreddit", F.struct("_tie", "id").alias("_last")))
    return (border.join(last, "subreddit", "left")
            .select("subreddit", "n_posts", "n_test",
                    F.struct(F.col("_key").alias("key"), F.col("_all").alias("whole"),
                             F.col("_last").alias("last")).alias("_cut")))


def with_split(df, test_fraction=0.2, method="temporal", seed=42, window_limit=WINDOW_LIMIT,
               largest=None):
    """Adds `split`; rows without a community are left out.

    While the largest community (counted, or bounded by `largest`) is within `window_limit` a plain
    window ranks the rows; larger ones are compared with their community's cut. Rows that are read
    more than once, to be counted or cut, are written once before.
    """
    if largest is None or largest > window_limit:
        df = settle(df)
    rows, _ = _split_keys(df.where(F.col("subreddit").isNotNull()), method, seed)
    if largest is None:
        largest = largest_group(rows, ["subreddit"])
    if largest <= window_limit:
        community = Window.partitionBy("subreddit")
        rank = F.row_number().over(community.orderBy("_key", "_tie", "id"))
        in_test = rank <= _test_size(F.count(F.lit(1)).over(community), test_fraction)
        return rows.withColumn("split", F.when(in_test, "test").otherwise("train")) \
            .drop("_key", "_tie")
    cuts = split_cuts(df, test_fraction, method, seed, window_limit)
    in_test = ((F.col("_key") < F.col("_cut.key"))
               | ((F.col("_key") == F.col("_cut.key"))
                  & (F.col("_cut.whole")
                     | F.coalesce(F.struct("_tie", "id") <= F.col("_cut.last"), F.lit(False)))))
    return (join_groups(rows, cuts.select("subreddit", "_cut"), ["subreddit"])
            .withColumn("split", F.when(in_test, "test").otherwise("train"))
            .drop("_key", "_tie", "_cut"))


def split_report(split_rows, method="temporal"):
    """Per community: rows, test rows, and for the temporal split when the test period starts."""
    test = F.col("split") == "test"
    starts = (F.min(F.when(test & ~F.isnan("created_utc"), F.col("created_utc")))
              if method == "temporal" else F.lit(None).cast("double"))
    return split_rows.groupBy("subreddit").agg(
        F.count(F.lit(1)).alias("n_posts"), F.count_if(test).alias("n_test"),
        starts.alias("test_starts_utc"))


# --- fingerprint --------------------------------------------------------------

# Hex digits of an id's hash that name its leaf, and the branch the leaf hangs on.
LEAF_DIGITS, BRANCH_DIGITS = 6, 3


def _joined_hash(rows, *names):
    lines = F.transform(F.sort_array(rows), lambda r: F.concat_ws(":", *[r[n] for n in names]))
    return F.sha2(F.array_join(lines, "\n"), 256)


def _branches(df, counts=None, kept=None):
    """Branch hashes of each split, with any further counts of the same rows added up."""
    ids, counts = F.col("id").cast("string"), counts or {}
    digits = F.md5(ids)
    listed = F.collect_list(ids if kept is None else F.when(kept, ids))
    leaves = df.groupBy("split", F.substring(digits, 1, LEAF_DIGITS).alias("bucket")).agg(
        F.sha2(F.array_join(F.sort_array(listed), "\n"), 256).alias("leaf"), F.size(listed).alias("n_ids"),
        *[count.alias(name) for name, count in counts.items()])
    below = F.collect_list(F.when(F.col("n_ids") > 0, F.struct("bucket", "leaf")))
    return leaves.groupBy("split", F.substring("bucket", 1, BRANCH_DIGITS).alias("branch")).agg(
        _joined_hash(below, "bucket", "leaf").alias("leaf"), *[F.sum(c).alias(c) for c in ("n_ids", *counts)]
    ).withColumnRenamed("branch", "bucket")


def _root():
    listed = F.collect_list(F.when(F.col("n_ids") > 0, F.struct("split", "bucket", "leaf")))
    return F.substring(_joined_hash(listed, "split", "bucket", "leaf"), 1, 12)


def fingerprint(df):
    """One row that names the exact content of a split, whatever the row order.

    A hash tree over the hashes of the ids, of a fixed shape, so that the value depends on the ids
    alone: the sorted ids of a leaf (16**6 of them) are hashed, then the leaves of a branch (16**3),
    then the branches of both splits. No task holds more than one leaf's ids or 4,096 hashes a split.
    """
    return _branches(df).agg(
        _root().alias("data_hash"), F.coalesce(F.sum("n_ids"), F.lit(0)).alias("n_ids"))


# --- the whole preparation ----------------------------------------------------

@dataclass
class Prepared:
    """`tagged` holds every surviving title's first post with `split` and `removed_reason`."""
    tagged: DataFrame
    groups: DataFrame
    cleaning: DataFrame
    split_info: DataFrame
    contract: dict

    @property
    def rows(self):
        return self.tagged.where(F.col("removed_reason").isNull()).drop(
            "removed_reason", "n_words")

    @property
    def train(self):
        return self.rows.where(F.col("split") == "train").drop("split")

    @property
    def test(self):
        return self.rows.where(F.col("split") == "test").drop("split")

    @property
    def class_balance(self):
        return class_balance(self.rows)

    @property
    def report(self):
        return prep_report(self)


def class_balance(rows):
    return rows.groupBy("split", "subreddit").agg(F.count(F.lit(1)).alias("n"))


def mean_words(rows):
    return rows.agg(F.avg(tx.spaced_word_count(F.col("text"))).alias("mean_words_per_post"))


def prepare(raw, *, min_words=3, test_fraction=0.2, split="temporal", seed=42,
            include_comments=False, order_by=ORDER_COLUMNS, empty_key="drop",
            window_limit=WINDOW_LIMIT):
    groups = title_groups(raw, order_by, empty_key)
    # Preparation only removes rows, so the raw communities bound the sizes to be split.
    decided = with_split(groups.where(~F.col("conflict")), test_fraction, split, seed,
                         window_limit, largest_group(raw, ["subreddit"]))
    wide = first_posts(raw, order_by, empty_key).join(
        decided.select("title_key", "split"), "title_key")
    wide = assemble(wide, include_comments)
    kept = contract_columns([*raw.columns, "n_comments_kept"], include_comments)
    tagged = (wide.select(*kept, "split", tx.spaced_word_count(F.col("text")).alias("n_words"))
              .withColumn("removed_reason",
                          F.when((F.col("split") == "train") & (F.col("n_words") < min_words),
                                 TOO_SHORT)))
    return Prepared(
        tagged=tagged, groups=groups, cleaning=cleaning_counts(raw, include_comments),
        split_info=split_report(decided, split),
        contract=contract_report(raw.columns, include_comments)
        | {"min_words": min_words, "test_fraction": test_fraction, "method": split})


def prep_report(prepared):
    """One row that accounts for every input row."""
    kept, short = F.col("removed_reason").isNull(), F.col("n_words") < prepared.contract["min_words"]
    # Counts ride along with the fingerprint: the texts are assembled once.
    outcome = _branches(prepared.tagged, {
        "short_train": F.count_if(~kept),
        "short_test": F.count_if((F.col("split") == "test") & short),
        "words": F.sum(F.when(kept, F.col("n_words")))}, kept)
    in_split = {name: F.coalesce(F.sum(F.when(F.col("split") == name, F.col("n_ids"))), F.lit(0))
                for name in ("train", "test")}
    outcome = outcome.agg(
        F.coalesce(F.sum("short_train"), F.lit(0)).alias("too_short_removed_from_train"),
        F.coalesce(F.sum("short_test"), F.lit(0)).alias("short_posts_kept_in_test"),
        F.coalesce(F.sum("n_ids"), F.lit(0)).alias("output_posts"),
        in_split["train"].alias("train_posts"), in_split["test"].alias("test_posts"),
        numeric.share(F.sum("words"), F.sum("n_ids")).alias("mean_words_per_post"),
        _root().alias("data_hash"))
    # Every part is one row: stack them and take the one value of each column.
    stacked = prepared.cleaning
    for part in (duplicate_counts(prepared.groups), outcome):
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def overlap(prepared):
    """Ids present in both train and test; always empty."""
    return prepared.train.join(prepared.test.select("id"), "id", "left_semi")

"""Exploratory statistics of the corpus."""
import math

from pyspark.sql import Window, functions as F

from tidewatch.functions import numeric, text as tx
from tidewatch.plans.quantiles import exact_quantiles
from tidewatch.plans.ranking import top_within
from tidewatch.plans.selection import column_quantiles
from tidewatch.plans.skew import join_groups, join_keys

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def dataset_profile(corpus, pattern):
    """Size, empty bodies, median title length and how often no franchise token occurs."""
    no_token = ~tx.has_token(tx.title_body(F.col("title"), F.col("body")), pattern)
    return corpus.agg(
        F.count(F.lit(1)).alias("n_posts"),
        F.avg(tx.is_blank(F.col("body")).cast("double")).alias("empty_body_rate"),
        F.percentile(tx.word_count(tx.or_empty(F.col("title"))), F.lit(0.5))
        .alias("median_title_words"),
        F.avg(no_token.cast("double")).alias("no_franchise_token_rate"))


def fill_flair(df, flair="flair", value="No flair"):
    return df.fillna({flair: value})


def null_counts(df):
    """Nulls per column, in one row per column and one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null"))
                        for c in df.columns])
    return counts.select(F.explode(entries).alias("e")).select("e.*")


def count_by(df, *columns):
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def share_by(df, group, column):
    """Count and percentage of each value of `column` within its group."""
    counts = count_by(df, group, column)
    total = F.sum("n").over(Window.partitionBy(group))
    return counts.withColumn("percent", 100 * F.col("n") / total)


def body_fill_counts(df, body="body", group=()):
    empty = tx.is_blank(F.col(body))
    return df.groupBy(*group).agg(F.count_if(~empty).alias("n_full"),
                                  F.count_if(empty).alias("n_empty"))


def posts_per_month(df, created="created_utc", group=("subreddit",)):
    return count_by(df.withColumn("month", numeric.month_of(F.col(created))), *group, "month")


def describe(df, columns):
    """count, mean, std, min, quartiles and max of numeric columns, one row each.

    One pass for the moments of all columns, and one per refinement for their quartiles; nulls and NaN
    are left out, and a column without any other value has no row.
    """
    def of(c):
        v = F.col(c).cast("double")
        v = F.when(~F.isnan(v), v)
        return [F.count(v), F.avg(v), F.stddev_samp(v), F.min(v), F.max(v)]

    moments = df.agg(*[F.struct(*[m.alias(f"m{k}") for k, m in enumerate(of(c))]).alias(f"c{i}")
                       for i, c in enumerate(columns)]).first()
    filled = {c: tuple(row) for c, row in zip(columns, moments) if row[0]}
    quartiles = column_quantiles(df, {c: row[0] for c, row in filled.items()}, QUARTILES)
    return df.sparkSession.createDataFrame(
        [(c, *row, *quartiles[c].values()) for c, row in filled.items()],
        "column string, count long, mean double, std double, min double, max double, "
        + ", ".join(f"{name} double" for name in QUARTILES))


def _value_cells(df, group, value):
    """Distinct values and how often they occur: copies no longer count as rows."""
    v = F.col(value).cast("double")
    return (df.select(*group, v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
            .groupBy(*group, "v").agg(F.count(F.lit(1)).alias("n")))


def histogram(df, value, bins=30, group=("subreddit",)):
    """Equal-width bins between each group's own minimum and maximum, empty bins included."""
    group = list(group)
    cells = _value_cells(df, group, value)
    limits = cells.groupBy(*group).agg(F.min("v").alias("_low"), F.max("v").alias("_high"))
    limits = limits.withColumn("_width", (F.col("_high") - F.col("_low")) / bins)
    bin_of = F.least(F.floor(F.coalesce(
        F.try_divide(F.col("v") - F.col("_low"), F.col("_width")), F.lit(0.0))), F.lit(bins - 1))
    counts = (join_groups(cells, limits, group)
              .groupBy(*group, bin_of.cast("int").alias("bin")).agg(F.sum("n").alias("n")))
    last = F.when(F.col("_width") == 0, 0).otherwise(bins - 1)
    edges = limits.withColumn("bin", F.explode(F.sequence(F.lit(0), last)))
    return join_keys(edges, counts, [*group, "bin"], "left").select(
        *group, "bin", (F.col("_low") + F.col("bin") * F.col("_width")).alias("low"),
        F.when(F.col("bin") == last, F.col("_high"))
        .otherwise(F.col("_low") + (F.col("bin") + 1) * F.col("_width")).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"))


def box_stats(df, value, group):
    """Quartiles, whiskers at the outermost points within 1.5 IQR, and outliers beyond them."""
    group = list(group)
    quartiles = exact_quantiles(df, group, value, QUARTILES)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    quartiles = quartiles.withColumn("_low", F.col("q1") - reach).withColumn(
        "_high", F.col("q3") + reach)
    inside = F.col("v").between(F.col("_low"), F.col("_high"))
    return (join_groups(_value_cells(df, group, value), quartiles, group)
            .groupBy(*group, "q1", "median", "q3")
            .agg(F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
                 F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
                 F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("n_outliers")))


def kde_curve(df, value, points=200, group=("subreddit",)):
    """Gaussian kernel density with Scott's bandwidth on a grid from minimum to maximum.

    Each distinct value adds to `points` sums that are combined before the shuffle.
    """
    group = list(group)
    cells = _value_cells(df, group, value)
    v, n = F.col("v"), F.col("n")
    stats = df.select(*group, F.col(value).cast("double").alias("v")).where(
        F.col("v").isNotNull() & ~F.isnan("v")).groupBy(*group).agg(
        F.count("v").alias("_n"), F.stddev_samp("v").alias("_std"),
        F.min("v").alias("_low"), F.max("v").alias("_high"))
    stats = stats.where(F.col("_std") > 0).withColumn(
        "_h", F.col("_std") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    at = F.col("_low") + F.col("point") * (F.col("_high") - F.col("_low")) / (points - 1)
    kernel = n * F.exp(-0.5 * F.pow((at - v) / F.col("_h"), 2))
    spread = join_groups(cells, stats, group).withColumn(
        "point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    scale = F.max("_n") * F.max("_h") * math.sqrt(2 * math.pi)
    return spread.groupBy(*group, "point").agg(
        F.max(at).alias("x"), (F.sum(kernel) / scale).alias("density"))


def top_tokens(df, tokens, n=25, group=("subreddit",)):
    """The `n` most frequent entries of a token array per group; ties by token."""
    counts = (df.select(*group, F.explode(tokens).alias("token"))
              .groupBy(*group, "token").agg(F.count(F.lit(1)).alias("n")))
    return top_within(counts, list(group), [F.col("n").desc(), F.col("token")], n, "rank")

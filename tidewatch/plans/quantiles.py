"""Exact quantiles without holding a group's values in memory."""
from pyspark.sql import functions as F

from tidewatch.functions.numeric import double_digits
from tidewatch.plans.ranking import WINDOW_LIMIT, largest_group, running_totals


def exact_quantiles(df, group, value, quantiles, window_limit=WINDOW_LIMIT):
    """Linearly interpolated quantiles of a numeric column; nulls and NaN are left out.

    `quantiles` maps result names to probabilities. The built-in `percentile` keeps all distinct
    values of a group in memory, so it only serves groups within `window_limit`. Beyond, distinct
    values are counted, ranked by their digits, and each quantile picks the one or two values its
    position falls on.
    """
    v = F.col(value).cast("double")
    values = df.select(*group, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if largest_group(values, group) <= window_limit:
        return values.groupBy(*group).agg(
            *[F.percentile("_v", F.lit(p)).alias(name) for name, p in quantiles.items()])
    cells = values.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(cells, group, double_digits(F.col("_v")), ["n"], [F.col("_v")])

    def at(rank):
        inside = (F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n"))
        return F.max(F.when(inside, F.col("_v")))

    aggregates = []
    for name, p in quantiles.items():
        position = (F.col("total_n") - 1) * F.lit(float(p))
        low, high = at(F.floor(position)), at(F.ceil(position))
        fraction = F.max(position - F.floor(position))
        between = F.when(F.abs(high - low) == float("inf"), (1 - fraction) * low + fraction * high).otherwise(
            low + (high - low) * fraction)                       # an infinity on one side
        aggregates.append(F.when((fraction == 0) | (low == high), low).otherwise(between).alias(name))
    return ranked.groupBy(*group).agg(*aggregates)

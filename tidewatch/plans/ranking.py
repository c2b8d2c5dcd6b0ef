"""Ordering within groups when one group may hold a large part of all rows.

`row_number() over (partition by group)` sends a group to one task, which is right while the largest
group is known to be small. Beyond that the helpers rank by digits of the sort key: counts per digit
are added up level by level, so that no window ever sees more rows than a digit has values, and only
rows equal in every digit meet in one task.
"""
from pyspark.sql import Window, functions as F

from tidewatch.plans.skew import join_keys
from tidewatch.session import settle

# Rows of one group that may be sorted in one task.
WINDOW_LIMIT = 1_000_000


def largest_group(df, group):
    """Size of the largest group: one aggregation over the group columns, one number back."""
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def running_totals(cells, group, digits, measures, order):
    """Sums of `measures` over the rows that sort before each cell, and over its whole group.

    `cells` has one row per distinct (group, order), and the digits are ever finer views of the order,
    coarsest first; all ascending. Adds `before_<m>` and `total_<m>`.
    """
    names = [f"_level{i}" for i in range(len(digits))]
    cells = cells.select("*", *[d.alias(n) for d, n in zip(digits, names)])
    above = None
    for depth in range(len(names) + 1):
        last = depth == len(names)
        outer, here = [*group, *names[:depth]], names[depth:depth + 1]
        level = cells if last else cells.groupBy(*outer, *here).agg(
            *[F.sum(m).alias(m) for m in measures])
        earlier = (Window.partitionBy(*outer).orderBy(*(order if last else here))
                   .rowsBetween(Window.unboundedPreceding, -1))
        added = {f"before_{m}": F.coalesce(F.sum(m).over(earlier), F.lit(0)) for m in measures}
        if above is None:
            whole = Window.partitionBy(*outer)
            added.update({f"total_{m}": F.sum(m).over(whole) for m in measures})
            level = level.withColumns(added)
        else:
            level = level.withColumns({f"_{k}": v for k, v in added.items()})
            level = join_keys(level, above, outer)
            level = level.withColumns(
                {k: F.col(k) + F.col(f"_{k}") for k in added}).drop(*[f"_{k}" for k in added])
        above = level if last else level.drop(*measures)
    return above.drop(*names)


def rank_all(df, order, alias="rn"):
    """`row_number()` over all rows: they are dealt by ranges of the order, numbered within each, and
    the sizes of the ranges before are added. One number a range comes to the driver."""
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settle(sorted_rows.withColumn("_at", F.monotonically_increasing_id()))
    in_range = F.shiftright("_at", 33)                       # how these ids are made up
    before, offsets = 0, []
    for row in sorted(placed.groupBy(in_range.alias("range")).count().collect()):
        offsets.append((row["range"], before))
        before += row["count"]
    ranges = df.sparkSession.createDataFrame(offsets, "_range long, _before long")
    return placed.join(F.broadcast(ranges), in_range == F.col("_range")).withColumn(
        alias, F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1).drop("_at", "_range", "_before")


def rank_within(df, group, digits, order, alias="rn", window_limit=WINDOW_LIMIT):
    """`row_number()` over (group order by order); `digits` are coarser views of the same order.

    The digits are only used when some group exceeds `window_limit`; without a group rows are ranked
    by ranges (`rank_all`).
    """
    if not group:
        return rank_all(df, order, alias)
    if largest_group(df, group) <= window_limit:
        window = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn(alias, F.row_number().over(window).cast("long"))
    names = [f"_digit{i}" for i in range(len(digits))]
    rows = df.select("*", *[d.alias(n) for d, n in zip(digits, names)])
    counts = rows.groupBy(*group, *names).agg(F.count(F.lit(1)).alias("_n"))
    coarse, fine = [F.col(n) for n in names[:-1]], [F.col(n) for n in names[-1:]]
    offsets = running_totals(counts, group, coarse, ["_n"], fine) \
        .select(*group, *names, "before__n")
    inner = Window.partitionBy(*group, *names).orderBy(*order)
    return (join_keys(rows, offsets, [*group, *names])
            .withColumn(alias, F.row_number().over(inner) + F.col("before__n"))
            .drop(*names, "before__n"))


def keep_first(df, keys, order):
    """The first row of every key. Copies collapse map-side, so a hot key costs one row per task."""
    ties = F.xxhash64(*df.columns)
    return (df.groupBy(*keys)
            .agg(F.min_by(F.struct(*df.columns), F.struct(*order, ties)).alias("_row"))
            .select("_row.*"))


def top_by_ranges(df, group, order, n, alias="rn"):
    """The first `n` rows of every group for any `n`: no task ever holds a group, or its first rows.

    Rows are dealt by ranges of (group, order), so a group lies in runs of neighbouring rows of a few
    ranges. The sizes of a group's earlier runs give the rank of a run's first row; runs that start
    beyond `n` are dropped. Rows equal in all of `order` share a range.
    """
    keys = [F.col(g) for g in group]
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = settle(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn(
        "_range", F.shiftright("_at", 33))                   # how these ids are made up
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).where(
        F.col("_before") < n).drop("_n")
    ranked = join_keys(placed, runs, [*group, "_range"]).withColumn(
        alias, F.col("_at") - F.col("_first") + F.col("_before") + 1)
    return ranked.where(F.col(alias) <= n).drop("_at", "_range", "_first", "_before").withColumn(
        alias, F.col(alias).cast("int"))


def top_within(df, group, order, n, alias="rn", spread=64):
    """The first `n` rows of every group.

    For n up to 1,000 Spark prunes each map task to `n` rows per group; what the tasks leave is cut
    once more by `spread` groups of tasks, so that the last task gets at most n * spread rows of a
    group however many tasks there were. A larger n goes by ranges.
    """
    if n > 1000:
        return top_by_ranges(df, group, order, n, alias)

    def cut(rows, keys):
        window = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumn(alias, F.row_number().over(window)).where(F.col(alias) <= n)
    sliced = df.withColumn("_slice", F.spark_partition_id() % spread)
    return cut(cut(sliced, [*group, "_slice"]).drop("_slice", alias), group)

"""Exact order statistics of many columns at once, by histograms that are refined where it matters.

A double is read as a 64-bit integer of the same order. A pass over the columns counts, per column, the
next 16 bits of the values whose bits so far are those of a wanted value; the counts added up tell which
cell holds each wanted rank and how many values lie before it. A cell with one distinct value is an
answer, so few passes need all four digits. Every pass reads the columns once, in their own layout; a
task keeps 65,536 cells per wanted value and column however many rows it has, and the driver gets one
row per wanted value.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

BITS = 16
_LOW = np.int64(0x7FFFFFFFFFFFFFFF)


def order_keys(values):
    """int64 keys in the order of the doubles; both zeros are one."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ _LOW, bits)


def key_values(keys):
    keys = np.asarray(keys, np.int64)
    return np.where(keys < 0, keys ^ _LOW, keys).view(np.float64)


def _cells_of(keys, parents, shift):
    """Cells of one batch below `parents`: id, number of values, least and greatest key."""
    if shift + BITS < 64:
        keys = keys[np.isin(keys >> (shift + BITS), parents)]
    keys = np.sort(keys)
    cells = keys >> shift
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
    return cells[starts], np.diff(np.r_[starts, len(cells)]), keys[starts], keys[np.r_[starts[1:], len(cells)] - 1] if len(cells) else keys


def _counter(parents, shift):
    """The task function of a pass; `parents` has the wanted prefixes of every column still open."""
    def count(batches):
        held = {}
        for c, prefixes in parents.items():
            size = len(prefixes) << BITS
            held[c] = (np.zeros(size, np.int64), np.full(size, _LOW), np.full(size, ~_LOW))
        for batch in batches:
            for c, prefixes in parents.items():
                values = batch.column(c).to_numpy(zero_copy_only=False)
                cells, n, low, high = _cells_of(order_keys(values[~np.isnan(values)]), prefixes, shift)
                if not len(cells):
                    continue
                above = cells >> BITS if shift + BITS < 64 else np.zeros(len(cells), np.int64)
                at = (np.searchsorted(prefixes, above) << BITS) + (cells & ((1 << BITS) - 1))
                counts, lows, highs = held[c]
                counts[at] += n
                lows[at] = np.minimum(lows[at], low)
                highs[at] = np.maximum(highs[at], high)
        for c, (counts, lows, highs) in held.items():
            at = np.flatnonzero(counts)
            cells = lows[at] >> shift
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), c, np.int32)), pa.array(cells), pa.array(counts[at]), pa.array(lows[at]),
                 pa.array(highs[at])], names=["c", "cell", "n", "low", "high"])
    return count


def values_at(df, columns, ranks):
    """The values at the given ranks (from 0) of each column's values in ascending order.

    `ranks` maps a column to the ranks wanted of it, which must lie below its number of values; nulls and
    NaN are not counted. Returns {(column, rank): value}.
    """
    spark = df.sparkSession
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    found = {}
    open_ranks = {(i, r): (0, r) for i, c in enumerate(columns) for r in set(ranks.get(c, ()))}
    for shift in range(64 - BITS, -1, -BITS):
        if not open_ranks:
            break
        parents = {}
        for (i, _), (prefix, _) in open_ranks.items():
            parents.setdefault(i, set()).add(prefix)
        parents = {i: np.array(sorted(p), np.int64) for i, p in parents.items()}
        counted = numbers.mapInArrow(_counter(parents, shift), "c int, cell long, n long, low long, high long").groupBy(
            "c", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        parent = F.shiftright("cell", BITS) if shift + BITS < 64 else F.lit(0).cast("long")
        before = Window.partitionBy("c", "parent").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        sums = counted.withColumn("parent", parent).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        wanted = spark.createDataFrame([(i, p, r, rest) for (i, r), (p, rest) in open_ranks.items()],
                                       "c int, parent long, rank long, rest long")
        hits = sums.join(F.broadcast(wanted), ["c", "parent"]).where(
            (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")))
        open_ranks = {}
        for row in hits.select("c", "rank", "cell", "low", "high", (F.col("rest") - F.col("before")).alias("rest")).collect():
            if row["low"] == row["high"]:
                found[columns[row["c"]], row["rank"]] = float(key_values([row["low"]])[0])
            else:
                open_ranks[row["c"], row["rank"]] = (row["cell"], row["rest"])
    return found


def interpolated(found, column, n, p):
    """The quantile `p` of a column of `n` values, linear between the two it lies between."""
    position = (n - 1) * p
    low, high = found[column, int(np.floor(position))], found[column, int(np.ceil(position))]
    fraction = position - np.floor(position)
    if fraction == 0 or low == high:
        return low
    if np.isinf(high - low):
        return (1 - fraction) * low + fraction * high
    return low + (high - low) * fraction


def column_quantiles(df, counts, quantiles):
    """{column: {name: value}} for columns with the given numbers of values (none are zero)."""
    ranks = {c: {int(f((n - 1) * p)) for p in quantiles.values() for f in (np.floor, np.ceil)} for c, n in counts.items()}
    found = values_at(df, list(counts), ranks)
    return {c: {name: float(interpolated(found, c, n, p)) for name, p in quantiles.items()} for c, n in counts.items()}

"""Joins of many rows to one row per group, for groups of any size."""
from pyspark.sql import functions as F


def salt_count(df, salts=None):
    return salts or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def join_keys(left, right, keys, how="inner"):
    """Equi-join on `keys`, where null is a key like any other; `right` loses its key columns."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(renamed[f"_right_{k}"])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def join_groups(facts, groups, keys, how="inner", salts=None, spread=None):
    """`facts` joined to `groups` (unique in `keys`) with every key spread over `salts` slices.

    Slices are told by hashing the `spread` columns of a fact (all of them by default), which should
    differ between the facts of a key; count equal facts first.

    Each group row is repeated once per slice, so a key that holds a third of all facts is shared
    out over as many tasks as there are shuffle partitions. Spark still turns this into a broadcast
    join when the groups turn out to be below its size threshold.
    """
    n = salt_count(facts, salts)
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*(spread or facts.columns)), F.lit(n)).cast("int"))
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return join_keys(salted, copies, [*keys, "_salt"], how).drop("_salt")


def widen(scan, key):
    """A plain file scan spread over all cores when its files give fewer splits than there are.

    For small tables in one file; a scan that already has a split per core is left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan

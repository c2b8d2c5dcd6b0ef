"""The prefix trie against dictionaries of tuples."""
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tidewatch.llm import shared, trie as tr

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows, splice=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(role, text) for _, role, text in sorted(v)] for c, v in own.items()}
    convs = own
    if splice:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        convs = {c: own.get(c - c % 100, [])[:h[c]] + own[c][h[c]:] for c in own}
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
        yield (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
               hashlib.sha256(ends.encode()).hexdigest())


def some_rows(n, seed):
    rng = random.Random(seed)
    return [(c if rng.random() > 0.02 else None, rng.choice([None, *range(-2, 7)]), rng.choice(["u", "a", None]),
             rng.choice(["x", "y", None, "zz", "é😀"])) for c in rng.sample(range(700), n) for _ in range(rng.randrange(1, 9))]


def same(got, want):
    return sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("n", [0, 1, 60, 250])
def test_families(spark, n):
    rows = some_rows(n, n)
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", depth int, p int")
    assert same(tr.family_trie(frame), expected(rows))


def test_long_conversations_and_a_full_sketch(spark, monkeypatch):
    """Ranks and sums by digits, and a sketch so small that singletons are grouped exactly."""
    monkeypatch.setattr(tr, "MIN_WIDTH", 64)
    rows = some_rows(80, 5) + [(c, i, "u", "t" if i < 290 + c else f"{c}") for c in (901, 902, 903) for i in range(300 + 7 * c % 9)]
    turns = shared.written(tr.turns_of(spark.createDataFrame(rows, SCHEMA), window_limit=20), "turns")
    assert same(tr.trie(tr.spliced(turns), window_limit=20, max_width=64), expected(rows))


def test_plain_conversations_with_a_hot_one(spark):
    """Half of all conversations are the same; many hang below one first turn."""
    rows = [(c, t, "u", f"turn {t}") for c in range(0, 400, 2) for t in range(3)]
    rows += [(c, t, "u", "turn 0" if t == 0 else f"{c} {t}") for c in range(1, 300, 2) for t in range(3)]
    assert same(tr.prefix_trie(spark.createDataFrame(rows, SCHEMA)), expected(rows, splice=False))


def test_ends_are_hashed_over_blocks(spark):
    ids = [5, 70_000, 131_072, 200_000, 65_535, 65_536]
    rows = [(c, 0, "u", "same") for c in ids]
    got = {r.depth: r.ends_sha256 for r in tr.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: tr.EMPTY, 1: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()}


def test_counted_joins_spread_heavy_keys(spread):
    """Half of all rows share a key: no task of the shuffle join reads more than twice the mean."""
    from pyspark.sql import functions as F
    rows = spread.range(20_000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 3000).alias("k"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    joined = shared.join_counted(rows, groups, ["k"], "n", ["id"])
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 and joined.where("top IS NULL").count() == 0
    assert max(sizes) <= 2 * 20_000 / 4

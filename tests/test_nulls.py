"""Null groups, null labels and infinities: both ranking paths give every row a result."""
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.numeric import double_digits
from tidewatch.operators import metrics, profile
from tidewatch.plans.quantiles import exact_quantiles
from tidewatch.plans.ranking import rank_within


@pytest.fixture(scope="module")
def rows(spark):
    inf = float("inf")
    values = [float(i % 17) for i in range(57)] + [inf, -inf, 0.0]
    return spark.createDataFrame(
        [("a" if i % 3 else None, v, i) for i, v in enumerate(values)], "subreddit string, v double, id long")


def test_both_ranks_agree(rows):
    order = [F.col("v"), F.col("id")]
    plain = rank_within(rows, ["subreddit"], double_digits(F.col("v")), order)
    digits = rank_within(rows, ["subreddit"], double_digits(F.col("v")), order, window_limit=0)
    assert sorted(map(str, plain.select("id", "rn").collect())) == sorted(map(str, digits.select("id", "rn").collect()))


def test_both_quantiles_agree(rows):
    wanted = {"low": 0.0, "q1": 0.25, "mid": 0.5, "high": 1.0}
    got = [{r.subreddit: tuple(r)[1:] for r in exact_quantiles(rows, ["subreddit"], "v", wanted, limit).collect()}
           for limit in (1000, 0)]
    assert got[0] == got[1] and set(got[0]) == {"a", None}


def test_null_groups_are_counted(rows):
    finite = rows.where(F.abs("v") < 100)
    n = {r.subreddit: r.n for r in finite.groupBy("subreddit").agg(F.count("v").alias("n")).collect()}
    bins = profile.histogram(finite, "v", bins=5)
    assert {r.subreddit: r.n for r in bins.groupBy("subreddit").agg(F.sum("n").alias("n")).collect()} == n
    assert {r.subreddit for r in profile.box_stats(finite, "v", ["subreddit"]).collect()} == {"a", None}
    assert {r.subreddit for r in profile.kde_curve(finite, "v", points=3).collect()} == {"a", None}
    scored = finite.withColumn("positive", F.col("id") % 2 == 0)
    assert {r.subreddit for r in metrics.auc(scored, "v", group=["subreddit"]).collect()} == {"a", None}

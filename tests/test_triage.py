import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import annotate, labels as lab, metrics, policy, profile
from tidewatch.plans.quantiles import exact_quantiles
from tidewatch.plans.ranking import keep_first, rank_within, top_by_ranges, top_within
from tidewatch.functions.numeric import double_digits, flag_precision
from tidewatch.schemas import LABEL

NOW, HOUR = 1_700_000_000.0, 3600.0


def case(spark, *rows):
    """Posts and statuses from (id, hours since creation, hours at snapshot, category or ABSENT)."""
    posts = spark.createDataFrame(
        [(i, "m", NOW - since * HOUR, NOW - (since - seen) * HOUR) for i, since, seen, _ in rows],
        "id string, subreddit string, created_utc double, snapshot_utc double")
    status = spark.createDataFrame([(i, c) for i, _, _, c in rows if c is not ABSENT],
                                   "id string, removed_by_category string")
    return posts, status


ABSENT = object()


def none_yet(spark):
    return spark.createDataFrame([], LABEL)


# --- labels -------------------------------------------------------------------

def test_outcome_table(spark):
    cases = {None: "kept", "moderator": "removed_by_moderation",
             "automod_filtered": "removed_by_moderation", "reddit": "removed_by_moderation",
             "deleted": "deleted_by_author", "author": "deleted_by_author",
             "quarantined": "other:quarantined"}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = {r.c: r.o for r in df.select("c", lab.outcome(F.col("c")).alias("o")).collect()}
    assert got == cases


def test_a_null_category_is_not_an_absent_post(spark):
    raw, status = case(spark, ("gone", 60, 1, "deleted"), ("fine", 60, 1, None),
                       ("lost", 60, 1, ABSENT), ("new", 47, 1, "moderator"))
    rows = lab.recheck(raw.unionByName(raw), status, none_yet(spark), NOW)
    assert {r.id: r.outcome for r in rows.collect()} == {
        "gone": "deleted_by_author", "fine": "kept", "lost": "missing"}
    assert rows.count() == 3


def test_a_label_is_given_once(spark):
    raw, status = case(spark, ("a", 60, 1, None), ("b", 47, 1, None))
    first = lab.recheck(raw, status, none_yet(spark), NOW)
    later = lab.recheck(raw, status, first, NOW + 2 * HOUR)
    assert [r.id for r in first.collect()] == ["a"] and [r.id for r in later.collect()] == ["b"]


def test_rate_counts_young_kept_and_removed_posts_only(spark):
    raw, status = case(
        spark, ("y1", 60, 0.5, "reddit"), ("y2", 60, 2.0, None), ("y3", 60, 1, None),
        ("author", 60, 1, "author"), ("odd", 60, 1, "brand_new"), ("late", 60, 2.1, "moderator"))
    rates = {r.scope: r for r in lab.removal_rate(
        lab.recheck(raw, status, none_yet(spark), NOW)).collect()}
    assert (rates["all"].eligible_posts, rates["all"].removed) == (3, 1)
    assert rates["all"].rate == pytest.approx(1 / 3) and rates["community"].rate == 0.3333


def test_rate_of_nothing_and_age_without_stamp_are_nan(spark):
    raw, status = case(spark, ("a", 60, 1, None), ("b", 60, 1, None))
    labels = lab.recheck(raw.withColumn("snapshot_utc", F.lit(0.0)), status, none_yet(spark), NOW)
    assert all(math.isnan(r.hours_old_at_snapshot) for r in labels.collect())
    overall = lab.removal_rate(labels).where("scope = 'all'").first()
    assert overall.eligible_posts == 0 and math.isnan(overall.rate)


# --- policy -------------------------------------------------------------------

def scored(spark, rows):
    return spark.createDataFrame(rows, "confidence double, correct boolean")


def test_decide_is_inclusive(spark):
    df = scored(spark, [(.75, True), (.7499, False), (1.0, False)])
    assert [r.action for r in policy.decisions(df, .75).collect()] == [
        "auto_resolve", "escalate_to_human", "auto_resolve"]


def test_best_point_stops_above_the_errors(spark):
    df = scored(spark, [(.82, True)] * 6 + [(.97, True)] * 3 + [(.60, False)] * 3)
    best = policy.best_operating_point(policy.threshold_sweep(df)).first()
    assert (best.coverage, best.n_errors_covered, best.precision) == (.75, 0, 1.0)
    # The grid's own step is 0.6000000000000001, so it already leaves the 0.60 rows out.
    assert policy.GRID[10] > .60 and best.threshold == pytest.approx(.60)
    half_wrong = scored(spark, [(.71, True)] * 3 + [(.88, False)])
    assert policy.best_operating_point(policy.threshold_sweep(half_wrong)).isEmpty()


def test_sweep_equals_direct_counting_and_is_monotone(spark):
    rows = [(0.5 + (i * 37 % 500) / 1000, i * 7 % 10 < 7) for i in range(400)]
    rows += [(0.57, True), (float("nan"), True), (None, True)]
    points = sorted(policy.threshold_sweep(scored(spark, rows)).collect(),
                    key=lambda r: r.threshold)
    for point, t in zip(points, policy.GRID):
        covered = [ok for c, ok in rows if c is not None and c >= t]
        assert (point.n_covered, point.n_errors_covered) == (len(covered), covered.count(False))
    assert [p.coverage for p in points] == sorted((p.coverage for p in points), reverse=True)


def test_exact_grid_value(spark):
    """0.57 lies just below the grid's own 0.57 step."""
    points = policy.threshold_sweep(scored(spark, [(0.57, True)])).collect()
    assert max(p.threshold for p in points) == pytest.approx(0.56)


def test_flag_precision(spark):
    cases = [(.8, .2), (1.0, .3), (0.0, 0.0)]
    df = spark.createDataFrame(cases, "p double, r double")
    got = [r[0] for r in df.select(flag_precision(F.col("p"), F.col("r"))).collect()]
    assert got[0] == pytest.approx(.5) and got[1:] == [1.0, 0.0]


def test_points_over_seeds(spark):
    best = spark.createDataFrame(
        [(1, .8, .4, 1.0, 40, 0, .95, True), (0, .7, .6, .96, 60, 2, .95, True)],
        "seed int, threshold double, coverage double, precision double, n_covered long, "
        "n_errors_covered long, precision_floor double, meets_floor boolean")
    rows = {r.precision_floor: r for r in policy.operating_point_over_seeds(
        best, 3, (.95, .99)).collect()}
    assert rows[.95].coverage == pytest.approx(.5) and rows[.95].coverage_std == pytest.approx(.1)
    assert (rows[.95].n_covered, rows[.95].n_seeds_reaching_floor) == (60, 2)
    assert rows[.99].coverage is None and rows[.99].n_seeds_reaching_floor == 0


# --- metrics and ranking ------------------------------------------------------

def test_kappa_and_its_undefined_cases(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "x string, y string")
    row = metrics.cohen_kappa(df, "x", "y").first()
    assert row.raw_agreement == .75 and row.kappa == pytest.approx(.5)
    same = spark.createDataFrame([("a", "a")] * 3, "x string, y string")
    assert math.isnan(metrics.cohen_kappa(same, "x", "y").first().kappa)


def test_report_macro_and_auc(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")],
                               "truth string, predicted string")
    rows = {r.label: r for r in metrics.classification_report(df).collect()}
    assert rows["accuracy"].f1 == .5 and rows["c"].precision == 0.0
    assert rows["macro avg"].f1 == pytest.approx((2 / 3 + .5 + 0) / 3)
    scores = spark.createDataFrame([(.9, 1), (.8, 0), (.8, 1), (.1, 0)], "score double, positive int")
    assert metrics.auc(scores).first().auc == pytest.approx(.875)
    assert metrics.auc(scores.where("positive = 1")).first().auc is None


def test_bootstrap_matches_the_normal_interval(spark):
    for n in (200, 20_000):
        df = spark.range(n).select((F.col("id") % 10 < 8).cast("double").alias("hit"))
        row = metrics.bootstrap_ci(df, "hit").first()
        half = 1.96 * math.sqrt(.8 * .2 / n)
        assert row.ci_low == pytest.approx(.8 - half, abs=half / 5)
        assert row.ci_high == pytest.approx(.8 + half, abs=half / 5)


def test_quantiles_by_digits_equal_the_built_in(spark):
    n = F.col("id")
    df = spark.range(2000).select(
        (n % 3).alias("g"),
        F.when(n % 3 == 0, 7.5).when(n % 11 == 0, -n * 1e9).when(n % 5 == 0, 0.0)
        .when(n % 7 == 0, F.lit(float("nan"))).otherwise((n * 37 % 1000) / 64 - 5).alias("v"))
    wanted = {"a": .1, "b": .5, "c": .93}
    built_in = exact_quantiles(df, ["g"], "v", wanted).orderBy("g").collect()
    digits = exact_quantiles(df, ["g"], "v", wanted, window_limit=0).orderBy("g").collect()
    for x, y in zip(built_in, digits, strict=True):
        assert list(x) == pytest.approx(list(y), rel=1e-12)


@pytest.mark.parametrize("n", [1, 37, 2500, 10_000])
def test_top_of_hot_small_and_null_groups(spark, n):
    """One group with most rows, spread over all ranges, next to a null group and groups of one row."""
    rows = spark.range(9000).selectExpr(
        "id", "CASE WHEN id % 10 < 7 THEN 'hot' WHEN id % 10 < 9 THEN NULL ELSE concat('g', id) END AS g",
        "pmod(xxhash64(id), 500) AS v")
    got = {(r.g, r.id): r.rn for r in top_within(rows, ["g"], [F.col("v").desc(), F.col("id")], n).collect()}
    wanted, groups = {}, {}
    for r in rows.collect():
        groups.setdefault(r.g, []).append((-r.v, r.id))
    for g, members in groups.items():
        wanted.update({(g, i): at for at, (_, i) in enumerate(sorted(members)[:n], 1)})
    assert got == wanted


def test_a_large_top_has_no_window_over_rows(spark):
    rows = spark.range(40_000).selectExpr("id", "'hot' AS g")
    top = top_by_ranges(rows, ["g"], [F.col("id").desc()], 20_000)
    plan = top._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert top.count() == 20_000 and top.agg(F.min("id")).first()[0] == 20_000
    windows = [line for line in plan if "Window" in line]
    assert len(windows) == 1 and "_range" in windows[0]          # over the sizes of runs, not over rows


def test_describe_selects_exact_quartiles(spark):
    """Columns whose values share all but the last bits, hold infinities, both zeros, copies or nothing."""
    deal = random.Random(3)
    inf, nan = float("inf"), float("nan")
    columns = {
        "near": [1.0 + deal.randrange(1 << 20) * 2.0 ** -52 for _ in range(997)],
        "wide": [deal.uniform(-1, 1) * 10.0 ** deal.randint(-300, 300) for _ in range(997)],
        "ends": [deal.choice([-inf, -0.0, 0.0, 5e-324, -5e-324, inf, nan, None]) for _ in range(997)],
        "same": [7.5] * 996 + [None], "one": [None] * 996 + [-3.0], "none": [None, nan] * 498 + [None]}
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(5)
    got = {r["column"]: r for r in profile.describe(df, list(columns)).collect()}
    assert set(got) == set(columns) - {"none"} and got["one"]["std"] is None
    for c, row in got.items():
        values = sorted(v for v in columns[c] if v is not None and v == v)
        assert (row["count"], row["min"], row["max"]) == (len(values), values[0], values[-1])
        for name, p in profile.QUARTILES.items():
            at, part = divmod((len(values) - 1) * p, 1)
            low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
            wanted = low if part == 0 or low == high else low + (high - low) * part
            if math.isinf(high - low) and part:
                wanted = (1 - part) * low + part * high
            assert row[name] == wanted or abs(row[name] - wanted) <= 1e-15 * abs(wanted), (c, name)


def test_rank_by_digits_equals_row_number(spark):
    df = spark.range(1500).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("g"),
        ((F.col("id") * 7919 % 1000) / 8.0 - 40).alias("v"), "id")
    order = [F.col("v"), F.col("id")]
    one = rank_within(df, ["g"], double_digits(F.col("v")), order)
    two = rank_within(df, ["g"], double_digits(F.col("v")), order, window_limit=0)
    assert one.exceptAll(two.select(one.columns)).isEmpty() and two.count() == 1500


def test_top_within_and_keep_first(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), "id")
    assert top_within(df, ["g"], [F.col("id")], 1200).agg(F.max("id")).first()[0] == 2399
    copies = df.unionByName(df).repartition(4)
    assert keep_first(copies, ["g"], [F.col("id")]).agg(F.sum("id")).first()[0] == 1


# --- annotation ---------------------------------------------------------------

def annotation_case(spark):
    """(id, truth, answer, seconds, model, confidence, text); unsure twice, wrong once."""
    rows = [("a", "x", "x", 1., "x", .99, "red kite"), ("b", "y", "x", 3., "y", .90, "a kite"),
            ("c", "x", "unsure", 9., "y", .80, "grey"), ("d", "y", "unsure", 7., "y", .70, "blue"),
            ("e", "x", "x", 5., "y", .60, "kite")]
    table = spark.createDataFrame(rows, "id string, subreddit string, answer string, "
                                  "seconds double, model string, confidence double, text string")
    return (table.select("id", F.lit("ann").alias("annotator"), "answer", "seconds"),
            table.select("id", "subreddit", "text"), table.select("id", "model", "confidence"),
            "kite")


@pytest.mark.parametrize("window_limit", [1000, 0])
def test_annotator_blocks(spark, window_limit):
    rows = {r.block: r for r in annotate.annotator_accuracy(
        *annotation_case(spark), window_limit=window_limit).collect()}
    expected = {                              # accuracy, rows
        "human_forced_choice": (3 / 5, 5), "model_same_posts": (3 / 5, 5),
        "human_when_answering": (2 / 3, 3),
        "model_at_same_coverage": (2 / 3, 3),             # keeps a, b, c
        "model_on_posts_human_answered": (2 / 3, 3),
        "model_on_posts_human_was_unsure": (1 / 2, 2),
        "with_token_human_forced_choice": (2 / 3, 3), "with_token_model": (2 / 3, 3),
        "without_token_human_forced_choice": (1 / 2, 2), "without_token_model": (1 / 2, 2)}
    assert {b: r.n for b, r in rows.items()} == {b: n for b, (_, n) in expected.items()}
    for block, (accuracy, _) in expected.items():
        assert rows[block].accuracy == pytest.approx(accuracy)
        assert rows[block].ci_low <= accuracy <= rows[block].ci_high


def test_annotator_summary(spark):
    row = annotate.annotator_summary(*annotation_case(spark)).first()
    assert (row.n_posts, row.unsure_rate, row.median_seconds_per_post) == (5, .4, 5.0)
    # Answered: (x, x), (x, y), (x, y): no agreement beyond chance.
    assert row.kappa_human_vs_model == pytest.approx(0.0)


@pytest.mark.parametrize("block", [256, 1])
def test_agreement_skips_unshared_posts(spark, block):
    answers = spark.createDataFrame(
        [(f"t{i}", who, answer) for who, given in
         {"kim": "xyxu", "lou": "xyy.", "max": "...x"}.items()
         for i, answer in enumerate(given) if answer != "."],
        "id string, annotator string, answer string")
    rows = annotate.agreement(answers, block).collect()
    assert [(r.a, r.b, r.n) for r in rows] == [("kim", "lou", 3)]
    assert rows[0].raw_agreement == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        annotate.agreement(answers.unionByName(answers))


def test_sample_is_balanced_and_reproducible(spark):
    corpus = spark.createDataFrame(
        [(f"n{i}", "abc"[min(i % 5, 2)], "") for i in range(150)],
        "id string, subreddit string, text string")
    sample = annotate.balanced_sample(corpus, 24, 3)
    assert sample.columns == ["id", "position"]
    counts = sample.join(corpus, "id").groupBy("subreddit").count().collect()
    assert [r["count"] for r in counts] == [8, 8, 8]
    again = annotate.balanced_sample(corpus.repartition(7), 24, 3)
    assert sample.exceptAll(again).isEmpty()
    assert sorted(r.position for r in sample.collect()) == list(range(1, 25))
    with pytest.raises(ValueError):
        annotate.balanced_sample(corpus, 200)


def test_histogram_of_one_value_and_kde_area(spark):
    flat = spark.createDataFrame([("a", 2.0)] * 3, "subreddit string, v double")
    assert [(r.bin, r.n) for r in profile.histogram(flat, "v").collect()] == [(0, 3)]
    assert profile.kde_curve(flat, "v").isEmpty()
    spread = spark.range(500).select(F.lit("a").alias("subreddit"), F.col("id").alias("v"))
    curve = profile.kde_curve(spread, "v").orderBy("x").collect()
    step = curve[1].x - curve[0].x
    assert 0.8 < sum(r.density for r in curve) * step < 1.0

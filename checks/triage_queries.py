"""Labels, policy, metrics, annotation, profile and collection queries with their SQL twins."""
from pyspark.sql import functions as F

from checks import inputs, twins
from checks.prepare_queries import PATTERNS
from tidewatch.functions import numeric, text as tx
from tidewatch.operators import (
    annotate, labels as lab, listing, metrics, policy, profile)

QUERIES = {}
NOW = 1_704_412_800.0          # four days after the first event: some posts are not due yet
PROBE_NOW = 1_704_326_400.0    # the end of the posts at the middle scale: a few are young
STOP_WORDS = ("the", "and", "of", "to", "le", "la", "de", "der", "und", "el", "que")


def query(name, sql=None):
    def register(function):
        QUERIES[name] = (function, sql)
        return function
    return register


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- labels -------------------------------------------------------------------

def _listed_names(names):
    return ", ".join(f"'{n}'" for n in names)


_OUTCOME = f"""CASE WHEN removed_by_category IS NULL THEN 'kept'
  WHEN removed_by_category IN ({_listed_names(lab.MODERATION_CATEGORIES)}) THEN 'removed_by_moderation'
  WHEN removed_by_category IN ({_listed_names(lab.AUTHOR_CATEGORIES)}) THEN 'deleted_by_author'
  ELSE 'other:' || removed_by_category END"""

# Ids below a quarter of the documents carry a label already.
_DONE = """done AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents
                   WHERE doc_id < (SELECT count(*) FROM documents) / 4)"""
_CHECKED = f"""{twins.POSTS}, {twins.STATUS}, {_DONE},
checked AS (
  SELECT p.id, subreddit, {NOW}::DOUBLE AS checked_utc,
         ({NOW}::DOUBLE - created_utc) / 3600 AS hours_since_creation,
         CASE WHEN snapshot_utc <> 0 THEN (snapshot_utc - created_utc) / 3600
              ELSE 'NaN'::DOUBLE END AS hours_old_at_snapshot,
         removed_by_category,
         CASE WHEN s.id IS NULL THEN 'missing' ELSE {_OUTCOME} END AS outcome
  FROM posts p LEFT JOIN status s ON s.id = p.id
  WHERE created_utc <= {NOW}::DOUBLE - 48 * 3600.0 AND p.id NOT IN (SELECT id FROM done))"""


def _labelled_before(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents").select("doc_id")
    quarter = docs.agg((F.count(F.lit(1)) / 4).alias("q")).scalar()
    return docs.where(F.col("doc_id") < quarter).select(F.col("doc_id").cast("string").alias("id"))


def _checked(spark, sf_dir):
    return lab.recheck(inputs.posts(spark, sf_dir), inputs.status(spark, sf_dir),
                       _labelled_before(spark, sf_dir), NOW)


@query("outcome", f"""WITH {twins.STATUS}
SELECT id, removed_by_category, {_OUTCOME} AS outcome FROM status""")
def outcome(spark, sf_dir):
    return inputs.status(spark, sf_dir).withColumn(
        "outcome", lab.outcome(F.col("removed_by_category")))


@query("due_for_labelling", f"""WITH {_CHECKED} SELECT id FROM checked""")
def due_for_labelling(spark, sf_dir):
    return lab.due_for_labelling(inputs.posts(spark, sf_dir), _labelled_before(spark, sf_dir),
                                 NOW).select("id")


@query("recheck", f"""WITH {_CHECKED}
SELECT id, subreddit, checked_utc, round(hours_since_creation, 6) AS hours_since_creation,
       round(hours_old_at_snapshot, 6) AS hours_old_at_snapshot, removed_by_category, outcome
FROM checked""")
def recheck(spark, sf_dir):
    return rounded(_checked(spark, sf_dir), "hours_since_creation", "hours_old_at_snapshot")


@query("outcome_counts", f"""WITH {_CHECKED}
SELECT outcome, count(*) AS n FROM checked GROUP BY outcome""")
def outcome_counts(spark, sf_dir):
    return lab.outcome_counts(_checked(spark, sf_dir))


@query("removal_rate", f"""WITH {_CHECKED},
young AS (SELECT * FROM checked WHERE NOT isnan(hours_old_at_snapshot)
          AND hours_old_at_snapshot <= 2 AND outcome IN ('kept', 'removed_by_moderation')),
counted AS (SELECT subreddit, grouping(subreddit) AS g, count(*) AS eligible_posts,
                   count(*) FILTER (outcome = 'removed_by_moderation') AS removed
            FROM young GROUP BY ROLLUP (subreddit))
SELECT CASE WHEN g = 1 THEN 'all' ELSE 'community' END AS scope, subreddit, eligible_posts, removed,
       CASE WHEN g = 1 THEN round(removed / eligible_posts, 6)
            ELSE round_even(removed / eligible_posts, 4) END AS rate
FROM counted""")
def removal_rate(spark, sf_dir):
    return rounded(lab.removal_rate(_checked(spark, sf_dir)), "rate")


_PROBE = f"""{twins.POSTS},
probe AS (SELECT id, subreddit, created_utc, title,
                 ({PROBE_NOW}::DOUBLE - created_utc) / 3600 AS age_hours,
                 {twins.stripped("coalesce(body, '')")} <> '' AS has_body
          FROM posts QUALIFY row_number() OVER (
            PARTITION BY subreddit ORDER BY created_utc DESC, id) <= 100)"""
_RETURNED = f"""{_PROBE},
returned AS (
  SELECT CAST(doc_id AS VARCHAR) AS id,
         CASE WHEN toxic = 1 THEN 'moderator' WHEN quality = 0 THEN 'deleted' END
           AS removed_by_category,
         CASE WHEN toxic = 1 THEN '[removed]' WHEN quality = 0 THEN '[deleted]' ELSE '' END
           AS selftext_marker,
         quality = 0 AS author_gone, toxic = 0 AS robot_indexable FROM labels),
rechecked AS (SELECT * FROM probe JOIN returned USING (id))"""


def _probe(spark, sf_dir):
    return lab.probe_snapshot(inputs.posts(spark, sf_dir), PROBE_NOW)


def _rechecked(spark, sf_dir):
    gone, bad = F.col("quality") == 0, F.col("toxic") == 1
    returned = inputs.labelled(spark, sf_dir).select(
        "id", F.when(bad, "moderator").when(gone, "deleted").alias("removed_by_category"),
        F.when(bad, "[removed]").when(gone, "[deleted]").otherwise("text").alias("selftext"),
        F.when(~gone, "someone").alias("author"), (~bad).alias("robot_indexable"))
    return lab.probe_recheck(_probe(spark, sf_dir), returned, PROBE_NOW + 7200)


@query("probe_snapshot", f"""WITH {_PROBE}
SELECT id, subreddit, round(age_hours, 6) AS age_hours, has_body FROM probe""")
def probe_snapshot(spark, sf_dir):
    return rounded(_probe(spark, sf_dir), "age_hours").select(
        "id", "subreddit", "age_hours", "has_body")


@query("probe_young", f"""WITH {_PROBE}
SELECT subreddit, count(*) AS n_young FROM probe WHERE age_hours < 3 GROUP BY subreddit""")
def probe_young(spark, sf_dir):
    return lab.young_per_community(_probe(spark, sf_dir))


@query("probe_recheck", f"""WITH {_RETURNED}
SELECT id, removed_by_category, selftext_marker, author_gone, robot_indexable,
       2.0::DOUBLE AS hours_observed FROM rechecked""")
def probe_recheck(spark, sf_dir):
    return _rechecked(spark, sf_dir).select(
        "id", "removed_by_category", "selftext_marker", "author_gone", "robot_indexable",
        "hours_observed")


@query("probe_categories", f"""WITH {_RETURNED}
SELECT removed_by_category, count(*) AS n, count(*) FILTER (age_hours < 3) AS n_young
FROM rechecked GROUP BY removed_by_category""")
def probe_categories(spark, sf_dir):
    return lab.probe_categories(_rechecked(spark, sf_dir))


@query("probe_markers", f"""WITH {_RETURNED}
SELECT selftext_marker, count(*) AS n, count(*) FILTER (author_gone) AS n_author_gone,
       count(*) FILTER (NOT robot_indexable) AS n_not_indexable
FROM rechecked GROUP BY selftext_marker""")
def probe_markers(spark, sf_dir):
    return lab.probe_markers(_rechecked(spark, sf_dir))


@query("removed_examples", f"""WITH {_RETURNED}
SELECT id, subreddit, removed_by_category, substr(title, 1, 70) AS title FROM rechecked
WHERE removed_by_category <> '' ORDER BY id LIMIT 8""")
def removed_examples(spark, sf_dir):
    return lab.removed_examples(_rechecked(spark, sf_dir))


# --- policy -------------------------------------------------------------------

def _grid(steps):
    return ", ".join(f"({t!r}::DOUBLE)" for t in steps)


def _sweep(grid=policy.GRID, floors=(0.99,), seeds=""):
    keys = "seed, " if seeds else ""
    return f"""{twins.SCORED}, {seeds}
grid(t) AS (VALUES {_grid(grid)}), floors(precision_floor) AS
  (VALUES {", ".join(f"({f}::DOUBLE)" for f in floors)}),
covered AS (
  SELECT {keys}t, count(*) AS n_covered, count(*) FILTER (NOT correct) AS n_errors_covered
  FROM {"seeded" if seeds else "scored"} JOIN grid ON confidence >= t GROUP BY {keys}t),
sizes AS (SELECT {keys}count(*) AS n_rows FROM {"seeded" if seeds else "scored"}
          {"GROUP BY seed" if seeds else ""}),
points AS (
  SELECT {keys}round(t, 4) AS threshold, n_covered / n_rows AS coverage,
         (n_covered - n_errors_covered) / n_covered AS precision, n_covered, n_errors_covered,
         n_rows - n_covered AS n_escalated, precision_floor,
         (n_covered - n_errors_covered) / n_covered >= precision_floor AS meets_floor
  FROM covered {"JOIN sizes USING (seed)" if seeds else "CROSS JOIN sizes"} CROSS JOIN floors)"""


_POINT = """threshold, round(coverage, 6) AS coverage, round(precision, 6) AS precision, n_covered,
       n_errors_covered, precision_floor, meets_floor"""
_SEEDED = """seeds(seed) AS (VALUES (0), (1), (2), (3), (4)),
seeded AS (SELECT seed, correct, 0.5 + ((doc_id + seed * 331) * 7919 % 4999) / 10000.0::DOUBLE
             AS confidence FROM scored CROSS JOIN seeds),"""


def _seeded(spark, sf_dir):
    seeds = F.explode(F.array(*[F.lit(s) for s in range(5)]))
    rows = inputs.scored(spark, sf_dir).withColumn("seed", seeds)
    shifted = (F.col("doc_id") + F.col("seed") * 331) * 7919 % 4999
    return rows.withColumn("confidence", 0.5 + shifted / 10000.0)


@query("threshold_sweep", f"""WITH {_sweep()} SELECT {_POINT}, n_escalated FROM points""")
def threshold_sweep(spark, sf_dir):
    return rounded(policy.threshold_sweep(inputs.scored(spark, sf_dir)), "coverage", "precision")


@query("threshold_sweep_coarse", f"""WITH {_sweep(policy.COARSE_GRID)}
SELECT {_POINT}, n_escalated FROM points""")
def threshold_sweep_coarse(spark, sf_dir):
    sweep = policy.threshold_sweep(inputs.scored(spark, sf_dir), grid=policy.COARSE_GRID)
    return rounded(sweep, "coverage", "precision")


FLOORS = (0.6, 0.75, 0.9, 1.5)


@query("best_operating_point", f"""WITH {_sweep(floors=FLOORS)}
SELECT {_POINT} FROM points WHERE meets_floor QUALIFY row_number() OVER (
  PARTITION BY precision_floor ORDER BY n_covered DESC, threshold) = 1""")
def best_operating_point(spark, sf_dir):
    sweep = policy.threshold_sweep(inputs.scored(spark, sf_dir), FLOORS)
    return rounded(policy.best_operating_point(sweep), "coverage", "precision")


_OVER_SEEDS = f"""{_sweep(floors=FLOORS, seeds=_SEEDED)},
best AS (SELECT * FROM points WHERE meets_floor QUALIFY row_number() OVER (
  PARTITION BY seed, precision_floor ORDER BY n_covered DESC, threshold) = 1),
summary AS (
  SELECT precision_floor, quantile_cont(threshold, 0.5) AS threshold, avg(coverage) AS coverage,
         stddev_pop(coverage) AS coverage_std, min(coverage) AS coverage_min,
         max(coverage) AS coverage_max, avg(precision) AS precision,
         arg_min(n_covered, seed) AS n_covered, arg_min(n_errors_covered, seed)
           AS n_errors_covered, count(*) AS n_seeds_reaching_floor FROM best GROUP BY ALL)"""


@query("operating_point_over_seeds", f"""WITH {_OVER_SEEDS}
SELECT precision_floor, round(threshold, 6) AS threshold, round(coverage, 6) AS coverage,
       round(coverage_std, 6) AS coverage_std, round(coverage_min, 6) AS coverage_min,
       round(coverage_max, 6) AS coverage_max, round(precision, 6) AS precision, n_covered,
       n_errors_covered, coalesce(n_seeds_reaching_floor, 0) AS n_seeds_reaching_floor,
       CAST(5 AS BIGINT) AS n_seeds
FROM floors LEFT JOIN summary USING (precision_floor)""")
def operating_point_over_seeds(spark, sf_dir):
    sweep = policy.threshold_sweep(_seeded(spark, sf_dir), FLOORS, group=["seed"])
    points = policy.operating_point_over_seeds(
        policy.best_operating_point(sweep, ["seed"]), 5, FLOORS)
    return rounded(points, "threshold", "coverage", "coverage_std", "coverage_min",
                   "coverage_max", "precision")


@query("flag_precision", f"""WITH {_sweep(floors=(0.6, 0.75))},
best AS (SELECT * FROM points WHERE meets_floor QUALIFY row_number() OVER (
  PARTITION BY precision_floor ORDER BY n_covered DESC, threshold) = 1),
rates(base_rate) AS (VALUES {", ".join(f"({r}::DOUBLE)" for r in policy.BASE_RATES)})
SELECT precision_floor, base_rate,
       round(coalesce(base_rate * precision
         / nullif(base_rate * precision + (1 - base_rate) * (1 - precision), 0), 0), 6)
         AS flag_precision
FROM best CROSS JOIN rates""")
def flag_precision(spark, sf_dir):
    sweep = policy.threshold_sweep(inputs.scored(spark, sf_dir), (0.6, 0.75))
    flags = policy.flag_precision_by_base_rate(policy.best_operating_point(sweep))
    return rounded(flags, "flag_precision").select(
        "precision_floor", "base_rate", "flag_precision")


@query("decide", f"""WITH {twins.SCORED}
SELECT id, CASE WHEN confidence >= 0.9::DOUBLE THEN 'auto_resolve' ELSE 'escalate_to_human' END
  AS action FROM scored""")
def decide(spark, sf_dir):
    return policy.decisions(inputs.scored(spark, sf_dir), 0.9).select("id", "action")


@query("argmax_label", """WITH p AS (
  SELECT vec_id, embedding::DOUBLE[] AS probability FROM embeddings)
SELECT vec_id, 'c' || list_position(probability, list_max(probability)) AS label,
       list_max(probability) AS confidence FROM p""")
def argmax_label(spark, sf_dir):
    vectors = inputs.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("probability"))
    classes = F.transform(F.sequence(F.lit(1), F.size("probability")),
                          lambda i: F.concat(F.lit("c"), i.cast("string")))
    return vectors.select("vec_id", numeric.argmax_label(F.col("probability"), classes)
                          .alias("label"), F.array_max("probability").alias("confidence"))


# --- metrics ------------------------------------------------------------------

@query("majority_rate", """SELECT round(max(n) / sum(n), 6) AS majority_rate FROM
  (SELECT count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)""")
def majority_rate(spark, sf_dir):
    return rounded(metrics.majority_rate(inputs.documents(spark, sf_dir), "lang"),
                   "majority_rate")


@query("accuracy", f"""WITH {twins.SCORED}
SELECT round(avg(CAST(truth = predicted AS INTEGER)), 6) AS accuracy, count(*) AS n FROM scored""")
def accuracy(spark, sf_dir):
    return rounded(metrics.accuracy(inputs.scored(spark, sf_dir)), "accuracy")


_LANGUAGE_GUESS = f"""guesses AS (
  SELECT lang AS truth, CASE WHEN {twins.has_token("text", PATTERNS["first"])}
                              AND NOT {twins.has_token("text", PATTERNS["second"])} THEN 'en'
                             WHEN {twins.has_token("text", PATTERNS["second"])}
                              AND NOT {twins.has_token("text", PATTERNS["first"])} THEN 'fr'
                             ELSE 'de' END AS predicted FROM documents),
names AS (SELECT truth AS label FROM guesses UNION SELECT predicted FROM guesses)"""


def _language_guess(spark, sf_dir):
    rule = tx.keyword_rule(F.col("text"), {"en": PATTERNS["first"], "fr": PATTERNS["second"]},
                           "de")
    return inputs.documents(spark, sf_dir).select(
        F.col("lang").alias("truth"), rule.alias("predicted"))


@query("confusion_matrix", f"""WITH {_LANGUAGE_GUESS}
SELECT a.label AS actual, p.label AS predicted, count(g.truth) AS n
FROM names a CROSS JOIN names p
LEFT JOIN guesses g ON g.truth = a.label AND g.predicted = p.label GROUP BY ALL""")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_language_guess(spark, sf_dir))


@query("classification_report", f"""WITH {_LANGUAGE_GUESS},
per AS (
  SELECT label, (SELECT count(*) FROM guesses WHERE truth = label) AS support,
         (SELECT count(*) FROM guesses WHERE predicted = label) AS claimed,
         (SELECT count(*) FROM guesses WHERE predicted = label AND truth = label) AS hits
  FROM names),
rated AS (SELECT label, coalesce(hits / nullif(claimed, 0), 0) AS precision,
                 coalesce(hits / nullif(support, 0), 0) AS recall,
                 coalesce(2 * hits / nullif(claimed + support, 0), 0) AS f1, support, hits
          FROM per),
rows_ AS (
  SELECT label, precision, recall, f1, support FROM rated UNION ALL
  SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support),
         sum(hits) / sum(support), sum(support) FROM rated UNION ALL
  SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM rated UNION ALL
  SELECT 'weighted avg', sum(precision * support) / sum(support),
         sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)
  FROM rated)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM rows_""")
def classification_report(spark, sf_dir):
    return rounded(metrics.classification_report(_language_guess(spark, sf_dir)),
                   "precision", "recall", "f1")


_ROC = """cells AS (
  SELECT value AS score, count(*) FILTER (event_type = 'purchase') AS pos,
         count(*) FILTER (event_type <> 'purchase') AS neg FROM events GROUP BY value),
curve AS (
  SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
         sum(pos) OVER () AS p, sum(neg) OVER () AS n
  FROM cells WINDOW w AS (ORDER BY score DESC))"""


def _purchase_scores(spark, sf_dir):
    return inputs.table(spark, sf_dir, "events").select(
        F.col("value").alias("score"), (F.col("event_type") == "purchase").alias("positive"))


@query("roc_curve", f"""WITH {_ROC}
SELECT score, round(tp / p, 6) AS tpr, round(fp / n, 6) AS fpr FROM curve""")
def roc_curve(spark, sf_dir):
    return rounded(metrics.roc_curve(_purchase_scores(spark, sf_dir)), "tpr", "fpr")


@query("auc", f"""WITH {_ROC}
SELECT round(sum((neg / n) * (2 * tp - pos) / (2 * p)), 6) AS auc FROM curve""")
def auc(spark, sf_dir):
    return rounded(metrics.auc(_purchase_scores(spark, sf_dir)), "auc")


@query("cohen_kappa", f"""WITH {twins.SCORED},
n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (truth = predicted) AS agree FROM scored),
c AS (SELECT sum(a * b)::DOUBLE AS chance FROM
  (SELECT truth AS l, count(*) AS a FROM scored GROUP BY 1) JOIN
  (SELECT predicted AS l, count(*) AS b FROM scored GROUP BY 1) USING (l))
SELECT CAST(n AS BIGINT) AS n, round(agree / n, 6) AS raw_agreement,
       round((agree * n - chance) / (n * n - chance), 6) AS kappa FROM n CROSS JOIN c""")
def cohen_kappa(spark, sf_dir):
    return rounded(metrics.cohen_kappa(inputs.scored(spark, sf_dir), "truth", "predicted"),
                   "raw_agreement", "kappa")


@query("bootstrap_ci")
def bootstrap_ci(spark, sf_dir):
    rows = inputs.scored(spark, sf_dir).withColumn("hit", F.col("correct").cast("double"))
    return metrics.bootstrap_ci(rows, "hit", ["truth"])


# --- annotation ---------------------------------------------------------------

_JUDGED = f"""{twins.ANSWERS}, {twins.SCORED},
judged AS (
  SELECT a.*, s.truth, s.predicted AS model, s.confidence, a.answer = 'unsure' AS unsure,
         CAST(a.answer = s.truth AS INTEGER) AS human_right,
         CAST(s.predicted = s.truth AS INTEGER) AS model_right,
         {twins.has_token("d.text", PATTERNS["first"])} AS named
  FROM answers a LEFT JOIN scored s USING (id)
  LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = a.id),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY annotator ORDER BY confidence, md5(id), id)
           > count(*) FILTER (unsure) OVER (PARTITION BY annotator) AS kept,
         CASE WHEN unsure THEN 0.5 ELSE human_right END AS forced FROM judged)"""


def _annotation(spark, sf_dir):
    scored = inputs.scored(spark, sf_dir)
    corpus = inputs.documents(spark, sf_dir).join(scored.select("id", "truth"), "id").select(
        "id", F.col("truth").alias("subreddit"), "text")
    predictions = scored.select("id", F.col("predicted").alias("model"), "confidence")
    return inputs.answers(spark, sf_dir), corpus, predictions, PATTERNS["first"]


@query("abstain_like_human", f"""WITH {_JUDGED} SELECT annotator, id, kept FROM kept""")
def abstain_like_human(spark, sf_dir):
    return annotate.abstain_like_human(
        annotate.judged_answers(*_annotation(spark, sf_dir))).select("annotator", "id", "kept")


@query("abstain_by_digits", f"""WITH {_JUDGED} SELECT annotator, id, kept FROM kept""")
def abstain_by_digits(spark, sf_dir):
    return annotate.abstain_like_human(
        annotate.judged_answers(*_annotation(spark, sf_dir)), window_limit=0).select(
        "annotator", "id", "kept")


@query("annotator_accuracy", f"""WITH {_JUDGED},
blocks AS (
  SELECT annotator, unnest([
    {{'block': 'human_forced_choice', 'v': forced::DOUBLE}},
    {{'block': 'model_same_posts', 'v': model_right::DOUBLE}},
    {{'block': 'human_when_answering', 'v': CASE WHEN NOT unsure THEN human_right END::DOUBLE}},
    {{'block': 'model_at_same_coverage', 'v': CASE WHEN kept THEN model_right END::DOUBLE}},
    {{'block': 'model_on_posts_human_answered', 'v': CASE WHEN NOT unsure THEN model_right END::DOUBLE}},
    {{'block': 'model_on_posts_human_was_unsure', 'v': CASE WHEN unsure THEN model_right END::DOUBLE}},
    {{'block': 'with_token_human_forced_choice', 'v': CASE WHEN named THEN forced END::DOUBLE}},
    {{'block': 'with_token_model', 'v': CASE WHEN named THEN model_right END::DOUBLE}},
    {{'block': 'without_token_human_forced_choice', 'v': CASE WHEN NOT named THEN forced END::DOUBLE}},
    {{'block': 'without_token_model', 'v': CASE WHEN NOT named THEN model_right END::DOUBLE}}]) AS b
  FROM kept)
SELECT annotator, b.block AS block, round(coalesce(avg(b.v), 'NaN'::DOUBLE), 6) AS accuracy,
       count(b.v) AS n FROM blocks GROUP BY ALL""")
def annotator_accuracy(spark, sf_dir):
    return rounded(annotate.annotator_accuracy(*_annotation(spark, sf_dir), intervals=False),
                   "accuracy")


@query("annotator_accuracy_ci")
def annotator_accuracy_ci(spark, sf_dir):
    return annotate.annotator_accuracy(*_annotation(spark, sf_dir))


@query("annotator_summary", f"""WITH {_JUDGED},
base AS (SELECT annotator, count(*) AS n_posts, avg(CAST(unsure AS INTEGER)) AS unsure_rate,
                quantile_cont(seconds, 0.5) AS median_seconds_per_post FROM judged GROUP BY 1),
sure AS (SELECT * FROM judged WHERE NOT unsure),
n AS (SELECT annotator, count(*)::DOUBLE AS n, count(*) FILTER (answer = model) AS agree
      FROM sure GROUP BY 1),
c AS (SELECT annotator, sum(x * y)::DOUBLE AS chance FROM
  (SELECT annotator, answer AS l, count(*) AS x FROM sure GROUP BY 1, 2) JOIN
  (SELECT annotator, model AS l, count(*) AS y FROM sure GROUP BY 1, 2) USING (annotator, l)
  GROUP BY 1)
SELECT annotator, n_posts, round(unsure_rate, 6) AS unsure_rate, median_seconds_per_post,
       round((agree * n - chance) / (n * n - chance), 6) AS kappa_human_vs_model
FROM base JOIN n USING (annotator) JOIN c USING (annotator)""")
def annotator_summary(spark, sf_dir):
    return rounded(annotate.annotator_summary(*_annotation(spark, sf_dir)),
                   "unsure_rate", "kappa_human_vs_model")


@query("annotator_agreement", f"""WITH {twins.ANSWERS},
pairs AS (SELECT x.annotator AS a, y.annotator AS b, x.answer AS ans_a, y.answer AS ans_b
          FROM answers x JOIN answers y ON x.id = y.id AND x.annotator < y.annotator),
n AS (SELECT a, b, count(*)::DOUBLE AS n, count(*) FILTER (ans_a = ans_b) AS agree
      FROM pairs GROUP BY 1, 2),
c AS (SELECT a, b, sum(x * y)::DOUBLE AS chance FROM
  (SELECT a, b, ans_a AS l, count(*) AS x FROM pairs GROUP BY 1, 2, 3) JOIN
  (SELECT a, b, ans_b AS l, count(*) AS y FROM pairs GROUP BY 1, 2, 3) USING (a, b, l)
  GROUP BY 1, 2)
SELECT a, b, CAST(n AS BIGINT) AS n, round(agree / n, 6) AS raw_agreement,
       round((agree * n - chance) / (n * n - chance), 6) AS kappa
FROM n JOIN c USING (a, b) WHERE n >= 2""")
def annotator_agreement(spark, sf_dir):
    return rounded(annotate.agreement(inputs.answers(spark, sf_dir)), "raw_agreement", "kappa")


_SAMPLE = """drawn AS (
  SELECT CAST(doc_id AS VARCHAR) AS id FROM documents QUALIFY row_number() OVER (
    PARTITION BY lang ORDER BY md5('draw0:' || doc_id), CAST(doc_id AS VARCHAR)) <= {per}),
sample AS (SELECT id, row_number() OVER (ORDER BY md5('shuffle0:' || id), id) AS position
           FROM drawn)"""


def _sample(spark, sf_dir):
    docs = inputs.documents(spark, sf_dir).withColumnRenamed("lang", "subreddit")
    return docs, annotate.balanced_sample(docs, n=40)


@query("balanced_sample", f"""WITH {_SAMPLE.format(per=10)} SELECT id, position FROM sample""")
def balanced_sample(spark, sf_dir):
    return _sample(spark, sf_dir)[1]


@query("annotation_queue", f"""WITH {_SAMPLE.format(per=10)}, {twins.ANSWERS}
SELECT position, s.id, CASE WHEN length(text) > 1200 THEN substr(text, 1, 1200) || ' [...]'
                            ELSE text END AS shown
FROM sample s JOIN documents d ON CAST(d.doc_id AS VARCHAR) = s.id
WHERE NOT EXISTS (SELECT 1 FROM answers a WHERE a.id = s.id AND a.annotator = 'a')""")
def annotation_queue(spark, sf_dir):
    docs, sample = _sample(spark, sf_dir)
    return annotate.annotation_queue(sample, inputs.answers(spark, sf_dir), "a", docs)


# --- profile ------------------------------------------------------------------

@query("dataset_profile", f"""WITH {twins.POSTS}
SELECT count(*) AS n_posts,
  round(avg(CAST({twins.stripped("body")} = '' AS INTEGER)), 6) AS empty_body_rate,
  quantile_cont({twins.word_count("title")}, 0.5) AS median_title_words,
  round(avg(CAST(NOT {twins.has_token("title || ' ' || body", PATTERNS["second"])} AS INTEGER)), 6)
    AS no_franchise_token_rate FROM posts""")
def dataset_profile(spark, sf_dir):
    return rounded(profile.dataset_profile(inputs.posts(spark, sf_dir), PATTERNS["second"]),
                   "empty_body_rate", "no_franchise_token_rate")


@query("null_counts", f"""WITH {twins.POSTS}
SELECT unnest([{{'column': 'id', 'n_null': count(*) FILTER (id IS NULL)}},
               {{'column': 'title', 'n_null': count(*) FILTER (title IS NULL)}},
               {{'column': 'flair', 'n_null': count(*) FILTER (flair IS NULL)}},
               {{'column': 'created_utc', 'n_null': count(*) FILTER (created_utc IS NULL)}}],
              recursive := true) FROM posts""")
def null_counts(spark, sf_dir):
    return profile.null_counts(inputs.posts(spark, sf_dir).select(
        "id", "title", "flair", "created_utc"))


@query("fill_flair", f"""WITH {twins.POSTS}
SELECT id, coalesce(flair, 'No flair') AS flair FROM posts""")
def fill_flair(spark, sf_dir):
    return profile.fill_flair(inputs.posts(spark, sf_dir).select("id", "flair"))


@query("count_by_flair", f"""WITH {twins.POSTS}
SELECT subreddit, coalesce(flair, 'No flair') AS flair, count(*) AS n FROM posts GROUP BY ALL""")
def count_by_flair(spark, sf_dir):
    return profile.count_by(profile.fill_flair(inputs.posts(spark, sf_dir)), "subreddit", "flair")


@query("share_by_type", f"""WITH {twins.POSTS}
SELECT subreddit, is_self, count(*) AS n,
       round(100 * count(*) / sum(count(*)) OVER (PARTITION BY subreddit), 6) AS percent
FROM posts GROUP BY subreddit, is_self""")
def share_by_type(spark, sf_dir):
    return rounded(profile.share_by(inputs.posts(spark, sf_dir), "subreddit", "is_self"),
                   "percent")


@query("body_fill_counts", f"""WITH {twins.POSTS}
SELECT count(*) FILTER ({twins.stripped("body")} <> '') AS n_full,
       count(*) FILTER ({twins.stripped("body")} = '') AS n_empty FROM posts""")
def body_fill_counts(spark, sf_dir):
    return profile.body_fill_counts(inputs.posts(spark, sf_dir))


@query("posts_per_month", """SELECT o_orderstatus AS subreddit,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n
FROM orders GROUP BY ALL""")
def posts_per_month(spark, sf_dir):
    orders = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("subreddit"),
        inputs.epoch_seconds(F.col("o_orderdate")).alias("created_utc"))
    return profile.posts_per_month(orders).orderBy("month", "subreddit")


_DESCRIBED = """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
  round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q1,
  round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median,
  round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q3 FROM lineitem"""
_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount")


@query("describe", " UNION ALL ".join(_DESCRIBED.format(c=c) for c in _COLUMNS))
def describe(spark, sf_dir):
    stats = profile.describe(inputs.table(spark, sf_dir, "lineitem"), list(_COLUMNS))
    return rounded(stats, "mean", "std", "q1", "median", "q3")


def _events(spark, sf_dir):
    return inputs.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("subreddit"), "value")


@query("histogram", """WITH limits AS (
  SELECT event_type, min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 30 AS w
  FROM events GROUP BY 1),
binned AS (SELECT event_type, least(CAST(floor((value - lo) / w) AS INTEGER), 29) AS bin,
                  count(*) AS n FROM events JOIN limits USING (event_type) GROUP BY ALL)
SELECT event_type AS subreddit, CAST(bin AS INTEGER) AS bin, round(lo + bin * w, 6) AS low,
       round(CASE WHEN bin = 29 THEN hi ELSE lo + (bin + 1) * w END, 6) AS high,
       coalesce(n, 0) AS n
FROM limits CROSS JOIN range(30) r(bin) LEFT JOIN binned USING (event_type, bin)""")
def histogram(spark, sf_dir):
    return rounded(profile.histogram(_events(spark, sf_dir), "value"), "low", "high")


_BOX = """WITH q AS (
  SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
         quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT event_type AS subreddit, round(q1, 6) AS q1, round(median, 6) AS median,
       round(q3, 6) AS q3, min(value) FILTER (value BETWEEN lo AND hi) AS whisker_low,
       max(value) FILTER (value BETWEEN lo AND hi) AS whisker_high,
       count(*) FILTER (value NOT BETWEEN lo AND hi) AS n_outliers
FROM events JOIN f USING (event_type) GROUP BY event_type, q1, median, q3"""


@query("box_stats", _BOX)
def box_stats(spark, sf_dir):
    return rounded(profile.box_stats(_events(spark, sf_dir), "value", ["subreddit"]),
                   "q1", "median", "q3")


@query("kde_curve", """WITH s AS (
  SELECT event_type, count(*) AS n, min(value) AS lo, max(value) AS hi,
         stddev_samp(value) * pow(count(*), -0.2) AS h FROM events GROUP BY 1),
v AS (SELECT event_type, value, count(*) AS c FROM events GROUP BY 1, 2)
SELECT event_type AS subreddit, CAST(p AS INTEGER) AS point, round(lo + p * (hi - lo) / 199, 6) AS x,
       round(sum(c * exp(-0.5 * pow((lo + p * (hi - lo) / 199 - value) / h, 2)))
             / (n * h * sqrt(2 * pi())), 9) AS density
FROM s CROSS JOIN range(200) r(p) JOIN v USING (event_type)
GROUP BY event_type, p, lo, hi, n, h""")
def kde_curve(spark, sf_dir):
    curve = profile.kde_curve(_events(spark, sf_dir), "value")
    return rounded(rounded(curve, "x"), "density", digits=9)


def _top(source):
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""WITH {twins.POSTS},
words AS (SELECT subreddit, unnest(regexp_extract_all({source}, '\\p{{L}}+')) AS token FROM posts),
counts AS (SELECT subreddit, token, count(*) AS n FROM words
           WHERE lower(token) NOT IN ({stop}) GROUP BY ALL)
SELECT subreddit, token, n, row_number() OVER (PARTITION BY subreddit ORDER BY n DESC, token)
  AS rank FROM counts QUALIFY rank <= 25"""


def _top_tokens(spark, sf_dir, text):
    tokens = tx.content_tokens(text, STOP_WORDS)
    return profile.top_tokens(inputs.posts(spark, sf_dir), tokens).withColumn(
        "rank", F.col("rank").cast("long"))


@query("top_title_tokens", _top("title"))
def top_title_tokens(spark, sf_dir):
    return _top_tokens(spark, sf_dir, F.col("title"))


@query("top_body_tokens", _top("body"))
def top_body_tokens(spark, sf_dir):
    return _top_tokens(spark, sf_dir, F.col("body"))


@query("top_text_tokens", _top("title || ' ' || body"))
def top_text_tokens(spark, sf_dir):
    return _top_tokens(spark, sf_dir, F.concat("title", F.lit(" "), "body"))


# --- collection ---------------------------------------------------------------

_SEEN = "seen AS (SELECT id FROM posts WHERE doc_id < (SELECT count(*) FROM posts) / 2)"


def _seen(spark, sf_dir):
    posts = inputs.posts(spark, sf_dir).select("id", "doc_id")
    half = posts.agg((F.count(F.lit(1)) / 2).alias("h")).scalar()
    return posts.where(F.col("doc_id") < half).select("id")


@query("unseen_posts", f"""WITH {twins.POSTS}, {_SEEN}
SELECT id, subreddit, title, body FROM posts WHERE id NOT IN (SELECT id FROM seen)""")
def unseen_posts(spark, sf_dir):
    return listing.unseen_posts(inputs.posts(spark, sf_dir), _seen(spark, sf_dir)).select(
        "id", "subreddit", "title", "body")


@query("ingest_counts", f"""WITH {twins.POSTS}, {_SEEN},
asked(subreddit) AS (VALUES ('src0'), ('src1'), ('elsewhere'))
SELECT subreddit, count(p.id) AS n FROM asked LEFT JOIN
  (SELECT * FROM posts WHERE id NOT IN (SELECT id FROM seen)) p USING (subreddit) GROUP BY 1""")
def ingest_counts(spark, sf_dir):
    fresh = listing.unseen_posts(inputs.posts(spark, sf_dir), _seen(spark, sf_dir))
    return listing.counts_per_community(fresh, ["src0", "src1", "elsewhere"])


@query("flatten_snapshot", f"""WITH {twins.COMMENTS}
SELECT doc_id AS conv_id, CAST(count(*) AS INTEGER) AS n_comments_collected,
       string_agg(body, '|' ORDER BY turn) AS bodies FROM comments GROUP BY 1""")
def flatten_snapshot(spark, sf_dir):
    from tidewatch.operators.prepare import parsed_comments
    flat = listing.flatten_snapshot(inputs.comment_arrays(spark, sf_dir))
    bodies = F.transform(parsed_comments(F.col("comments_json")), lambda c: tx.strip(c["body"]))
    return flat.select("conv_id", "n_comments_collected", F.array_join(bodies, "|").alias("bodies"))


@query("normalise_submissions", f"""WITH {twins.POSTS}
SELECT id, title, body, coalesce(upvote_ratio, 'NaN'::DOUBLE) AS upvote_ratio, flair,
       {NOW}::DOUBLE AS snapshot_utc, '' AS domain, false AS over_18 FROM
  (SELECT id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE title END AS title, body,
          CASE WHEN doc_id % 3 <> 0 THEN upvote_ratio::DOUBLE END AS upvote_ratio, flair
   FROM posts)""")
def normalise_submissions(spark, sf_dir):
    n = F.col("doc_id")
    records = inputs.posts(spark, sf_dir).select(
        "id", "subreddit", F.when(n % 5 != 0, F.col("title")).alias("title"),
        F.col("body").alias("selftext"), "score", F.lit(0).alias("num_comments"), "created_utc",
        F.when(n % 3 != 0, F.col("upvote_ratio")).alias("upvote_ratio"),
        F.col("flair").alias("link_flair_text"), "is_self", F.lit("").alias("permalink"),
        F.lit(None).cast("string").alias("domain"), F.lit(None).cast("boolean").alias("over_18"),
        F.lit(None).cast("boolean").alias("spoiler"),
        F.lit(None).cast("array<struct<body:string,score:bigint,author:string,"
                         "stickied:boolean,distinguished:string>>").alias("comments"))
    return listing.normalise_submissions(records, NOW).select(
        "id", "title", "body", "upvote_ratio", "flair", "snapshot_utc", "domain", "over_18")


# Days before the newest post that a listing reaches back to; all posts are in the first.
_DAYS = {"all": 1_000_000, "year": 365, "month": 30, "week": 7, "day": 1}
_LIMIT, _LEGACY_LIMIT = 20, 30                   # both below the posts of a community
_LISTED = f"""{twins.POSTS},
entries AS (SELECT wrank, (96 - score) * 1099511627776 + doc_id AS pos, posts.* FROM posts,
              (VALUES {", ".join(f"({i}, {d})" for i, d in enumerate(_DAYS.values()))}) w(wrank, days)
            WHERE created_utc >= (SELECT max(created_utc) FROM posts) - days * 86400.0),
firsts AS (SELECT * FROM entries QUALIFY
           row_number() OVER (PARTITION BY subreddit, id ORDER BY wrank, pos) = 1)"""


def _entries(spark, sf_dir):
    """Every post in every listing that reaches back to it, by falling score."""
    posts = inputs.posts(spark, sf_dir).select("id", "subreddit", "doc_id", "created_utc", "title", "score")
    newest = posts.agg(F.max("created_utc")).scalar()
    listed = F.array(*[F.when(F.col("created_utc") >= newest - days * 86400.0, F.lit(w)) for w, days in _DAYS.items()])
    pos = (96 - F.col("score")) * F.lit(1 << 40) + F.col("doc_id")
    return posts.select("*", pos.alias("pos"), F.explode(F.array_compact(listed)).alias("window"))


@query("merged_listing", f"""WITH {_LISTED}, {_SEEN},
considered AS (SELECT * FROM firsts QUALIFY
               row_number() OVER (PARTITION BY subreddit ORDER BY wrank, pos, id) <= {_LIMIT})
SELECT id, subreddit FROM considered WHERE id NOT IN (SELECT id FROM seen)""")
def merged_listing(spark, sf_dir):
    merged = listing.merged_listing(_entries(spark, sf_dir), _LIMIT, seen=_seen(spark, sf_dir))
    return merged.select("id", "subreddit")


@query("legacy_listing", f"""WITH {_LISTED}
SELECT id, subreddit, created_utc AS submission_datetime,
       CASE WHEN doc_id % 2 = 0 THEN 'u' || doc_id ELSE 'Unknown' END AS author FROM firsts
QUALIFY row_number() OVER (PARTITION BY subreddit ORDER BY wrank, pos, id) <= {_LEGACY_LIMIT}""")
def legacy_listing(spark, sf_dir):
    n = F.col("doc_id")
    entries = _entries(spark, sf_dir).withColumn(
        "author", F.when(n % 2 == 0, F.concat(F.lit("u"), n.cast("string"))))
    return listing.legacy_listing(entries, _LEGACY_LIMIT).select(
        "id", "subreddit", "submission_datetime", "author")


@query("newest_per_community", f"""WITH {twins.POSTS}
SELECT id, subreddit, created_utc FROM posts QUALIFY
  row_number() OVER (PARTITION BY subreddit ORDER BY created_utc DESC, id) <= 15""")
def newest_per_community(spark, sf_dir):
    from tidewatch.plans.ranking import top_within
    posts = inputs.posts(spark, sf_dir).select("id", "subreddit", "created_utc")
    return top_within(posts, ["subreddit"], [F.col("created_utc").desc(), F.col("id")], 15) \
        .drop("rn")

"""Text features, folds, classifiers and their evaluation."""
from pyspark.sql import functions as F

from checks import inputs, twins
from checks.prepare_queries import PATTERNS
from tidewatch.functions import text as tx
from tidewatch.operators import features, models, policy

QUERIES = {}

# Repeated fits stop after so many passes of the solver; `logistic_fit_report` shows how far one gets.
PASSES = 50


def query(name, sql=None):
    def register(function):
        QUERIES[name] = (function, sql)
        return function
    return register


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def corpus(spark, sf_dir):
    """Documents labelled with their language, in the role of the community."""
    return inputs.documents(spark, sf_dir).select("id", F.col("lang").alias("subreddit"), "text")


def binary_corpus(spark, sf_dir):
    return corpus(spark, sf_dir).withColumn(
        "subreddit", F.when(F.col("subreddit") == "en", "en").otherwise("other"))


def turns(spark, sf_dir):
    return inputs.table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), "text")


# --- features -----------------------------------------------------------------

def _terms(source):
    """Distinct terms per document with counts; `source` is a query giving (id, text)."""
    words = f"regexp_extract_all(lower(text), '[{twins.WORD}]{{2,}}')"
    return f"""worded AS (SELECT id, {words} AS w FROM ({source})),
listed AS (
  SELECT id, unnest(w) AS term FROM worded UNION ALL
  SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
  FROM worded WHERE len(w) > 1),
terms AS (SELECT id, term, count(*) AS tf FROM listed GROUP BY ALL)"""


_TURNS = "SELECT conv_id || ':' || turn AS id, text FROM conversations"
_DOCS = "SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents"


def _weights(source):
    return f"""{_terms(source)},
vocab AS (SELECT term, count(*) AS df,
                 ln((1.0::DOUBLE + (SELECT count(*) FROM ({source}))) / (1 + count(*))) + 1 AS idf
          FROM terms GROUP BY term HAVING count(*) >= 2),
raw AS (SELECT id, term, (1 + ln(tf::DOUBLE)) * idf AS w FROM terms JOIN vocab USING (term)),
weights AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw)"""


@query("tokens", f"""SELECT CAST(doc_id AS VARCHAR) AS id,
       CAST(len(w) AS BIGINT) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM
  (SELECT doc_id, regexp_extract_all(lower(text), '[{twins.WORD}]{{2,}}') AS w FROM documents)""")
def tokens(spark, sf_dir):
    words = inputs.documents(spark, sf_dir).select("id", tx.tokens(F.col("text")).alias("w"))
    return words.select("id", F.size("w").cast("long").alias("n_tokens"),
                        F.md5(F.array_join("w", " ")).alias("tokens_md5"))


@query("document_terms", f"WITH {_terms(_TURNS)} SELECT id, term, tf FROM terms")
def document_terms(spark, sf_dir):
    return features.document_terms(turns(spark, sf_dir)).withColumn("tf", F.col("tf").cast("long"))


@query("vocabulary", f"""WITH {_weights(_DOCS)}
SELECT term, df, round(idf, 9) AS idf FROM vocab""")
def vocabulary(spark, sf_dir):
    docs = inputs.documents(spark, sf_dir).select("id", "text")
    vocab = features.vocabulary_of(docs)
    return rounded(vocab, "idf", digits=9)


@query("tfidf_weights", f"""WITH {_weights(_TURNS)}
SELECT id, term, round(weight, 9) AS weight FROM weights""")
def tfidf_weights(spark, sf_dir):
    return rounded(features.tfidf_of(turns(spark, sf_dir)), "weight", digits=9)


@query("tfidf_per_document", f"""WITH {_weights(_DOCS)}
SELECT id, count(*) AS n_terms, round(sum(weight), 6) AS total, round(max(weight), 6) AS largest
FROM weights GROUP BY id""")
def tfidf_per_document(spark, sf_dir):
    weights = features.tfidf_of(inputs.documents(spark, sf_dir).select("id", "text"))
    per_doc = weights.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("weight").alias("total"),
        F.max("weight").alias("largest"))
    return rounded(per_doc, "total", "largest")


# --- folds --------------------------------------------------------------------

_FOLDS = """folds AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, lang AS subreddit,
         CAST((row_number() OVER (ORDER BY lang, md5('0:' || doc_id), CAST(doc_id AS VARCHAR)) - 1)
              % 5 AS INTEGER) AS fold
  FROM documents)"""


@query("stratified_folds", f"WITH {_FOLDS} SELECT id, subreddit, fold FROM folds")
def stratified_folds(spark, sf_dir):
    docs = corpus(spark, sf_dir).select("id", "subreddit")
    return models.stratified_folds(docs, 5, 0)


@query("stratified_folds_by_digits", f"WITH {_FOLDS} SELECT id, subreddit, fold FROM folds")
def stratified_folds_by_digits(spark, sf_dir):
    """The same ranks by the digits of the hash, as groups of any size are ranked."""
    from tidewatch.functions import numeric
    from tidewatch.plans.ranking import rank_within
    docs = corpus(spark, sf_dir).select(
        "id", "subreddit", F.lit(1).alias("one"), numeric.seeded_hash(F.col("id"), 0).alias("h"))
    ranked = rank_within(docs, ["one"], [F.col("subreddit"), *numeric.hash_digits(F.col("h"))],
                         [F.col("subreddit"), F.col("h"), F.col("id")], "rank", window_limit=0)
    return ranked.select("id", "subreddit",
                         F.pmod(F.col("rank") - 1, F.lit(5)).cast("int").alias("fold"))


# --- classifiers --------------------------------------------------------------

@query("naive_bayes", f"""WITH {_weights(_DOCS)},
labelled AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang AS label FROM documents),
mass AS (SELECT label, term, sum(weight) AS m FROM weights JOIN labelled USING (id) GROUP BY ALL),
totals AS (SELECT label, sum(m) + (SELECT count(*) FROM vocab) AS total FROM mass GROUP BY label),
prior AS (SELECT label, ln(count(*)::DOUBLE / (SELECT count(*) FROM labelled)) AS p
          FROM labelled GROUP BY label),
xsum AS (SELECT id, sum(weight) AS x FROM weights GROUP BY id),
gain AS (SELECT id, label, sum(weight * ln(1 + m)) AS g FROM weights JOIN mass USING (term)
         GROUP BY ALL),
scores AS (
  SELECT l.id, p.label, p.p - ln(t.total) * coalesce(x.x, 0) + coalesce(g.g, 0) AS s
  FROM labelled l CROSS JOIN prior p JOIN totals t ON t.label = p.label
  LEFT JOIN xsum x ON x.id = l.id LEFT JOIN gain g ON g.id = l.id AND g.label = p.label),
shifted AS (SELECT *, s - max(s) OVER (PARTITION BY id) AS d FROM scores)
SELECT id, min_by(label, struct_pack(a := -d, b := label)) AS predicted,
       round(1 / sum(exp(d)), 6) AS confidence FROM shifted GROUP BY id""")
def naive_bayes(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    fitted = models.fit(docs, learner="naive_bayes")
    scored = models.predict_proba(fitted, docs)
    return rounded(scored.select("id", "predicted", "confidence"), "confidence")


_HELD_OUT = f"""WITH {_terms(_DOCS)}, {_FOLDS},
model AS (SELECT unnest(range(5)) AS i),
inside AS (SELECT i, id, subreddit FROM folds JOIN model ON fold <> i),
size AS (SELECT i, count(*) AS n FROM inside GROUP BY i),
known AS (SELECT i, term, ln((1.0::DOUBLE + max(n)) / (1 + count(*))) + 1 AS idf
          FROM inside JOIN size USING (i) JOIN terms USING (id) GROUP BY i, term HAVING count(*) >= 2),
raw AS (SELECT i, id, term, (1 + ln(tf::DOUBLE)) * idf AS w FROM terms JOIN known USING (term)),
weights AS (SELECT i, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY i, id)) AS weight FROM raw),
mass AS (SELECT i, subreddit, term, sum(weight) AS m FROM weights JOIN inside USING (i, id) GROUP BY ALL),
totals AS (SELECT i, subreddit, sum(m) + max(v) AS total FROM mass
           JOIN (SELECT i, count(*) AS v FROM known GROUP BY i) USING (i) GROUP BY i, subreddit),
prior AS (SELECT i, subreddit, ln(count(*)::DOUBLE / max(n)) AS p FROM inside JOIN size USING (i) GROUP BY ALL),
outside AS (SELECT fold AS i, id, subreddit AS label FROM folds),
xsum AS (SELECT i, id, sum(weight) AS x FROM weights JOIN outside USING (i, id) GROUP BY ALL),
gain AS (SELECT i, id, m.subreddit, sum(weight * ln(1 + m)) AS g FROM weights JOIN outside USING (i, id)
         JOIN mass m USING (i, term) GROUP BY ALL),
scores AS (SELECT o.i, o.id, label, p.subreddit, p.p - ln(t.total) * coalesce(x.x, 0) + coalesce(g.g, 0) AS s
           FROM outside o JOIN prior p ON p.i = o.i JOIN totals t ON t.i = o.i AND t.subreddit = p.subreddit
           LEFT JOIN xsum x ON x.i = o.i AND x.id = o.id
           LEFT JOIN gain g ON g.i = o.i AND g.id = o.id AND g.subreddit = p.subreddit),
shifted AS (SELECT *, s - max(s) OVER (PARTITION BY id) AS d FROM scores),
judged AS (SELECT id, max(label) AS label, CAST(max(i) AS INTEGER) AS fold,
                  min_by(subreddit, struct_pack(a := -d, b := subreddit)) AS predicted,
                  1 / sum(exp(d)) AS confidence FROM shifted GROUP BY id)"""


def _naive_bayes_runs(spark, sf_dir):
    return models.oof_predictions(corpus(spark, sf_dir), 5, 0, learner="naive_bayes")


@query("oof_naive_bayes", f"""{_HELD_OUT}
SELECT id, label, fold, predicted, round(confidence, 6) AS confidence FROM judged""")
def oof_naive_bayes(spark, sf_dir):
    runs = _naive_bayes_runs(spark, sf_dir)
    return rounded(runs.select("id", "label", "fold", "predicted", "confidence"), "confidence")


@query("cv_naive_bayes", f"""{_HELD_OUT},
per_fold AS (SELECT fold, avg(CASE WHEN predicted = label THEN 1.0::DOUBLE ELSE 0 END) AS accuracy
             FROM judged GROUP BY fold)
SELECT round(avg(accuracy), 9) AS cv_accuracy_mean, round(stddev_pop(accuracy), 9) AS cv_accuracy_std,
       count(*) AS n_fits FROM per_fold""")
def cv_naive_bayes(spark, sf_dir):
    scores = models.summarised(models.fold_scores(_naive_bayes_runs(spark, sf_dir)))
    return rounded(scores.select("cv_accuracy_mean", "cv_accuracy_std", "n_fits"),
                   "cv_accuracy_mean", "cv_accuracy_std", digits=9)


@query("logistic_batch_scoring")
def logistic_batch_scoring(spark, sf_dir):
    """Fits on the labelled documents only and scores all of them."""
    labelled = inputs.labelled(spark, sf_dir).select("id")
    docs = binary_corpus(spark, sf_dir)
    fitted = models.fit(docs.join(labelled, "id", "left_semi"))
    return models.predict_proba(fitted, docs).select("id", "predicted", "confidence")


@query("logistic_fit_report")
def logistic_fit_report(spark, sf_dir):
    """How the fits of a five-fold cross-validation end: passes, objective, largest gradient entry."""
    docs = binary_corpus(spark, sf_dir)
    return models.cv_fit_report(docs, 5, 0)


@query("oof_predictions")
def oof_predictions(spark, sf_dir):
    return models.oof_predictions(binary_corpus(spark, sf_dir), 5, 0)


@query("cv_scores")
def cv_scores(spark, sf_dir):
    return models.cv_scores(binary_corpus(spark, sf_dir), max_iter=PASSES)


@query("lift_over_rule")
def lift_over_rule(spark, sf_dir):
    docs = binary_corpus(spark, sf_dir)
    cv = models.cv_scores(docs, max_iter=PASSES)
    rule = tx.keyword_rule(F.col("text"), {"en": PATTERNS["first"], "other": PATTERNS["second"]},
                           "en")
    return models.lift_over_rule(docs, cv, rule)


@query("ablation")
def ablation(spark, sf_dir):
    return models.ablation(binary_corpus(spark, sf_dir), tx.any_token(PATTERNS), max_iter=PASSES)


@query("compare_learners")
def compare_learners(spark, sf_dir):
    return models.compare_learners(corpus(spark, sf_dir), 5, 42, logistic={"max_iter": PASSES})


@query("learning_curve")
def learning_curve(spark, sf_dir):
    return models.learning_curve(binary_corpus(spark, sf_dir), max_iter=PASSES)


@query("oof_operating_points")
def oof_operating_points(spark, sf_dir):
    """Threshold policy on the classifier's own out-of-fold predictions, over seeds."""
    runs = models.repeated_predictions(corpus(spark, sf_dir), max_iter=PASSES)
    scored = runs.withColumn("correct", F.col("predicted") == F.col("label"))
    sweep = policy.threshold_sweep(scored, policy.PRECISION_FLOORS, group=["seed"])
    return policy.operating_point_over_seeds(policy.best_operating_point(sweep, ["seed"]), 5)

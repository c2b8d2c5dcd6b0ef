"""Linear text classifiers: fitted for many training sets, kept as tables, scored inside the task.

Every model is a table (model, term, idf, coef per class) plus intercepts. Vocabulary and document
frequencies are taken from the training rows of each model only. Logistic models are fitted by Spark ML
over one table of vectors (`linear`); naive Bayes adds up weights by term for all models together.
Scoring looks the terms of a text up in a broadcast table of counted size (`vectors`), without a
shuffle; a larger model, or naive Bayes of a larger vocabulary, goes by blocks of documents (`blocks`).
"""
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.functions import numeric, text as tx
from tidewatch.operators import blocks, linear, metrics, vectors
from tidewatch.operators.vectors import hashes_of
from tidewatch.operators.features import (
    document_terms, join_vocabulary, smooth_idf, sublinear, vocabulary_bytes)
from tidewatch.plans.ranking import rank_within
from tidewatch.session import settle

# A logistic model is fitted on every labelled row of its training set. Only a caller that passes
# `max_fit_rows` gets a hashed share of about so many.
MAX_FIT_ROWS = None
LEARNERS = ("logistic", "naive_bayes")


def stratified_folds(df, k=5, seed=0, label="subreddit"):
    """Adds `fold`: rows in label order, shuffled within the label, dealt out in turn."""
    rows = df.withColumn("_h", numeric.seeded_hash(F.col("id"), seed))
    ranked = rank_within(rows, [], [F.col(label), *numeric.hash_digits(F.col("_h"))],
                         [F.col(label), F.col("_h"), F.col("id")], "_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")) \
        .drop("_h", "_rank")


@dataclass
class LinearModels:
    """One or more fitted models over the same classes."""
    classes: list
    intercepts: list          # one list per model, in class order
    table: DataFrame          # model, term, idf, coef
    n_rows: int

    def save(self, path):
        self.table.write.mode("overwrite").parquet(f"{path}/terms")
        spark = self.table.sparkSession
        spark.createDataFrame([(self.classes, self.intercepts, self.n_rows)],
                              "classes array<string>, intercepts array<array<double>>, n_rows long"
                              ).write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, spark, path):
        row = spark.read.parquet(f"{path}/model").first()
        return cls(list(row["classes"]), [list(i) for i in row["intercepts"]],
                   spark.read.parquet(f"{path}/terms"), row["n_rows"])


# --- fitting ------------------------------------------------------------------

def training_terms(df, label="subreddit", text="text", bigrams=True):
    """(id, label, other columns, term, tf) for fitting and scoring, written once for reuse."""
    rows = df.withColumn("label", F.col(label)) if label != "label" else df
    return settle(document_terms(rows, text, bigrams, outer=True))


def _members(sets):
    """The numbers of the training sets a row belongs to, exploded."""
    return F.explode(F.array_compact(F.array(
        *[F.when(s, F.lit(i)) for i, s in enumerate(sets)]))).alias("model")


def _vocabularies(terms, sets, n_docs, min_df):
    """(model, term, idf) of all models.

    Document frequencies of all sets are counted in one pass over the terms.
    """
    counted = terms.where(F.col("term").isNotNull()).groupBy("term").agg(
        *[F.count_if(s).alias(f"df{i}") for i, s in enumerate(sets)])
    entries = F.array(*[
        F.struct(F.lit(i).alias("model"), F.col(f"df{i}").alias("df"),
                 smooth_idf(F.col(f"df{i}"), n).alias("idf")) for i, n in enumerate(n_docs)])
    vocab = counted.select("term", F.explode(entries).alias("e")).where(F.col("e.df") >= min_df)
    return settle(vocab.select("e.model", "term", "e.idf"))


def _logistic_table(space, fits, slice_rows=1_000_000):
    """(model, term, idf, coef) of fitted models; each goes to Spark in slices."""
    spark, parts = space.rows.sparkSession, []
    for model, (idf, values) in enumerate(fits):
        known = np.flatnonzero(idf)
        for start in range(0, len(known), slice_rows):
            at = known[start:start + slice_rows]
            frame = pd.DataFrame({"model": np.int32(model), "idx": at, "idf": idf[at],
                                  **{f"c{c}": row[at] for c, row in enumerate(values)}})
            parts.append(spark.createDataFrame(frame))
    schema = "model int, idx long, idf double, " + ", ".join(f"c{c} double" for c in range(len(space.classes)))
    table = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        table = table.unionByName(part)
    words = space.terms.select("term", *vectors.term_parts(F.col("term"))).mapInArrow(
        _places(space), "term string, idx long")
    return words.join(table, "idx").select(
        "model", "term", "idf", F.array(*[f"c{c}" for c in range(len(space.classes))]).alias("coef"))


def _places(space):
    """Adds to the terms their index in the vectors."""
    held = space.rows.sparkSession.sparkContext.broadcast(space.hashes)

    def run(batches):
        for batch in batches:
            at = np.searchsorted(held.value, hashes_of(pa.Table.from_batches([batch])))
            yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array(at)], ["term", "idx"])
    return run


def _naive_bayes(terms, sets, vocab, vocab_sizes, counts, classes, alpha):
    """(model, term, idf, coef) with smoothed log probabilities per class, and log priors."""
    facts = terms.select("id", "label", "term", "tf", _members(sets))
    known = join_vocabulary(facts, vocab, ["model", "term"], sum(vocab_sizes)) \
        .where(F.col("idf").isNotNull()) \
        .select("model", "id", "label", "term", "idf",
                (sublinear(F.col("tf")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("model", "id")))
    x = settle(known.withColumn("x", F.col("w") / norm).groupBy("model", "term").agg(
        F.max("idf").alias("idf"),
        *[F.sum(F.when(F.col("label") == label, F.col("x")).otherwise(0.0)).alias(f"m{c}")
          for c, label in enumerate(classes)]))
    return _bayes_table(x, vocab_sizes, counts, classes, alpha)


def _bayes_table(x, vocab_sizes, counts, classes, alpha):
    """The models from their classes' masses (model, term, idf, m0, m1, ...)."""
    totals = x.groupBy("model").agg(*[F.sum(f"m{c}") for c in range(len(classes))]).collect()
    logs = [[0.0] * len(classes) for _ in counts]
    for row in totals:                                       # one row per model
        logs[row[0]] = [float(np.log(m + alpha * vocab_sizes[row[0]])) for m in row[1:]]
    log_total = F.get(F.array(*[F.array(*[F.lit(v) for v in row]) for row in logs]),
                      F.col("model"))
    table = x.select("model", "term", "idf", F.array(*[
        F.ln(F.col(f"m{c}") + alpha) - F.get(log_total, F.lit(c)) for c in range(len(classes))])
        .alias("coef"))
    with np.errstate(divide="ignore"):
        priors = np.log(counts / counts.sum(axis=1, keepdims=True))
    return table, priors


def _class_sizes(docs, label, sets):
    """The classes in order and an array of their sizes in each training set."""
    sizes = docs.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(
        *[F.count_if(s).alias(f"n{i}") for i, s in enumerate(sets)]).collect()  # row per class
    sizes = sorted(sizes, key=lambda r: r["label"])
    return [r["label"] for r in sizes], np.array(
        [[float(r[f"n{i}"]) for r in sizes] for i in range(len(sets))])


def _within(condition, n, most):
    """A training set of n rows cut to about `most` by hash of the id."""
    if n <= most:
        return condition
    return condition & (F.pmod(F.xxhash64(F.lit("fit"), F.col("id")), F.lit(2 ** 40)) < int(
        most / n * 2 ** 40))


def _logistic_space(docs, sets, label, max_fit_rows, min_df=2, text="text", bigrams=True):
    """The shared vectors of all training sets; with `max_fit_rows` the larger ones are cut to about so many rows."""
    classes, counts = _class_sizes(docs, label, sets)
    if max_fit_rows is not None and counts.sum(axis=1).max(initial=0) > max_fit_rows:
        sets = [_within(s, n, max_fit_rows) for s, n in zip(sets, counts.sum(axis=1))]
        classes, counts = _class_sizes(docs, label, sets)
    return linear.space_of(docs, sets, classes, [int(n) for n in counts.sum(axis=1)], min_df=min_df,
                           text=text, bigrams=bigrams, class_of=label)


def fit_models(docs, terms, sets, *, learner="logistic", label="subreddit", text="text", bigrams=True,
               min_df=2, alpha=1.0, max_fit_rows=MAX_FIT_ROWS, **solver):
    """Fits one model per training set, all of them together.

    `sets` are conditions on the columns of `docs`. Naive Bayes reads `terms`, from `training_terms`,
    which has these columns too; a logistic model reads the text of `docs`, and takes every row of a set
    unless the caller sets `max_fit_rows`; `solver` has C, max_iter and tol.
    """
    if learner not in LEARNERS:
        raise ValueError(f"learner must be one of {LEARNERS}, got {learner!r}")
    if learner == "logistic":
        space = _logistic_space(docs, sets, label, max_fit_rows, min_df, text, bigrams)
        if not isinstance(space, linear.Space):
            fits = linear.for_each_set(space, lambda i, fit: (settle(fit.table(i)), fit.bias, fit.n_terms), **solver)
            return LinearModels(space.classes, [bias for _, bias, _ in fits], _union([table for table, _, _ in fits]),
                                sum(n for _, _, n in fits))
        fits = linear.for_each_set(space, lambda i, fit: (fit.idf, *fit.coefficients()), **solver)
        table = settle(_logistic_table(space, [(idf, values) for idf, values, _ in fits]))
        return LinearModels(space.classes, [bias for _, _, bias in fits], table,
                            sum(int((idf > 0).sum()) for idf, _, _ in fits))
    classes, counts = _class_sizes(docs, label, sets)
    n_docs = [int(n) for n in counts.sum(axis=1)]
    terms = terms.where(F.col("label").isNotNull())
    vocab = _vocabularies(terms, sets, n_docs, min_df)
    in_vocab = {r["model"]: r["n"] for r in vocab.groupBy("model").agg(
        F.count(F.lit(1)).alias("n")).collect()}             # one row per model
    vocab_sizes = [in_vocab.get(i, 0) for i in range(len(sets))]
    table, intercepts = _naive_bayes(terms, sets, vocab, vocab_sizes, counts, classes, alpha)
    return LinearModels(classes, [[float(b) for b in row] for row in intercepts], settle(table),
                        sum(vocab_sizes))


def fit_bayes_by_blocks(docs, sets, *, label="subreddit", text="text", bigrams=True, min_df=2, alpha=1.0):
    """The naive Bayes models of `fit_models` from the texts of `docs`, a training set at a time, by
    blocks of documents (`blocks`): no row per term of a document is written or moved."""
    docs = docs.where(F.col(label).isNotNull())
    classes, counts = _class_sizes(docs, label, sets)
    masses = []
    for i, (chosen, n) in enumerate(zip(sets, counts.sum(axis=1))):
        rows = docs.where(chosen).select(F.col(label).alias("label"), text)
        with blocks.passing(docs.sparkSession):              # the masses are written, their blocks go
            masses.append(settle(blocks.class_masses(
                rows, blocks.count_words(rows, text), classes, int(n), "label", text, min_df, bigrams
            ).withColumn("model", F.lit(i))))
    vocab_sizes = [m.count() for m in masses]
    table, intercepts = _bayes_table(_union(masses), vocab_sizes, counts, classes, alpha)
    return LinearModels(classes, [[float(b) for b in row] for row in intercepts], table, sum(vocab_sizes))


def _bayes(options):
    """The options that naive Bayes has."""
    return {k: v for k, v in options.items() if k in ("min_df", "alpha")}


def _by_blocks(learner, docs, text="text", bigrams=True, min_df=2, **_):
    """Whether a vocabulary of these texts may be too large for a broadcast (naive Bayes only)."""
    return learner == "naive_bayes" and vocabulary_bytes(
        blocks.count_words(docs, text), min_df, bigrams) > vectors.BROADCAST_BYTES


def fit(df, *, label="subreddit", text="text", bigrams=True, learner="logistic", **options):
    """One model on all rows of (id, label, text)."""
    docs = df.select("id", F.col(label).alias("label"), text)
    if _by_blocks(learner, docs, text, bigrams, **options):
        return fit_bayes_by_blocks(docs, [F.lit(True)], label="label", text=text, bigrams=bigrams, **_bayes(options))
    terms = training_terms(docs, "label", text, bigrams) if learner == "naive_bayes" else None
    return fit_models(docs, terms, [F.lit(True)], label="label", text=text, bigrams=bigrams,
                      learner=learner, **options)


# --- scoring ------------------------------------------------------------------

def score_terms(models, terms, carried=(), own=None, broadcast_limit=2_000_000):
    """Class probabilities, label and confidence for every document and model.

    `terms` are rows (id, carried columns, term, tf), with a null term for documents without any.
    `own` names an integer column: then each document is only scored by that model.
    """
    k = len(models.classes)
    keys = ["id", *carried]
    if own is not None or len(models.intercepts) == 1:
        chosen = F.col(own) if own is not None else F.lit(0)
        facts = terms.select(*keys, chosen.cast("int").alias("model"), "term", "tf")
    else:
        every = F.explode(F.array(*[F.lit(i) for i in range(len(models.intercepts))]))
        facts = terms.select(*keys, "term", "tf", every.alias("model"))
    joined = join_vocabulary(facts, models.table, ["model", "term"], models.n_rows,
                             limit=broadcast_limit)
    w = sublinear(F.col("tf")) * F.col("idf")
    sums = joined.withColumn("_w", w).groupBy(*keys, "model").agg(
        F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"),
        *[F.sum(F.col("_w") * F.get(F.col("coef"), F.lit(c))).alias(f"_s{c}") for c in range(k)])
    bias = F.get(F.array(*[F.array(*[F.lit(b) for b in row]) for row in models.intercepts]),
                 F.col("model"))
    scores = F.array(*[
        F.get(bias, F.lit(c)) + F.coalesce(F.try_divide(F.col(f"_s{c}"), F.col("_norm")),
                                           F.lit(0.0)) for c in range(k)])
    scored = sums.select(*keys, "model", scores.alias("_scores"))
    top = F.array_max("_scores")
    scored = scored.select(*keys, "model", F.transform(
        "_scores", lambda s: F.exp(s - top)).alias("_exp"))
    total = F.aggregate("_exp", F.lit(0.0), lambda a, b: a + b)
    scored = scored.withColumn("probability", F.transform("_exp", lambda e: e / total)) \
        .drop("_exp")
    return _judged(models, scored, [*keys, "model"])


def _judged(models, scored, columns):
    names = F.array(*[F.lit(c) for c in models.classes])
    return scored.select(*columns, "probability",
                         numeric.argmax_label(F.col("probability"), names).alias("predicted"),
                         F.array_max("probability").alias("confidence"))


def score_texts(models, df, text="text", bigrams=True, carried=(), own=None,
                broadcast_bytes=vectors.BROADCAST_BYTES):
    """As `score_terms`, from texts: inside the task while the models' table, whose bytes are counted,
    is within `broadcast_bytes`; else by blocks of documents, a model at a time."""
    columns = list(dict.fromkeys(["id", *carried, *([own] if own is not None else [])]))
    n_models = len(models.intercepts)
    n_terms = models.n_rows if n_models == 1 else models.table.agg(F.count_distinct("term")).first()[0]
    if vectors.table_bytes(n_models, n_terms, len(models.classes)) > broadcast_bytes:
        parts = []
        for i in range(n_models):
            rows = df.select(*columns, text).where(F.lit(True) if own is None else F.col(own) == i)
            parts.append(blocks.block_probabilities(
                models.table.where(F.col("model") == i), models.intercepts[i], rows, text, bigrams).withColumn("model", F.lit(i)))
        return _judged(models, _union(parts), [*columns, "model"])
    table = vectors.ScoringTable.of(models.table, models.intercepts)
    scored = vectors.class_probabilities(table, df.select(*columns, text), text, bigrams, own)
    return _judged(models, scored, [*columns, "model"])


def predict_proba(models, df, text="text", bigrams=True, carried=(), **options):
    """Scores texts with a single fitted model."""
    return score_texts(models, df, text, bigrams, carried, **options).drop("model")


# --- cross-validation ---------------------------------------------------------

def _held_out(k):
    return [F.col("fold") != i for i in range(k)]


def _union(frames):
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def _folded(df, k, seeds, label):
    """Ids and labels with the fold of every seed as `fold_<number>`, and the text met once, by id."""
    ids = df.select("id", F.col(label).alias("label"))
    folds = None
    for n, seed in enumerate(seeds):
        one = stratified_folds(ids, k, seed, "label").withColumnRenamed("fold", f"fold_{n}")
        folds = one if folds is None else folds.join(one.select("id", f"fold_{n}"), "id")
    return settle(folds)


def cv_fit_report(df, k=5, seed=0, label="subreddit", text="text", bigrams=True, max_fit_rows=MAX_FIT_ROWS,
                  min_df=2, **solver):
    """How the logistic fits of a cross-validation end (`linear.fit_report`)."""
    docs = df.select("id", text).join(_folded(df, k, [seed], label), "id")
    space = _logistic_space(docs, [F.col("fold_0") != i for i in range(k)], "label", max_fit_rows, min_df,
                            text, bigrams)
    return linear.fit_report(space, **solver)


def _logistic_runs(df, k, seeds, label, text, bigrams, with_train, max_fit_rows=MAX_FIT_ROWS, min_df=2,
                   **solver):
    """(seed number, model, id, label, fold, probability, predicted, confidence) of all folds of all seeds,
    fitted over the same vectors."""
    docs = df.select("id", text).join(_folded(df, k, seeds, label), "id")
    runs = [(n, i) for n in range(len(seeds)) for i in range(k)]
    space = _logistic_space(docs, [F.col(f"fold_{n}") != i for n, i in runs], "label", max_fit_rows,
                            min_df, text, bigrams)

    def use(number, fit):
        n, i = runs[number]
        rows = space.rows if with_train else space.rows.where(F.col(f"fold_{n}") == i)
        # written here, so that the driver can give up the fit
        return settle(fit.predictions(rows.withColumn("fold", F.col(f"fold_{n}")), space.classes,
                                      ["id", "label", "fold"]).withColumns({"_seed": F.lit(n), "model": F.lit(i)}))
    return _union(linear.for_each_set(space, use, **solver))


def cross_validated(df, k=5, seed=0, label="subreddit", text="text", bigrams=True,
                    with_train=False, learner="logistic", **options):
    """Every row scored by the model of its fold, which never saw it (`model = fold`).

    With `with_train` the other models' scores are returned as well.
    """
    if learner == "logistic":
        return _logistic_runs(df, k, [seed], label, text, bigrams, with_train, **options).drop("_seed")
    docs = df.select("id", text).join(
        _folded(df, k, [seed], label).withColumnRenamed("fold_0", "fold"), "id")
    if _by_blocks(learner, docs, text, bigrams, **options):
        models = fit_bayes_by_blocks(docs, _held_out(k), label="label", text=text, bigrams=bigrams, **_bayes(options))
    else:
        terms = training_terms(docs, "label", text, bigrams)
        models = fit_models(docs, terms, _held_out(k), label="label", learner=learner, **options)
    return score_texts(models, docs, text, bigrams, ["label", "fold"], None if with_train else "fold")


def oof_predictions(df, k=5, seed=0, **options):
    """Out-of-fold label, probabilities and confidence of every row."""
    return cross_validated(df, k, seed, **options).drop("model")


def fold_scores(predictions, group=("fold",)):
    """Accuracy and macro F1 per fold."""
    group = list(group)
    report = metrics.classification_report(predictions, "label", "predicted", group) \
        .withColumnRenamed("label", "row")
    return report.groupBy(*group).agg(
        F.max(F.when(F.col("row") == "accuracy", F.col("f1"))).alias("accuracy"),
        F.max(F.when(F.col("row") == "macro avg", F.col("f1"))).alias("macro_f1"))


def repeated_predictions(df, k=5, seeds=range(5), label="subreddit", text="text", bigrams=True,
                         learner="logistic", **options):
    """Out-of-fold predictions for several fold assignments, told apart by `seed`."""
    seeds = list(seeds)
    if learner == "logistic":
        runs = _logistic_runs(df, k, seeds, label, text, bigrams, False, **options)
        number = F.array(*[F.lit(s) for s in seeds])
        return runs.withColumn("seed", F.get(number, F.col("_seed"))).drop("_seed", "model")
    return _union([oof_predictions(df, k, seed, label=label, text=text, bigrams=bigrams, learner=learner,
                                   **options).withColumn("seed", F.lit(seed)) for seed in seeds])


def cv_scores(df, k=5, seeds=range(5), **options):
    """Mean and spread of accuracy and macro F1 over repeated cross-validation, in one row."""
    return summarised(fold_scores(repeated_predictions(df, k, seeds, **options),
                                  ["seed", "fold"]))


def summarised(scores):
    """One row from the scores of all folds and seeds."""
    return scores.agg(
        F.avg("accuracy").alias("cv_accuracy_mean"),
        F.stddev_pop("accuracy").alias("cv_accuracy_std"),
        F.avg("macro_f1").alias("cv_macro_f1_mean"), F.count(F.lit(1)).alias("n_fits"))


def ablation(df, pattern, k=5, seeds=range(5), text="text", cv=None, **options):
    """Cross-validated accuracy with and without the given tokens in the text.

    `cv` are the scores of `cv_scores` on the whole text, where they are known already.
    """
    whole = (cv if cv is not None else cv_scores(df, k, seeds, text=text, **options)).select(
        F.lit("whole").alias("variant"), "cv_accuracy_mean")
    stripped = df.withColumn(text, tx.strip_tokens(F.col(text), pattern))
    less = cv_scores(stripped, k, seeds, text=text, **options).select(
        F.lit("stripped").alias("variant"), "cv_accuracy_mean")
    means = whole.unionByName(less)

    def of(variant):
        return F.max(F.when(F.col("variant") == variant, F.col("cv_accuracy_mean")))
    return means.agg(of("whole").alias("cv_accuracy_mean"),
                     of("stripped").alias("cv_accuracy_tokens_removed"),
                     (of("whole") - of("stripped")).alias("ablation_drop"))


def compare_learners(df, k=5, seed=42, learners=LEARNERS, logistic=None, **options):
    """Test and train scores of each learner under the same folds, each fitted on all training rows.

    `logistic` has options of its solver."""
    own = {"logistic": {"max_fit_rows": None, **(logistic or {})}}   # else the train side holds unseen rows
    table = None
    for learner in learners:
        scored = cross_validated(df, k, seed, with_train=True, learner=learner, **own.get(learner, {}), **options)
        side = F.when(F.col("fold") == F.col("model"), "test").otherwise("train")
        scores = fold_scores(scored.withColumn("side", side), ["model", "side"])

        def on(name, value):
            return F.when(F.col("side") == name, F.col(value))
        row = scores.agg(
            F.avg(on("test", "accuracy")).alias("cv_accuracy"),
            F.stddev_pop(on("test", "accuracy")).alias("cv_std"),
            F.avg(on("test", "macro_f1")).alias("macro_f1"),
            F.avg(on("train", "accuracy")).alias("train_accuracy")) \
            .withColumn("learner", F.lit(learner))
        table = row if table is None else table.unionByName(row)
    return table


def lift_over_rule(df, cv, rule, label="subreddit"):
    """Cross-validated accuracy minus the accuracy of a rule column on the same rows."""
    of_rule = metrics.accuracy(df.withColumn("_rule", rule), label, "_rule").select(
        F.col("accuracy").alias("rule_accuracy")).scalar()
    return cv.withColumn("rule_accuracy", of_rule).withColumn(
        "lift_over_rule", F.col("cv_accuracy_mean") - F.col("rule_accuracy"))


LEARNING_SIZES = (0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0)


def learning_curve(df, fractions=LEARNING_SIZES, k=5, seed=42, label="subreddit", text="text",
                   bigrams=True, min_df=1, learner="logistic", **options):
    """Held-out accuracy when training on growing shuffled prefixes of each training fold, whole ones."""
    docs = stratified_folds(df.select("id", F.col(label).alias("label")), k, seed, "label")
    # One shuffle of all rows; the prefix of a training fold is its first rows in that order.
    order = docs.withColumn("_h", numeric.seeded_hash(F.col("id"), f"curve{seed}"))
    digits = numeric.hash_digits(F.col("_h"))
    for i in range(k):
        held = order.withColumn("_in", F.when(F.col("fold") == i, 1).otherwise(0))
        order = rank_within(held, [], [F.col("_in"), *digits],
                            [F.col("_in"), F.col("_h"), F.col("id")], f"rank{i}").drop("_in")
    docs = settle(order.drop("_h"))
    n_train = docs.where(F.col("fold") != 0).count()
    sizes = [int(f * n_train) for f in fractions]
    docs = df.select("id", text).join(docs, "id")
    keys = [(i, size) for i in range(k) for size in sizes]
    sets = [(F.col("fold") != i) & (F.col(f"rank{i}") <= size) for i, size in keys]
    spark = df.sparkSession
    if learner == "logistic":
        # all rows of a set, else `train_size` is not what was fitted
        space = _logistic_space(docs, sets, "label", None, min_df, text, bigrams)

        def use(number, fit):
            fold, size = keys[number]
            scored = fit.predictions(space.rows.where(F.col("fold") == fold), space.classes, ["id", "label"])
            return (size, metrics.accuracy(scored, "label", "predicted").first()["accuracy"])
        per_fold = spark.createDataFrame(linear.for_each_set(space, use, **options), "train_size int, accuracy double")
    else:
        terms = training_terms(docs, "label", text, bigrams)
        models = fit_models(docs, terms, sets, label="label", learner=learner, min_df=min_df, **options)
        chosen = spark.createDataFrame([(n, *key) for n, key in enumerate(keys)], "model int, fold int, train_size int")
        held_out = docs.withColumn("_model", F.explode(F.sequence(
            F.col("fold") * len(sizes), F.col("fold") * len(sizes) + len(sizes) - 1)))
        scored = score_texts(models, held_out, text, bigrams, ["label", "fold"], "_model")
        per_fold = metrics.accuracy(scored, "label", "predicted", ["model", "fold"]).join(
            F.broadcast(chosen), ["model", "fold"])
    return per_fold.groupBy("train_size").agg(
        F.avg("accuracy").alias("cv_accuracy"), F.count(F.lit(1)).alias("n_folds"))

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import blocks, descent, features, linear, models, spans, vectors

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        label = ("a", "b", "c")[i % 3]
        weights = np.ones(len(WORDS))
        weights[(i % 3) * 2:(i % 3) * 2 + 2] += 2.5
        words = rng.choice(WORDS, size=rng.integers(0, 9), p=weights / weights.sum())
        rows.append((f"d{i}", label, " ".join(words)))
    return spark.createDataFrame(rows, "id string, subreddit string, text string")


def dense(docs, min_df):
    """Weights of documents (label, text), term by term, with the terms in order."""
    counted = {}
    for _, text in docs:
        for t in set(text.split()):
            counted[t] = counted.get(t, 0) + 1
    terms = sorted(t for t, n in counted.items() if n >= min_df)
    x = np.zeros((len(docs), len(terms)))
    for row, (_, text) in zip(x, docs):
        words = text.split()
        for i, t in enumerate(terms):
            if t in words:
                row[i] = (1 + np.log(words.count(t))) * (np.log((1 + len(docs)) / (1 + counted[t])) + 1)
        row /= np.linalg.norm(row) or 1.0
    return terms, x


@pytest.mark.parametrize("n_classes", [2, 3])
def test_logistic_fit_is_stationary(corpus, n_classes):
    """Weights computed here, and the gradient of mean loss + |w|^2 / 2n at the fit's coefficients."""
    some = corpus.where(F.col("subreddit").isin(list("abc")[:n_classes])).orderBy("id")
    rows = [(r.subreddit, r.text) for r in some.collect()]
    fitted = models.fit(some, bigrams=False, tol=1e-12, max_iter=2000)
    terms, x = dense(rows, 2)
    coef = {r.term: r.coef for r in fitted.table.collect()}
    assert sorted(coef) == terms
    w, bias = np.array([coef[t] for t in terms]).T, np.array(fitted.intercepts[0])
    scores = x @ w.T + bias
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    y = np.array([[label == c for c in fitted.classes] for label, _ in rows], float)
    gradient = (p - y).T @ x / len(rows)
    expected = w / len(rows) if n_classes > 2 else np.vstack([-w[1], w[1]]) / len(rows)
    assert np.abs(gradient + expected).max() < 1e-5
    scored = {r.id: r.probability for r in models.predict_proba(fitted, some, bigrams=False).collect()}
    ids = [r.id for r in some.collect()]
    assert np.allclose([scored[i] for i in ids], p, atol=1e-9)


def test_the_report_of_a_fit(corpus):
    sizes = models._class_sizes(corpus, "subreddit", [F.lit(True), F.col("id") != "d3"])
    space = linear.space_of(corpus, [F.lit(True), F.col("id") != "d3"], sizes[0],
                            [int(n) for n in sizes[1].sum(axis=1)], class_of="subreddit")
    rows = linear.fit_report(space, tol=1e-12).orderBy("model").collect()
    assert [r.n_rows for r in rows] == [120, 119]
    assert all(r.gradient_norm < 1e-5 and r.iterations > 1 and r.n_terms > 8 for r in rows)


@pytest.mark.parametrize("bigrams", [False, True])
def test_counts_in_the_task_are_those_of_the_terms(spark, tmp_path, bigrams):
    texts = ["", None, "one two one two one", "Über uns über uns", "a b c", "x1 y2\n\nz3 x1", "w " * 50 + "word " * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    terms = features.document_terms(docs, bigrams=bigrams)
    known = terms.select("term").distinct().where("term <> 'uns'")
    named = [r.term for r in known.collect()]
    hashes = vectors.hashes_of(known.select("term", *vectors.term_parts(F.col("term"))).toArrow())
    names = dict(zip(hashes.tolist(), named))
    ordered = np.sort(hashes)
    rows = vectors.count_vectors(docs, ordered, str(tmp_path / "v"), bigrams=bigrams).collect()
    got = {(r.id, names[int(ordered[i])], round(float(np.exp(v - 1)))) for r in rows for i, v in zip(r.v.indices, r.v.values)}
    assert got == {(r.id, r.term, r.tf) for r in terms.where("term <> 'uns'").collect()}
    assert sorted(r.id for r in rows) == list(range(len(texts)))


def test_weights_are_the_same_on_both_paths(corpus):
    inside, joined = (features.tfidf_of(corpus, broadcast_bytes=b) for b in (vectors.BROADCAST_BYTES, 0))
    assert "Exchange" not in inside._jdf.queryExecution().executedPlan().toString()
    rows = [sorted((r.id, r.term, round(r.weight, 12)) for r in df.collect()) for df in (inside, joined)]
    assert rows[0] == rows[1] and len(rows[0]) > 500


def test_weights_by_blocks_are_those_of_one_block(spark, monkeypatch):
    """Blocks smaller than a document, several ranges, repeated and null ids, empty and null texts."""
    texts = ["one two one two one", "", None, "two one three", "one", "Über uns über uns one two", "w " * 50 + "word " * 700 + "one two"]
    docs = spark.createDataFrame([(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(0, "one two word")], "id int, text string")
    expected = sorted((str(r.id), r.term, round(r.weight, 12)) for r in features.tfidf(
        features.document_terms(docs.where("id is not null and text <> 'one two word'")),
        features.vocabulary(features.document_terms(docs), docs.count())).collect() if r.id != 0)
    assert len(expected) > 8
    for words, range_words in ((1 << 19, 1 << 21), (7, 5)):
        monkeypatch.setattr(blocks, "BLOCK_WORDS", words)
        monkeypatch.setattr(blocks, "RANGE_WORDS", range_words)
        found = blocks.block_weights(docs.repartition(3), blocks.count_words(docs))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "Generate" not in plan and "Window" not in plan
        rows = found.collect()
        assert sorted((str(r.id), r.term, round(r.weight, 12)) for r in rows if r.id not in (None, 0)) == expected
        assert sum(r.id is None for r in rows) == 1 and sum(r.id == 0 for r in rows) == 8


def test_scoring_neither_explodes_nor_shuffles(corpus):
    fitted = models.fit(corpus)
    plan = models.predict_proba(fitted, corpus)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "MapInArrow" in plan


def test_folds_are_stratified_and_stable(corpus):
    folds = models.stratified_folds(corpus, 5, 1)
    counts = [r["count"] for r in folds.groupBy("subreddit", "fold").count().collect()]
    assert len(counts) == 15 and max(counts) - min(counts) <= 1
    again = models.stratified_folds(corpus.repartition(6), 5, 1)
    assert folds.exceptAll(again).isEmpty()


@pytest.mark.parametrize("learner", models.LEARNERS)
def test_out_of_fold_predictions(corpus, learner):
    rows = models.oof_predictions(corpus, 4, 0, learner=learner).collect()
    assert len({r.id for r in rows}) == len(rows) == 120
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in rows)
    assert sum(r.predicted == r.label for r in rows) > 60          # chance is 40


def test_held_out_words_do_not_reach_the_vocabulary(spark, corpus):
    """A word that only two rows of one fold share is unknown to that fold's model."""
    docs = models.stratified_folds(corpus, 4, 0).withColumn("label", F.col("subreddit"))
    pair = [r.id for r in docs.where("fold = 2").limit(2).collect()]
    docs = docs.withColumn("text", F.when(F.col("id").isin(pair), F.concat("text", F.lit(" leak")))
                           .otherwise(F.col("text")))
    terms = models.training_terms(docs, "label")
    fitted = models.fit_models(docs, terms, models._held_out(4), label="label",
                               learner="naive_bayes")
    assert {r.model for r in fitted.table.where("term = 'leak'").collect()} == {0, 1, 3}


def test_saved_model_scores_alike_on_both_join_paths(spark, corpus, tmp_path):
    fitted = models.fit(corpus)
    fitted.save(str(tmp_path / "m"))
    loaded = models.LinearModels.load(spark, str(tmp_path / "m"))
    first = {r.id: r.confidence for r in models.predict_proba(fitted, corpus).collect()}
    spread = models.predict_proba(loaded, corpus, broadcast_bytes=0)
    assert "Exchange" in spread._jdf.queryExecution().executedPlan().toString()
    for r in spread.collect():
        assert r.confidence == pytest.approx(first[r.id], rel=1e-12)
    assert len(first) == 120


def test_a_bounded_share_of_the_labelled_rows_is_enough_to_fit(corpus):
    fitted = models.fit(corpus, max_fit_rows=80)
    assert fitted.n_rows < models.fit(corpus).n_rows
    rows = models.predict_proba(fitted, corpus, carried=["subreddit"]).collect()
    assert sum(r.predicted == r.subreddit for r in rows) > 60


@pytest.mark.parametrize("run", [
    lambda df: models.fit(df), lambda df: models.cv_fit_report(df, 2), lambda df: models.cv_scores(df, 2, (3, 4))])
def test_large_training_sets_are_fitted_whole(spark, monkeypatch, run):
    class Seen(Exception):
        pass

    def sizes_of(docs, sets, classes, sizes, **_):
        raise Seen(sizes)
    monkeypatch.setattr(linear, "space_of", sizes_of)
    n = 401_000
    rows = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("some words").alias("text"),
                                 F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("subreddit"))
    with pytest.raises(Seen) as seen:
        run(rows)
    assert set(seen.value.args[0]) <= {n, n // 2}


def test_vocabulary_by_blocks_is_the_same(spark, corpus, monkeypatch):
    docs = corpus.select("text").unionByName(spark.createDataFrame([(None,), ("",), ("Über uns über uns",), ("uns",)], "text string"))
    monkeypatch.setattr(blocks, "BLOCK_WORDS", 30)
    monkeypatch.setattr(blocks, "RANGE_WORDS", 100)
    counted, by_blocks = (features.vocabulary_of(docs, broadcast_bytes=b) for b in (vectors.BROADCAST_BYTES, 0))
    plan = by_blocks._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "HashAggregate" not in plan
    assert sorted(by_blocks.collect()) == sorted(counted.collect()) and counted.where("term = 'uns'").first().df == 2


def test_naive_bayes_by_blocks_is_the_same(corpus, monkeypatch):
    """Texts and labels may be null."""
    odd = corpus.withColumns({"text": F.when(F.col("id") != "d7", F.col("text")),
                              "subreddit": F.when(F.col("id") != "d8", F.col("subreddit"))})

    def results():
        fitted = models.fit(odd, learner="naive_bayes")
        runs = models.oof_predictions(corpus, 4, 0, learner="naive_bayes")
        return (sorted((r.term, round(r.idf, 12), *[round(c, 9) for c in r.coef]) for r in fitted.table.collect()),
                sorted((r.id, r.predicted, round(r.confidence, 9)) for r in models.predict_proba(fitted, odd).collect()),
                sorted((r.id, r.label, r.fold, r.predicted, round(r.confidence, 9)) for r in runs.collect()))
    expected = results()
    assert len(expected[0]) > 20 and len(expected[1]) == 120 and len(expected[2]) == 120
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(blocks, "BLOCK_WORDS", 30)
    monkeypatch.setattr(blocks, "RANGE_WORDS", 100)
    monkeypatch.setattr(models, "training_terms", None)      # no row per term of a document
    monkeypatch.setattr(models.score_texts, "__defaults__", (*models.score_texts.__defaults__[:-1], 0))
    assert results() == expected


def test_blocks_of_a_fold_go_with_its_fit(corpus, monkeypatch):
    """What a fold wrote for its fit is deleted before the next one, and block functions give memory back."""
    folders, new_folder = [], blocks.new_folder
    monkeypatch.setattr(blocks, "new_folder", lambda *a: folders.append(new_folder(*a)) or folders[-1])
    fitted = models.fit_bayes_by_blocks(corpus, [F.col("id") != "d1", F.col("id") != "d2"])
    assert len(folders) == 2 and not any(os.path.exists(f.removeprefix("file:")) for f in folders)
    assert fitted.n_rows > 40 and fitted.table.count() == fitted.n_rows
    released, function = [], blocks._answers
    monkeypatch.setattr(vectors, "release_memory", lambda: released.append(1))
    ask = [np.array(h, np.uint64).tobytes() for h in ([3, 5, 9], [], [5, 7])]
    n = [np.array(v, np.int32).tobytes() for v in ([1, 2, 3], [], [4, 5])]
    out = function(pa.table({"block": [8, 6, 7], "range": [0, 0, 0], "hashes": ask, "n": n}))
    assert [np.frombuffer(v, np.int32).tolist() for v in out["df"].to_pylist()] == [[1, 6, 3], [], [6, 5]]
    assert [np.frombuffer(v, bool).tolist() for v in out["first"].to_pylist()] == [[True] * 3, [], [False, True]]
    assert released


def test_scores_curve_and_ablation(corpus):
    cv = models.cv_scores(corpus, 3, range(2), learner="naive_bayes")
    row = cv.first()
    assert row.n_fits == 6 and 0.4 < row.cv_accuracy_mean <= 1 and row.cv_accuracy_std >= 0
    lift = models.lift_over_rule(corpus, cv, F.lit("a")).first()
    assert lift.rule_accuracy == pytest.approx(1 / 3)
    assert lift.lift_over_rule == pytest.approx(row.cv_accuracy_mean - 1 / 3)
    curve = models.learning_curve(corpus, (.2, 1.0), 3, learner="naive_bayes").collect()
    assert sorted((r.train_size, r.n_folds) for r in curve) == [(16, 3), (80, 3)]
    drop = models.ablation(corpus, "alpha|beta|gamma", 3, range(1), learner="naive_bayes").first()
    assert drop.ablation_drop > 0
    both = models.compare_learners(corpus, 3, learners=("naive_bayes",)).first()
    assert both.train_accuracy >= both.cv_accuracy
    with pytest.raises(ValueError):
        models.fit(corpus, learner="forest")


def test_curve_and_comparison_fit_every_training_row(corpus, monkeypatch):
    fitted, fit_one = [], linear.fit_one

    def spy(space, i, **options):
        fitted.append(space.sizes[i])
        return fit_one(space, i, **options)
    monkeypatch.setattr(linear, "fit_one", spy)
    monkeypatch.setattr(models, "MAX_FIT_ROWS", 20)
    models.learning_curve(corpus, (.5, 1.0), 2, max_iter=3)
    models.compare_learners(corpus, 2, learners=("logistic",), logistic={"max_iter": 3})
    assert sorted(fitted) == sorted([30, 60, 30, 60, 60, 60])


def test_repeated_predictions_share_one_table_of_vectors(corpus, monkeypatch):
    built, space_of = [], linear.space_of
    monkeypatch.setattr(linear, "space_of", lambda *a, **k: built.append(1) or space_of(*a, **k))
    runs = models.repeated_predictions(corpus, 3, (4, 9)).collect()
    assert len(built) == 1 and sorted({r.seed for r in runs}) == [4, 9]
    assert all(len({r.id for r in runs if r.seed == s}) == 120 for s in (4, 9))
    alone = {r.id: r.confidence for r in models.oof_predictions(corpus, 3, 9).collect()}
    assert all(alone[r.id] == pytest.approx(r.confidence, abs=1e-6) for r in runs if r.seed == 9)


def test_fits_share_the_drivers_memory_and_are_given_up(corpus, monkeypatch):
    running, most, fit_one = [], [], linear.fit_one

    def spy(space, i, **options):
        running.append(i)
        most.append(len(running))
        try:
            return fit_one(space, i, **options)
        finally:
            running.remove(i)
    monkeypatch.setattr(linear, "fit_one", spy)
    expected = sorted((r.id, round(r.confidence, 9)) for r in models.oof_predictions(corpus, 4, 0, max_iter=5).collect())
    monkeypatch.setattr(linear, "FIT_BYTES", 1)
    most.clear()
    runs = models.oof_predictions(corpus, 4, 0, max_iter=5)
    assert most == [1] * 4 and "UDF" not in runs._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id, round(r.confidence, 9)) for r in runs.collect()) == expected


def test_fits_too_large_for_the_driver_take_the_same_steps(spark, corpus, monkeypatch):
    """Null texts and labels, repeated ids, two and three classes; a block may miss a training set altogether."""
    odd = corpus.withColumns({"text": F.when(F.col("id") != "d7", F.col("text")),
                              "subreddit": F.when(F.col("id") != "d8", F.col("subreddit"))})
    two = odd.withColumn("subreddit", F.when(F.col("subreddit") == "a", "a").otherwise("b"))
    odd = odd.unionByName(odd.where("id = 'd9'"))

    def results():
        found = {}
        for name, df in (("two", two), ("three", odd)):
            fitted = models.fit(df, max_iter=12)
            found[name, "terms"] = {r.term: (r.idf, *r.coef) for r in fitted.table.collect()}
            found[name, "docs"] = {r.id: (r.predicted, *r.probability) for r in models.predict_proba(fitted, df).collect()}
            docs = df.where("subreddit IS NOT NULL").dropDuplicates(["id"])
            found[name, "held out"] = {r.id: (r.predicted, *r.probability) for r in models.oof_predictions(
                docs, 2, 0, max_iter=3).collect()}
        found["report"] = {r.model: tuple(r)[1:] for r in models.cv_fit_report(docs, 2, max_iter=4).collect()}
        return found
    expected = results()
    for module, name, value in ((linear, "DRIVER_BYTES", 1), (blocks, "BLOCK_WORDS", 200), (blocks, "RANGE_WORDS", 400),
                                (descent, "CHECKPOINT_EVERY", 5), (linear, "LogisticRegression", None)):
        monkeypatch.setattr(module, name, value)
    found = results()
    assert len(expected["two", "docs"]) == 120 and len(expected["three", "terms"]) > 20
    for part, rows in expected.items():
        assert found[part].keys() == rows.keys()
        for key, row in rows.items():
            for a, b in zip(row, found[part][key], strict=True):
                assert a == b if isinstance(a, str) else b == pytest.approx(a, abs=1e-7)


def test_fits_of_many_terms_go_by_combinations_of_documents(spark, corpus, monkeypatch):
    """The same models as Spark ML's, in fewer steps. Null texts and labels, repeated ids, a set of one class."""
    odd = corpus.withColumns({"text": F.when(F.col("id") != "d7", F.col("text")),
                              "subreddit": F.when(F.col("id") != "d8", F.col("subreddit"))})
    two = odd.withColumn("subreddit", F.when(F.col("subreddit") == "a", "a").otherwise("b"))
    odd = odd.unionByName(odd.where("id = 'd9'"))
    options = {"tol": 1e-10, "max_iter": 300}

    def results():
        fitted = models.fit(two, **options)
        found = {"terms": {r.term: (r.idf, *(c - np.mean(r.coef) for c in r.coef)) for r in fitted.table.collect()}}
        found["docs"] = {r.id: (r.predicted, *r.probability) for r in models.predict_proba(fitted, two).collect()}
        found["held out"] = {r.id: (r.label, r.fold, r.predicted, *r.probability) for r in models.oof_predictions(
            odd.dropDuplicates(["id"]), 2, 0, **options).collect()}
        return found
    expected = results()
    monkeypatch.setattr(linear, "DRIVER_BYTES", 4000)
    monkeypatch.setattr(spans, "VECTORS", 1)
    monkeypatch.setattr(spans, "LEAST_CHUNK", 50)
    for module, name, value in ((blocks, "BLOCK_WORDS", 200), (blocks, "RANGE_WORDS", 400), (linear, "LogisticRegression", None),
                                (descent, "fit_one", None)):
        monkeypatch.setattr(module, name, value)
    found = results()
    assert len(expected["docs"]) == len(expected["held out"]) == 120
    for part, rows in expected.items():
        assert found[part].keys() == rows.keys()
        for key, row in rows.items():
            for a, b in zip(row, found[part][key], strict=True):
                assert a is b is None or a == b if not isinstance(a, float) else b == pytest.approx(a, abs=2e-4)
    report = models.cv_fit_report(odd, 2, tol=1e-12).collect()
    assert all(r.gradient_norm < 1e-6 and 1 < r.iterations < 60 and r.n_terms > 20 for r in report)
    one = models.predict_proba(models.fit(two.where("subreddit = 'b'")), two).collect()
    assert {r.predicted for r in one} == {"b"}


def test_a_step_that_overshoots_is_shortened():
    calls = []

    def phi(t):
        calls.append(t)
        return t, (t - 0.2) ** 2, 2 * (t - 0.2)
    t = descent.wolfe_step(phi, 1.0, phi(0.0))
    assert 0 < t < 0.4 and len(calls) > 2
    with pytest.raises(descent.LineSearchFailed):
        descent.wolfe_step(phi, 1.0, (0.0, 1.0, 1.0))


def test_evaluation_document(spark, corpus, tmp_path):
    from tidewatch.operators.evaluate import evaluation
    from tidewatch.sources.outputs import write_document
    posts = corpus.withColumns({"title": F.col("text"), "body": F.lit("")})
    sections = evaluation(posts, {"a": "alpha|beta", "b": "gamma|delta"}, "c", k=3, seeds=range(1),
                          floors=(.5, 1.1), fractions=(1.0,), learner="naive_bayes")
    write_document(str(tmp_path / "report"), **sections)
    report = spark.read.json(str(tmp_path / "report")).first()
    assert report.dataset[0].n_posts == 120 and len(report.class_balance) == 3
    assert report.model[0].lift_over_rule == pytest.approx(
        report.model[0].cv_accuracy_mean - report.keyword_rule[0].accuracy)
    assert len(report.flag_precision) == 6 and len(report.operating_points) == 2

"""Human baseline: sampling, the annotation queue, scoring annotators and their agreement."""
from pyspark.sql import functions as F

from tidewatch.functions import numeric, text as tx
from tidewatch.operators.metrics import bootstrap_ci, cohen_kappa
from tidewatch.plans.quantiles import exact_quantiles
from tidewatch.plans.ranking import WINDOW_LIMIT, rank_within, top_within
from tidewatch.plans.skew import join_groups

UNSURE = "unsure"


def balanced_sample(corpus, n=200, seed=0, label="subreddit"):
    """n // k random rows of each of the k classes, shuffled; ids and positions only."""
    labelled = corpus.where(F.col(label).isNotNull()).select("id", label)
    classes = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    k, smallest = classes.agg(F.count(F.lit(1)), F.min("n")).first()
    if k == 0:
        raise ValueError("no labelled rows to sample from")
    per_class = n // k
    if smallest < per_class:
        raise ValueError(f"a class has {smallest} rows, {per_class} are needed")
    drawn = labelled.withColumn("_draw", numeric.seeded_hash(F.col("id"), f"draw{seed}"))
    picked = top_within(drawn, [label], [F.col("_draw"), F.col("id")], per_class)
    shuffled = picked.select("id", numeric.seeded_hash(F.col("id"), f"shuffle{seed}").alias("_s"))
    return rank_within(shuffled, [], numeric.hash_digits(F.col("_s")),
                       [F.col("_s"), F.col("id")], "position").select("id", "position")


def annotation_queue(sample, answers, annotator, corpus, max_chars=1200):
    """Sampled posts the annotator has not answered, with the text to show, in sample order."""
    done = answers.where(F.col("annotator") == annotator).select("id")
    return (sample.join(done, "id", "left_anti")
            .join(corpus.select("id", tx.truncated(F.col("text"), max_chars).alias("shown")), "id")
            .select("position", "id", "shown").orderBy("position"))


def judged_answers(answers, corpus, predictions, pattern):
    """Answers with the truth, the prediction and whether the text names a franchise.

    The corpus is first reduced to the answered posts; only that narrow table meets the answers, so
    a post answered by very many people does not pile up in one task.
    """
    wanted = answers.select("id").distinct()
    facts = (wanted.join(corpus.select("id", F.col("subreddit").alias("truth"),
                                       tx.has_token(F.col("text"), pattern).alias("named")),
                         "id", "left")
             .join(predictions.select("id", "model", "confidence"), "id", "left"))
    rows = join_groups(answers, facts, ["id"], "left")
    return rows.select(
        "id", "annotator", "answer", "seconds", "truth", "model", "confidence",
        F.coalesce("named", F.lit(False)).alias("named"),
        F.coalesce(F.col("answer") == UNSURE, F.lit(False)).alias("unsure"),
        F.coalesce(F.col("answer") == F.col("truth"), F.lit(False)).alias("human_right"),
        F.coalesce(F.col("model") == F.col("truth"), F.lit(False)).alias("model_right"))


def abstain_like_human(rows, window_limit=WINDOW_LIMIT):
    """Adds `kept`: false for each annotator's k least confident predictions, k their unsure count.

    Ties in confidence are broken by hashed id.
    """
    confidence = F.coalesce(F.nanvl(F.col("confidence"), F.lit(2.0)), F.lit(2.0))
    rows = rows.withColumn("_conf", confidence).withColumn("_tie", F.md5("id"))
    digits = [*numeric.double_digits(F.col("_conf")), *numeric.hash_digits(F.col("_tie"))]
    ranked = rank_within(rows, ["annotator"], digits,
                         [F.col("_conf"), F.col("_tie"), F.col("id")], "_rank", window_limit)
    unsure = rows.groupBy("annotator").agg(F.count_if("unsure").alias("_k"))
    return (join_groups(ranked, unsure, ["annotator"])
            .withColumn("kept", F.col("_rank") > F.col("_k"))
            .drop("_conf", "_tie", "_rank", "_k"))


def _blocks(rows):
    """Long form: one row per answer and block it counts in (value null where it does not)."""
    forced = F.when(F.col("unsure"), 0.5).otherwise(F.col("human_right").cast("double"))
    model = F.col("model_right").cast("double")
    human = F.col("human_right").cast("double")
    named, answered = F.col("named"), ~F.col("unsure")
    values = {
        "human_forced_choice": forced,
        "model_same_posts": model,
        "human_when_answering": F.when(answered, human),
        "model_at_same_coverage": F.when(F.col("kept"), model),
        "model_on_posts_human_answered": F.when(answered, model),
        "model_on_posts_human_was_unsure": F.when(~answered, model),
        "with_token_human_forced_choice": F.when(named, forced),
        "with_token_model": F.when(named, model),
        "without_token_human_forced_choice": F.when(~named, forced),
        "without_token_model": F.when(~named, model)}
    entries = F.array(*[F.struct(F.lit(name).alias("block"), value.alias("value"))
                        for name, value in values.items()])
    return rows.select("annotator", F.explode(entries).alias("e")).select("annotator", "e.*")


def annotator_accuracy(answers, corpus, predictions, pattern, intervals=True, seed=42,
                       window_limit=WINDOW_LIMIT):
    """Accuracy of human and model per annotator and block, with bootstrap intervals."""
    rows = abstain_like_human(judged_answers(answers, corpus, predictions, pattern), window_limit)
    blocks = _blocks(rows)
    scored = blocks.groupBy("annotator", "block").agg(
        numeric.nan_if_null(F.avg("value")).alias("accuracy"), F.count("value").alias("n"))
    if not intervals:
        return scored
    bounds = bootstrap_ci(blocks, "value", ["annotator", "block"], seed=seed)
    return scored.join(bounds, ["annotator", "block"], "left").select(
        "annotator", "block", "accuracy", "n", numeric.nan_if_null(F.col("ci_low")).alias("ci_low"),
        numeric.nan_if_null(F.col("ci_high")).alias("ci_high"))


def annotator_summary(answers, corpus, predictions, pattern):
    """Per annotator: posts, unsure rate, median seconds, kappa with the model when answering."""
    rows = judged_answers(answers, corpus, predictions, pattern)
    base = rows.groupBy("annotator").agg(
        F.count(F.lit(1)).alias("n_posts"),
        F.avg(F.col("unsure").cast("double")).alias("unsure_rate"))
    seconds = exact_quantiles(answers, ["annotator"], "seconds",
                              {"median_seconds_per_post": 0.5})
    kappa = cohen_kappa(rows.where(~F.col("unsure")), "answer", "model", ["annotator"]).select(
        "annotator", F.col("kappa").alias("kappa_human_vs_model"))
    return base.join(seconds, "annotator", "left").join(kappa, "annotator", "left").withColumn(
        "kappa_human_vs_model", numeric.nan_if_null(F.col("kappa_human_vs_model")))


def check_single_answers(answers):
    """A second answer by the same annotator to the same post is an error."""
    twice = answers.groupBy("id", "annotator").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError("an annotator answered a post more than once")
    return answers


def agreement(answers, block=256):
    """Raw agreement and kappa of every pair of annotators with at least two shared posts.

    The result has one row per pair, so pairs have to meet; a post answered by many people is cut
    into blocks of annotators, and each pair of blocks is a join key of its own.
    """
    rows = check_single_answers(answers).where(F.col("answer").isNotNull())
    crowds = rows.groupBy("id").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int").alias("_blocks"))
    rows = join_groups(rows.select("id", "annotator", "answer"), crowds, ["id"])
    mine = F.pmod(F.xxhash64("annotator"), F.col("_blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("_blocks") - 1)
    left = rows.select("id", F.col("annotator").alias("a"), F.col("answer").alias("answer_a"),
                       mine.alias("_i"), F.explode(others).alias("_j"))
    right = rows.select("id", F.col("annotator").alias("b"), F.col("answer").alias("answer_b"),
                        mine.alias("_j"), F.explode(others).alias("_i"))
    pairs = left.join(right, ["id", "_i", "_j"]).where(F.col("a") < F.col("b"))
    return cohen_kappa(pairs, "answer_a", "answer_b", ["a", "b"]).where(F.col("n") >= 2)

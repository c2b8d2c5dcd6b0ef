"""Classification metrics and resampling, each from one aggregation to few cells."""
import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F, types as T

from tidewatch.functions.numeric import double_digits, nan_if_null, share
from tidewatch.plans.ranking import running_totals

N_BOOTSTRAP = 2000
GROUPS_AT_ONCE = 1000            # whose replicates a task holds: 32 KB each


def majority_rate(df, label="subreddit"):
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.agg(share(F.max("n"), F.sum("n")).alias("majority_rate"))


def accuracy(df, truth="truth", predicted="predicted", group=()):
    right = F.coalesce(F.col(truth) == F.col(predicted), F.lit(False)).cast("double")
    return df.groupBy(*group).agg(F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def _cells(df, truth, predicted, group):
    return df.groupBy(*group, F.col(truth).alias("actual"), F.col(predicted).alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df, truth="truth", predicted="predicted"):
    """Counts for every pair of labels, zeros included."""
    cells = _cells(df, truth, predicted, ())
    labels = cells.select(F.explode(F.array("actual", "predicted")).alias("label")).agg(
        F.collect_set("label").alias("labels"))
    pairs = labels.select(F.explode("labels").alias("actual"), "labels").select(
        "actual", F.explode("labels").alias("predicted"))
    return pairs.join(cells, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def _per_label(df, truth, predicted, group):
    cells = _cells(df, truth, predicted, group)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("long")
    roles = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"),
                 none.alias("claimed"), hit.alias("hits")),
        F.struct(F.col("predicted").alias("label"), none.alias("support"),
                 F.col("n").alias("claimed"), none.alias("hits")))
    return (cells.select(*group, F.explode(roles).alias("r")).select(*group, "r.*")
            .groupBy(*group, "label")
            .agg(*[F.sum(c).alias(c) for c in ("support", "claimed", "hits")]))


def classification_report(df, truth="truth", predicted="predicted", group=()):
    """Precision, recall, F1 and support per label, then accuracy, macro and weighted averages."""
    def ratio(part, whole):
        return F.coalesce(share(part, whole), F.lit(0.0))
    rows = _per_label(df, truth, predicted, group).select(
        *group, "label", "hits", "support",
        ratio(F.col("hits"), F.col("claimed")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("claimed") + F.col("support")).alias("f1"))
    measures = ("precision", "recall", "f1")
    total = F.sum("support")

    def summary(name, values):
        return F.struct(F.lit(name).alias("label"),
                        *[v.alias(m) for m, v in zip(measures, values)],
                        total.alias("support"))
    right = share(F.sum("hits"), total)
    summaries = rows.groupBy(*group).agg(F.array(
        summary("accuracy", [right] * 3),
        summary("macro avg", [F.avg(m) for m in measures]),
        summary("weighted avg", [share(F.sum(F.col(m) * F.col("support")), total)
                                 for m in measures])).alias("s"))
    return rows.select(*group, "label", *measures, "support").unionByName(
        summaries.select(*group, F.explode("s").alias("s")).select(*group, "s.*"))


def roc_points(df, score="score", positive="positive", group=()):
    """True and false positive rate at every distinct score, highest first, ties together."""
    hit = F.coalesce(F.col(positive).cast("boolean"), F.lit(False))
    cells = (df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score)))
             .groupBy(*group, F.col(score).cast("double").alias("score"))
             .agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
             .withColumn("_down", -F.col("score")))
    return running_totals(cells, list(group), double_digits(F.col("_down")), ["pos", "neg"],
                          [F.col("_down")]).drop("_down")


def roc_curve(df, score="score", positive="positive", group=()):
    points = roc_points(df, score, positive, group)
    return points.select(
        *group, "score",
        share(F.col("before_pos") + F.col("pos"), F.col("total_pos")).alias("tpr"),
        share(F.col("before_neg") + F.col("neg"), F.col("total_neg")).alias("fpr"))


def auc(df, score="score", positive="positive", group=()):
    """Trapezoid area under the ROC curve."""
    points = roc_points(df, score, positive, group)
    height = share(F.col("before_pos") * 2 + F.col("pos"), F.col("total_pos") * 2)
    width = share(F.col("neg"), F.col("total_neg"))
    # Both are null without positives or without negatives, and so is the area.
    return points.groupBy(*group).agg(F.sum(height * width).alias("auc"))


def cohen_kappa(df, a, b, group=()):
    """Agreement beyond chance, raw agreement and rows; NaN where kappa is not defined."""
    labels = _per_label(df, a, b, group)
    totals = labels.groupBy(*group).agg(
        F.sum("support").alias("n"), F.sum("hits").alias("agree"),
        F.sum(F.col("support").cast("double") * F.col("claimed")).alias("chance"))
    n = F.col("n").cast("double")
    kappa = share(F.col("agree") * n - F.col("chance"), n * n - F.col("chance"))
    return totals.select(
        *group, "n", share(F.col("agree"), F.col("n")).alias("raw_agreement"),
        nan_if_null(F.when(F.col("n") > 1, kappa)).alias("kappa"))


# --- bootstrap ----------------------------------------------------------------

def _resampled(group, replicates):
    """A mapInArrow function: per group of a task the sums of weights and of weighted values of every
    replicate, one row each."""
    def run(batches):
        held = {}

        def rows():
            keys = list(zip(*held)) if group else []
            sums = np.concatenate(list(held.values()))
            lists = pa.ListArray.from_arrays(np.arange(len(held) + 1, dtype=np.int32) * 2 * replicates, pa.array(sums))
            columns = [pa.array(k, t) for k, t in zip(keys, types)]
            held.clear()
            return pa.RecordBatch.from_arrays([*columns, lists], [*group, "sums"])

        for batch in batches:
            types = [batch.schema.field(g).type for g in group]
            names = list(zip(*[batch.column(g).to_pylist() for g in group])) or [()] * batch.num_rows
            for name, *cell in zip(names, *(batch.column(c).to_pylist() for c in ("v", "n", "_seed"))):
                v, n, key = cell
                # seeded by the cell, so that a draw does not depend on the task it is made in
                w = np.random.default_rng(key % 2 ** 64).poisson(n, replicates)
                if name not in held:
                    held[name] = np.zeros(2 * replicates)
                held[name][:replicates] += w
                held[name][replicates:] += w * v
                if len(held) > GROUPS_AT_ONCE:
                    yield rows()
        if held:
            yield rows()
    return run


def _quantile(ordered, q):
    """The interpolated quantile of a sorted array."""
    at = q * (F.size(ordered) - 1)
    low = F.get(ordered, F.floor(at).cast("int"))
    return low + (F.get(ordered, F.ceil(at).cast("int")) - low) * (at - F.floor(at))


def bootstrap_ci(df, value, group=(), replicates=N_BOOTSTRAP, seed=42):
    """95% percentile interval of the mean under Poisson resampling.

    Rows with equal values are exchangeable, so they are counted first, and as a sum of n unit draws
    is a Poisson(n) draw, each replicate needs one exact draw per (group, value). A task adds up the
    replicates of a group, so what is shuffled is one vector a group and task.
    """
    group = list(group)
    cells = (df.where(F.col(value).isNotNull())
             .groupBy(*group, F.col(value).cast("double").alias("v"))
             .agg(F.count(F.lit(1)).alias("n")))
    keyed = cells.withColumn("_seed", F.xxhash64(F.lit(seed), *[F.col(g) for g in group], F.col("v")))
    schema = T.StructType([cells.schema[g] for g in group] + [T.StructField("sums", T.ArrayType(T.DoubleType()))])
    drawn = keyed.mapInArrow(_resampled(group, replicates), schema)
    added = drawn.groupBy(*group).agg(Summarizer.sum(array_to_vector("sums")).alias("_v")).select(
        *group, vector_to_array("_v").alias("_v"))
    means = F.zip_with(F.slice("_v", replicates + 1, replicates), F.slice("_v", 1, replicates), F.try_divide)
    ordered = added.where(F.col("_v").isNotNull()).select(*group, F.sort_array(F.array_compact(means)).alias("_means"))
    return ordered.select(*group, _quantile(F.col("_means"), 0.025).alias("ci_low"),
                          _quantile(F.col("_means"), 0.975).alias("ci_high"))

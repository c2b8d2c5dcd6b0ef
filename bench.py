"""Times the headline queries at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from checks import inputs, model_queries  # noqa: E402
from checks.registry import REGISTRY  # noqa: E402
from tidewatch.operators import models  # noqa: E402
from tidewatch.session import build_session, settle  # noqa: E402

HEADLINE = (
    "prepared_posts", "prepared_with_comments", "prep_report", "deduplicate", "temporal_split",
    "temporal_split_by_cuts", "recheck", "removal_rate", "threshold_sweep", "best_operating_point",
    "operating_point_over_seeds", "roc_curve", "auc", "classification_report", "annotator_accuracy",
    "annotator_agreement", "bootstrap_ci", "describe", "box_stats", "histogram", "kde_curve",
    "top_text_tokens", "dataset_profile", "unseen_posts", "merged_listing", "vocabulary",
    "tfidf_per_document", "naive_bayes")


def run(df):
    df.write.format("noop").mode("overwrite").save()


def timed(action):
    started = time.perf_counter()
    action()
    return round(time.perf_counter() - started, 3)


def scoring(spark, sf_dir):
    """Batch scoring with a fitted model: whole documents, and each of their lines as a post."""
    docs = settle(model_queries.binary_corpus(spark, sf_dir))
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    lines = settle(lines.select(F.concat_ws(":", "id", "line").alias("id"), "text"))
    labelled = inputs.labelled(spark, sf_dir).select("id")
    fitted = models.fit(docs.join(labelled, "id", "left_semi"))
    results = {}
    for name, rows in (("documents", docs), ("lines", lines)):
        n = rows.count()
        run(models.predict_proba(fitted, rows))                              # warm up
        seconds = timed(lambda: run(models.predict_proba(fitted, rows)))
        results[name] = {"seconds": seconds, "docs_per_sec": round(n / seconds)}
    return results


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "tidewatch-bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    run(inputs.documents(spark, sf_dir))                                     # start the JVM
    times = {}
    for name in HEADLINE:
        query, _ = REGISTRY[name]
        times[name] = timed(lambda: run(query(spark, sf_dir)))
    score = scoring(spark, sf_dir)
    times["score_documents"] = score["documents"]["seconds"]
    times["score_lines"] = score["lines"]["seconds"]
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
        "score_docs_per_sec": score["documents"]["docs_per_sec"],
        "score_lines_per_sec": score["lines"]["docs_per_sec"]}))
    spark.stop()


if __name__ == "__main__":
    main()

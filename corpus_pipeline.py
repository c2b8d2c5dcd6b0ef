"""Documents to packed training sequences, in five stages.

Each stage reads what the one before kept, written as Parquet in between, and all but the last return
documents with their columns. The stages are functions of (spark, docs, sf_dir).
"""
from tidewatch.llm import decontaminate, exact, packing, quality, setsketch
from tidewatch.llm.shared import written


def quality_classifier(spark, docs, sf_dir):
    """Documents that the co-trained classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark, docs, sf_dir):
    """Of equal texts the document with the largest id stays."""
    return exact.keep_unique(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate group stays."""
    return setsketch.keep_one(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark, docs, sf_dir):
    """Pieces of the remaining documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

# The classifier and the tokenizer cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Sinks for prepared data, reports, samples and answers."""
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidewatch.schemas import ANSWER, SAMPLE


def write_json(df, path):
    """A small result as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").json(str(path))


def write_document(path, **sections):
    """Several small results as one JSON document, one key per section.

    Meant for reports: every section is an aggregate of a few rows.
    """
    document = None
    for name, df in sections.items():
        section = df.agg(F.collect_list(F.struct(*df.columns)).alias("rows")).select(
            F.lit(name).alias("section"), F.to_json("rows").alias("rows"))
        document = section if document is None else document.unionByName(section)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "rows"))),
                                    lambda s: F.concat(F.lit('"'), s["section"], F.lit('":'),
                                                       s["rows"])), ",")
    (document.agg(F.concat(F.lit("{"), body, F.lit("}")).alias("value"))
     .write.mode("overwrite").text(str(path)))


def write_prepared(prepared, path, name=None):
    """Train and test rows plus the report, under the data hash unless a name is given."""
    report = prepared.report
    if name is None:
        name = report.first()["data_hash"]
    target = f"{path}/{name}"
    prepared.rows.write.mode("overwrite").partitionBy("split").parquet(f"{target}/posts")
    write_document(f"{target}/report", report=report, split=prepared.split_info,
                   class_balance=prepared.class_balance)
    return target


def read_prepared(spark, target, split):
    return spark.read.parquet(f"{target}/posts").where(F.col("split") == split).drop("split")


def fixed_sample(spark, path, draw):
    """The sample at `path`, drawn by `draw()` the first time only."""
    try:
        return spark.read.schema(SAMPLE).parquet(str(path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    draw().write.mode("ignore").parquet(str(path))
    return spark.read.schema(SAMPLE).parquet(str(path))


def scan_answers(spark, pattern):
    """All answer files; empty, with its columns, when there are none."""
    try:
        return spark.read.schema(ANSWER).csv(str(pattern), header=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ANSWER)

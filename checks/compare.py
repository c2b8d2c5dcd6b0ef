"""Runs registered queries next to their SQL twins: python -m checks.compare [sf] [name ...]."""
import math
import sys
import time

import duckdb

from checks.registry import REGISTRY
from tidewatch.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    return str(value)


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([canonical(r[i]) for i in order]) for r in rows)


def compare(spark, connection, name, sf_dir):
    run, sql = REGISTRY[name]
    started = time.time()
    df = run(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    if sql is None:
        return f"rows-only {len(rows):>7}", seconds, bool(rows)
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(columns)}", seconds, False
    ours, theirs = normal_rows(df.columns, rows), normal_rows(columns, expected)
    if ours == theirs:
        return f"ok {len(rows):>7}", seconds, True
    extra = [r for r in ours if r not in set(theirs)][:2]
    lacking = [r for r in theirs if r not in set(ours)][:2]
    return (f"DIFF {len(ours)} vs {len(theirs)}\n   spark {str(extra)[:700]}\n"
            f"   sql   {str(lacking)[:700]}", seconds, False)


def main(arguments):
    sf = arguments[0] if arguments else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    failed = []
    for name in arguments[1:] or REGISTRY:
        try:
            message, seconds, good = compare(spark, connection, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            message, seconds, good = f"ERROR {str(error)[:1500]}", 0.0, False
        print(f"{seconds:7.2f}s {name:<32} {message}", flush=True)
        if not good:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

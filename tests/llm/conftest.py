import pytest


@pytest.fixture
def spread(spark):
    """Shuffle joins whose partitions stay as they are dealt, to see how many rows a task gets."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k in settings:
        spark.conf.unset(k)

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from causeway.workload.registry import Given


def _shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {str(p) for folder in manager.localDirsString() for p in Path(folder).rglob("shuffle_*")}


def test_shuffle_files_go_with_the_query_that_made_them(spark, scratch):
    before = _shuffle_files(spark)
    grouped = spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).count()
    made = scratch.cut(grouped)
    assert made.count() == 7
    assert not _shuffle_files(spark) - before
    # A frame that is asked for twice gives the same rows again.
    assert sorted(grouped.collect()) == sorted(grouped.collect()) == sorted(made.collect())


@pytest.fixture
def broadcast_settings(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name, None) for name in names}
    for name in names:
        spark.conf.unset(name)
    yield names
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_only_what_was_measured_is_broadcast(spark, scratch, broadcast_settings):
    """40 MB of rows in a file far below the limit of 10 MB are shuffled; few rows are still broadcast."""
    limit = spark.conf.get(broadcast_settings[0])
    Given(spark, "/nowhere")
    assert spark.conf.get(broadcast_settings[1]) == limit
    wide = scratch.cut(spark.range(200_000).select("id", F.repeat(F.lit("x"), F.lit(200)).alias("text")))
    few = wide.filter("id % 50000 = 1")
    other = scratch.cut(spark.range(1_000_000).select("id", F.repeat(F.lit("y"), F.lit(50)).alias("other")))
    for side, rows, broadcast in ((wide, 200_000, False), (few, 4, True)):
        joined = other.join(side, "id").agg(F.count("text").alias("n"), F.max("other"))
        assert joined.collect()[0].n == rows
        assert ("BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]) == broadcast

import os
import time

from pyspark.sql import functions as F

from sparsight import session


def test_materialized_rows_outlive_their_source_until_cleared(spark):
    df = spark.range(5).withColumnRenamed("id", "n")
    kept = session.materialize(df, "probe")
    assert sorted(r.n for r in kept.collect()) == list(range(5))
    path = session.scratch_path(spark, "probe")
    base = spark.conf.get("spark.checkpoint.dir")
    assert path.startswith(base) and spark.sparkContext.applicationId in path
    folder = os.path.dirname(path)
    assert os.listdir(folder)
    session.clear_scratch(spark)
    assert not os.path.exists(folder)


def test_shuffles_of_what_is_written_are_released(spark):
    """Their files would stay until the driver happens to collect its garbage."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().endswith(".data")}

    before = files()
    df = spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).count()
    kept = session.materialize(df, "sums")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert sorted(r["count"] for r in kept.collect()) == sorted(r["count"] for r in df.collect())
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"

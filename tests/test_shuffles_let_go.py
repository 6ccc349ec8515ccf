"""Shuffle files of a staged write go with it; they used to stay until the driver's heap was full."""

import os
import time

from pyspark.sql import functions as F

from netquill.sources.stage import released, shuffles_let_go, staged
from netquill.sources.zeek import existing, write_zeek


def _shuffles(spark):
    jvm = spark.sparkContext._jvm
    top = [f.toString() for f in jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return {f for t in top for _, _, names in os.walk(t) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def _left(spark, before):
    for _ in range(20):
        if not (left := _shuffles(spark) - before):
            break
        time.sleep(0.25)  # files go in the background
    return left


def test_staged_and_log_writes_leave_no_shuffle(spark, tmp_path):
    before = _shuffles(spark)
    counts = staged(spark.range(20_000).groupBy((F.col("id") % 997).alias("k")).agg(F.count(F.lit(1)).alias("n")))
    assert not _left(spark, before)
    write_zeek(spark.range(500).select(F.col("id").cast("string").alias("uid")), str(tmp_path / "conn.log"))
    assert not _left(spark, before)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert counts.count() == 997
    released(counts)
    assert not existing(spark, counts._staged_at)


def test_the_setting_is_given_back_after_an_error(spark):
    try:
        with shuffles_let_go(spark):
            raise KeyError
    except KeyError:
        pass
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"

"""Profiles without exploded rows, contract differences as rows, hot instants in several tasks, typed streams and observed progress."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import CONN_HEADER, conn_row, write_log
from netquill import contract as K
from netquill.operators import assemble as A
from netquill.operators import dataset as D
from netquill.operators import models as M
from netquill.operators.windows import window_features
from netquill.plans.staged_logs import rule_scorer
from netquill.sources import zeek as Z
from netquill.streaming.live import LiveDetector, Throughput
from netquill.streaming.typed import flows_stream, without_repeats


def test_profile_from_counts(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0.0, -0.0, 1.5, 7.25]), None if i % 5 == 0 else rng.gauss(0, 1e4), 3.0, float(i % 2)) for i in range(999)]
    table = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(6)
    got = {r["feature"]: r for r in D.feature_profile(table, list("abcd")).collect()}
    for i, name in enumerate("abcd"):
        values = np.array([r[i] for r in rows if r[i] is not None])
        want = (values.min(), values.max(), values.mean(), np.median(values), values.std())
        assert all(math.isclose(got[name][k], v, abs_tol=1e-4) for k, v in zip(("min", "max", "mean", "median", "std"), want, strict=True))
        assert got[name]["unique_count"] == len(set(values + 0.0)) and math.isclose(got[name]["zero_pct"], 100 * (values == 0).mean(), abs_tol=0.01)
    plan = D.value_counts(table, list("abcd"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan
    assert D.feature_profile(table.limit(0), list("abcd")).count() == 0
    assert [r["feature"] for r in D.zero_variance_columns(table, list("abcd")).collect()] == ["c"]


def test_contract_differences_as_rows(spark):
    names = [c for c in K.FEATURE_COLUMNS if c != "missed_bytes"]
    table = spark.range(4).select(*[F.lit(1.0).alias(c) for c in names], F.when(F.col("id") > 0, 1).alias("own"), F.lit("u").alias("flow_uid"))
    assert sorted(map(tuple, A.column_differences(table).collect())) == [("missed_bytes", "missing", 0), ("own", "unexpected", 3)]
    with pytest.raises(A.ContractViolation):
        A.check_columns([*names, "own"])
    whole = table.withColumn("missed_bytes", F.lit(0.0)).drop("own")
    assert A.column_differences(whole).count() == 0
    A.check_columns([c for c in whole.columns if c != "flow_uid"])


def test_importance_of_no_rows(spark):
    none = spark.createDataFrame([], "flow_uid string, timestamp double, label string").withColumn("x", M.array_to_vector(F.array(F.lit(1.0))))
    assert M.permutation_importance(None, none, ["a"]).count() == 0


def test_a_hot_instant_is_split(spark, tmp_path):
    """Copies of one flow at one instant end in several tasks of every join, with the same totals as added up by hand."""
    write_log(f"{tmp_path}/conn.log", CONN_HEADER, [conn_row("1000", "HOT"), conn_row("1010", "B"), conn_row("1020", "C", dst="9.9.9.9")])
    flows = Z.silver(Z.zeek_dir_scan(spark, str(tmp_path)))["conn"]
    copies = 300_000
    hot = flows.filter("uid = 'HOT'").first()
    cells = {f.name: F.lit(hot[f.name]).cast(f.dataType).alias(f.name) for f in flows.schema if f.name != "uid"}
    repeats = spark.range(0, copies, 1, 8).select(F.concat(F.lit("H"), "id").alias("uid"), *cells.values())
    many = repeats.unionByName(flows.filter("uid <> 'HOT'"))
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        features = ["win_src_flow_count_60s", "win_dst_inbound_flow_rate_10s", "win_pair_flow_count_300s"]
        out = window_features(many, features=features).withColumn("task", F.spark_partition_id()).cache()
        hot = out.filter(F.col("uid").startswith("H"))
        assert hot.select("task").distinct().count() > 3
        assert {tuple(r) for r in hot.select(*features).distinct().collect()} == {(float(copies), copies / 10.0, float(copies))}
        assert out.filter("uid = 'B'").first()["win_pair_flow_count_300s"] == copies + 1
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_typed_stream_and_repeats(spark, tmp_path):
    inbox = f"{tmp_path}/in"
    write_log(f"{inbox}/conn.1.log", CONN_HEADER, [conn_row("1000", "A"), conn_row("1001", "B")])
    write_log(f"{inbox}/conn.2.log", CONN_HEADER, [conn_row("1005", "A"), conn_row("1006", "C"), ["too", "short"]])
    seen = {}
    for name, change in (("kept", lambda f: f), ("dropped", lambda f: without_repeats(f, "1 hour"))):
        for _ in range(2):  # the second start has nothing new to read
            sink = change(flows_stream(spark, inbox, max_files_per_trigger=1)).select("uid").writeStream.format("parquet")
            sink = sink.option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-state")
            sink.trigger(availableNow=True).start().awaitTermination()
        seen[name] = sorted(r["uid"] for r in spark.read.parquet(f"{tmp_path}/{name}").collect())
    assert seen == {"kept": ["A", "A", "B", "C"], "dropped": ["A", "B", "C"]}
    write_log(f"{inbox}/conn.3.log", list(reversed(CONN_HEADER)), [conn_row("1007", "D")])
    bad = flows_stream(spark, inbox).select("uid").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/bad")
    with pytest.raises(Exception, match="other fields"):
        bad.trigger(availableNow=True).start().awaitTermination()


def test_progress_is_observed(spark, tmp_path):
    inbox = f"{tmp_path}/in"
    write_log(f"{inbox}/conn.1.log", CONN_HEADER, [conn_row("1000", "A"), conn_row("1001", "B"), ["bad"]])
    throughput = Throughput()
    spark.streams.addListener(throughput)
    try:
        live = LiveDetector(spark, f"{tmp_path}/work", rule_scorer)
        live.start(inbox).awaitTermination()
        steps = {r["step"]: (r["records"], r["flows"], r["alerts"]) for r in spark.read.parquet(live.path("progress")).collect()}
        assert steps == {"land": (2, 2, 0), "score": (0, 0, 2)}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        assert throughput.recent and max(rows for _, _, rows, _ in throughput.recent) >= 3
    finally:
        spark.streams.removeListener(throughput)

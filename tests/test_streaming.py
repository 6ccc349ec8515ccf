"""The stream gives the batch result, survives a restart and isolates subscribers."""

import os

from pyspark.sql import functions as F

from helpers import CONN_HEADER, DNS_HEADER, conn_row, write_log
from netquill.contract import FEATURE_COLUMNS
from netquill.operators.assemble import alert_rows, feature_matrix
from netquill.plans.staged_logs import rule_scorer
from netquill.sources import zeek as Z
from netquill.streaming.live import LiveDetector, running_telemetry, scored_or_rejected


def conn(ts, uid, **kw):
    return conn_row(f"{1.6e9 + ts}", uid, **kw)


def dns(ts, uid, query):
    return [f"{1.6e9 + ts}", uid, "192.168.1.50", 1, "1.1.1.1", 53, query, "A", "NXDOMAIN", "-", "0.1"]


def features(df):
    return {r["flow_uid"]: [r[c] for c in FEATURE_COLUMNS] for r in df.collect()}


def test_stream_equals_batch_across_restart(spark, tmp_path):
    inbox, everything = str(tmp_path / "in"), str(tmp_path / "all")
    first = [conn(0, "A"), conn(10, "B", dst="9.9.9.9"), conn(3590, "C")]
    second = [conn(3620, "D"), conn(3640, "E", state="S0", dport=22), conn(3640, "B")]
    lookups = [dns(5, "B", "x.example.com"), dns(3600, "D", "y.example.com")]
    write_log(f"{inbox}/conn.1.log", CONN_HEADER, first)
    write_log(f"{inbox}/dns.1.log", DNS_HEADER, lookups)
    seen = []
    args = (str(tmp_path / "work"), rule_scorer, [lambda b, i: 1 / 0, lambda b, i: seen.append((i, b.count()))])
    LiveDetector(spark, *args).start(inbox).awaitTermination()
    write_log(f"{inbox}/conn.2.log", CONN_HEADER, second)
    live = LiveDetector(spark, *args)  # a new process resuming from the same work folder
    live.start(inbox).awaitTermination()
    assert [n for _, n in seen] == [3, 3]

    write_log(f"{everything}/conn.log", CONN_HEADER, first + second[:2])
    write_log(f"{everything}/dns.log", DNS_HEADER, lookups)
    want = features(feature_matrix(Z.silver(Z.zeek_dir_scan(spark, everything))))
    stored = spark.read.parquet(live.path("features"))
    got = features(stored.filter("flow_uid <> 'B' and flow_uid <> 'E'"))
    assert got == {k: v for k, v in want.items() if k in ("A", "C", "D")}
    assert stored.filter("flow_uid = 'B'").count() == 2  # a repeated uid is kept
    totals = spark.read.parquet(live.path("summary")).agg({"flows_count": "sum", "dns_count": "sum"}).first()
    assert sorted(totals) == [2, 6]

    stream = running_telemetry(spark, live.path("alerts")).writeStream.outputMode("complete").format("memory").queryName("t1")
    stream.trigger(availableNow=True).start().awaitTermination()
    assert spark.table("t1").first()["flows"] == 6


def test_late_future_and_undated_flows_are_scored(spark, tmp_path):
    inbox = str(tmp_path / "in")
    write_log(f"{inbox}/dns.0.log", DNS_HEADER, [dns(0, "M", "far.example.com")])
    write_log(f"{inbox}/conn.1.log", CONN_HEADER, [conn(100_000, "N"), conn(100_001, "N2"), conn(9e8, "FUTURE")])
    live = LiveDetector(spark, str(tmp_path / "work"), rule_scorer)
    live.start(inbox).awaitTermination()
    write_log(f"{inbox}/conn.2.log", CONN_HEADER, [conn(0, "OLD"), conn(100_010, "M"), conn(-1.6e9, "ZERO"), ["only", "two"]])
    live.start(inbox).awaitTermination()
    stored = {r["flow_uid"]: r for r in spark.read.parquet(live.path("features")).collect()}
    assert {u: r["late"] for u, r in stored.items()} == {"N": False, "N2": False, "FUTURE": False, "OLD": True, "M": False, "ZERO": True}
    assert stored["M"]["dns_query_len"] == len("far.example.com")  # found by uid, a day away
    assert stored["M"]["win_src_flow_count_60s"] == 3 and stored["OLD"]["win_src_flow_count_60s"] == 1
    assert {r["flow_uid"] for r in spark.read.parquet(live.path("alerts")).collect()} == set(stored)
    assert [r["reason"] for r in spark.read.parquet(live.path("quarantine")).collect()] == ["field_count"]
    assert os.path.isdir(live.path("checkpoint"))
    assert live.expire(1.6e9 + 90_000) == 3  # OLD and its lookup, ZERO
    assert spark.read.parquet(live.path("history/conn")).count() == 4


def test_rows_that_cannot_be_scored_become_error_alerts(spark, tmp_path):
    path = str(tmp_path / "conn.log")
    write_log(path, CONN_HEADER, [conn(0, "OK"), conn(1, "NAN"), conn(2, "INF"), conn(3, "NULL"), conn(4, "PROBS")])
    uid = F.col("flow_uid")
    bad = F.when(uid == "NAN", float("nan")).when(uid == "INF", float("inf")).when(uid != "NULL", F.col("flow_duration"))
    matrix = feature_matrix(Z.silver(Z.zeek_dir_scan(spark, str(tmp_path)))).withColumn("flow_duration", bad)

    def scorer(rows):
        assert rows.filter(uid.isin("NAN", "INF", "NULL")).count() == 0
        return rule_scorer(rows).withColumn("probs", F.when(uid == "PROBS", F.array(F.lit(float("nan")))).otherwise(F.col("probs")))

    got = {r["flow_uid"]: (r["decision"], r["metadata"].get("error")) for r in alert_rows(scored_or_rejected(matrix, scorer)).collect()}
    assert got.pop("OK")[0] != "INFERENCE_ERROR"
    assert got == {
        "NAN": ("INFERENCE_ERROR", "contract: nan"), "INF": ("INFERENCE_ERROR", "contract: infinite"),
        "NULL": ("INFERENCE_ERROR", "contract: non_numeric"), "PROBS": ("INFERENCE_ERROR", "scorer: no finite probabilities"),
    }

"""Policy, alert rows, store queries and triage on literal inputs."""

import pytest
from pyspark.sql import functions as F

from helpers import flow, flows_df
from netquill import contract as K
from netquill.operators import alerts as AL
from netquill.operators import assemble as A
from netquill.operators import policy as P
from netquill.operators import triage as TR
from netquill.sources import tables as T


def verdict(spark, probs):
    return spark.createDataFrame([(probs,)], "p array<double>").select(P.verdict(F.col("p")).alias("v")).first()["v"]


def test_policy(spark):
    assert verdict(spark, [0.9, 0.02, 0.02, 0.02, 0.02, 0.02])["predicted_label"] == "BENIGN"
    v = verdict(spark, [0.38, 0.05, 0.36, 0.07, 0.07, 0.07])  # RECON reaches 0.35 and nine tenths of the best
    assert (v["predicted_label"], v["confidence"], v["decision"]) == ("RECON", 0.36, "ANALYST_REVIEW")
    assert verdict(spark, [0.45, 0.05, 0.36, 0.05, 0.05, 0.04])["predicted_label"] == "BENIGN"
    low = verdict(spark, [0.3, 0.3, 0.1, 0.1, 0.1, 0.1])  # first maximum wins, below 0.40 abstains
    assert (low["predicted_class_id"], low["abstained"]) == (0, True)


def alert_frame(spark, n=8):
    rows = flows_df(spark, [flow(100 + i, f"evict-{i}", "10.0.0.1", "9.9.9.9", ob=i) for i in range(n)])
    probs = F.array(*[F.lit(x) for x in (0.1, 0.5, 0.1, 0.1, 0.1, 0.1)])
    return A.alert_rows(rows.withColumn("probs", probs).withColumn("processing_time_ms", F.lit(12.3456)))


def test_alert_row(spark):
    a = alert_frame(spark, 1).first()
    assert list(a.asDict()) == K.ALERT_COLUMNS and len(a) == 19
    assert a["timestamp_iso"] == "1970-01-01T00:01:40+00:00" and a["processing_time_ms"] == 12.346
    assert a["metadata"]["conn_state"] == "SF" and a["probabilities"]["DDOS"] == 0.5


def test_store_pages_and_eviction(spark):
    a = alert_frame(spark)
    assert [r["flow_uid"] for r in AL.bounded_store(a, 5).collect()] == [f"evict-{i}" for i in (7, 6, 5, 4, 3)]
    assert [r["flow_uid"] for r in AL.recent_alerts(a, 2).collect()] == ["evict-6", "evict-7"]
    page = AL.alerts_page(a, 2, 3, "ddos").collect()
    assert [r["flow_uid"] for r in page] == ["evict-5", "evict-4", "evict-3"] and page[0]["total"] == 8
    with pytest.raises(ValueError):
        AL.alert_filter(a, "NOT_A_CLASS")
    with pytest.raises(ValueError):
        AL.alerts_page(a, 0, 501)


def test_metrics_golden(spark):
    rows = [("a1", "DDOS", False, "AUTOMATED_DETECTION", 10.0), ("a2", "BENIGN", False, "AUTOMATED_DETECTION", 20.0),
            ("a3", "RECON", True, "ANALYST_REVIEW", 30.0)]
    a = spark.createDataFrame(rows, "alert_id string, predicted_label string, abstained boolean, decision string, processing_time_ms double")
    m = AL.alert_metrics(a).first()
    assert (m["total_flows"], m["total_threats"], m["benign_count"], m["analyst_review_count"]) == (3, 1, 1, 1)
    assert (m["average_inference_latency_ms"], m["p95_latency_ms"]) == (20.0, 29.0)


def test_triage_and_audit(spark):
    a = alert_frame(spark, 2)
    ids = [r["alert_id"] for r in a.orderBy("timestamp").collect()]
    rows = [(ids[0], 5.0, "ANALYST_REVIEW", ""), (ids[0], 200.0, "ANALYST_REVIEW", ""), (ids[0], 500.0, "FALSE_POSITIVE", "ok"),
            ("unknown", 1.0, "FALSE_POSITIVE", ""), (ids[1], 1.0, "NONSENSE", "")]
    d = spark.createDataFrame(rows, "alert_id string, decided_at double, decision string, notes string")
    state = {r["alert_id"]: (r["decision"], r["abstained"]) for r in TR.apply_triage(a, d).collect()}
    assert state == {ids[0]: ("FALSE_POSITIVE", False), ids[1]: ("AUTOMATED_DETECTION", False)}
    audit = TR.triage_audit(a, d, slot_seconds=60.0).orderBy("timestamp").collect()
    assert [(r["old_decision"], r["new_decision"]) for r in audit] == [
        ("AUTOMATED_DETECTION", "ANALYST_REVIEW"), ("ANALYST_REVIEW", "FALSE_POSITIVE")]


def test_stored_alerts_round_trip(spark, tmp_path):
    a = alert_frame(spark)
    path = str(tmp_path / "alerts")
    T.append_alerts(a, path)
    back = T.read_alerts_since(spark, path, "1970-01-01")
    assert sorted(map(tuple, (r.asDict().items() for r in back.select("alert_id", "confidence").collect()))) == sorted(
        map(tuple, (r.asDict().items() for r in a.select("alert_id", "confidence").collect())))
    assert back.first()["probabilities"]["DDOS"] == 0.5
    assert T.read_alerts_since(spark, path, "1999-01-01").isEmpty()
    T.export_alerts(a, str(tmp_path / "csv"), limit=3)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == AL.EXPORT_COLUMNS


def test_contract(spark):
    with pytest.raises(A.ContractViolation):
        A.check_columns(K.FEATURE_COLUMNS[:-1])
    with pytest.raises(A.ContractViolation):
        A.check_columns([*K.FEATURE_COLUMNS, "extra"])
    good = [0.0] * 78
    rows = [("ok", good), ("short", good[:-1]), ("nan", good[:-1] + [float("nan")]), ("inf", good[:-1] + [float("-inf")])]
    valid, rejected = A.contract_split(spark.createDataFrame(rows, "id string, features array<double>"))
    assert [r["id"] for r in valid.collect()] == ["ok"]
    assert {r["id"]: r["reason"] for r in rejected.collect()} == {"short": "wrong_dimension", "nan": "nan", "inf": "infinite"}


def test_a_payload_is_parsed_once(spark):
    """Judging every field used to parse the payload anew for each of them."""
    text = '{"alert_id":"a","confidence":0.5}'
    valid, rejected = TR.parse_payloads(spark.createDataFrame([(text,), (None,), ("{",)], "payload string"))
    for part in (valid.select("alert_id"), rejected.select("reason")):
        assert part._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert valid.count() == 0
    assert {tuple(r) for r in rejected.collect()} == {(p, "missing_or_malformed_field") for p in (text, None, "{")}

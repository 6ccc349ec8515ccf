"""The stored feature tables hold all 78 features, from all logs, in every format."""

from pathlib import Path

from pyspark.sql import functions as F

from netquill import contract as K
from netquill.plans import catalog_runs as R
from netquill.plans.catalog import QUERIES, matrix

CONTEXT = ["has_dns_context", "has_ssl_context", "weird_anomaly_count_flow", "quic_sni_len", "win_src_flow_count_60s"]


def _kept_path(monkeypatch):
    paths = []
    monkeypatch.setattr(R.L, "scratch", lambda *a, real=R.L.scratch: paths.append(real(*a)) or paths[-1])
    return paths


def _sums(table):
    return {c: round(v or 0, 3) for c, v in table.agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in CONTEXT]).first().asDict().items()}


def test_features_jsonl_and_master_table_are_whole(spark, sf, monkeypatch):
    want = _sums(matrix(spark, sf, K.FEATURE_COLUMNS))
    assert all(v > 0 for v in want.values())
    paths = _kept_path(monkeypatch)
    n = QUERIES["features_jsonl"](spark, sf).count()
    assert _sums(R.D.wide(R.T.read_features_jsonl(spark, paths[-1]))) == want
    assert QUERIES["master_table"](spark, sf).count() == n
    stored = spark.read.parquet(f"{paths[-1]}/parquet")
    csv = spark.read.option("header", True).csv(f"{paths[-1]}/csv")
    nested = spark.read.json(f"{paths[-1]}/json")
    assert stored.columns == csv.columns and len(csv.columns) == 90
    assert _sums(stored) == _sums(csv) == _sums(R.D.wide(nested)) == want and nested.count() == n


def test_texts_are_packed(spark, sf, monkeypatch):
    """Plain text of 78 numbers took some 500 bytes a row, in two formats."""
    paths = _kept_path(monkeypatch)
    n = QUERIES["master_table"](spark, sf).count()
    sizes = {kind: sum(f.stat().st_size for f in Path(paths[-1].removeprefix("file:"), kind).glob("part-*")) for kind in ("csv", "json")}
    assert all(0 < size < 200 * n for size in sizes.values())

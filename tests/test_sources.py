import json

import pytest
from pyspark.sql import functions as F

from helpers import CONN_HEADER, DNS_HEADER, conn_row, write_log
from netquill.contract import FEATURE_COLUMNS, LOG_KINDS
from netquill.operators import flows as FL
from netquill.operators.assemble import feature_matrix
from netquill.sources import tables as T
from netquill.sources import zeek as Z


def test_scan_and_missing_kinds(spark, tmp_path):
    write_log(f"{tmp_path}/conn.log", CONN_HEADER, [conn_row("1.5", "A"), conn_row("2.5", "B")])
    raw = Z.zeek_dir_scan(spark, str(tmp_path))
    assert set(raw) == set(LOG_KINDS)
    assert {r["kind"]: r["n"] for r in Z.record_counts(raw).collect()} == {"conn": 2}
    assert [r["uid"] for r in FL.flatten(FL.normalize_conn(raw["conn"])).orderBy("ts").collect()] == ["A", "B"]


def test_custom_separator(spark, tmp_path):
    write_log(f"{tmp_path}/conn.log", CONN_HEADER, [conn_row("1.5", "A")], separator="|")
    rec = Z.zeek_scan(spark, f"{tmp_path}/conn.log").first()["record"]
    assert rec["id.resp_p"] == "80" and rec["uid"] == "A"


def test_malformed_rows(spark, tmp_path):
    path = tmp_path / "conn.log"
    path.write_text("early\trow\n#separator \\x09\n#fields\tts\tuid\n1\tA\n\n2\tB\tmore\n3\n4\tC\n")
    placed = Z.with_place(Z.located(spark.read.text(str(path))))
    assert sorted(r["record"]["uid"] for r in Z.records(placed).collect()) == ["A", "C"]
    assert {r["reason"]: r["n"] for r in Z.malformed_counts(placed).collect()} == {"no_header": 1, "field_count": 2}


def test_header_change_inside_a_file(spark, tmp_path):
    path = tmp_path / "conn.log"
    path.write_text("#fields\tts\tuid\n1\tA\n#fields\tuid\tts\tx\nB\t2\ty\n")
    recs = [r["record"] for r in Z.zeek_scan(spark, str(path)).collect()]
    assert sorted((r["uid"], r["ts"]) for r in recs) == [("A", "1"), ("B", "2")]


def test_last_dns_row_in_file_order_wins(spark, tmp_path):
    write_log(f"{tmp_path}/conn.log", CONN_HEADER, [conn_row("100", "A")])
    write_log(f"{tmp_path}/dns.log", DNS_HEADER, [
        ["99", "A", "192.168.1.50", 1, "1.1.1.1", 53, "first.example.com", "A", "NOERROR", "-", "0.1"],
        ["98", "A", "192.168.1.50", 1, "1.1.1.1", 53, "b.example.com", "TXT", "NXDOMAIN", "x,y", "0.25"],
    ])
    m = feature_matrix(Z.silver(Z.zeek_dir_scan(spark, str(tmp_path)))).first()
    assert m["has_dns_context"] == 1 and m["dns_qtype_is_TXT"] == 1 and m["dns_answer_count"] == 2 and m["dns_rtt"] == 0.25
    assert m["win_src_dns_query_count_60s"] == 2 and m["win_src_dns_nxdomain_ratio_60s"] == 0.5
    assert m["has_ssl_context"] == 0 and m["history_len"] == 6


def test_features_jsonl_and_master(spark, tmp_path):
    row = ("e", "u", 1.0, "a:1", "b:2", "tcp", "SF", "flow", "BENIGN", 0, [float(i) for i in range(78)])
    from netquill.contract import LABELLED_ROW
    T.write_features_jsonl(spark.createDataFrame([row], LABELLED_ROW), f"{tmp_path}/f")
    back = T.read_features_jsonl(spark, f"{tmp_path}/f")
    assert back.first()["features"][77] == 77.0
    T.write_master(back.withColumn("master_row_id", F.lit(1)), f"{tmp_path}/m", source_dir="runs")
    csv = spark.read.option("header", True).csv(f"{tmp_path}/m/csv")
    assert len(csv.columns) == 90 and csv.columns[12:] == FEATURE_COLUMNS
    assert len(json.loads(spark.read.text(f"{tmp_path}/m/json").first()[0])["features"]) == 78


def test_unknown_export_format(spark, tmp_path):
    with pytest.raises(ValueError):
        T.export_alerts(spark.createDataFrame([], T.ALERT_ROW), str(tmp_path / "x"), "xml")

"""The catalogue: every operator as a named query over the benchmark tables.

``QUERIES[name](spark, sf_dir)`` builds the DataFrame; ``ORACLES[name]`` is the same result in
plain SQL where one exists.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquill import contract as K
from netquill.functions import scalars as S
from netquill.functions.netaddr import is_private_ip
from netquill.operators import alerts as AL
from netquill.operators import assemble as A
from netquill.operators import audits as AU
from netquill.operators import correlate as C
from netquill.operators import dataset as D
from netquill.operators import evaluate as E
from netquill.operators import flows as FL
from netquill.operators import policy as P
from netquill.operators import triage as TR
from netquill.operators import windows as W
from netquill.plans import oracle as O
from netquill.sources import bindings as B
from netquill.sources import tables as T
from netquill.sources.stage import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query, and its SQL restatement when there is one."""

    def register(build):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = O.sql(oracle)
        return build

    return register


# --- bound inputs ----------------------------------------------------------------


def matrix(spark: SparkSession, d: str, features: list[str]) -> DataFrame:
    return A.feature_matrix(B.logs(spark, d), features)


def labelled(spark: SparkSession, d: str, features: list[str]) -> DataFrame:
    runs = B.run_labels(spark, d).withColumnRenamed("uid", "flow_uid")
    return (
        matrix(spark, d, features).join(runs, "flow_uid")
        .withColumn("source_endpoint", S.endpoint_str(F.col("source_ip"), F.col("source_port")))
        .withColumn("destination_endpoint", S.endpoint_str(F.col("destination_ip"), F.col("destination_port")))
    )


def alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alert rows of the bound flows plus their run."""
    scored = B.flows(spark, d).join(B.predictions(spark, d), "uid")
    return A.alert_rows(scored, carry=["experiment_id"]).select(*K.ALERT_COLUMNS, "experiment_id")


def scored(spark: SparkSession, d: str) -> DataFrame:
    return E.with_argmax(B.predictions(spark, d))


def plain(df: DataFrame) -> DataFrame:
    """Alert columns without the two maps."""
    return df.select(*[c for c in df.columns if c not in ("probabilities", "metadata")])


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """One to three triage decisions for every eleventh alert."""
    e = B.flows(spark, d).select("uid", "ts", F.substring("uid", 2, 20).cast("long").alias("event_id"))
    kinds = F.array(*[F.lit(x) for x in K.TRIAGE_DECISIONS])
    steps = F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int"))
    e = e.filter(F.col("event_id") % 11 == 0).withColumn("step", F.explode(steps))
    return e.select(
        A.alert_id(F.col("uid"), F.col("ts")).alias("alert_id"),
        (F.col("ts") + 1000.0 + F.col("step") * 50.0).alias("decided_at"),
        F.get(kinds, ((F.col("event_id") + F.col("step")) % 3).cast("int")).alias("decision"),
        F.concat(F.lit("step "), F.col("step")).alias("notes"),
    )


_DECISIONS_SQL = """
    SELECT sha256(uid || '|' || CAST(floor(ts * 1000000) AS BIGINT)) AS alert_id, ts + 1000 + step * 50 AS decided_at,
           ['AUTOMATED_DETECTION', 'ANALYST_REVIEW', 'FALSE_POSITIVE'][(event_id + step) % 3 + 1] AS decision, 'step ' || step AS notes
    FROM (SELECT uid, ts, event_id, unnest(range(0, event_id % 3 + 1)) AS step FROM conn_v WHERE event_id % 11 = 0)"""

# Raw field texts with every placeholder and near-number, one per event.
_TEXTS = ["-", "(empty)", "", " 12 ", "12.9", "-7.5", "1e3", "1d", "abc", ".5", "5.", "1_0"]


def texts(spark: SparkSession, d: str, number: Column | str = "value") -> DataFrame:
    e = B.table(spark, d, "events")
    pick = F.get(F.array(*[F.lit(t) for t in _TEXTS]), (F.col("event_id") % 13).cast("int"))
    return e.select("event_id", F.coalesce(pick, (F.col(number) if isinstance(number, str) else number).cast("string")).alias("raw"))


_PARSED_SQL = """
    SELECT event_id, CASE event_id % 13 WHEN 0 THEN {0} WHEN 1 THEN {0} WHEN 2 THEN {0} WHEN 3 THEN {1} WHEN 4 THEN {2} WHEN 5 THEN {3}
           WHEN 6 THEN {4} WHEN 7 THEN {0} WHEN 8 THEN {0} WHEN 9 THEN {5} WHEN 10 THEN {6} WHEN 11 THEN {0} ELSE {7} END AS parsed
    FROM events"""


@query("safe_int", _PARSED_SQL.format(*[f"CAST({x} AS BIGINT)" for x in (0, 12, 12, -7, 1000, 0, 5, "trunc(value)")]))
def _(spark, d):
    return texts(spark, d).select("event_id", S.safe_int(F.col("raw")).alias("parsed"))


@query("safe_float", _PARSED_SQL.format(*[f"CAST({x} AS DOUBLE)" for x in (0, 12, 12.9, -7.5, 1000, 0.5, 5, "value")]))
def _(spark, d):
    return texts(spark, d).select("event_id", S.safe_float(F.col("raw")).alias("parsed"))


@query("clean_str", """
    SELECT event_id, CASE event_id % 13 WHEN 3 THEN '12' WHEN 4 THEN '12.9' WHEN 5 THEN '-7.5' WHEN 6 THEN '1e3' WHEN 7 THEN '1d'
           WHEN 8 THEN 'abc' WHEN 9 THEN '.5' WHEN 10 THEN '5.' WHEN 11 THEN '1_0' WHEN 12 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) ELSE '' END AS cleaned
    FROM events""")
def _(spark, d):
    return texts(spark, d, F.floor("value")).select("event_id", S.clean_str(F.col("raw")).alias("cleaned"))


@query("split_answers", """
    SELECT uid, seq, array_to_string([trim(a) for a in string_split(answers, ',') if trim(a) NOT IN ('-', '')], '|') AS answers FROM dns_v""")
def _(spark, d):
    return B.dns(spark, d).select("uid", "seq", F.array_join(S.split_answers(F.col("answers")), "|").alias("answers"))


def _hosts(spark: SparkSession, d: str) -> DataFrame:
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1))
    return B.table(spark, d, "pages").select(host.alias("host")).distinct()


for _name, _fn, _column in [
    ("shannon_entropy", S.shannon_entropy, "entropy"), ("dns_vowel_ratio", S.dns_vowel_ratio, "vowel_ratio"),
    ("dns_numeric_ratio", S.dns_numeric_ratio, "numeric_ratio"), ("dns_subdomain_depth", S.dns_subdomain_depth, "depth"),
    ("dns_max_label_len", S.dns_max_label_len, "longest"),
]:
    query(_name, f"SELECT host, {_column} FROM text_v")(
        lambda spark, d, fn=_fn, column=_column: _hosts(spark, d).select("host", fn(F.col("host")).alias(column))
    )


@query("is_private_ip", """
    SELECT event_id, (a IN (0, 10, 127) OR a >= 240 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)
           OR (a = 198 AND b BETWEEN 18 AND 19)) AS private
    FROM (SELECT event_id, [0, 10, 127, 169, 172, 192, 198, 8, 100, 224, 255][event_id % 11 + 1] AS a,
                 [254, 16, 31, 32, 168, 18, 20][event_id % 7 + 1] AS b FROM events)""")
def _(spark, d):
    first = [0, 10, 127, 169, 172, 192, 198, 8, 100, 224, 255]
    second = [254, 16, 31, 32, 168, 18, 20]
    eid = F.col("event_id")
    pick = lambda xs: F.get(F.array(*[F.lit(str(x)) for x in xs]), (eid % len(xs)).cast("int"))
    ip = F.concat_ws(".", pick(first), pick(second), (eid % 256).cast("string"), (eid * 7 % 256).cast("string"))
    return B.table(spark, d, "events").select("event_id", is_private_ip(ip).alias("private"))


def _flow_columns(names: list[str]):
    cols = ", ".join(f'"{n}"' for n in names)

    def build(spark, d):
        return A.flow_features(B.flows(spark, d)).select("uid", *names)

    return f"SELECT uid, {cols} FROM flowf_v", build


for _name, _members in {
    "port_class": K.FLOW_FEATURES[12:15], "proto_onehot": K.FLOW_FEATURES[17:20], "state_onehot": K.FLOW_FEATURES[20:24],
    "history_flags": K.FLOW_FEATURES[24:27], "bytes_per_packet": ["bytes_per_packet"],
    "byte_packet_ratios": K.FLOW_FEATURES[8:11], "flow_features": K.FLOW_FEATURES,
}.items():
    _sql, _build = _flow_columns(_members)
    query(_name, _sql)(_build)


@query("iso_timestamp", """
    SELECT event_id, strftime(make_timestamp(CAST(round_even(ts * 1440000000, 0) AS BIGINT)), '%Y-%m-%dT%H:%M:%S')
           || CASE WHEN CAST(round_even(ts * 1440000000, 0) AS BIGINT) % 1000000 = 0 THEN ''
                   ELSE strftime(make_timestamp(CAST(round_even(ts * 1440000000, 0) AS BIGINT)), '.%f') END || '+00:00' AS iso
    FROM ev""")
def _(spark, d):
    e = B.flows(spark, d).select(F.substring("uid", 2, 20).cast("long").alias("event_id"), "ts")
    return e.select("event_id", S.iso_timestamp(F.col("ts") * 1440).alias("iso"))


@query("endpoint_str", "SELECT uid, src_ip || ':' || src_port AS source_endpoint, dst_ip || ':' || dst_port AS destination_endpoint FROM conn_v")
def _(spark, d):
    return B.flows(spark, d).select(
        "uid", S.endpoint_str(F.col("src_ip"), F.col("src_port")).alias("source_endpoint"),
        S.endpoint_str(F.col("dst_ip"), F.col("dst_port")).alias("destination_endpoint"),
    )


def _prob_cells(column: str = "probabilities") -> list[Column]:
    return [F.try_element_at(column, F.lit(c)).alias(f"p_{c.lower()}") for c in K.ACTIVE_CLASSES]


_PROB_SQL = ", ".join(f"round_even(p[{i + 1}], 4) AS p_{c.lower()}" for i, c in enumerate(K.ACTIVE_CLASSES))


@query("round_probabilities", f"SELECT uid, {_PROB_SQL} FROM pred_v")
def _(spark, d):
    m = F.map_from_arrays(P.class_array(), F.col("probs"))
    rows = B.predictions(spark, d).select("uid", S.round_probabilities(m).alias("probabilities"))
    return rows.select("uid", *_prob_cells())


@query("is_threat", "SELECT flow_uid, predicted_label <> 'BENIGN' AND NOT abstained AND decision = 'AUTOMATED_DETECTION' AS threat FROM alert_v")
def _(spark, d):
    return alerts(spark, d).select("flow_uid", S.is_threat(F.col("predicted_label"), F.col("abstained"), F.col("decision")).alias("threat"))


@query("json_maps", f"SELECT flow_uid, {_PROB_SQL}, conn_state FROM alert_v")
def _(spark, d):
    back = T.decode_alerts(T.encode_alerts(alerts(spark, d)))
    return back.select("flow_uid", *_prob_cells(), F.try_element_at("metadata", F.lit("conn_state")).alias("conn_state"))


# --- projections and filters -------------------------------------------------------

_CONN_SQL = """ts AS "timestamp", uid, src_ip, src_port, dst_ip, dst_port, protocol, service, duration, orig_bytes, resp_bytes, total_bytes,
    orig_packets, resp_packets, total_packets, bytes_per_packet, missed_bytes, conn_state"""


@query("normalize_conn", f"SELECT {_CONN_SQL}, history, 'T' AS local_orig, CAST(2 AS INTEGER) AS leftovers FROM conn_v")
def _(spark, d):
    n = FL.normalize_conn(B.raw_conn(spark, d))
    more = n.select("uid", F.try_element_at("metadata", F.lit("local_orig")).alias("local_orig"), F.size("metadata").alias("leftovers"))
    return FL.flatten(n).withColumnRenamed("ts", "timestamp").join(more, "uid")


@query("connection_features", """
    SELECT uid, ts AS "timestamp", src_ip AS source_ip, src_port AS source_port, dst_ip AS destination_ip, dst_port AS destination_port, protocol,
           service, duration, orig_bytes, resp_bytes, total_bytes, orig_packets AS orig_pkts, resp_packets AS resp_pkts, total_packets,
           bytes_per_packet, conn_state AS connection_state, missed_bytes FROM conn_v""")
def _(spark, d):
    return FL.connection_features(B.raw_conn(spark, d))


@query("dns_projection", """
    SELECT uid, ts AS "timestamp", src_ip AS source_ip, dst_ip AS destination_ip, query, qtype_name, rcode_name,
           array_to_string([trim(a) for a in string_split(answers, ',') if trim(a) NOT IN ('-', '')], '|') AS answers,
           CAST(len([a for a in string_split(answers, ',') if trim(a) NOT IN ('-', '')]) AS INTEGER) AS answer_count FROM dns_v""")
def _(spark, d):
    raw = B.dns(spark, d).select(
        F.col("ts").cast("string").alias("ts"), "uid", F.col("src_ip").alias("id.orig_h"), F.col("dst_ip").alias("id.resp_h"),
        "query", "qtype_name", "rcode_name", "answers",
    )
    return FL.dns_projection(raw).withColumn("answers", F.array_join("answers", "|"))


for _kind, _view, _members in [
    ("dns", "dnsf_v", K.DNS_FEATURES), ("quic", "quicf_v", K.QUIC_FEATURES), ("ssl", "sslf_v", K.SSL_FEATURES), ("weird", "weirdf_v", K.WEIRD_FEATURES),
]:
    _cells = ", ".join(f'coalesce(x."{c}", 0) AS "{c}"' for c in _members)
    query(f"{_kind}_features", f"SELECT f.uid AS flow_uid, {_cells} FROM conn_v f LEFT JOIN {_view} x ON x.uid = f.uid")(
        lambda spark, d, members=_members: matrix(spark, d, members).select("flow_uid", *members)
    )


@query("assemble_vector", f"""
    SELECT uid, {', '.join(f'"{n}"' if n in K.FLOW_FEATURES else f'CAST({K.default_of(n)} AS DOUBLE) AS "{n}"' for n in K.FEATURE_COLUMNS)}
    FROM flowf_v""")
def _(spark, d):
    return A.assemble_defaults(A.flow_features(B.flows(spark, d)))


@query("feature_matrix", O.matrix_select(K.FEATURE_COLUMNS))
def _(spark, d):
    return matrix(spark, d, K.FEATURE_COLUMNS)


def _spoiled(spark: SparkSession, d: str) -> DataFrame:
    """uid and features of every flow, four of ten spoiled in one of the ways the contract names."""
    e = A.assemble_defaults(A.flow_features(B.flows(spark, d)))
    kind = F.substring("uid", 2, 20).cast("long") % 10

    def cell(x: Column, i: Column) -> Column:
        last = i == K.NUM_FEATURES - 1
        return F.when(last & (kind == 0), float("nan")).when(last & (kind == 1), float("inf")).when(last & (kind == 2), None).otherwise(x)

    spoiled = F.slice(F.transform(A.feature_array(), cell), 1, F.when(kind == 3, K.NUM_FEATURES - 1).otherwise(K.NUM_FEATURES))
    return e.select("uid", spoiled.alias("features"))


@query("contract_reject", """
    SELECT uid, CASE event_id % 10 WHEN 0 THEN 'nan' WHEN 1 THEN 'infinite' WHEN 2 THEN 'non_numeric' WHEN 3 THEN 'wrong_dimension' ELSE 'valid' END AS reason
    FROM conn_v""")
def _(spark, d):
    valid, rejected = A.contract_split(_spoiled(spark, d))
    return rejected.select("uid", "reason").unionByName(valid.select("uid", F.lit("valid").alias("reason")))


@query("contract_validate", """
    SELECT CASE event_id % 10 WHEN 0 THEN 'nan' WHEN 1 THEN 'infinite' WHEN 2 THEN 'wrong_dimension' ELSE 'valid' END AS verdict, count(*) AS n
    FROM events GROUP BY 1""")
def _(spark, d):
    e = A.assemble_defaults(A.flow_features(B.flows(spark, d)))
    kind = F.substring("uid", 2, 20).cast("long") % 10
    vec = A.feature_array()
    spoiled = (
        F.when(kind == 0, F.concat(F.slice(vec, 1, 77), F.array(F.lit(float("nan")))))
        .when(kind == 1, F.concat(F.slice(vec, 1, 77), F.array(F.lit(float("inf")))))
        .when(kind == 2, F.slice(vec, 1, 77)).otherwise(vec)
    )
    judged = e.select(F.coalesce(A.contract_reason(spoiled), F.lit("valid")).alias("verdict"))
    return judged.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


_ALERT_SQL = """alert_id, flow_uid, "timestamp", timestamp_iso, source_ip, destination_ip, source_port, destination_port, protocol, predicted_class_id,
    predicted_label, confidence, abstained, decision, 'v1.0.0' AS model_version, '1.0.0' AS schema_version, processing_time_ms, experiment_id"""


@query("alert_project", f"SELECT {_ALERT_SQL}, {_PROB_SQL}, CAST(orig_bytes AS VARCHAR) AS meta_orig_bytes, conn_state AS meta_conn_state FROM alert_v")
def _(spark, d):
    a = alerts(spark, d)
    meta = lambda k: F.try_element_at("metadata", F.lit(k)).alias(f"meta_{k}")
    return a.select(*[c for c in a.columns if c not in ("probabilities", "metadata")], *_prob_cells(), meta("orig_bytes"), meta("conn_state"))


@query("error_alert", """
    SELECT flow_uid, CASE WHEN event_id % 17 = 0 THEN 'UNKNOWN' ELSE predicted_label END AS predicted_label,
           CASE WHEN event_id % 17 = 0 THEN -1 ELSE predicted_class_id END AS predicted_class_id,
           CASE WHEN event_id % 17 = 0 THEN 'INFERENCE_ERROR' ELSE decision END AS decision, abstained OR event_id % 17 = 0 AS abstained,
           CASE WHEN event_id % 17 = 0 THEN 0 ELSE confidence END AS confidence,
           CASE WHEN event_id % 17 = 0 THEN 'nan' END AS error FROM alert_v""")
def _(spark, d):
    s = B.flows(spark, d).join(B.predictions(spark, d), "uid").withColumn("error", F.when(F.col("event_id") % 17 == 0, "nan"))
    return A.alert_rows(s).select(
        "flow_uid", "predicted_label", "predicted_class_id", "decision", "abstained", "confidence",
        F.try_element_at("metadata", F.lit("error")).alias("error"),
    )


@query("alert_filter", f"SELECT {_ALERT_SQL} FROM alert_v WHERE predicted_label = 'RECON' AND decision = 'ANALYST_REVIEW'")
def _(spark, d):
    return plain(AL.alert_filter(alerts(spark, d), " recon ", "analyst_review"))


@query("alert_search", f"""SELECT {_ALERT_SQL} FROM alert_v WHERE contains(source_ip, '10.3') OR contains(destination_ip, '10.3')
    OR contains(CAST(source_port AS VARCHAR), '10.3') OR contains(CAST(destination_port AS VARCHAR), '10.3')
    OR contains(lower(flow_uid), '10.3') OR contains(lower(predicted_label), '10.3') OR contains(protocol, '10.3')""")
def _(spark, d):
    return plain(AL.alert_search(alerts(spark, d), "10.3"))


_REVIEW_SQL = "(abstained OR decision = 'ANALYST_REVIEW')"
_THREAT_SQL = f"(predicted_label <> 'BENIGN' AND NOT {_REVIEW_SQL} AND decision <> 'FALSE_POSITIVE')"
_MODES = {"ALL": "true", "THREATS_ONLY": _THREAT_SQL, "REVIEW_ONLY": _REVIEW_SQL, "BENIGN_ONLY": f"NOT ({_THREAT_SQL} OR {_REVIEW_SQL})"}


@query("triage_mode", " UNION ALL ".join(f"SELECT '{m}' AS mode, {_ALERT_SQL} FROM alert_v WHERE {rule}" for m, rule in _MODES.items())
       + f" UNION ALL SELECT 'THREATS_ONLY udp' AS mode, {_ALERT_SQL} FROM alert_v WHERE {_THREAT_SQL} AND protocol = 'udp'")
def _(spark, d):
    a = alerts(spark, d)
    views = {m: AL.triage_mode(a, m) for m in _MODES} | {"THREATS_ONLY udp": AL.triage_mode(a, "THREATS_ONLY", protocol="UDP")}
    return reduce(DataFrame.unionByName, [plain(v).withColumn("mode", F.lit(m)) for m, v in views.items()])


_INSPECTED = [c for c in E.INSPECT if c in K.FEATURE_COLUMNS]


def _inspected(spark: SparkSession, d: str, features: list[str]) -> DataFrame:
    table = labelled(spark, d, features).drop("label", "label_id", "experiment_id")
    return table.join(scored(spark, d).withColumnRenamed("uid", "flow_uid"), "flow_uid")


def _inspected_sql(features: list[str]) -> str:
    return (
        "SELECT m.*, a.experiment_id, a.label, a.prediction, a.max_confidence, a.is_correct, a.p, source_ip || ':' || source_port AS source_endpoint, "
        f"destination_ip || ':' || destination_port AS destination_endpoint FROM ({O.matrix_select(features)}) m JOIN arg_v a ON a.uid = m.flow_uid"
    )


@query("misclassified", f"""SELECT {', '.join(f'"{c}"' for c in E.INSPECT)},
    {', '.join(f'p[{i + 1}] AS prob_{c.lower()}' for i, c in enumerate(K.ACTIVE_CLASSES))} FROM ({_inspected_sql(_INSPECTED)}) WHERE NOT is_correct""")
def _(spark, d):
    return E.misclassified(_inspected(spark, d, _INSPECTED))


for _label in ("RECON", "DNS_TUNNEL"):
    _cols = E.CLASS_INSPECT[_label]
    _feats = [c for c in _cols if c in K.FEATURE_COLUMNS]
    query(
        f"class_error_table_{_label.lower()}",
        f"""SELECT flow_uid, experiment_id, label, prediction, max_confidence AS confidence, {', '.join(_cols)}
            FROM ({_inspected_sql(_feats)}) WHERE label = '{_label}' OR prediction = '{_label}'""",
    )(lambda spark, d, label=_label, feats=_feats: E.class_error_table(_inspected(spark, d, feats), label))


@query("label_rule", """
    SELECT uid, label, CAST(CASE label WHEN 'DDOS' THEN 1 WHEN 'RECON' THEN 2 ELSE 0 END AS INTEGER) AS label_id
    FROM (SELECT uid, CASE event_id % 3 WHEN 0 THEN 'BENIGN' WHEN 1 THEN 'RECON'
                      ELSE CASE WHEN dst_port = 8080 OR conn_state IN ('S0', 'REJ') THEN 'DDOS' ELSE 'BENIGN' END END AS label FROM conn_v)""")
def _(spark, d):
    f = B.flows(spark, d).withColumn("event_id", F.substring("uid", 2, 20).cast("long"))
    run = F.when(F.col("event_id") % 3 == 0, "BENIGN").when(F.col("event_id") % 3 == 1, "RECON").otherwise("DDOS")
    return D.label_rule(f, run, F.lit(8080)).select("uid", "label", "label_id")


_BEACON = ["win_pair_flow_count_300s", "win_pair_delta_t_cv"]


@query("beacon_signature", f"""SELECT flow_uid, win_pair_flow_count_300s, win_pair_delta_t_cv FROM ({O.matrix_select(_BEACON)})
    WHERE win_pair_delta_t_cv < 0.6 AND win_pair_flow_count_300s > 3""")
def _(spark, d):
    return AU.beacon_signature(matrix(spark, d, _BEACON), 0.6, 3).select("flow_uid", *_BEACON)


# --- joins ---------------------------------------------------------------------------


@query("flow_dns_by_uid", """SELECT c.uid, q.query, q.qtype_name, q.rcode_name FROM conn_v c LEFT JOIN
    (SELECT * FROM dns_v QUALIFY row_number() OVER (PARTITION BY uid ORDER BY seq DESC) = 1) q ON q.uid = c.uid""")
def _(spark, d):
    cols = ["query", "qtype_name", "rcode_name"]
    j = C.attach_last(B.flows(spark, d), B.dns(spark, d), cols, "dns")
    return j.select("uid", *[F.col("dns")[c].alias(c) for c in cols])


@query("flow_quic_by_uid", "SELECT c.uid, q.server_name, q.dcid AS client_initial_dcid FROM conn_v c LEFT JOIN quic_v q ON q.uid = c.uid")
def _(spark, d):
    cols = ["server_name", "client_initial_dcid"]
    j = C.attach_last(B.flows(spark, d), B.quic(spark, d), cols, "quic")
    return j.select("uid", *[F.col("quic")[c].alias(c) for c in cols])


@query("flow_ssl_by_uid", "SELECT c.uid, q.server_name, q.version, q.issuer, q.resumed FROM conn_v c LEFT JOIN ssl_v q ON q.uid = c.uid")
def _(spark, d):
    cols = ["server_name", "version", "issuer", "resumed"]
    j = C.attach_last(B.flows(spark, d), B.ssl(spark, d), cols, "ssl")
    return j.select("uid", *[F.col("ssl")[c].alias(c) for c in cols])


@query("flow_weird_by_uid", """SELECT c.uid, coalesce(w.anomalies, '') AS anomalies FROM conn_v c LEFT JOIN
    (SELECT uid, string_agg(name || '/' || notice || '/' || n, ';' ORDER BY name, notice) AS anomalies
     FROM (SELECT uid, name, notice, count(*) AS n FROM weird_v GROUP BY ALL) GROUP BY uid) w ON w.uid = c.uid""")
def _(spark, d):
    j = B.flows(spark, d).select("uid").join(C.weird_by_uid(B.weird(spark, d)), "uid", "left")
    shown = F.transform("weird", lambda w: F.concat_ws("/", w["name"], w["notice"], w["n"].cast("string")))
    return j.select("uid", F.coalesce(F.array_join(shown, ";"), F.lit("")).alias("anomalies"))


def _window_query(name: str, features: list[str]) -> None:
    cells = ", ".join(f'"{f}"' for f in features)
    query(name, f"SELECT flow_uid, {cells} FROM ({O.matrix_select(features)})")(
        lambda spark, d: W.window_features(B.flows(spark, d), B.dns(spark, d), B.weird(spark, d), features).select(
            F.col("uid").alias("flow_uid"), *features
        )
    )


_window_query("flow_dns_interval", ["win_src_dns_query_count_60s", "win_src_dns_nxdomain_ratio_60s", "win_src_dns_unique_domains_60s"])
_window_query("flow_weird_interval", ["win_src_weird_count_60s"])
for _f in K.WINDOW_FEATURES:
    _window_query(_f, [_f])
_window_query("window_features", K.WINDOW_FEATURES)


@query("alert_point_lookup", f"SELECT {_ALERT_SQL} FROM alert_v WHERE flow_uid = (SELECT min(uid) FROM conn_v)")
def _(spark, d):
    flow = B.flows(spark, d).agg(F.min(F.struct("uid", "ts")).alias("f"))
    return plain(AL.alert_by_id(alerts(spark, d), flow.select(A.alert_id(F.col("f.uid"), F.col("f.ts"))).scalar()))


_TIED = "(SELECT uid, src_ip, src_ip || '>' || dst_ip AS pair, floor(ts / 30) * 30 AS ts, orig_bytes, event_id FROM conn_v)"


@query("win_arrival_mode", f"""
    SELECT uid AS flow_uid, CAST(count(*) OVER (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)
             - count(*) OVER (PARTITION BY src_ip, ts) + row_number() OVER (PARTITION BY src_ip, ts ORDER BY event_id) AS DOUBLE) AS win_src_flow_count_60s,
           CAST(sum(orig_bytes) OVER (PARTITION BY pair ORDER BY ts RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) - sum(orig_bytes) OVER (PARTITION BY pair, ts)
             + sum(orig_bytes) OVER (PARTITION BY pair, ts ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS win_pair_total_orig_bytes_300s
    FROM {_TIED}""")
def _(spark, d):
    f = B.flows(spark, d).withColumn("ts", F.floor(F.col("ts") / 30) * 30.0).withColumn("n", F.substring("uid", 2, 20).cast("long"))
    asked = ["win_src_flow_count_60s", "win_pair_total_orig_bytes_300s"]
    w = W.window_features(f, features=asked, arrival="n")
    return w.select(F.col("uid").alias("flow_uid"), *[F.col(c).cast("double").alias(c) for c in asked])


@query("metadata_join", """
    SELECT r.uid, r.experiment_id, g.traffic_generator, g.packet_count FROM runs_v r LEFT JOIN
    (SELECT experiment_id, 'gen-' || count(*) AS traffic_generator, CAST(sum(total_packets) AS BIGINT) AS packet_count
     FROM runs_v JOIN conn_v USING (uid) WHERE experiment_id <> 'exp_7' GROUP BY experiment_id) g ON g.experiment_id = r.experiment_id""")
def _(spark, d):
    rows = B.run_labels(spark, d).select("uid", "experiment_id")
    facts = rows.join(B.flows(spark, d), "uid").filter(F.col("experiment_id") != "exp_7").groupBy("experiment_id").agg(
        F.concat(F.lit("gen-"), F.count(F.lit(1))).alias("traffic_generator"), F.sum("total_packets").alias("packet_count")
    )
    return D.with_run_facts(rows, facts).select("uid", "experiment_id", "traffic_generator", "packet_count")


@query("label_dim_join", "SELECT uid, label, CAST(label_id + CASE WHEN label_id = 5 THEN 1 ELSE 0 END AS INTEGER) AS label_id FROM runs_v WHERE label_id = 5")
def _(spark, d):
    rows = B.run_labels(spark, d)
    shifted = rows.withColumn("label_id", F.when(F.col("label_id") == 5, 6).otherwise(F.col("label_id")))
    return D.label_violations(shifted, D.label_dimension(spark)).select("uid", "label", "label_id")


@query("threshold_cross", """
    SELECT t.threshold AS confidence_threshold, count(*) AS rows, count(*) FILTER (max_confidence >= t.threshold) AS accepted
    FROM arg_v, (SELECT CAST(unnest([0.0, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS DOUBLE) AS threshold) t GROUP BY t.threshold""")
def _(spark, d):
    c = E.coverage_curve(scored(spark, d))
    accepted, abstained = F.col("accepted_sample_count"), F.col("abstained_review_count")
    return c.select("confidence_threshold", (accepted + abstained).alias("rows"), accepted.alias("accepted"))


# --- aggregates ------------------------------------------------------------------------


@query("traffic_summary", """
    SELECT (SELECT count(*) FROM conn_v) AS total_connections, (SELECT count(*) FROM dns_v) AS total_dns_queries,
           (SELECT count(DISTINCT src_ip) FROM (SELECT src_ip FROM conn_v UNION SELECT src_ip FROM dns_v)) AS unique_source_ips,
           (SELECT count(DISTINCT dst_ip) FROM (SELECT dst_ip FROM conn_v UNION SELECT dst_ip FROM dns_v)) AS unique_destination_ips,
           CAST(sum(total_bytes) AS BIGINT) AS total_bytes_observed, CAST(sum(total_packets) AS BIGINT) AS total_packets_observed FROM conn_v""")
def _(spark, d):
    return FL.traffic_summary(B.flows(spark, d), B.dns(spark, d))


for _name, _column in [("protocol_counts", "protocol"), ("service_counts", "service"), ("state_counts", "conn_state")]:
    query(_name, f"SELECT {_column} AS value, count(*) AS n FROM conn_v WHERE {_column} <> '' GROUP BY 1")(
        lambda spark, d, column=_column: FL.value_counts(B.flows(spark, d), column)
    )

for _name, _column in [("class_distribution", "label"), ("experiment_distribution", "experiment_id")]:
    query(_name, f"SELECT {_column}, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM runs_v), 2) AS pct FROM runs_v GROUP BY 1")(
        lambda spark, d, column=_column: D.distribution(B.run_labels(spark, d), column)
    )

_PROFILE_SQL = f"""
    SELECT feature, round_even(min(value), 4) AS min, round_even(max(value), 4) AS max, round_even(avg(value), 4) AS mean,
           round_even(quantile_cont(value, 0.5), 4) AS median, round_even(stddev_pop(value), 4) AS std,
           count(DISTINCT value) AS unique_count, round_even(avg(CAST(value = 0 AS DOUBLE)) * 100, 2) AS zero_pct
    FROM (UNPIVOT (SELECT * EXCLUDE (flow_uid, "timestamp", source_ip, source_port, destination_ip, destination_port, protocol, connection_state)
                   FROM ({O.matrix_select(K.FEATURE_COLUMNS)})) ON COLUMNS(*) INTO NAME feature VALUE value) GROUP BY feature"""


@query("feature_profile", _PROFILE_SQL)
def _(spark, d):
    return D.feature_profile(staged(matrix(spark, d, K.FEATURE_COLUMNS)))


@query("feature_flags", f"""
    SELECT feature, unique_count = 1 AS is_constant, unique_count <> 1 AND unique_count <= 3 AND zero_pct > 95 AS is_near_constant,
           unique_count <> 1 AND zero_pct >= 90 AS is_sparse, max - min > 10000 AS is_extreme_range FROM ({_PROFILE_SQL})""")
def _(spark, d):
    return D.feature_flags(D.feature_profile(staged(matrix(spark, d, K.FEATURE_COLUMNS))))


# All 78 features; every twentieth flow comes again under another uid, so that equal vectors do occur.
_VECTOR_SQL = ", ".join(f'"{f}"' for f in K.FEATURE_COLUMNS)
_PLANTED_SQL = f"""(SELECT * FROM ({O.labelled_select(K.FEATURE_COLUMNS)}) UNION ALL BY NAME
    SELECT * REPLACE (flow_uid || '-again' AS flow_uid) FROM ({O.labelled_select(K.FEATURE_COLUMNS)}) WHERE CAST(substr(flow_uid, 2) AS BIGINT) % 20 = 0)"""


def _planted(spark: SparkSession, d: str) -> DataFrame:
    table = staged(labelled(spark, d, K.FEATURE_COLUMNS))
    again = table.filter(F.substring("flow_uid", 2, 20).cast("long") % 20 == 0)
    return table.unionByName(again.withColumn("flow_uid", F.concat("flow_uid", F.lit("-again"))))


@query("duplicate_vectors", f"""
    SELECT min(flow_uid) AS cluster_id, count(*) AS duplicate_count, count(*) - 1 AS excess_rows, count(DISTINCT experiment_id) AS experiments,
           count(DISTINCT label) AS classes FROM {_PLANTED_SQL} GROUP BY {_VECTOR_SQL} HAVING count(*) > 1""")
def _(spark, d):
    return D.duplicate_clusters(_planted(spark, d), K.FEATURE_COLUMNS).drop("_v")


@query("duplicate_members", f"""
    SELECT min(flow_uid) OVER w AS cluster_id, flow_uid, experiment_id, label, protocol, destination_endpoint
    FROM {_PLANTED_SQL} WINDOW w AS (PARTITION BY {_VECTOR_SQL}) QUALIFY count(*) OVER w > 1""")
def _(spark, d):
    return D.duplicate_members(_planted(spark, d), K.FEATURE_COLUMNS)


_AUDITED = ["missed_bytes", "has_ssl_context", "has_dns_context", "flow_duration", "orig_bytes", "resp_bytes"]


@query("run_audit", f"""
    SELECT experiment_id, count(*) AS total_flows, sum(missed_bytes) AS total_missed_bytes, count(*) FILTER (has_ssl_context = 1) AS ssl_context_flows,
           count(*) FILTER (has_dns_context = 1) AS dns_context_flows, min(flow_duration) AS duration_min, max(flow_duration) AS duration_max,
           min(orig_bytes) AS orig_bytes_min, max(orig_bytes) AS orig_bytes_max, min(resp_bytes) AS resp_bytes_min, max(resp_bytes) AS resp_bytes_max
    FROM ({O.labelled_select(_AUDITED)}) GROUP BY 1""")
def _(spark, d):
    return AU.run_audit(labelled(spark, d, _AUDITED))


for _name, _column in [("run_protocol_distribution", "protocol"), ("run_state_distribution", "connection_state"), ("run_port_distribution", "destination_port")]:
    query(_name, f"SELECT experiment_id, CAST({_column} AS VARCHAR) AS value, count(*) AS n FROM ({O.labelled_select([])}) GROUP BY 1, 2")(
        lambda spark, d, column=_column: AU.run_distribution(labelled(spark, d, []), column)
    )


_RECON = K.FLOW_FEATURES[12:15] + ["win_src_unique_dst_ports_60s"]


@query("recon_audit", f"""
    SELECT experiment_id, count(DISTINCT destination_port) AS scanned_ports_count, count(*) FILTER (is_well_known_dst_port = 1) AS well_known,
           count(*) FILTER (is_registered_dst_port = 1) AS registered, count(*) FILTER (is_dynamic_dst_port = 1) AS dynamic,
           max(win_src_unique_dst_ports_60s) AS max_unique_dst_ports_60s FROM ({O.labelled_select(_RECON)}) GROUP BY 1""")
def _(spark, d):
    return AU.recon_audit(labelled(spark, d, _RECON))


@query("dns_audit", f"""
    SELECT experiment_id, count(*) AS dns_flows_total, round_even(avg(dns_query_len), 2) AS mean_query_len, max(dns_query_len) AS max_query_len,
           round_even(avg(dns_query_entropy), 4) AS mean_entropy, max(dns_query_entropy) AS max_entropy,
           round_even(avg(dns_subdomain_depth), 2) AS mean_depth, max(dns_subdomain_depth) AS max_depth,
           round_even(avg(dns_max_label_len), 2) AS mean_max_label_len, round_even(avg(dns_numeric_ratio), 4) AS mean_numeric_ratio,
           round_even(avg(dns_vowel_ratio), 4) AS mean_vowel_ratio, count(*) FILTER ("dns_qtype_is_A" = 1) AS qtype_a_count,
           count(*) FILTER ("dns_qtype_is_TXT" = 1) AS qtype_txt_count, count(*) FILTER (dns_is_nxdomain = 1) AS nxdomain_count
    FROM ({O.labelled_select(K.DNS_FEATURES)}) WHERE has_dns_context = 1 GROUP BY 1""")
def _(spark, d):
    return AU.dns_audit(labelled(spark, d, K.DNS_FEATURES))


@query("dns_answer_histogram", f"""SELECT experiment_id, CAST(dns_answer_count AS BIGINT) AS answers, count(*) AS n
    FROM ({O.labelled_select(K.DNS_FEATURES)}) WHERE has_dns_context = 1 GROUP BY 1, 2""")
def _(spark, d):
    return AU.answer_histogram(labelled(spark, d, K.DNS_FEATURES))


@query("tls_audit", f"""
    SELECT experiment_id, count(*) AS ssl_flows_total, min(ssl_sni_len) AS sni_len_min, max(ssl_sni_len) AS sni_len_max,
           min(ssl_sni_entropy) AS sni_entropy_min, max(ssl_sni_entropy) AS sni_entropy_max,
           count(*) FILTER (ssl_is_outdated_version = 1) AS outdated_version_count, count(*) FILTER (ssl_is_self_signed = 1) AS self_signed_count,
           count(*) FILTER (ssl_has_ja3_fingerprint = 1) AS ja3_count, count(*) FILTER (ssl_resumed_flag = 1) AS resumed_count
    FROM ({O.labelled_select(K.SSL_FEATURES)}) WHERE has_ssl_context = 1 GROUP BY 1""")
def _(spark, d):
    return AU.tls_audit(labelled(spark, d, K.SSL_FEATURES))


_SLOW = ["flow_duration", "orig_bytes", "resp_bytes", "total_packets"]


@query("slow_http_audit", f"""
    SELECT experiment_id, round_even(avg(flow_duration), 4) AS mean_duration_seconds, round_even(avg(orig_bytes), 2) AS mean_orig_bytes,
           round_even(avg(resp_bytes), 2) AS mean_resp_bytes, round_even(avg(total_packets), 2) AS mean_packets_per_flow
    FROM ({O.labelled_select(_SLOW)}) GROUP BY 1""")
def _(spark, d):
    return AU.slow_http_audit(labelled(spark, d, _SLOW))


@query("interval_stats", """
    SELECT src_ip, dst_ip, dst_port, n AS count, round_even(m, 4) AS mean_interval_seconds, round_even(lo, 4) AS min_interval_seconds,
           round_even(hi, 4) AS max_interval_seconds, round_even(s, 4) AS std_interval_seconds,
           round_even(s / (m + CAST(1e-6 AS DOUBLE)), 4) AS cv_interval
    FROM (SELECT src_ip, dst_ip, dst_port, count(*) AS n, avg(g) AS m, min(g) AS lo, max(g) AS hi, stddev_pop(g) AS s
          FROM (SELECT src_ip, dst_ip, dst_port, ts - lag(ts) OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY ts) AS g FROM conn_v)
          GROUP BY ALL HAVING count(*) > 1)""")
def _(spark, d):
    return AU.interval_stats(B.flows(spark, d), ["src_ip", "dst_ip", "dst_port"])


@query("weird_events", "SELECT experiment_id, name AS event, count(*) AS n FROM weird_v JOIN runs_v USING (uid) GROUP BY 1, 2")
def _(spark, d):
    return AU.weird_events(B.weird(spark, d), B.run_labels(spark, d))


_OUTCOME = "CASE WHEN abstained THEN 'review' WHEN predicted_label = 'BENIGN' THEN 'benign' ELSE 'threat' END"
_CLASS_COUNTS = ", ".join(f"count(*) FILTER (predicted_label = '{c}') AS n_{c.lower()}" for c in K.ACTIVE_CLASSES)


@query("alert_metrics", f"""
    SELECT count(*) AS total_flows, count(*) FILTER (o = 'threat') AS total_threats, count(*) FILTER (o = 'benign') AS benign_count,
           count(*) FILTER (o = 'review') AS analyst_review_count, {_CLASS_COUNTS},
           round_even(avg(processing_time_ms), 3) AS average_inference_latency_ms,
           round_even(quantile_cont(processing_time_ms, 0.95), 3) AS p95_latency_ms
    FROM (SELECT *, {_OUTCOME} AS o FROM alert_v)""")
def _(spark, d):
    return AL.alert_metrics(alerts(spark, d))


@query("alert_class_counts", "SELECT predicted_label, count(*) AS n FROM alert_v GROUP BY 1")
def _(spark, d):
    return AL.class_counts(alerts(spark, d))


@query("latency_profile", """
    SELECT experiment_id, count(*) AS flows, round_even(avg(processing_time_ms), 3) AS mean_latency_ms,
           round_even(quantile_cont(processing_time_ms, 0.5), 3) AS p50_latency_ms, round_even(quantile_cont(processing_time_ms, 0.95), 3) AS p95_latency_ms,
           round_even(quantile_cont(processing_time_ms, 0.99), 3) AS p99_latency_ms, round_even(max(processing_time_ms), 3) AS max_latency_ms
    FROM alert_v GROUP BY 1""")
def _(spark, d):
    return AL.latency_profile(alerts(spark, d))


@query("replay_benchmark", """
    SELECT experiment_id, count(*) AS flows_count, count(*) FILTER (NOT abstained AND predicted_label <> 'BENIGN') AS threats_detected,
           count(*) FILTER (NOT abstained AND predicted_label = 'BENIGN') AS benign_detected, count(*) FILTER (abstained) AS analyst_reviews,
           CAST(0 AS BIGINT) AS inference_errors FROM alert_v GROUP BY ROLLUP (experiment_id)""")
def _(spark, d):
    return AL.replay_benchmark(alerts(spark, d))


@query("protocol_share", """SELECT upper(protocol) AS protocol, count(*) AS n,
    round_even(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM alert_v), 2) AS pct FROM alert_v GROUP BY 1""")
def _(spark, d):
    return AL.protocol_share(alerts(spark, d))


@query("threat_ratio", f"""SELECT count(*) AS total, count(*) FILTER (o = 'threat') AS threats,
    round_even(count(*) FILTER (o = 'threat') * 100.0::DOUBLE / count(*), 1) AS threat_pct FROM (SELECT {_OUTCOME} AS o FROM alert_v)""")
def _(spark, d):
    return AL.threat_ratio(alerts(spark, d))


@query("activity_timeline", f"""
    SELECT bucket, count(*) FILTER (o = 'threat') AS threats, count(*) FILTER (o = 'benign') AS benign, count(*) FILTER (o = 'review') AS reviews
    FROM (SELECT o, CAST(least(13, (row_number() OVER (ORDER BY "timestamp", alert_id) - 1) // 10) AS INTEGER) AS bucket
          FROM (SELECT "timestamp", alert_id, {_OUTCOME} AS o FROM alert_v ORDER BY "timestamp" DESC, alert_id DESC LIMIT 140)) GROUP BY 1""")
def _(spark, d):
    return AL.activity_timeline(alerts(spark, d))


@query("session_counters", f"""SELECT count(*) AS flows, count(*) FILTER (NOT abstained AND predicted_label <> 'BENIGN') AS threats,
    count(*) FILTER (abstained) AS reviews, {_CLASS_COUNTS} FROM alert_v""")
def _(spark, d):
    return AL.session_counters(alerts(spark, d))


@query("banner_summary", """
    SELECT count(*) AS flagged, count(*) FILTER (NOT abstained) AS confirmed, count(*) FILTER (abstained) AS under_review,
           arg_max(alert_id, "timestamp") AS latest_flagged FROM alert_v WHERE predicted_label <> 'BENIGN' OR abstained""")
def _(spark, d):
    return AL.banner_summary(alerts(spark, d))


# --- evaluation ------------------------------------------------------------------------

_CLASS_LIST = "(SELECT unnest(['BENIGN', 'DDOS', 'RECON', 'DNS_TUNNEL', 'C2_BEACON', 'SLOW_HTTP']) AS class_name)"
_SCORES = """
    SELECT {by} class_name, support, tp, pred - tp AS fp, support - tp AS fn, CASE WHEN pred > 0 THEN tp / CAST(pred AS DOUBLE) ELSE 0 END AS pr,
           CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END AS rc
    FROM (SELECT {by} class_name, count(*) FILTER (label = class_name) AS support, count(*) FILTER (prediction = class_name) AS pred,
                 count(*) FILTER (label = class_name AND prediction = class_name) AS tp
          FROM ({rows}), """ + _CLASS_LIST + """ GROUP BY {by} class_name) WHERE support + pred > 0"""
_F1 = "CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END"
_ARG_SCORES = _SCORES.format(by="", rows="SELECT label, prediction FROM arg_v")


@query("confusion_matrix", "SELECT class_name AS label, " + ", ".join(
    f"count(*) FILTER (prediction = '{c}') AS pred_{c.lower()}" for c in K.ACTIVE_CLASSES) + f" FROM {_CLASS_LIST} LEFT JOIN arg_v ON label = class_name GROUP BY 1")
def _(spark, d):
    return E.confusion_matrix(scored(spark, d))


@query("per_class_metrics", f"""
    SELECT class_name, CAST([0, 1, 2, 4, 5, 7][list_position(['BENIGN', 'DDOS', 'RECON', 'DNS_TUNNEL', 'C2_BEACON', 'SLOW_HTTP'], class_name)] AS INTEGER) AS class_id,
           support AS test_support, tp AS true_positives, fp AS false_positives, fn AS false_negatives,
           round_even(pr, 4) AS precision, round_even(rc, 4) AS recall, round_even({_F1}, 4) AS f1_score FROM ({_ARG_SCORES})""")
def _(spark, d):
    return E.per_class_metrics(scored(spark, d))


@query("macro_metrics", f"""
    SELECT round_even(avg(pr), 4) AS macro_precision, round_even(avg(rc), 4) AS macro_recall, round_even(avg({_F1}), 4) AS macro_f1,
           round_even(sum({_F1} * support) / sum(support), 4) AS weighted_f1, round_even(avg(rc) FILTER (support > 0), 4) AS balanced_accuracy
    FROM ({_ARG_SCORES})""")
def _(spark, d):
    return E.macro_metrics(scored(spark, d))


_TRUTH = "list_position(['BENIGN', 'DDOS', 'RECON', 'DNS_TUNNEL', 'C2_BEACON', 'SLOW_HTTP'], label)"
_OVR = f"(SELECT unnest(p) AS p, unnest(range(1, 7)) AS pos, {_TRUTH} AS truth FROM pred_v)"


@query("log_loss", f"SELECT round_even(avg(-ln(p[{_TRUTH}])), 4) AS log_loss FROM pred_v")
def _(spark, d):
    return E.log_loss(B.predictions(spark, d))


@query("brier_mean", f"SELECT round_even(avg(b), 4) AS mean_brier_score FROM (SELECT pos, avg(pow(CAST(pos = truth AS DOUBLE) - p, 2)) AS b FROM {_OVR} GROUP BY pos)")
def _(spark, d):
    return E.brier_mean(B.predictions(spark, d))


@query("reliability_curve", f"""SELECT CAST(least(9, floor(p * 10)) AS INTEGER) AS bin, count(*) AS n, round_even(avg(p), 4) AS mean_predicted,
    round_even(avg(CAST(pos = truth AS DOUBLE)), 4) AS fraction_positive FROM {_OVR} GROUP BY 1""")
def _(spark, d):
    return E.reliability_curve(B.predictions(spark, d))


_CONF = """round_even(coalesce(avg(max_confidence), 0), 4) AS {0}, round_even(coalesce(avg(max_confidence) FILTER (is_correct), 0), 4) AS {1},
    round_even(coalesce(avg(max_confidence) FILTER (NOT is_correct), 0), 4) AS {2}"""


@query("per_experiment_accuracy", f"""
    SELECT experiment_id, count(*) AS test_flows, count(*) FILTER (is_correct) AS correct_predictions, count(*) FILTER (NOT is_correct) AS incorrect_predictions,
           round_even(avg(CAST(is_correct AS DOUBLE)), 4) AS accuracy, {_CONF.format('mean_confidence', 'correct_confidence', 'incorrect_confidence')}
    FROM arg_v GROUP BY 1""")
def _(spark, d):
    return E.per_experiment_accuracy(scored(spark, d))


@query("confidence_by_class", f"""
    SELECT label AS class_name, count(*) AS total_test_count, count(*) FILTER (is_correct) AS correct_count, count(*) FILTER (NOT is_correct) AS incorrect_count,
           {_CONF.format('overall_confidence', 'correct_confidence', 'incorrect_confidence')} FROM arg_v GROUP BY 1""")
def _(spark, d):
    return E.confidence_by_class(scored(spark, d))


@query("confidence_summary", f"""
    SELECT count(*) AS overall_test_samples, count(*) FILTER (is_correct) AS correct_samples, count(*) FILTER (NOT is_correct) AS incorrect_samples,
           {_CONF.format('overall_mean_confidence', 'correct_mean_confidence', 'incorrect_mean_confidence')},
           count(*) FILTER (NOT is_correct AND max_confidence > 0.9::DOUBLE) AS high_confidence_errors_count FROM arg_v""")
def _(spark, d):
    return E.confidence_summary(scored(spark, d))


@query("coverage_curve", """
    SELECT threshold AS confidence_threshold, round_even(a / CAST(n AS DOUBLE) * 100, 2) AS coverage_percentage, a AS accepted_sample_count,
           n - a AS abstained_review_count, round_even(CASE WHEN a > 0 THEN ok / CAST(a AS DOUBLE) * 100 ELSE 0 END, 2) AS accepted_accuracy_pct,
           round_even(CASE WHEN a > 0 THEN 100 - ok / CAST(a AS DOUBLE) * 100 ELSE 0 END, 2) AS accepted_error_rate_pct
    FROM (SELECT threshold, count(*) AS n, count(*) FILTER (max_confidence >= threshold) AS a, count(*) FILTER (max_confidence >= threshold AND is_correct) AS ok
          FROM arg_v, (SELECT CAST(unnest([0.0, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS DOUBLE) AS threshold) GROUP BY threshold)""")
def _(spark, d):
    return E.coverage_curve(scored(spark, d))


_SWEPT = _SCORES.format(by="r, t,", rows="""
    SELECT r, t, label, CASE WHEN p[4] >= t AND p[4] >= p[3] THEN 'DNS_TUNNEL' WHEN p[3] >= r THEN 'RECON' ELSE prediction END AS prediction
    FROM arg_v, (SELECT CAST(unnest([0.5, 0.35, 0.25]) AS DOUBLE) AS r), (SELECT CAST(unnest([0.5, 0.35, 0.25]) AS DOUBLE) AS t)""")
_FOCUS = ", ".join(f"round_even(coalesce(max({m}) FILTER (class_name = '{c}'), 0), 4) AS {c.lower()}_{n}"
                   for c in ("RECON", "DNS_TUNNEL") for m, n in (("rc", "recall"), ("pr", "precision")))


@query("threshold_grid", f"""
    SELECT r AS recon_threshold, t AS dns_tunnel_threshold, round_even(avg({_F1}), 4) AS macro_f1, round_even(avg(rc), 4) AS macro_recall,
           round_even(avg(rc) FILTER (support > 0), 4) AS balanced_accuracy, {_FOCUS} FROM ({_SWEPT}) GROUP BY r, t""")
def _(spark, d):
    return E.threshold_grid(B.predictions(spark, d))


@query("decision_policy", "SELECT uid, predicted_class_id, predicted_label, confidence, abstained, decision FROM verdict_v")
def _(spark, d):
    return B.predictions(spark, d).select("uid", P.verdict(F.col("probs")).alias("v")).select(
        "uid", "v.predicted_class_id", "v.predicted_label", "v.confidence", "v.abstained", "v.decision"
    )


@query("class_threshold_rule", """SELECT uid, CASE WHEN p[4] >= 0.25::DOUBLE AND p[4] >= p[3] THEN 'DNS_TUNNEL' WHEN p[3] >= 0.25::DOUBLE THEN 'RECON'
    ELSE prediction END AS prediction FROM arg_v""")
def _(spark, d):
    rule = P.swept_label(F.col("probs"), F.lit(0.25), F.lit(0.25))
    return B.predictions(spark, d).select("uid", rule.alias("prediction"))


@query("importance_stability", """
    SELECT feature, round_even(avg(v), 5) AS mean_importance_across_seeds, round_even(stddev_pop(v), 5) AS std_importance_across_seeds,
           round_even(min(v), 5) AS min_importance, round_even(max(v), 5) AS max_importance
    FROM (SELECT label AS feature, avg(max_p) AS v FROM pred_v GROUP BY label, experiment_id) GROUP BY 1""")
def _(spark, d):
    per_seed = scored(spark, d).groupBy(F.col("label").alias("feature"), F.col("experiment_id").alias("seed"))
    return E.importance_stability(per_seed.agg(F.avg("max_confidence").alias("importance")))


# --- sorts, limits, splits ---------------------------------------------------------------


@query("chronological", 'SELECT uid, ts FROM conn_v ORDER BY ts, uid')
def _(spark, d):
    return B.flows(spark, d).select("uid", "ts").orderBy("ts", "uid")


_NEWEST = 'ORDER BY "timestamp" DESC, alert_id DESC'


@query("alerts_page", f"""SELECT {_ALERT_SQL}, (SELECT count(*) FROM alert_v WHERE predicted_label = 'DDOS') AS total
    FROM alert_v WHERE predicted_label = 'DDOS' {_NEWEST} LIMIT 50 OFFSET 20""")
def _(spark, d):
    return plain(AL.alerts_page(alerts(spark, d), 20, 50, "DDOS"))


@query("recent_alerts", f"SELECT {_ALERT_SQL} FROM alert_v {_NEWEST} LIMIT 100")
def _(spark, d):
    return plain(AL.recent_alerts(alerts(spark, d), 100))


@query("bounded_store", f"SELECT {_ALERT_SQL} FROM alert_v {_NEWEST} LIMIT 2000")
def _(spark, d):
    return plain(AL.bounded_store(alerts(spark, d)))


@query("alert_export", f"""
    SELECT alert_id, timestamp_iso, flow_uid, source_ip, source_port, destination_ip, destination_port, protocol, predicted_label,
           round_even(confidence, 4) AS confidence, decision, abstained, round_even(processing_time_ms, 2) AS processing_time_ms
    FROM alert_v WHERE decision = 'ANALYST_REVIEW' {_NEWEST} LIMIT 500""")
def _(spark, d):
    return AL.alert_export(alerts(spark, d), 500, decision="ANALYST_REVIEW")


@query("top_features", """SELECT label || '/' || experiment_id AS feature, round_even(avg(max_p), 9) AS importance FROM pred_v GROUP BY 1
    ORDER BY importance DESC, feature LIMIT 10""")
def _(spark, d):
    g = scored(spark, d).groupBy(F.concat_ws("/", "label", "experiment_id").alias("feature"))
    return E.top_features(g.agg(S.round_half_even(F.avg("max_confidence"), 9).alias("importance")))


@query("top_probabilities", f"""
    SELECT alert_id, rank, class_name, probability FROM
    (SELECT alert_id, class_name, probability, CAST(row_number() OVER (PARTITION BY alert_id ORDER BY probability DESC, pos) AS INTEGER) AS rank
     FROM (SELECT alert_id, unnest(['BENIGN', 'DDOS', 'RECON', 'DNS_TUNNEL', 'C2_BEACON', 'SLOW_HTTP']) AS class_name,
                  unnest([round_even(x, 4) for x in p]) AS probability, unnest(range(6)) AS pos FROM alert_v)) WHERE rank <= 4""")
def _(spark, d):
    return AL.top_probabilities(alerts(spark, d))


@query("first_alert_per_run", f"""SELECT {_ALERT_SQL} FROM alert_v
    QUALIFY row_number() OVER (PARTITION BY experiment_id ORDER BY "timestamp", alert_id) = 1""")
def _(spark, d):
    return plain(AL.first_alert_per_run(alerts(spark, d)))


@query("sample_by_label", f"""SELECT {_ALERT_SQL}, CAST(row_number() OVER (PARTITION BY experiment_id ORDER BY "timestamp", alert_id) AS INTEGER) AS rank
    FROM alert_v WHERE predicted_label = 'SLOW_HTTP' QUALIFY rank <= 5""")
def _(spark, d):
    return plain(AL.sample_by_label(alerts(spark, d), "slow_http", 5))


def _split_rows(spark: SparkSession, d: str) -> DataFrame:
    runs = B.run_labels(spark, d)
    f = B.flows(spark, d).select("uid", "ts").join(runs, "uid")
    return f.select(F.col("uid").alias("flow_uid"), F.col("ts").alias("timestamp"), "experiment_id", "label")


def _split(spark: SparkSession, d: str) -> DataFrame:
    return D.holdout_split(_split_rows(spark, d), B.BOUND_TRAIN_RUNS, B.BOUND_TEST_RUNS)


_SPLIT_SQL = """
    SELECT uid AS flow_uid, ts AS "timestamp", experiment_id, label,
           CASE WHEN experiment_id IN ('exp_0', 'exp_1', 'exp_2') THEN 'train' WHEN experiment_id IN ('exp_3', 'exp_4') THEN 'test'
                WHEN rn <= round_even(0.7::DOUBLE * n, 0) THEN 'train' ELSE 'test' END AS part,
           CASE WHEN experiment_id IN ('exp_0', 'exp_1', 'exp_2') THEN 'train_holdout' WHEN experiment_id = 'exp_3' THEN 'test_holdout_unseen_experiment'
                WHEN experiment_id = 'exp_4' THEN 'test_holdout_unseen_modality' ELSE 'chronological_70_30' END AS partition
    FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY ts, uid) AS rn, count(*) OVER (PARTITION BY experiment_id) AS n
          FROM conn_v JOIN runs_v USING (uid))"""


@query("holdout_split", _SPLIT_SQL)
def _(spark, d):
    return _split(spark, d)


@query("zero_variance_columns", f"""
    SELECT feature FROM (UNPIVOT (SELECT {_VECTOR_SQL} FROM ({O.labelled_select(K.FEATURE_COLUMNS)}) JOIN (SELECT flow_uid, part FROM ({_SPLIT_SQL})) USING (flow_uid)
                                  WHERE part = 'train') ON COLUMNS(*) INTO NAME feature VALUE value)
    GROUP BY feature HAVING count(DISTINCT value) <= 1""")
def _(spark, d):
    table = staged(labelled(spark, d, K.FEATURE_COLUMNS))  # the split reads it twice
    split = D.holdout_split(table, B.BOUND_TRAIN_RUNS, B.BOUND_TEST_RUNS)
    return D.zero_variance_columns(split.filter(F.col("part") == "train"))


@query("split_manifest", f"""SELECT experiment_id, partition, count(*) FILTER (part = 'train') AS train_count, count(*) FILTER (part = 'test') AS test_count,
    count(*) AS total_count FROM ({_SPLIT_SQL}) GROUP BY 1, 2""")
def _(spark, d):
    return D.split_manifest(_split(spark, d))


@query("validation_split", f"""
    SELECT * EXCLUDE (rn, n), CASE WHEN experiment_id IN ('exp_0', 'exp_1') THEN 'sub_train' WHEN experiment_id = 'exp_2' THEN 'validation'
           WHEN rn <= round_even(0.7::DOUBLE * n, 0) THEN 'sub_train' ELSE 'validation' END AS inner_part
    FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY "timestamp", flow_uid) AS rn, count(*) OVER (PARTITION BY experiment_id) AS n
          FROM ({_SPLIT_SQL}) WHERE part = 'train')""")
def _(spark, d):
    return D.validation_split(_split(spark, d), ["exp_0", "exp_1"], B.BOUND_VALIDATION_RUNS)


_CAUSAL = K.WINDOW_FEATURES


@query("causality_check", """SELECT count(*) AS rows_checked, CAST(0 AS BIGINT) AS rows_changed FROM conn_v
    WHERE ts <= (SELECT (min(ts) + max(ts)) / 2 FROM conn_v)""")
def _(spark, d):
    f = B.flows(spark, d)
    middle = f.agg((F.min("ts") + F.max("ts")) / 2).scalar()
    past = f.filter(F.col("ts") <= middle)
    others = [B.dns(spark, d), B.weird(spark, d)]
    full = W.window_features(f, *others, features=_CAUSAL).filter(F.col("ts") <= middle).select("uid", *_CAUSAL)
    earlier = [x.filter(F.col("ts") <= middle) for x in others]
    cut = W.window_features(past, *earlier, features=_CAUSAL).select("uid", *[F.col(c).alias(f"cut_{c}") for c in _CAUSAL])
    same = F.lit(True)
    for c in _CAUSAL:
        same = same & F.col(c).eqNullSafe(F.col(f"cut_{c}"))
    return full.join(cut, "uid", "full").agg(F.count(F.lit(1)).alias("rows_checked"), F.count_if(~same).alias("rows_changed"))


@query("row_id", """SELECT uid AS flow_uid, experiment_id, row_number() OVER (ORDER BY experiment_id, ts, uid) AS master_row_id
    FROM conn_v JOIN runs_v USING (uid)""")
def _(spark, d):
    return D.with_row_id(_split_rows(spark, d)).select("flow_uid", "experiment_id", "master_row_id")


# --- set operations ------------------------------------------------------------------------


@query("host_union", "SELECT src_ip FROM conn_v UNION SELECT src_ip FROM dns_v")
def _(spark, d):
    return FL.hosts(B.flows(spark, d), B.dns(spark, d), "src_ip")


@query("concat_experiments", "SELECT uid, experiment_id, label FROM runs_v")
def _(spark, d):
    runs = B.run_labels(spark, d).select("uid", "experiment_id", "label")
    return staged(runs, by=["experiment_id"])  # a folder for each experiment, read as one table


@query("contract_differences", """SELECT DISTINCT lower(event_type) AS name FROM events EXCEPT SELECT unnest(['click', 'view'])""")
def _(spark, d):
    got = B.table(spark, d, "events").select(F.lower("event_type").alias("name")).distinct()
    expected = spark.range(1).select(F.explode(F.array(F.lit("click"), F.lit("view"))).alias("name"))
    return got.exceptAll(expected)


# A feature table that lacks two columns of the contract and has one of its own.
@query("contract_columns", """SELECT 'missed_bytes' AS name, 'missing' AS problem, CAST(0 AS BIGINT) AS n, true AS rejected UNION ALL SELECT 'quic_sni_len', 'missing', 0, true
    UNION ALL SELECT 'orig_bytes_log', 'unexpected', count(*), true FROM conn_v""")
def _(spark, d):
    table = matrix(spark, d, K.FEATURE_COLUMNS).drop("missed_bytes", "quic_sni_len").withColumn("orig_bytes_log", F.log1p("orig_bytes"))
    try:
        A.check_columns([c for c in table.columns if c not in A.IDENTITY])
        rejected = False
    except A.ContractViolation:
        rejected = True
    return A.column_differences(table).withColumn("rejected", F.lit(rejected))


@query("split_quality", f"""SELECT count(*) FILTER (part = 'train') AS train_rows, count(*) FILTER (part = 'test') AS test_rows,
    CAST(0 AS BIGINT) AS in_both, CAST(0 AS BIGINT) AS in_neither FROM ({_SPLIT_SQL})""")
def _(spark, d):
    return D.split_quality(_split_rows(spark, d), _split(spark, d))


# --- alert state -------------------------------------------------------------------------------

_VERSIONED = """SELECT *, CAST(0 AS BIGINT) AS version FROM alert_v
    UNION ALL BY NAME SELECT * REPLACE ('C2_BEACON' AS predicted_label), CAST(1 AS BIGINT) AS version FROM alert_v WHERE event_id % 5 = 0"""


@query("alert_upsert", f"SELECT {_ALERT_SQL}, version FROM ({_VERSIONED}) QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY version DESC) = 1")
def _(spark, d):
    a = plain(alerts(spark, d)).withColumn("version", F.lit(0).cast("long"))
    again = a.filter(F.substring("flow_uid", 2, 20).cast("long") % 5 == 0)
    again = again.withColumn("predicted_label", F.lit("C2_BEACON")).withColumn("version", F.lit(1).cast("long"))
    return TR.current_alerts(a.unionByName(again))


_TRIAGED = f"""
    SELECT * REPLACE (coalesce(n, decision) AS decision, CASE WHEN n IS NOT NULL AND n <> decision THEN n = 'ANALYST_REVIEW' ELSE abstained END AS abstained)
    FROM alert_v LEFT JOIN (SELECT alert_id, arg_max(decision, decided_at) AS n FROM ({_DECISIONS_SQL}) GROUP BY 1) USING (alert_id)"""


@query("triage_update", f"SELECT {_ALERT_SQL} FROM ({_TRIAGED})")
def _(spark, d):
    return plain(TR.apply_triage(alerts(spark, d), decisions(spark, d)))


@query("triage_audit", f"""
    SELECT alert_id, decided_at AS "timestamp", old_decision, new_decision, notes
    FROM (SELECT x.alert_id, decided_at, notes, x.decision AS new_decision,
                 coalesce(lag(x.decision) OVER (PARTITION BY x.alert_id ORDER BY decided_at), a.decision) AS old_decision
          FROM ({_DECISIONS_SQL}) x JOIN alert_v a ON a.alert_id = x.alert_id) WHERE old_decision <> new_decision""")
def _(spark, d):
    return TR.triage_audit(alerts(spark, d), decisions(spark, d))


@query("batch_triage", f"""SELECT CASE WHEN predicted_label = 'RECON' THEN 'FALSE_POSITIVE' ELSE decision END AS decision, count(*) AS n FROM alert_v GROUP BY 1""")
def _(spark, d):
    a = alerts(spark, d)
    ids = a.filter(F.col("predicted_label") == "RECON").select("alert_id")
    many = TR.batch_decisions(ids, "FALSE_POSITIVE", F.lit(0.0))
    return TR.apply_triage(a, many).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query("counters_after_triage", f"""
    SELECT count(*) AS total_flows,
           count(*) FILTER (NOT r AND NOT b) AS total_threats, count(*) FILTER (NOT r AND b) AS benign_count, count(*) FILTER (r) AS analyst_review_count,
           {_CLASS_COUNTS}, round_even(avg(processing_time_ms), 3) AS average_inference_latency_ms,
           round_even(quantile_cont(processing_time_ms, 0.95), 3) AS p95_latency_ms
    FROM (SELECT *, abstained OR decision = 'ANALYST_REVIEW' AS r, predicted_label = 'BENIGN' OR decision = 'FALSE_POSITIVE' AS b FROM ({_TRIAGED}))""")
def _(spark, d):
    return AL.alert_metrics(TR.apply_triage(alerts(spark, d), decisions(spark, d)))


@query("alert_ingest", """
    SELECT CASE event_id % 10 WHEN 0 THEN 'port_out_of_range' WHEN 1 THEN 'confidence_out_of_range' WHEN 2 THEN 'negative_latency'
           WHEN 3 THEN 'missing_or_malformed_field' ELSE 'valid' END AS verdict, count(*) AS n FROM alert_v GROUP BY 1""")
def _(spark, d):
    kind = F.substring("flow_uid", 2, 20).cast("long") % 10
    a = alerts(spark, d).withColumn("kind", kind)
    a = (
        a.withColumn("source_port", F.when(F.col("kind") == 0, 70000).otherwise(F.col("source_port")))
        .withColumn("confidence", F.when(F.col("kind") == 1, 1.5).otherwise(F.col("confidence")))
        .withColumn("processing_time_ms", F.when(F.col("kind") == 2, -1.0).otherwise(F.col("processing_time_ms")))
        .withColumn("decision", F.when(F.col("kind") != 3, F.col("decision")))
    )
    valid, rejected = TR.parse_payloads(a.select(F.to_json(F.struct(*K.ALERT_COLUMNS)).alias("payload")))
    both = valid.select(F.lit("valid").alias("verdict")).unionByName(rejected.select(F.col("reason").alias("verdict")))
    return both.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))

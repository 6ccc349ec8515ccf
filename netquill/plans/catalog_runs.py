"""Registered queries that write, stream or train: log text, live detection and models."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquill import contract as K
from netquill.operators import alert_pages as PG
from netquill.operators import alerts as AL
from netquill.operators import assemble as A
from netquill.operators import dataset as D
from netquill.operators import evaluate as E
from netquill.operators import flows as FL
from netquill.operators import models as M
from netquill.operators import policy as P
from netquill.plans import oracle as O
from netquill.plans import staged_logs as L
from netquill.plans.catalog import _ALERT_SQL, _OUTCOME, alerts, labelled, plain, query
from netquill.sources import bindings as B
from netquill.sources import tables as T
from netquill.sources import zeek as Z
from netquill.sources.stage import released, staged
from netquill.streaming.live import LiveDetector, running_telemetry
from netquill.streaming.typed import flows_stream, without_repeats

# --- log text ----------------------------------------------------------------------------

_FLOW_SQL = """SELECT ts, uid, src_ip, src_port, dst_ip, dst_port, protocol, service, duration, orig_bytes, resp_bytes, total_bytes, orig_packets,
    resp_packets, total_packets, bytes_per_packet, missed_bytes, conn_state, history FROM conn_v"""


@query("zeek_scan", _FLOW_SQL)
def _(spark, d):
    folder = L.write_logs(spark, d, ("conn",))
    return FL.flatten(FL.normalize_conn(Z.zeek_scan(spark, f"{folder}/conn.log")))


@query("zeek_dir_scan", """
    SELECT 'conn' AS kind, count(*) AS n FROM conn_v UNION ALL SELECT 'dns', count(*) FROM dns_v UNION ALL SELECT 'weird', count(*) FROM weird_v
    UNION ALL SELECT 'ssl', count(*) FROM ssl_v UNION ALL SELECT 'quic', count(*) FROM quic_v UNION ALL SELECT 'http', count(*) FROM pages
    UNION ALL SELECT 'files', count(*) FROM orders UNION ALL SELECT 'x509', count(*) FROM customer
    UNION ALL SELECT 'ntp', count(*) FROM events WHERE event_id % 3 = 0""")
def _(spark, d):
    return Z.record_counts(Z.zeek_dir_scan(spark, L.write_logs(spark, d, tuple(K.LOG_KINDS))))


@query("malformed_rows", """SELECT 'field_count' AS reason, count(*) AS n FROM events WHERE event_id % 10 = 0
    UNION ALL SELECT 'no_header', count(*) FROM events WHERE event_id % 25 = 0""")
def _(spark, d):
    folder = L.write_spoiled_conn(spark, d)
    placed = Z.with_place(Z.located(spark.read.text(f"{folder}/conn.log")))
    return Z.malformed_counts(placed).groupBy("reason").agg(F.sum("n").alias("n"))


_LABELLED = ["flow_duration", "total_bytes", "history_len"]


@query("features_jsonl", f"""SELECT flow_uid, experiment_id, label, label_id, "timestamp", source_endpoint, destination_endpoint, protocol, connection_state,
    flow_duration, total_bytes, history_len FROM ({O.labelled_select(_LABELLED)})""")
def _(spark, d):
    full = A.assemble_defaults(A.feature_matrix(B.logs(spark, d)))
    path = L.scratch(spark, "features")
    T.write_features_jsonl(D.labelled_rows(full, B.run_labels(spark, d)), path)
    back = D.wide(T.read_features_jsonl(spark, path))
    return back.select("flow_uid", "experiment_id", "label", "label_id", "timestamp", "source_endpoint", "destination_endpoint",
                       "protocol", "connection_state", *_LABELLED)


@query("master_table", """SELECT row_number() OVER (ORDER BY experiment_id, ts, uid) AS master_row_id, uid AS flow_uid, label,
    'runs/' || label || '/' || experiment_id AS source_dir, CAST(90 AS INTEGER) AS n_columns, CAST(total_bytes AS DOUBLE) AS total_bytes
    FROM conn_v JOIN runs_v USING (uid)""")
def _(spark, d):
    full = A.assemble_defaults(A.feature_matrix(B.logs(spark, d)))
    path = L.scratch(spark, "master")
    rows = staged(D.labelled_rows(full, B.run_labels(spark, d)))  # the numbers read it twice
    placed = staged(D.with_row_id(rows))
    released(rows)
    T.write_master(placed, path, source_dir="runs")
    back = spark.read.parquet(f"{path}/parquet")
    return back.select("master_row_id", "flow_uid", "label", "source_dir", F.lit(len(back.columns)).alias("n_columns"), "total_bytes")


@query("alert_table", f"SELECT {_ALERT_SQL} FROM alert_v WHERE timestamp_iso >= '1970-01-14T16:55'")
def _(spark, d):
    path = L.scratch(spark, "alerts")
    T.append_alerts(alerts(spark, d), path)
    return plain(T.read_alerts_since(spark, path, "1970-01-14").filter(F.col("timestamp_iso") >= "1970-01-14T16:55"))


@query("report_tables", f"SELECT {_OUTCOME} AS outcome, count(*) AS n FROM alert_v GROUP BY 1")
def _(spark, d):
    path = L.scratch(spark, "report")
    T.write_report(alerts(spark, d).groupBy(AL.outcome().alias("outcome")).agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.option("header", True).schema("outcome string, n long").csv(path)


@query("alert_reset", "SELECT count(*) AS left_over FROM events WHERE false")
def _(spark, d):
    path = L.scratch(spark, "alerts")
    T.encode_alerts(alerts(spark, d)).write.parquet(path)
    T.reset_alerts(spark, path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("left_over"))


def _pages(spark: SparkSession, d: str) -> PG.AlertPages:
    """The alert table in two appends, with its directory."""
    every = alerts(spark, d)
    pages = PG.AlertPages(spark, L.scratch(spark, "pages"))
    odd = F.substring("flow_uid", 2, 20).cast("long") % 2
    for turn in (0, 1):
        pages.append(every.filter(odd == turn))
    return pages


_NEWEST = 'ORDER BY "timestamp" DESC, alert_id DESC'


@query("alerts_page_stored", f"""SELECT {_ALERT_SQL}, (SELECT count(*) FROM alert_v WHERE predicted_label = 'DDOS') AS total
    FROM alert_v WHERE predicted_label = 'DDOS' {_NEWEST} LIMIT 50 OFFSET 300""")
def _(spark, d):
    return plain(_pages(spark, d).page(300, 50, "DDOS"))


@query("alerts_after", f"SELECT {_ALERT_SQL} FROM alert_v WHERE decision = 'ANALYST_REVIEW' {_NEWEST} LIMIT 40 OFFSET 100")
def _(spark, d):
    pages = _pages(spark, d)
    last = pages.page(60, 40, decision="ANALYST_REVIEW").orderBy("timestamp", "alert_id").first()
    return plain(pages.after(last["timestamp"], last["alert_id"], 40, decision="ANALYST_REVIEW"))


# --- live detection ----------------------------------------------------------------------------


def _live(spark: SparkSession, d: str, subscribers=(), scorer=L.rule_scorer, conn_time=None, batches: int = 1) -> LiveDetector:
    """Run the stream over the written logs, in about ``batches`` micro-batches, until everything available is processed."""
    folder = L.write_logs(spark, d, conn_time=conn_time)
    live = LiveDetector(spark, L.scratch(spark, "live"), scorer, subscribers)
    files = None if batches == 1 else -(-len(Z.existing(spark, f"{folder}/*/part-*")) // batches)
    live.start(folder, max_files_per_trigger=files, names="part-*.txt").awaitTermination()
    return live


_LIVE_FEATURES = ["win_src_flow_count_60s", "win_src_dns_query_count_60s", "win_src_dns_nxdomain_ratio_60s", "win_dst_unique_sources_60s",
                  "win_pair_delta_t_std", "dns_query_len", "ssl_resumed_flag", "weird_anomaly_count_flow", "quic_sni_len"]


@query("zeek_stream", f"""SELECT flow_uid, {', '.join(_LIVE_FEATURES)} FROM ({O.matrix_select(_LIVE_FEATURES)})""")
def _(spark, d):
    live = _live(spark, d)
    return spark.read.parquet(live.path("features")).select("flow_uid", *_LIVE_FEATURES)


@query("poll_summary", """
    SELECT (SELECT count(*) FROM conn_v) AS flows_count, (SELECT count(*) FROM conn_v) + (SELECT count(*) FROM dns_v) + (SELECT count(*) FROM weird_v)
           + (SELECT count(*) FROM ssl_v) + (SELECT count(*) FROM quic_v) AS total_records, (SELECT count(*) FROM conn_v) AS conn_count,
           (SELECT count(*) FROM dns_v) AS dns_count""")
def _(spark, d):
    live = _live(spark, d)
    s = spark.read.parquet(live.path("summary"))
    return s.agg(*[F.sum(c).alias(c) for c in ("flows_count", "total_records", "conn_count", "dns_count")])


_RULE_SQL = """(SELECT uid, protocol, list_max(w) / CAST(list_sum(w) AS DOUBLE) AS best, w[3] / CAST(list_sum(w) AS DOUBLE) AS recon, list_position(w, list_max(w)) AS top
    FROM (SELECT uid, protocol, [1 + ((total_bytes + total_packets) * q) % 97 for q in [3, 5, 7, 11, 13, 17]] AS w FROM conn_v))"""
_RULE_VERDICT = f"""(SELECT uid, CASE WHEN recon >= 0.35::DOUBLE AND recon >= best * 0.9::DOUBLE THEN 3 ELSE top END AS pick,
    CASE WHEN recon >= 0.35::DOUBLE AND recon >= best * 0.9::DOUBLE THEN recon ELSE best END AS conf FROM {_RULE_SQL})"""
_RULE_LABEL = "['BENIGN', 'DDOS', 'RECON', 'DNS_TUNNEL', 'C2_BEACON', 'SLOW_HTTP'][pick]"


@query("alert_stream", f"""SELECT uid AS flow_uid, {_RULE_LABEL} AS predicted_label, round_even(conf, 4) AS confidence, conf < 0.4::DOUBLE AS abstained
    FROM {_RULE_VERDICT}""")
def _(spark, d):
    copied = L.scratch(spark, "subscriber")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("append").parquet(copied)

    def broken(batch: DataFrame, batch_id: int) -> None:
        raise RuntimeError("a failing subscriber must not stop the stream")

    _live(spark, d, (broken, keep))
    return spark.read.parquet(copied).select("flow_uid", "predicted_label", "confidence", "abstained")


# Flows without a date and flows dated far ahead, in three micro-batches: all of them get an alert at their own time.
@query("stream_late_flows", f"""SELECT uid AS flow_uid, CASE WHEN event_id % 50 = 0 THEN CAST(0 AS DOUBLE) WHEN event_id % 50 = 1 THEN ts + CAST(10000000 AS DOUBLE) ELSE ts END AS "timestamp",
    {_RULE_LABEL} AS predicted_label, round_even(conf, 4) AS confidence FROM {_RULE_VERDICT} JOIN conn_v USING (uid)""")
def _(spark, d):
    turn = L.event_number("uid") % 50
    shifted = F.when(turn == 0, "0.0").when(turn == 1, (F.col("ts").cast("double") + 1e7).cast("string")).otherwise(F.col("ts"))
    live = _live(spark, d, conn_time=shifted, batches=3)
    return spark.read.parquet(live.path("alerts")).select("flow_uid", "timestamp", "predicted_label", "confidence")


# A scorer that fails for every tenth flow: these become error alerts, the others are scored.
@query("stream_error_alerts", f"""SELECT uid AS flow_uid, event_id % 10 = 0 AS failed, CASE WHEN event_id % 10 = 0 THEN 'UNKNOWN' ELSE {_RULE_LABEL} END AS predicted_label,
    CASE WHEN event_id % 10 = 0 THEN CAST(0 AS DOUBLE) ELSE round_even(conf, 4) END AS confidence,
    event_id % 10 = 0 OR conf < 0.4::DOUBLE AS abstained FROM {_RULE_VERDICT} JOIN conn_v USING (uid)""")
def _(spark, d):
    def scorer(features: DataFrame) -> DataFrame:
        broken = F.transform("probs", lambda p: F.lit(float("nan")))
        return L.rule_scorer(features).withColumn("probs", F.when(L.event_number("flow_uid") % 10 == 0, broken).otherwise(F.col("probs")))

    live = _live(spark, d, scorer=scorer)
    failed = (F.col("decision") == "INFERENCE_ERROR").alias("failed")
    return spark.read.parquet(live.path("alerts")).select("flow_uid", failed, "predicted_label", "confidence", "abstained")


# What went in and out, as observed while it was written; nothing is read a second time.
@query("stream_progress", """SELECT (SELECT count(*) FROM conn_v) + (SELECT count(*) FROM dns_v) + (SELECT count(*) FROM weird_v)
           + (SELECT count(*) FROM ssl_v) + (SELECT count(*) FROM quic_v) AS records, (SELECT count(*) FROM conn_v) AS flows, (SELECT count(*) FROM conn_v) AS alerts""")
def _(spark, d):
    live = _live(spark, d, batches=2)
    return spark.read.parquet(live.path("progress")).agg(*[F.sum(c).alias(c) for c in ("records", "flows", "alerts")])


@query("running_telemetry", f"""SELECT count(*) AS flows, count(*) FILTER (conf >= 0.4::DOUBLE AND pick <> 1) AS threats,
    count(*) FILTER (conf < 0.4::DOUBLE) AS reviews FROM {_RULE_VERDICT}""")
def _(spark, d):
    live = _live(spark, d)
    name = f"telemetry_{abs(hash(live.root))}"
    stream = running_telemetry(spark, live.path("alerts")).writeStream.outputMode("complete").format("memory").queryName(name)
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("flows", "threats", "reviews")


# A tenth of the uids come twice, in several micro-batches: kept by default, dropped within a watermark on request.
@query("stream_repeated_uid", """SELECT 'kept' AS mode, uid, CASE WHEN event_id % 10 = 0 THEN 2 ELSE 1 END AS n FROM conn_v
    UNION ALL SELECT 'dropped', uid, 1 FROM conn_v""")
def _(spark, d):
    folder, seen = L.write_repeated_conn(spark, d), []
    files = -(-len(Z.existing(spark, f"{folder}/*/conn.log/part-*")) // 3)
    for mode, change in (("kept", lambda flows: flows), ("dropped", lambda flows: without_repeats(flows, "1 hour"))):
        out = L.scratch(spark, f"repeats-{mode}")
        rows = change(flows_stream(spark, folder, "part-*.txt", files)).select("uid", "ts")
        sink = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint")
        sink.trigger(availableNow=True).start().awaitTermination()
        stored = spark.read.schema(rows.schema).parquet(f"{out}/rows")
        seen.append(stored.groupBy("uid").agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit(mode).alias("mode"), "uid", "n"))
    return seen[0].unionByName(seen[1])


# The first run ends between the features and the alerts of its first batch; the second one goes on from its checkpoint.
@query("stream_resume", f"""SELECT uid AS flow_uid, CAST(1 AS BIGINT) AS alerts, {_RULE_LABEL} AS predicted_label FROM {_RULE_VERDICT}""")
def _(spark, d):
    folder, root = L.write_logs(spark, d), L.scratch(spark, "live")
    files = -(-len(Z.existing(spark, f"{folder}/*/part-*")) // 3)

    def crash(features: DataFrame) -> DataFrame:
        raise RuntimeError("between features and alerts")

    for scorer in (crash, L.rule_scorer):
        stream = LiveDetector(spark, root, scorer).start(folder, max_files_per_trigger=files, names="part-*.txt")
        try:
            stream.awaitTermination()
        except StreamingQueryException as e:
            if scorer is not crash or "between features and alerts" not in str(e):
                raise
    stored = spark.read.parquet(f"{root}/alerts")
    return stored.groupBy("flow_uid").agg(F.count(F.lit(1)).alias("alerts"), F.first("predicted_label").alias("predicted_label"))


@query("stream_every_second", f"""SELECT uid AS flow_uid, {_RULE_LABEL} AS predicted_label, round_even(conf, 4) AS confidence FROM {_RULE_VERDICT}""")
def _(spark, d):
    live = LiveDetector(spark, L.scratch(spark, "live"), L.rule_scorer)
    stream = live.start(L.write_logs(spark, d), continuous_every="1 second", names="part-*.txt")
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    return spark.read.parquet(live.path("alerts")).select("flow_uid", "predicted_label", "confidence")


# A trained model in the live path: what it says of every flow is what it says in batch.
@query("stream_model_alerts", "SELECT uid AS flow_uid, CAST(1 AS BIGINT) AS alerts, true AS as_in_batch FROM conn_v")
def _(spark, d):
    split = _split(spark, d)
    path = L.scratch(spark, "bundle")
    train = staged(M.prepared(split.filter(F.col("part") == "train"), K.FEATURE_COLUMNS).drop(*K.FEATURE_COLUMNS))
    released(split)
    M.save_bundle(M.estimators()["random_forest"].fit(train), path)
    released(train)
    live = _live(spark, d, scorer=M.bundle_scorer(path))
    alerts_ = spark.read.parquet(live.path("alerts")).groupBy("flow_uid").agg(F.count(F.lit(1)).alias("alerts"), F.first("predicted_label").alias("live"), F.first("confidence").alias("live_confidence"))
    batch = M.bundle_scorer(path)(A.assemble_defaults(A.feature_matrix(B.logs(spark, d))))
    verdicts = batch.select("flow_uid", P.verdict(F.col("probs")).alias("v")).select("flow_uid", F.col("v.predicted_label").alias("batch"), F.col("v.confidence").alias("batch_confidence"))
    same = (F.col("live") == F.col("batch")) & (F.abs(F.col("live_confidence") - F.col("batch_confidence")) < 1e-3)
    return verdicts.join(alerts_, "flow_uid", "left").select("flow_uid", F.coalesce("alerts", F.lit(0)).alias("alerts"), F.coalesce(same, F.lit(False)).alias("as_in_batch"))


# --- models ----------------------------------------------------------------------------------------

# The whole contract, from all logs; learners, rounds, settings and repeats are the defaults of the operators.
_MODEL_COLUMNS = K.FEATURE_COLUMNS


def _split(spark: SparkSession, d: str) -> DataFrame:
    table = staged(labelled(spark, d, _MODEL_COLUMNS))  # the split reads it twice
    split = staged(D.holdout_split(table, B.BOUND_TRAIN_RUNS, B.BOUND_TEST_RUNS))
    released(table)
    return split


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged labelled table with its split, and its two parts with weights and vectors in place of the columns: (all, train, test)."""
    split = _split(spark, d)
    train, test = (staged(M.prepared(split.filter(F.col("part") == p), _MODEL_COLUMNS).drop(*_MODEL_COLUMNS)) for p in ("train", "test"))
    return split, train, test


@query("class_weights", f"""SELECT label, round_even(sum(n) OVER () / (count(*) OVER () * CAST(n AS DOUBLE)), 9) AS w
    FROM (SELECT label, count(*) AS n FROM runs_v GROUP BY label)""")
def _(spark, d):
    rows = B.run_labels(spark, d).withColumn("y", M.class_index())
    return M.with_class_weight(rows).groupBy("label").agg(F.rint(F.max("w") * 1e9).alias("w")).withColumn("w", F.col("w") / 1e9)


@query("majority_baseline", "SELECT (SELECT arg_max(label, n) FROM (SELECT label, count(*) AS n FROM runs_v GROUP BY label)) AS prediction, count(*) AS n FROM runs_v")
def _(spark, d):
    rows = B.run_labels(spark, d).withColumn("y", M.class_index())
    out = M.majority_probabilities(rows, rows)
    return out.groupBy(P.argmax_label(F.col("probs")).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


@query("baseline_models")
def _(spark, d):
    _, train, test = _parts(spark, d)
    return M.baselines(train, test)


@query("score_batch")
def _(spark, d):
    _, train, test = _parts(spark, d)
    model = M.estimators()["random_forest"].fit(train)
    return M.score(model, test).select("flow_uid", P.verdict(F.col("probs")).alias("v")).select("flow_uid", "v.predicted_label", "v.confidence", "v.decision")


@query("probability_calibration")
def _(spark, d):
    _, train, test = _parts(spark, d)
    return M.calibration_comparison(train, test)


@query("hyperparameter_sensitivity")
def _(spark, d):
    split, train, test = _parts(spark, d)
    inner = staged(D.validation_split(split, ["exp_0", "exp_1"], B.BOUND_VALIDATION_RUNS))
    sub = M.prepared(inner.filter(F.col("inner_part") == "sub_train"), _MODEL_COLUMNS)
    val = M.prepared(inner.filter(F.col("inner_part") == "validation"), _MODEL_COLUMNS)
    return M.sensitivity(staged(sub), staged(val), train, test)


_ABLATED = ["random_forest", "gradient_boosting", "logistic_regression"]


@query("feature_ablation")
def _(spark, d):
    split = _split(spark, d)
    train, test = split.filter(F.col("part") == "train"), split.filter(F.col("part") == "test")
    results = [M.ablation(train, test, lambda n=name: M.estimators()[n]).withColumn("model", F.lit(name)) for name in _ABLATED]
    return reduce(DataFrame.unionByName, results)


@query("permutation_importance")
def _(spark, d):
    _, train, test = _parts(spark, d)
    model = M.estimators()["decision_tree"].fit(train)
    return M.permutation_importance(model, test, _MODEL_COLUMNS)


# A model and its permutation importances for each of five seeds, their spread, and the ten features that lead on average.
@query("importance_over_seeds")
def _(spark, d):
    _, train, test = _parts(spark, d)
    return M.importance_over_seeds(lambda seed: M.estimators(seed=seed)["decision_tree"], train, test, _MODEL_COLUMNS)


@query("impurity_importance")
def _(spark, d):
    _, train, _ = _parts(spark, d)
    return E.top_features(M.impurity_importance(M.estimators()["random_forest"].fit(train), _MODEL_COLUMNS))


@query("model_bundle", "SELECT CAST(0 AS BIGINT) AS differing_rows, CAST(78 AS INTEGER) AS contract_features")
def _(spark, d):
    _, train, test = _parts(spark, d)
    model = M.estimators()["random_forest"].fit(train)
    path = L.scratch(spark, "bundle")
    changed = M.round_trip_differences(model, path, test)
    _, documents = M.load_bundle(path)
    return changed.agg(F.count(F.lit(1)).alias("differing_rows")).withColumn(
        "contract_features", F.lit(len(documents["feature_contract"]["columns"])))

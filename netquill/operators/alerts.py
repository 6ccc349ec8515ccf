"""Queries over the alert table: filters, pages, metrics and dashboard summaries.

Newest first means by ``(timestamp, alert_id)`` descending; every "newest N" is a
distributed top-N.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquill.contract import ACTIVE_CLASSES, DECISIONS, THREAT_CLASSES, TRIAGE_DECISIONS
from netquill.functions.scalars import round_half_even
from netquill.operators.quantiles import exact_percentiles

STORE_CAPACITY = 2000
MAX_PAGE = 500
# The columns of an export, in order.
EXPORT_COLUMNS = [
    "alert_id", "timestamp_iso", "flow_uid", "source_ip", "source_port", "destination_ip", "destination_port",
    "protocol", "predicted_label", "confidence", "decision", "abstained", "processing_time_ms",
]


def _newest_first() -> list[Column]:
    return [F.col("timestamp").desc(), F.col("alert_id").desc()]


def _oldest_first() -> list[Column]:
    return [F.col("timestamp").asc(), F.col("alert_id").asc()]


def in_review() -> Column:
    return F.col("abstained") | (F.col("decision") == "ANALYST_REVIEW")


def outcome() -> Column:
    """review / benign / threat by the store's rebuild rule."""
    benign = (F.col("predicted_label") == "BENIGN") | (F.col("decision") == "FALSE_POSITIVE")
    return F.when(in_review(), "review").when(benign, "benign").otherwise("threat")


def _validated(value: str, allowed: list[str], what: str) -> str:
    wanted = value.strip().upper()
    if wanted not in allowed:
        raise ValueError(f"invalid {what} {value!r}; must be one of {allowed}")
    return wanted


def alert_filter(alerts: DataFrame, threat_class: str | None = None, decision: str | None = None) -> DataFrame:
    out = alerts
    if threat_class:
        out = out.filter(F.col("predicted_label") == _validated(threat_class, THREAT_CLASSES, "threat class"))
    if decision:
        allowed = DECISIONS + [d for d in TRIAGE_DECISIONS if d not in DECISIONS]
        out = out.filter(F.col("decision") == _validated(decision, allowed, "decision"))
    return out


def alert_search(alerts: DataFrame, term: str) -> DataFrame:
    """Case-insensitive substring over addresses, ports, uid, label and protocol."""
    q = term.lower()
    if not q.strip():
        return alerts
    texts = ["source_ip", "destination_ip", "source_port", "destination_port", "flow_uid", "predicted_label", "protocol"]
    hit = F.lit(False)
    for name in texts:
        hit = hit | F.coalesce(F.lower(F.col(name).cast("string")).contains(q), F.lit(False))
    return alerts.filter(hit)


def triage_mode(alerts: DataFrame, mode: str = "ALL", threat_class: str = "ALL", protocol: str = "ALL") -> DataFrame:
    review = in_review()
    threat = (F.col("predicted_label") != "BENIGN") & ~review & (F.col("decision") != "FALSE_POSITIVE")
    rules = {"ALL": F.lit(True), "THREATS_ONLY": threat, "REVIEW_ONLY": review, "BENIGN_ONLY": ~(threat | review)}
    out = alerts.filter(rules[mode])
    if threat_class != "ALL":
        out = out.filter(F.upper("predicted_label") == threat_class.upper())
    if protocol != "ALL":
        out = out.filter(F.upper("protocol") == protocol.upper())
    return out


def alerts_page(
    alerts: DataFrame, offset: int = 0, limit: int = 50,
    threat_class: str | None = None, decision: str | None = None, most: int = MAX_PAGE,
) -> DataFrame:
    """One page, newest first, with the filtered ``total`` on every row; ``most`` is the largest page a caller may ask for.

    For pages far back, :class:`netquill.operators.alert_pages.AlertPages` opens only what a page needs."""
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be 1..{most} and offset must not be negative")
    matching = alert_filter(alerts, threat_class, decision)
    total = matching.agg(F.count(F.lit(1))).scalar()
    return matching.orderBy(*_newest_first()).offset(offset).limit(limit).withColumn("total", total)


def alert_by_id(alerts: DataFrame, alert_id: str | Column) -> DataFrame:
    return alerts.filter(F.col("alert_id") == alert_id)


def newest(alerts: DataFrame, n: int) -> DataFrame:
    return alerts.orderBy(*_newest_first()).limit(n)


def recent_alerts(alerts: DataFrame, n: int = STORE_CAPACITY) -> DataFrame:
    """The newest ``n`` alerts, returned oldest first."""
    return newest(alerts, n).orderBy(*_oldest_first())


def bounded_store(alerts: DataFrame, capacity: int = STORE_CAPACITY) -> DataFrame:
    """Retention view: the latest ``capacity`` alerts; older ids are no longer visible."""
    return newest(alerts, capacity)


def alert_export(alerts: DataFrame, limit: int = 500, threat_class: str | None = None, decision: str | None = None, most: int = STORE_CAPACITY) -> DataFrame:
    """The 13 export columns of the newest matching alerts; ``most`` is the largest export a caller may ask for."""
    if not 1 <= limit <= most:
        raise ValueError(f"export limit must be 1..{most}")
    rows = newest(alert_filter(alerts, threat_class, decision), limit)
    return rows.select(*[
        round_half_even(F.col(c), {"confidence": 4, "processing_time_ms": 2}[c]).alias(c)
        if c in ("confidence", "processing_time_ms") else F.col(c)
        for c in EXPORT_COLUMNS
    ])


def class_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("predicted_label").agg(F.count(F.lit(1)).alias("n"))


def alert_metrics(alerts: DataFrame) -> DataFrame:
    """One row: totals by outcome, per-class counts, mean and p95 latency."""
    count_of = lambda o: F.count_if(outcome() == o)
    counts = alerts.agg(
        F.count(F.lit(1)).alias("total_flows"),
        count_of("threat").alias("total_threats"),
        count_of("benign").alias("benign_count"),
        count_of("review").alias("analyst_review_count"),
        *[F.count_if(F.col("predicted_label") == c).alias(f"n_{c.lower()}") for c in ACTIVE_CLASSES],
        round_half_even(F.coalesce(F.avg("processing_time_ms"), F.lit(0.0)), 3).alias("average_inference_latency_ms"),
    )
    p95 = exact_percentiles(alerts, [], "processing_time_ms", {"p": 0.95}).agg(F.max("p")).scalar()
    return counts.withColumn("p95_latency_ms", round_half_even(F.coalesce(p95, F.lit(0.0)), 3))


def threat_ratio(alerts: DataFrame) -> DataFrame:
    total, threats = F.count(F.lit(1)), F.count_if(outcome() == "threat")
    pct = F.when(total > 0, round_half_even(threats * 100.0 / total, 1)).otherwise(F.lit(0.0))
    return alerts.agg(total.alias("total"), threats.alias("threats"), pct.alias("threat_pct"))


def latency_profile(alerts: DataFrame, run: str = "experiment_id") -> DataFrame:
    """Latency distribution per run, three places."""
    p = {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95, "p99_latency_ms": 0.99}
    marks = exact_percentiles(alerts, [run], "processing_time_ms", p)
    basics = alerts.groupBy(run).agg(
        F.avg("processing_time_ms").alias("mean_latency_ms"), F.max("processing_time_ms").alias("max_latency_ms")
    )
    rounded = [round_half_even(F.col(c), 3).alias(c) for c in ("mean_latency_ms", *p, "max_latency_ms")]
    return basics.join(marks, run).select(run, F.col("n").alias("flows"), *rounded)


def replay_benchmark(alerts: DataFrame, run: str = "experiment_id") -> DataFrame:
    """Outcome counts per run plus the corpus row (null run)."""
    error = F.col("decision") == "INFERENCE_ERROR"
    benign = ~F.col("abstained") & (F.col("predicted_label") == "BENIGN")
    return alerts.rollup(run).agg(
        F.count_if(~error).alias("flows_count"),
        F.count_if(~error & ~F.col("abstained") & (F.col("predicted_label") != "BENIGN")).alias("threats_detected"),
        F.count_if(~error & benign).alias("benign_detected"),
        F.count_if(~error & F.col("abstained")).alias("analyst_reviews"),
        F.count_if(error).alias("inference_errors"),
    )


def protocol_share(alerts: DataFrame) -> DataFrame:
    """Upper-case protocol counts and their percentage."""
    name = F.upper(F.when(F.coalesce(F.col("protocol"), F.lit("")) == "", "OTHER").otherwise(F.col("protocol")))
    counts = alerts.groupBy(name.alias("protocol")).agg(F.count(F.lit(1)).alias("n"))
    total = alerts.agg(F.count(F.lit(1))).scalar()
    return counts.select("protocol", "n", round_half_even(F.col("n") * 100.0 / total, 2).alias("pct"))


def activity_timeline(alerts: DataFrame, recent: int = 140, buckets: int = 14) -> DataFrame:
    """The newest alerts in equal-count buckets, oldest first, counted by outcome.

    The single-partition window runs over at most ``recent`` rows.
    """
    kind = F.when(in_review(), "reviews").when(F.col("predicted_label") == "BENIGN", "benign").otherwise("threats")
    last = newest(alerts.select("timestamp", "alert_id", kind.alias("kind")), recent)
    one = Window.partitionBy(F.lit(0))
    position = F.row_number().over(one.orderBy("timestamp", "alert_id")) - 1
    size = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(one) / buckets))
    bucket = F.least(F.lit(buckets - 1), F.floor(position / size))
    counts = last.withColumn("bucket", bucket.cast("int")).groupBy("bucket").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("threats", "benign", "reviews")]
    )
    return counts


def session_counters(alerts: DataFrame) -> DataFrame:
    """Running totals of a session; also valid on a stream in complete or update mode."""
    return alerts.agg(
        F.count(F.lit(1)).alias("flows"),
        F.count_if(~in_review() & (F.col("predicted_label") != "BENIGN")).alias("threats"),
        F.count_if(in_review()).alias("reviews"),
        *[F.count_if(F.col("predicted_label") == c).alias(f"n_{c.lower()}") for c in ACTIVE_CLASSES],
    )


def banner_summary(alerts: DataFrame) -> DataFrame:
    """Flagged alerts: confirmed and under review, and the newest one."""
    flagged = alerts.filter((F.col("predicted_label") != "BENIGN") | in_review())
    latest = F.max_by("alert_id", F.struct("timestamp", "alert_id"))
    return flagged.agg(
        F.count(F.lit(1)).alias("flagged"),
        F.count_if(~in_review()).alias("confirmed"),
        F.count_if(in_review()).alias("under_review"),
        latest.alias("latest_flagged"),
    )


def top_probabilities(alerts: DataFrame, k: int = 4) -> DataFrame:
    """Per alert the ``k`` most probable classes, one row each.

    A class without a probability counts as the confidence if it was predicted, else 0.
    """
    entries = F.array(*[
        F.struct(
            F.coalesce(
                F.try_element_at("probabilities", F.lit(c)),
                F.when(F.col("predicted_label") == c, F.col("confidence")).otherwise(F.lit(0.0)),
            ).alias("prob"),
            F.lit(-i).alias("tie"),
            F.lit(c).alias("cls"),
        )
        for i, c in enumerate(ACTIVE_CLASSES)
    ])
    best = F.slice(F.sort_array(entries, asc=False), 1, k)
    return alerts.select("alert_id", F.posexplode(best).alias("pos", "e")).select(
        "alert_id", (F.col("pos") + 1).alias("rank"), F.col("e.cls").alias("class_name"), F.col("e.prob").alias("probability")
    )


def first_alert_per_run(alerts: DataFrame, run: str = "experiment_id") -> DataFrame:
    others = [c for c in alerts.columns if c != run]
    first = F.min_by(F.struct(*others), F.struct("timestamp", "alert_id"))
    return alerts.groupBy(run).agg(first.alias("a")).select(run, "a.*")


def sample_by_label(alerts: DataFrame, label: str, k: int, run: str = "experiment_id") -> DataFrame:
    """The first ``k`` alerts of every run predicted as ``label`` (a per-group top-k)."""
    w = Window.partitionBy(run).orderBy("timestamp", "alert_id")
    hits = alerts.filter(F.upper("predicted_label") == label.upper())
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

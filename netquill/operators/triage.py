"""Alert state as append-only logs: upserts, triage decisions and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquill.contract import ALERT_ROW, TRIAGE_DECISIONS
from netquill.functions import scalars as S
from netquill.operators.timeline import DEFAULT_SLOT_SECONDS


def current_alerts(event_log: DataFrame, version: str = "version") -> DataFrame:
    """Insert-or-replace view: the highest version of every alert id."""
    others = [c for c in event_log.columns if c not in ("alert_id", version)]
    latest = F.max_by(F.struct(*others), F.col(version))
    return event_log.groupBy("alert_id").agg(latest.alias("a"), F.max(version).alias(version)).select("alert_id", "a.*", version)


def decision_events(decisions: DataFrame) -> DataFrame:
    """Keep well-formed triage decisions ``(alert_id, decided_at, decision, notes)``."""
    return decisions.filter(F.col("decision").isin(TRIAGE_DECISIONS))


def apply_triage(alerts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Alerts with their latest decision; only ANALYST_REVIEW leaves an alert abstained.

    Decisions for unknown alerts have no effect.
    """
    last = decision_events(decisions).groupBy("alert_id").agg(
        F.max_by("decision", F.struct("decided_at", "decision")).alias("_new")
    )
    joined = alerts.join(last, "alert_id", "left")
    changed = F.col("_new").isNotNull() & (F.col("_new") != F.col("decision"))
    return joined.select(*[
        F.when(changed, F.col("_new") == "ANALYST_REVIEW").otherwise(F.col("abstained")).alias(c) if c == "abstained"
        else F.coalesce("_new", "decision").alias(c) if c == "decision"
        else F.col(c)
        for c in alerts.columns
    ])


def triage_audit(alerts: DataFrame, decisions: DataFrame, slot_seconds: float = DEFAULT_SLOT_SECONDS) -> DataFrame:
    """Old -> new per effective decision of a known alert; repeats of the same verdict are no-ops.

    Each decision is paired with the one before it (the alert's own decision at first). Only
    one decision per alert and slot crosses to the next slot, so a much re-decided alert is
    spread over tasks.
    """
    known = decision_events(decisions).join(alerts.select("alert_id", F.col("decision").alias("_original")), "alert_id")
    slotted = known.withColumn("_slot", F.floor(F.col("decided_at") / F.lit(float(slot_seconds))))
    ends = slotted.groupBy("alert_id", "_slot").agg(F.max_by("decision", F.struct("decided_at", "decision")).alias("_end"))
    over_slots = Window.partitionBy("alert_id").orderBy("_slot")
    carried = ends.select("alert_id", "_slot", F.lag("_end").over(over_slots).alias("_carried"))
    within = Window.partitionBy("alert_id", "_slot").orderBy("decided_at", "decision")
    old = F.coalesce(F.lag("decision").over(within), F.col("_carried"), F.col("_original"))
    return (
        slotted.join(carried, ["alert_id", "_slot"])
        .withColumn("old_decision", old)
        .filter(F.col("old_decision") != F.col("decision"))
        .select("alert_id", F.col("decided_at").alias("timestamp"), "old_decision",
                F.col("decision").alias("new_decision"), "notes")
    )


def batch_decisions(alert_ids: DataFrame, decision: str, decided_at: Column, notes: str = "") -> DataFrame:
    """One decision for many alerts as rows to append to the decision log."""
    if decision not in TRIAGE_DECISIONS:
        raise ValueError(f"invalid decision {decision!r}; must be one of {TRIAGE_DECISIONS}")
    return alert_ids.select("alert_id").distinct().select(
        "alert_id", decided_at.cast("double").alias("decided_at"), F.lit(decision).alias("decision"), F.lit(notes).alias("notes")
    )


def parse_payloads(payloads: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """JSON alert payloads -> (valid alert rows, rejected payloads with ``reason``).

    The parsed row comes out of an ``explode``, through which Spark moves no filter: as a plain column it would be
    parsed again for every field that is judged.
    """
    parsed = payloads.select("*", F.explode(F.array(F.from_json(F.col(column), ALERT_ROW))).alias("a"))
    a = F.col("a")
    required = [f.name for f in ALERT_ROW.fields if f.name not in ("timestamp_iso", "probabilities", "metadata")]
    missing = F.lit(False)
    for name in required:
        missing = missing | a[name].isNull()
    port = lambda n: a[n].between(0, 65535)
    reason = (
        F.when(a.isNull() | missing, "missing_or_malformed_field")
        .when(~port("source_port") | ~port("destination_port"), "port_out_of_range")
        .when(~a["confidence"].between(0.0, 1.0), "confidence_out_of_range")
        .when(a["processing_time_ms"] < 0, "negative_latency")
    )
    judged = parsed.withColumn("reason", reason)
    ok = judged.filter(F.col("reason").isNull()).select("a.*")
    iso = F.when(F.coalesce("timestamp_iso", F.lit("")) == "", S.iso_timestamp(F.col("timestamp"))).otherwise(F.col("timestamp_iso"))
    valid = ok.select(*[_normalised(f, iso) for f in ALERT_ROW.fields])
    return valid, judged.filter(F.col("reason").isNotNull()).select(F.col(column), "reason")


def _normalised(f: T.StructField, iso: Column) -> Column:
    c = F.col(f.name)
    if f.name == "timestamp_iso":
        c = iso
    elif f.name == "protocol":
        c = F.lower(c)
    elif f.name == "confidence":
        c = S.round_half_even(c, 4)
    elif f.name == "processing_time_ms":
        c = S.round_half_even(c, 3)
    elif f.name == "probabilities":
        c = S.round_probabilities(F.coalesce(c, F.create_map().cast(f.dataType)))
    elif f.name == "metadata":
        c = F.coalesce(c, F.create_map().cast(f.dataType))
    return c.alias(f.name)

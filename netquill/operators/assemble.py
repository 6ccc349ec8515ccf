"""Assembly of the 78-column feature table, its contract check and alert rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.contract import (
    CONTRACT_VERSION, DNS_FEATURES, FEATURE_COLUMNS, FLOW_FEATURES, MODEL_VERSION, NUM_FEATURES,
    QUIC_FEATURES, SSL_FEATURES, WEIRD_FEATURES, WINDOW_FEATURES, default_of,
)
from netquill.functions import scalars as S
from netquill.operators import correlate as C
from netquill.operators import policy as P
from netquill.operators.windows import SLOT_SECONDS, window_features
from netquill.sources.stage import staged

# Identity columns in front of the features.
IDENTITY = {
    "flow_uid": "uid", "timestamp": "ts", "source_ip": "src_ip", "source_port": "src_port",
    "destination_ip": "dst_ip", "destination_port": "dst_port", "protocol": "protocol",
    "connection_state": "conn_state",
}


_CONTEXT_GROUPS = {"dns": DNS_FEATURES, "quic": QUIC_FEATURES, "ssl": SSL_FEATURES, "weird": WEIRD_FEATURES}


def feature_matrix(
    logs: dict[str, DataFrame],
    features: list[str] = FEATURE_COLUMNS,
    slot_seconds: float = SLOT_SECONDS,
    targets: DataFrame | None = None,
    keep: tuple[str, ...] = (),
    arrival: str | None = None,
    stage: Callable[..., DataFrame] = staged,
) -> DataFrame:
    """Logs -> one row per connection: identity columns, then the features in contract order.

    Asking for fewer features drops the joins and windows only the others need. Missing
    logs leave their features at the contract defaults. ``targets``, ``arrival`` and ``stage`` are passed
    on to :func:`window_features`; ``keep`` names further flow columns to carry along.
    """
    wanted = [f for f in FEATURE_COLUMNS if f in set(features)]
    flows = window_features(
        logs["conn"], logs.get("dns"), logs.get("weird"), [f for f in WINDOW_FEATURES if f in wanted], slot_seconds,
        targets, arrival, stage,
    )
    columns = C.flow_feature_columns()
    columns.update({f: F.col(f) for f in WINDOW_FEATURES})
    for kind, members in _CONTEXT_GROUPS.items():
        if logs.get(kind) is not None and any(f in wanted for f in members):
            context = C.weird_features(logs[kind]) if kind == "weird" else C.context_features(logs[kind], kind)
            flows = flows.join(context.select("uid", *[f for f in members if f in wanted]), "uid", "left")
            columns.update({f: F.coalesce(F.col(f), F.lit(0.0)) for f in members})
    return flows.select(
        *[F.col(c).alias(n) for n, c in IDENTITY.items()], *keep,
        *[columns.get(f, F.lit(default_of(f))).alias(f) for f in wanted],
    )


def flow_features(flows: DataFrame) -> DataFrame:
    cols = C.flow_feature_columns()
    return flows.select("uid", *[cols[n].alias(n) for n in FLOW_FEATURES])


def assemble_defaults(partial: DataFrame) -> DataFrame:
    """Fill a partly computed feature table up to the full contract with neutral defaults."""
    have = set(partial.columns)
    keep = [c for c in partial.columns if c not in FEATURE_COLUMNS]
    return partial.select(
        *keep,
        *[
            (F.coalesce(F.col(n).cast("double"), F.lit(default_of(n))) if n in have else F.lit(default_of(n))).alias(n)
            for n in FEATURE_COLUMNS
        ],
    )


def feature_array() -> Column:
    return F.array(*[F.col(n).cast("double") for n in FEATURE_COLUMNS])


class ContractViolation(ValueError):
    """The column set does not match the feature contract."""


def check_columns(columns: list[str]) -> None:
    """Raise unless ``columns`` is exactly the contract's column set."""
    missing = sorted(set(FEATURE_COLUMNS) - set(columns))
    extra = sorted(set(columns) - set(FEATURE_COLUMNS))
    if missing:
        raise ContractViolation(f"missing {len(missing)} required feature(s): {missing[:5]}")
    if extra:
        raise ContractViolation(f"unexpected feature(s): {extra[:5]}")


def column_differences(table: DataFrame) -> DataFrame:
    """What :func:`check_columns` finds in a feature table, as rows: column name, ``missing`` or ``unexpected``, and how many rows have a
    value there. The identity columns are not features."""
    have = [c for c in table.columns if c not in IDENTITY]
    extra = [c for c in have if c not in FEATURE_COLUMNS]
    missing = [c for c in FEATURE_COLUMNS if c not in have]
    entry = lambda name, problem, n: F.struct(F.lit(name).alias("name"), F.lit(problem).alias("problem"), n.cast("long").alias("n"))
    found = [entry(c, "missing", F.lit(0)) for c in missing] + [entry(c, "unexpected", F.col(f"_{i}")) for i, c in enumerate(extra)]
    counts = table.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(f"_{i}") for i, c in enumerate(extra)])
    kind = "array<struct<name:string,problem:string,n:bigint>>"
    return counts.select(F.inline(F.array(*found).cast(kind)))


def contract_reason(features: Column) -> Column:
    """Why an array of features breaks the contract; null when it does not."""
    bad_nan = F.exists(features, lambda x: F.isnan(x))
    bad_inf = F.exists(features, lambda x: F.abs(x) == F.lit(float("inf")))
    bad_null = F.exists(features, lambda x: x.isNull())
    return (
        F.when(features.isNull() | (F.size(features) != NUM_FEATURES), "wrong_dimension")
        .when(bad_null, "non_numeric")
        .when(bad_nan, "nan")
        .when(bad_inf, "infinite")
    )


def contract_split(rows: DataFrame, features: str = "features") -> tuple[DataFrame, DataFrame]:
    """Split labelled rows into (valid, rejected-with-``reason``)."""
    judged = rows.withColumn("reason", contract_reason(F.col(features)))
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull())


def alert_id(uid: Column, ts: Column) -> Column:
    """Deterministic alert id, so a replay replaces alerts instead of doubling them."""
    return F.sha2(F.concat(uid, F.lit("|"), F.floor(ts * 1e6).cast("string")), 256)


def alert_rows(
    scored: DataFrame, abstain: float = P.ABSTAIN_THRESHOLD, recon: float = P.RECON_THRESHOLD, carry: Sequence[str] = (),
) -> DataFrame:
    """Scored flows -> 19-field alert rows, followed by the columns of ``scored`` named in ``carry``.

    ``scored`` has the flat flow columns plus ``probs`` (array in active-class order),
    ``processing_time_ms`` and, for rows that could not be scored, a non-null ``error``.
    """
    s = scored if "error" in scored.columns else scored.withColumn("error", F.lit(None).cast("string"))
    s = s.withColumn("verdict", P.verdict(F.col("probs"), abstain, recon))
    failed = F.col("error").isNotNull()
    v = F.col("verdict")
    facts = F.create_map(
        F.lit("duration"), F.col("duration").cast("string"),
        F.lit("orig_bytes"), F.col("orig_bytes").cast("string"),
        F.lit("resp_bytes"), F.col("resp_bytes").cast("string"),
        F.lit("total_bytes"), F.col("total_bytes").cast("string"),
        F.lit("conn_state"), F.col("conn_state"),
    )
    no_probs = F.create_map().cast("map<string,double>")
    return s.select(
        alert_id(F.col("uid"), F.col("ts")).alias("alert_id"),
        F.col("uid").alias("flow_uid"),
        F.col("ts").alias("timestamp"),
        S.iso_timestamp(F.col("ts")).alias("timestamp_iso"),
        F.col("src_ip").alias("source_ip"), F.col("dst_ip").alias("destination_ip"),
        F.col("src_port").alias("source_port"), F.col("dst_port").alias("destination_port"),
        F.lower("protocol").alias("protocol"),
        F.when(failed, F.lit(-1)).otherwise(v["predicted_class_id"]).alias("predicted_class_id"),
        F.when(failed, F.lit("UNKNOWN")).otherwise(v["predicted_label"]).alias("predicted_label"),
        F.when(failed, F.lit(0.0)).otherwise(v["confidence"]).alias("confidence"),
        F.when(failed, no_probs).otherwise(v["probabilities"]).alias("probabilities"),
        (failed | v["abstained"]).alias("abstained"),
        F.when(failed, F.lit("INFERENCE_ERROR")).otherwise(v["decision"]).alias("decision"),
        F.lit(MODEL_VERSION).alias("model_version"),
        F.lit(CONTRACT_VERSION).alias("schema_version"),
        S.round_half_even(F.col("processing_time_ms"), 3).alias("processing_time_ms"),
        F.when(failed, F.create_map(F.lit("error"), F.col("error"))).otherwise(facts).alias("metadata"),
        *carry,
    )

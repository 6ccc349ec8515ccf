"""Stored tables: labelled features, the master table, alerts, reports and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquill.contract import ALERT_COLUMNS, ALERT_ROW, FEATURE_COLUMNS, LABELLED_ROW
from netquill.operators.alerts import alert_export
from netquill.operators.dataset import wide

MASTER_METADATA = [
    "master_row_id", "experiment_id", "experiment_class", "source_dir", "flow_uid", "timestamp", "source_endpoint",
    "destination_endpoint", "protocol", "connection_state", "label", "label_id",
]


#: Text of 78 numbers a row is several times the input; Spark and others read it in this form by the name of the file.
TEXT_CODEC = "gzip"


def write_features_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.select(*LABELLED_ROW.fieldNames()).write.mode(mode).option("compression", TEXT_CODEC).json(path)


def read_features_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Labelled feature rows from one or many JSON-lines paths (no schema inference)."""
    return spark.read.schema(LABELLED_ROW).json(path)


def master_table(rows: DataFrame, source_dir: str = "") -> DataFrame:
    """Labelled rows with ids -> the 12 metadata columns followed by the 78 features."""
    full = rows.withColumn("experiment_class", F.col("label")).withColumn(
        "source_dir", F.concat_ws("/", F.lit(source_dir), F.col("label"), F.col("experiment_id"))
    )
    return wide(full).select(*MASTER_METADATA, *FEATURE_COLUMNS)


def write_master(rows: DataFrame, path: str, formats: tuple[str, ...] = ("parquet", "csv", "json"), source_dir: str = "") -> None:
    """Master table as Parquet (primary), 90-column CSV and nested JSON lines, the texts packed."""
    table = master_table(rows, source_dir)
    if "parquet" in formats:
        table.write.mode("overwrite").parquet(f"{path}/parquet")
    if "csv" in formats:
        table.write.mode("overwrite").option("header", True).option("compression", TEXT_CODEC).csv(f"{path}/csv")
    if "json" in formats:
        nested = table.select(*MASTER_METADATA, F.array(*FEATURE_COLUMNS).alias("features"))
        nested.write.mode("overwrite").option("compression", TEXT_CODEC).json(f"{path}/json")


def encode_alerts(alerts: DataFrame) -> DataFrame:
    """Maps as JSON text and the storage date as partition column."""
    js = lambda c: F.coalesce(F.to_json(c), F.lit("{}")).alias(f"{c}_json")
    plain = [c for c in alerts.columns if c not in ("probabilities", "metadata")]
    return alerts.select(*plain, js("probabilities"), js("metadata"), F.substring("timestamp_iso", 1, 10).alias("alert_date"))


def decode_alerts(stored: DataFrame) -> DataFrame:
    types = {f.name: f.dataType for f in ALERT_ROW.fields}
    extra = [c for c in stored.columns if c not in ALERT_COLUMNS and not c.endswith("_json") and c != "alert_date"]
    back = lambda c: F.from_json(f"{c}_json", types[c]).alias(c)
    return stored.select(
        *[back(c) if c in ("probabilities", "metadata") else F.col(c) for c in ALERT_COLUMNS], *extra
    )


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Append to the alert log, partitioned by date so reads prune."""
    encode_alerts(alerts).write.mode("append").partitionBy("alert_date").parquet(path)


def read_alerts_since(spark: SparkSession, path: str, date: str) -> DataFrame:
    """Alerts stored on or after an ISO date; older partitions are not opened."""
    return decode_alerts(spark.read.parquet(path).filter(F.col("alert_date") >= date))


def reset_alerts(spark: SparkSession, *paths: str) -> None:
    """Delete all rows of alert and audit tables by writing an empty new version of each."""
    for path in paths:
        schema = spark.read.parquet(path).schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def export_alerts(alerts: DataFrame, path: str, fmt: str = "csv", limit: int = 500,
                  threat_class: str | None = None, decision: str | None = None) -> None:
    """At most 2000 newest matching alerts as one CSV or JSON file."""
    rows = alert_export(alerts, limit, threat_class, decision).coalesce(1)
    if fmt == "csv":
        rows.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        rows.write.mode("overwrite").json(path)
    else:
        raise ValueError("format must be csv or json")


def write_report(report: DataFrame, path: str, fmt: str = "csv") -> None:
    """A small aggregate as a single file."""
    out = report.coalesce(1).write.mode("overwrite")
    out.option("header", True).csv(path) if fmt == "csv" else out.json(path)

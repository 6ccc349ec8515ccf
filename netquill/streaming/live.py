"""Live detection: a directory of closed log files -> features -> alerts.

Files must be complete when they appear (rotated or moved in), because the file source sees
files, not growth. Each micro-batch is parsed once and lands its typed rows in a levelled history
(:mod:`netquill.streaming.history`). Time windows read back the hours they can reach; context rows of a
connection are found by its uid, however old they are, in the files whose filter may hold it. Every flow
is scored at its own time, late ones too, and a row that cannot be scored becomes an error alert. A
replayed batch overwrites its own rows, so restarts neither lose nor double any.
"""

from __future__ import annotations

import logging
import time
from collections import deque
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from netquill.contract import LOG_KINDS
from netquill.operators import assemble as A
from netquill.operators.alerts import session_counters
from netquill.operators.correlate import NO_UID
from netquill.operators.policy import ACTIVE_CLASSES
from netquill.operators.windows import SLOT_SECONDS
from netquill.sources import zeek as Z
from netquill.sources.stage import shuffles_let_go
from netquill.sources.tables import encode_alerts
from netquill.streaming.history import History, delete

log = logging.getLogger(__name__)

HORIZON_SECONDS = 300.0
BUCKET_SECONDS = 3600.0
FEATURE_KINDS = ("conn", "dns", "weird", "ssl", "quic")

Scorer = Callable[[DataFrame], DataFrame]
Subscriber = Callable[[DataFrame, int], None]


def log_lines(spark: SparkSession, directory: str, max_files_per_trigger: int | None = None, names: str = "*.log") -> DataFrame:
    """Streaming text rows of all files named like ``names`` below ``directory``."""
    reader = spark.readStream.format("text").option("pathGlobFilter", names).option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return Z.located(reader.load(directory))


def kind_of(file: str = "file") -> Column:
    """``.../conn.log``, ``.../conn.2024-01-01.log`` and ``.../conn.log/part-0`` are kind ``conn``."""
    return F.regexp_extract(file, r"/([A-Za-z0-9_]+)[^/]*\.log(?:/[^/]*)?$", 1)


def poll_summary() -> list[Column]:
    """Readable rows per log kind, flows and total of one trigger, as metrics to observe on parsed rows while they are written."""
    good = F.col("reason").isNull()
    per_kind = [F.count_if(good & (F.col("kind") == k)).alias(f"{k}_count") for k in LOG_KINDS]
    return [F.count_if(good & (F.col("kind") == "conn")).alias("flows_count"), F.count_if(good).alias("total_records"), *per_kind]


class Throughput(StreamingQueryListener):
    """Rows and rows per second of the last triggers of all queries of the session; ``add`` it with ``spark.streams.addListener``."""

    def __init__(self, keep: int = 1000):
        self.recent: deque[tuple[str, int, int, float]] = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.recent.append((str(p.runId), p.batchId, p.numInputRows, p.processedRowsPerSecond or 0.0))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


class LiveDetector:
    """Turns micro-batches into alerts; state lives in tables under ``work_dir``.

    A flow more than ``late_after`` seconds older than the median flow of the batch before it is marked ``late`` in the
    feature table and scored like any other. The history grows until :meth:`expire` is called; ``fan`` runs of a level of it become one.
    """

    def __init__(self, spark: SparkSession, work_dir: str, scorer: Scorer, subscribers: Iterable[Subscriber] = (),
                 late_after: float = 3600.0, slot_seconds: float = SLOT_SECONDS, fan: int = 8) -> None:
        self.spark = spark
        self.root = work_dir.rstrip("/")
        self.scorer = scorer
        self.subscribers = list(subscribers)
        self.late_after = late_after
        self.slot_seconds = slot_seconds
        self.history = History(spark, self.path("history"), FEATURE_KINDS, fan)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _replace(self, df: DataFrame, table: str, *partitions: str) -> None:
        with shuffles_let_go(df.sparkSession):
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(self.path(table))

    def _read(self, table: str, *globs: str) -> DataFrame | None:
        """The partitions of a table that match one of the globs; others are not even listed."""
        paths = [p for g in globs for p in Z.existing(self.spark, f"{self.path(table)}/{g}")]
        return self.spark.read.option("basePath", self.path(table)).parquet(*paths) if paths else None

    def _with_context(self, kind: str, hours: Iterable[int], own: DataFrame) -> DataFrame | None:
        """The rows of ``kind`` in ``hours`` and those of the batch's connections in any other hour.

        Windows are decided by time, so the older rows don't enter them."""
        uids = own.select("uid").filter(~F.col("uid").isin(*NO_UID)).distinct()
        parts = [p for p in (self.history.near(kind, hours), self.history.far(kind, uids, hours)) if p is not None]
        return reduce(DataFrame.unionByName, map(_ordered, parts)) if parts else None

    def expire(self, before: float) -> int:
        """Delete the history of all hours that end before the time ``before``; returns how many folders went.

        Later windows and uid lookups don't see those rows, so keep at least ``HORIZON_SECONDS`` and as much as the
        longest connection whose context matters. Call it between batches."""
        return self.history.expire(int(before // BUCKET_SECONDS))

    def _land(self, batch: DataFrame, batch_id: int) -> tuple[list[int], float | None]:
        """Parse the batch, store its rows by kind; returns the hours of its flows and the median flow time before it."""
        number = F.lit(batch_id)
        rows = Z.parsed(Z.with_place(batch)).withColumn("kind", kind_of()).filter(F.col("kind").isin(LOG_KINDS))
        seen, began = Observation(), time.monotonic()
        self._replace(rows.observe(seen, *poll_summary()).withColumn("batch_id", number), "bronze", "batch_id", "kind")
        bronze = self._read("bronze", f"batch_id={batch_id}")
        if bronze is None:
            bronze = rows.limit(0)
        bad = bronze.filter(F.col("reason").isNotNull())
        self._replace(bad.select("file", F.col("seq.line").alias("line"), F.col("value").alias("text"), "reason", "kind")
                      .withColumn("batch_id", number), "quarantine", "batch_id")
        good = bronze.filter(F.col("reason").isNull()).select("kind", "seq", F.map_from_arrays("fields", "cells").alias("record"))
        counts = seen.get
        self.history.begin(batch_id)
        hours, median = [], None
        for kind in FEATURE_KINDS:
            records = good.filter(F.col("kind") == kind).drop("kind")
            typed = Z.silver({"conn": records})["conn"] if kind == "conn" else Z.typed_aux(records, kind)
            landed = self.history.land(kind, typed.withColumn("bucket", F.floor(F.col("ts") / BUCKET_SECONDS)), counts[f"{kind}_count"])
            if kind == "conn" and landed:
                hours, median = landed, self.history.own(kind).agg(F.percentile_approx("ts", 0.5)).first()[0]
        self.history.commit()
        last = self._read("summary", f"batch_id={batch_id - 1}")
        before = None if last is None else last.agg(F.max("median_ts")).first()[0]
        summary = self.spark.createDataFrame([tuple(counts.values())], ", ".join(f"{c} long" for c in counts))
        summary = summary.withColumn("median_ts", F.lit(before if median is None else median).cast("double"))
        self._replace(summary.withColumn("batch_id", number), "summary", "batch_id")
        self._report(batch_id, counts["total_records"], counts["flows_count"], 0, began)
        return hours, before

    def _report(self, batch_id: int, records: int, flows: int, alerts: int, began: float) -> None:
        """Rows in and out of a batch and the seconds they took: a row for landing, a row for scoring."""
        row = (batch_id, "score" if alerts else "land", records, flows, alerts, time.monotonic() - began)
        columns = "batch_id long, step string, records long, flows long, alerts long, seconds double"
        self._replace(self.spark.createDataFrame([row], columns), "progress", "batch_id", "step")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch, as called by ``foreachBatch``."""
        hours, before = self._land(batch, batch_id)
        if not hours:
            return
        own = _ordered(self.history.own("conn"))
        reached = sorted({h - back for h in hours for back in (0, 1)})  # an hour holds more than the horizon
        logs = {"conn": _ordered(self.history.near("conn", reached))}
        logs |= {k: self._with_context(k, reached, own) for k in FEATURE_KINDS if k != "conn"}
        scratch: list[str] = []

        def stage(df: DataFrame, by: Iterable[str] = ()) -> DataFrame:
            scratch.append(self.path(f"scratch/{batch_id}-{len(scratch)}"))
            with shuffles_let_go(df.sparkSession):
                df.write.mode("overwrite").partitionBy(*by).parquet(scratch[-1])
            return self.spark.read.schema(df.schema).parquet(scratch[-1])

        present = {k: v for k, v in logs.items() if v is not None}
        matrix = A.feature_matrix(present, slot_seconds=self.slot_seconds, targets=own, stage=stage)
        late = F.lit(False) if before is None else F.col("timestamp") < F.lit(before - self.late_after)
        self._replace(matrix.withColumn("late", late).withColumn("batch_id", F.lit(batch_id)), "features", "batch_id")
        for path in scratch:
            delete(self.spark, path)
        self._alert(batch_id)

    def _alert(self, batch_id: int) -> None:
        """Score the stored features of a batch, store its alerts and tell the subscribers."""
        stored = self._read("features", f"batch_id={batch_id}").drop("batch_id", "late")
        alerts = encode_alerts(A.alert_rows(scored_or_rejected(stored, self.scorer)))
        seen, began = Observation(), time.monotonic()
        alerts = alerts.observe(seen, F.count(F.lit(1)).alias("alerts"))
        self._replace(alerts.drop("alert_date").withColumn("batch_id", F.lit(batch_id)), "alerts", "batch_id")
        self._report(batch_id, 0, 0, seen.get["alerts"], began)
        written = self._read("alerts", f"batch_id={batch_id}")
        for subscriber in self.subscribers:
            try:
                subscriber(written, batch_id)
            except Exception:  # noqa: BLE001 - one subscriber must not stop the stream or the others
                log.exception("alert subscriber failed on batch %s", batch_id)

    def start(self, directory: str, continuous_every: str | None = None, max_files_per_trigger: int | None = None,
              names: str = "*.log") -> StreamingQuery:
        """Run over ``directory``: everything available and stop, or every ``continuous_every`` (e.g. ``1 second``)."""
        writer = log_lines(self.spark, directory, max_files_per_trigger, names).writeStream.foreachBatch(self.process)
        writer = writer.option("checkpointLocation", self.path("checkpoint"))
        if continuous_every is None:
            return writer.trigger(availableNow=True).start()
        return writer.trigger(processingTime=continuous_every).start()


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows of later batches come after those of earlier ones."""
    return rows.withColumn("seq", F.struct("batch_id", "seq")) if "seq" in rows.columns else rows


def scored_or_rejected(features: DataFrame, scorer: Scorer) -> DataFrame:
    """Flows with ``probs``, or with an ``error`` where the features break the contract or the scorer gives no usable
    probabilities; no row is lost and no rejected row reaches the scorer."""
    valid, rejected = A.contract_split(features.withColumn("_array", A.feature_array()), "_array")
    scored = as_flows(scorer(valid.drop("_array")))
    unusable = F.col("probs").isNull() | (F.size("probs") != len(ACTIVE_CLASSES)) | F.exists("probs", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    known = F.col("error") if "error" in scored.columns else F.lit(None).cast("string")
    scored = scored.withColumn("error", F.coalesce(known, F.when(unusable, F.lit("scorer: no finite probabilities"))))
    scored = scored.withColumn("probs", F.when(F.col("error").isNull(), F.col("probs")))
    failed = as_flows(rejected.drop("_array").withColumn("error", F.concat(F.lit("contract: "), F.col("reason"))))
    failed = failed.withColumn("probs", F.lit(None).cast("array<double>")).withColumn("processing_time_ms", F.lit(0.0))
    return scored.unionByName(failed)


def as_flows(scored: DataFrame) -> DataFrame:
    """Scored feature rows -> the flow column names that alert rows are built from."""
    back = {c: n for n, c in A.IDENTITY.items()}
    counts = ("orig_bytes", "resp_bytes", "total_bytes")
    return scored.select(
        *[F.col(n).alias(c) for c, n in back.items()], F.col("flow_duration").alias("duration"),
        *[F.col(c).cast("long").alias(c) for c in counts],
        *[c for c in ("probs", "processing_time_ms", "error") if c in scored.columns],
    )


def running_telemetry(spark: SparkSession, alerts_path: str) -> DataFrame:
    """Streaming session counters over the growing alert table (use ``complete`` output mode)."""
    schema = spark.read.parquet(alerts_path).schema
    return session_counters(spark.readStream.schema(schema).parquet(alerts_path))

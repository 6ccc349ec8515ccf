"""Sliding-window totals and neighbour lookups that survive hot keys.

A Spark RANGE frame re-reads its whole frame for every row and keeps a key in one
task, so one busy host makes it quadratic. The operators here use three facts
instead:

* rows of one key at one instant are interchangeable, so they are added up first
  (with map-side combine); copies of a row therefore cost nothing downstream;
* a backward window ``[t-h, t]`` is a running total in which every row enters at
  ``t`` and leaves just after ``t+h``, so one running sum answers every horizon;
* a running sum splits into time slots: totals per slot are tiny and are carried into
  the next slot as one extra row. A task holds one (key, slot), at most one row per
  distinct instant in it, however many rows the key has.

All totals are integers or decimals, so adding and removing leaves no residue.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SLOT_SECONDS = 60.0
_ENTER = 1
TIE = "tie"  # order among rows of one key at one instant; constant unless arrival order counts


def _slot(position: str, slot_seconds: float) -> Column:
    return F.floor(F.col(position) / F.lit(float(slot_seconds)))


def neighbours(
    instants: DataFrame, keys: Sequence[str], ts: str = "ts", slot_seconds: float = DEFAULT_SLOT_SECONDS
) -> DataFrame:
    """Add ``prev_ts`` / ``next_ts`` per key. ``(keys, ts[, tie])`` must be unique and not null."""
    keys = list(keys)
    ties = [TIE] if TIE in instants.columns else []
    slotted = instants.withColumn("_slot", _slot(ts, slot_seconds)).withColumn("_mark", F.lit(False))
    ends = slotted.groupBy(*keys, "_slot").agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    over_slots = Window.partitionBy(*keys).orderBy("_slot")
    ends = ends.select(
        *keys, "_slot",
        F.lag("_hi").over(over_slots).alias("_before"), F.lead("_lo").over(over_slots).alias("_after"),
    )
    # The last instant before a slot and the first one after it join the slot as marker rows.
    markers = (
        ends.select(*keys, "_slot", F.explode(F.array("_before", "_after")).alias(ts))
        .filter(F.col(ts).isNotNull())
        .withColumn("_mark", F.lit(True))
    )
    within = Window.partitionBy(*keys, "_slot").orderBy(ts, *ties)
    return (
        slotted.unionByName(markers, allowMissingColumns=True)
        .withColumn("prev_ts", F.lag(ts).over(within))
        .withColumn("next_ts", F.lead(ts).over(within))
        .filter(~F.col("_mark"))
        .drop("_slot", "_mark")
    )


def follows_within(horizon: float, ts: str = "ts") -> str:
    """True when the previous instant of the key is still inside ``[ts-horizon, ts]``; SQL."""
    return f"coalesce(prev_ts >= {ts} - {float(horizon)}D, false)"


def followed_within(horizon: float, ts: str = "ts") -> str:
    """True when this instant is still inside the window of the next one; SQL."""
    return f"coalesce({ts} >= next_ts - {float(horizon)}D, false)"


def steps(
    key: dict[str, str],
    types: dict[str, str],
    enters: dict[str, str],
    leaves: dict[float, dict[str, str]],
    tie: str,
    ts: str = "ts",
) -> list[str]:
    """The signed movements of one row as structs ``(key, pos, rank, tie, measures)``, in SQL: one expression instead of hundreds of columns.

    ``enters`` is what a row adds at ``ts``; ``leaves[h]`` is what goes away once ``ts``
    has dropped out of ``[t-h, t]``; measures of ``types`` that are not named move by 0.
    ``rank`` orders movements at the same position: a departure happens after the arrivals at
    ``ts+h`` (both window ends are inclusive), unless ``ts+h`` was rounded up past the true edge.
    Arrivals at one instant are further ordered by ``tie``.
    """
    def step(pos: str, rank: str, order: str, values: dict[str, str], sign: str) -> str:
        cells = [f"'{n}', cast({sign}({values[n]}) as {kind})" if n in values else f"'{n}', cast(0 as {kind})" for n, kind in types.items()]
        keys = [f"'{n}', {c}" for n, c in key.items()]
        return f"named_struct({', '.join([*keys, f"'pos', cast({pos} as double)", f"'rank', {rank}", f"'{TIE}', cast({order} as bigint)", *cells])})"

    out = [step(ts, str(_ENTER), tie, enters, "")]
    for h, gone in leaves.items():
        edge = f"({ts} + {float(h)}D)"
        out.append(step(edge, f"CASE WHEN {edge} - {float(h)}D > {ts} THEN 0 ELSE 2 END", "0", gone, "-"))
    return out


def running_totals(
    movements: DataFrame, keys: Sequence[str], slot_seconds: float = DEFAULT_SLOT_SECONDS,
    stage: Callable[..., DataFrame] = lambda df: df,
) -> DataFrame:
    """Totals in force at every arrival instant: ``(keys, ts, tie, measures)``, one row per instant.

    The movements added up per instant are read twice, for the sums of the slots and inside them; ``stage`` may write them.
    """
    keys = list(keys)
    measures = [c for c in movements.columns if c not in (*keys, "pos", "rank", TIE)]
    types = dict(movements.dtypes)

    def total(m: str) -> Column:
        return F.sum(m).cast(types[m]).alias(m)

    at = movements.groupBy(*keys, "pos", "rank", TIE).agg(*[total(m) for m in measures])
    slotted = stage(at.withColumn("_slot", _slot("pos", slot_seconds)))
    per_slot = slotted.groupBy(*keys, "_slot").agg(*[total(m) for m in measures])
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_slot.select(
        *keys, "_slot",
        F.lit(None).cast("double").alias("pos"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias(TIE),
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).cast(types[m]).alias(m) for m in measures],
    )
    upto = (
        Window.partitionBy(*keys, "_slot")
        .orderBy(F.col("pos").asc_nulls_first(), "rank", TIE)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        slotted.unionByName(carry)
        .select(*keys, "pos", "rank", TIE, *[F.sum(m).over(upto).cast(types[m]).alias(m) for m in measures])
        .filter(F.col("pos").isNotNull() & (F.col("rank") == _ENTER))
        .select(*keys, F.col("pos").alias("ts"), TIE, *measures)
    )


def numbered(
    rows: DataFrame, keys: Sequence[str], ts: str, tie_breakers: Sequence[str],
    slot_seconds: float, name: str = "position",
) -> DataFrame:
    """1-based chronological position per key plus ``group_size``, without a one-task sort.

    Slot counts give every slot its starting offset; rows are numbered inside their slot.
    """
    keys = list(keys)
    slotted = rows.withColumn("_slot", _slot(ts, slot_seconds))
    counts = slotted.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = counts.select(
        *keys, "_slot",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(whole).alias("group_size"),
    )
    within = Window.partitionBy(*keys, "_slot").orderBy(ts, *tie_breakers)
    return (
        slotted.join(offsets, [*keys, "_slot"])
        .withColumn(name, F.row_number().over(within) + F.col("_offset"))
        .drop("_slot", "_offset")
    )

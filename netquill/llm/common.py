"""Helpers of the corpus operators: shared scratch tables, row keys and byte-level text views."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six bytes that separate words: space and 0x09 to 0x0D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_local_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that every executor reads: ``spark.checkpoint.dir``. A local master may do without that setting."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="netquill-"))
    return f"file://{_local_root[0]}"


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver did. On a cluster it is installed or sent along."""
    root, environment = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table; only called on paths made by :func:`scratch_path`."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        remove(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark)}/corpus-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_at_exit, spark, path)
    return path


def written(df: DataFrame, name: str, held: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors and
    fixes whatever depends on the order of a partition. ``held`` notes the path under the name, for :func:`drop`."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if held is not None:
        held[name] = path
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Collect the driver's garbage, so that Spark removes the shuffle files of finished jobs now and not whenever the driver runs out of heap.
    Once more after a pause: news of the last job, on their way to Spark's listeners, still hold its plan."""
    for pause in (0, 0.5):
        time.sleep(pause)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, held: dict[str, str], *names: str) -> None:
    """Delete the named tables of ``held``, which nothing reads any more, and the shuffle files of finished jobs."""
    for name in names:
        remove(spark, held.pop(name))
    let_go(spark)


def row_key(key: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that name a row by its id and its whole text. Rows equal in both share the key, which no operator minds:
    whatever is found for one of them holds for the other."""
    return F.xxhash64(key, text), F.xxhash64(F.lit(7), text, key)


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def combined(states: DataFrame, combine: Callable[[list[bytes]], bytes], name: str, group: int = 16) -> bytes | None:
    """One state from a table (part, state) with a state for each partition, ``group`` at a time in a tree: no task holds more than that,
    and only the last state reaches the driver. None for an empty table."""

    def merge(rows: pa.Table) -> pa.Table:
        merged = combine([x.as_py() for x in rows.column("state")])
        return pa.table({"part": rows.column("next")[:1], "state": pa.array([merged], pa.binary())})

    spark, last = states.sparkSession, None
    while True:
        path = scratch_path(spark, name)
        states.write.parquet(path)
        if last is not None:
            remove(spark, last)
        states, last = spark.read.schema(states.schema).parquet(path), path
        if states.count() <= 1:
            break
        states = states.withColumn("next", F.floor(F.col("part") / group)).groupBy("next").applyInArrow(merge, "part long, state binary")
    found = states.select("state").first()
    remove(spark, last)
    return None if found is None else bytes(found[0])


# --- bytes of an Arrow string column -------------------------------------------------------------------------------


def text_chunks(column, limit: int):
    """Cut an Arrow string column into runs of whole texts of at most ``limit`` bytes (one text at least).

    Yields (first row, bytes as uint8, offsets); nulls are empty. Nothing is copied for a run.
    """
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return
    _, offsets_buffer, data = column.buffers()
    offsets = np.frombuffer(offsets_buffer, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
LOWER_ASCII = _lower
_is_space = np.zeros(256, dtype=bool)
_is_space[list(SPACES)] = True
IS_SPACE = _is_space


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(seed: int, n: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers for a seed."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_BYTE_VALUES = random_words(11, 256)


class PowerTable:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def at_least(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, np.uint64(b), dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))


FIRST, SECOND = PowerTable(BASE), PowerTable(0x9FB21C651E98DF25)


def prefix_hashes(data: np.ndarray, table: PowerTable = FIRST) -> np.ndarray:
    """h[i] = sum over j < i of value(byte j) * base**j modulo 2**64."""
    table.at_least(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * table.up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, table: PowerTable = FIRST) -> np.ndarray:
    """64-bit hash of each byte span [start, end): depends on its bytes and its length only."""
    table.at_least(len(prefix))
    with np.errstate(over="ignore"):
        return mix64((prefix[end] - prefix[start]) * table.down[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words of all texts; words never cross from one text into the next."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = ~IS_SPACE[data]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins[edges] = letter[edges]
    ends = letter.copy()
    ends[:-1] &= ~letter[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    ends[last] = letter[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1

"""Kept log rows of a live run, in levelled runs with a manifest, so that a batch neither lists nor scans what it can't need.

Every batch writes one run per log kind: Parquet files by hour. As soon as a level holds ``fan`` runs, they are rewritten as one run of
the next level, so the number of runs grows with the logarithm of the number of batches. The manifest names every live file with its
hour and the size of its uid filter; each batch writes a new one, which is the batch's commit, and no folder that grows
with the history is ever listed.

A filter is a blocked Bloom filter kept as rows (file, word, bits): four bits of one 64-bit word for each uid, about sixteen bits a row.
A lookup by uid joins the batch's words with the words of the filters, so it is distributed like any join; what reaches the driver are
names of files. Only those files are opened.

A replayed batch overwrites its own run and starts from the manifest before it. Files that a compaction replaced stay for two more
batches, as a replay may still need them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquill.sources.stage import shuffles_let_go
from netquill.sources.zeek import existing

#: Log2 of the smallest filter; a filter has a word for each ROWS_A_WORD rows of the file.
LEAST_WORDS, ROWS_A_WORD = 4, 4
_MANIFEST = "kind string, level int, run string, bucket long, file string, rows long, words int, gone_since long"


@dataclass(frozen=True)
class Entry:
    """One file; ``rows`` are those of its run, ``words`` is the logarithm of its filter's size, ``gone_since`` the batch that replaced it."""

    kind: str
    level: int
    run: str
    bucket: int
    file: str
    rows: int
    words: int
    gone_since: int | None = None


def _word_and_bits(uid: str, words: Column) -> tuple[Column, Column]:
    name = F.xxhash64(uid)
    bits = [f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({uid}), {40 + 6 * i}) & 63 as int))" for i in range(4)]
    return name.bitwiseAND(F.pow(F.lit(2.0), words).cast("long") - 1), F.expr(" | ".join(bits))


def delete(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True))


class History:
    """Rows of each kind below ``root``, as seen by one batch after another: ``begin``, ``land`` for every kind, ``commit``."""

    def __init__(self, spark: SparkSession, root: str, kinds: Iterable[str], fan: int = 8, file_rows: int = 1_000_000):
        self.spark, self.root, self.kinds, self.fan, self.file_rows = spark, root.rstrip("/"), tuple(kinds), fan, file_rows
        self.batch_id = -1
        self.entries: list[Entry] = []
        #: Files of the last lookups: kind -> (live files, files read for their hour, files read for a uid).
        self.opened: dict[str, tuple[int, int, int]] = {}

    # --- manifest --------------------------------------------------------------------------------------------------

    def _manifests(self) -> list[tuple[int, int, str]]:
        """(batch, revision, path) of the kept manifests, oldest first: those of the last three batches and their revisions."""
        found = [p.rsplit("/", 2)[-2] for p in existing(self.spark, f"{self.root}/manifest/*/_SUCCESS")]
        return sorted((int(n.split(".")[0]), int(n.split(".")[1]), f"{self.root}/manifest/{n}") for n in found)

    def _load(self, before: int | None = None) -> None:
        kept = [m for m in self._manifests() if before is None or m[0] < before]
        self.entries = [Entry(**r.asDict()) for r in self.spark.read.schema(_MANIFEST).parquet(kept[-1][2]).collect()] if kept else []

    def _store(self, entries: list[Entry], batch: int, revision: int) -> None:
        rows = [tuple(vars(e).values()) for e in entries]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/{batch:012d}.{revision:06d}")

    # --- writing ---------------------------------------------------------------------------------------------------

    def begin(self, batch_id: int) -> None:
        """Start (or start again) a batch from the last manifest before it."""
        self.batch_id, self.opened = batch_id, {}
        self._load(before=batch_id)

    def _path(self, kind: str) -> str:
        return f"{self.root}/{kind}"

    def _run(self, rows: DataFrame, kind: str, level: int, count: int) -> list[Entry]:
        """Write one run of ``count`` rows, which have a ``bucket``, and its filters."""
        run = f"L{level}-{self.batch_id}"
        folder = f"{self._path(kind)}/run={run}"
        dealt = rows.hint("rebalance", F.col("bucket"))
        with shuffles_let_go(dealt.sparkSession):
            dealt.write.mode("overwrite").option("maxRecordsPerFile", self.file_rows).partitionBy("bucket").parquet(folder)
        files = existing(self.spark, f"{folder}/bucket=*/part-*")
        if not files:
            delete(self.spark, folder)
            return []
        words = max(LEAST_WORDS, (min(count, self.file_rows) // ROWS_A_WORD).bit_length())
        word, bits = _word_and_bits("uid", F.lit(words))
        name = F.concat(F.lit(f"{run}/"), F.col("bucket").cast("string"), F.lit("/"), F.col("_metadata.file_name"))
        named = self.spark.read.schema(rows.schema).parquet(folder).select(name.alias("file"), "uid")
        filters = named.select("file", word.alias("word"), bits.alias("bits")).groupBy("file", "word").agg(F.bit_or("bits").alias("bits"))
        with shuffles_let_go(filters.sparkSession):
            filters.hint("rebalance").write.mode("overwrite").parquet(f"{self.root}/filters/{kind}/{run}")
        return [Entry(kind, level, run, int(f.split("/bucket=")[-1].split("/")[0]), f, count, words) for f in files]

    def land(self, kind: str, rows: DataFrame, count: int) -> list[int]:
        """Store the batch's ``count`` rows of a kind; returns their hours."""
        if not count:
            return []
        new = self._run(rows.withColumn("batch_id", F.lit(self.batch_id)), kind, 0, count)
        self.entries += new
        return sorted({e.bucket for e in new})

    def _compact(self, kind: str) -> None:
        level = 0
        while len(runs := {e.run for e in self.live(kind) if e.level == level}) >= self.fan:
            old = [e for e in self.live(kind) if e.run in runs]
            count = sum({e.run: e.rows for e in old}.values())
            merged = self._run(self._read(kind, old), kind, level + 1, count)
            gone = {e.file for e in old}
            self.entries = [replace(e, gone_since=self.batch_id) if e.kind == kind and e.file in gone else e for e in self.entries] + merged
            level += 1

    def commit(self) -> None:
        """Compact, forget what two batches ago was replaced, and write the manifest: the batch is in the history from here on."""
        for kind in self.kinds:
            self._compact(kind)
        stale = {(e.kind, e.run) for e in self.entries if e.gone_since is not None and e.gone_since <= self.batch_id - 2}
        for kind, run in stale:
            delete(self.spark, f"{self._path(kind)}/run={run}")
            delete(self.spark, f"{self.root}/filters/{kind}/{run}")
        self.entries = [e for e in self.entries if (e.kind, e.run) not in stale]
        self._store(self.entries, self.batch_id, max((r + 1 for b, r, _ in self._manifests() if b == self.batch_id), default=0))
        for batch, _, path in self._manifests():
            if batch < self.batch_id - 2:
                delete(self.spark, path)

    def expire(self, hours_before: int) -> int:
        """Delete all rows of hours under ``hours_before``; returns how many (run, hour) folders went.

        Every manifest that a replay may start from is written anew before the files go."""
        newest = {batch: (revision, path) for batch, revision, path in self._manifests()}
        folders: set[tuple[str, str, int]] = set()
        for batch, (revision, path) in newest.items():
            entries = [Entry(**r.asDict()) for r in self.spark.read.schema(_MANIFEST).parquet(path).collect()]
            old = [e for e in entries if e.bucket < hours_before]
            folders |= {(e.kind, e.run, e.bucket) for e in old}
            if old:
                self._store([e for e in entries if e.bucket >= hours_before], batch, revision + 1)
        for kind, run, bucket in folders:
            delete(self.spark, f"{self._path(kind)}/run={run}/bucket={bucket}")
        self._load()
        return len(folders)

    # --- reading ---------------------------------------------------------------------------------------------------

    def live(self, kind: str) -> list[Entry]:
        return [e for e in self.entries if e.kind == kind and e.gone_since is None]

    def _read(self, kind: str, entries: Iterable[Entry]) -> DataFrame | None:
        files = sorted({e.file for e in entries})
        return self.spark.read.option("basePath", self._path(kind)).parquet(*files).drop("run") if files else None

    def own(self, kind: str) -> DataFrame | None:
        """The rows of the batch itself."""
        return self._read(kind, [e for e in self.entries if e.kind == kind and e.run == f"L0-{self.batch_id}"])

    def near(self, kind: str, hours: Iterable[int]) -> DataFrame | None:
        """All rows of these hours."""
        wanted = set(hours)
        found = [e for e in self.live(kind) if e.bucket in wanted]
        self.opened[kind] = (len(self.live(kind)), len(found), 0)
        return self._read(kind, found)

    def holding(self, kind: str, uids: DataFrame, besides: Iterable[int]) -> list[Entry]:
        """The files outside the hours ``besides`` whose filter may hold one of ``uids``."""
        left = set(besides)
        far = {f"{e.run}/{e.bucket}/{e.file.rsplit('/', 1)[1]}": e for e in self.live(kind) if e.bucket not in left}
        if not far:
            return []
        sizes = sorted({e.words for e in far.values()})
        asked = uids.select("uid", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("words"))
        word, bits = _word_and_bits("uid", F.col("words"))
        asked = asked.select("words", word.alias("word"), bits.alias("asked")).distinct()
        names = self.spark.createDataFrame([(name, e.words) for name, e in far.items()], "file string, words int")
        filters = self.spark.read.schema("file string, word long, bits long").parquet(*sorted({f"{self.root}/filters/{kind}/{e.run}" for e in far.values()}))
        met = filters.join(names, "file").join(asked, ["words", "word"])
        return [far[r["file"]] for r in met.filter(F.col("bits").bitwiseAND(F.col("asked")) == F.col("asked")).select("file").distinct().collect()]

    def far(self, kind: str, uids: DataFrame, besides: Iterable[int]) -> DataFrame | None:
        """The rows of ``uids`` outside the hours ``besides``, from the files that may hold them."""
        found = self.holding(kind, uids, besides)
        live, near, _ = self.opened.get(kind, (len(self.live(kind)), 0, 0))
        self.opened[kind] = (live, near, len(found))
        rows = self._read(kind, found)
        return None if rows is None else rows.join(uids, "uid", "left_semi")

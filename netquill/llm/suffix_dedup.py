"""Repeated passages by a logarithmic family of suffix arrays.

Every window of ``length`` bytes has one anchor: the place of its smallest hashed gram. Equal windows have equal anchors, so the suffixes
that begin at anchors, about one in ``(length - gram) / 2`` bytes, are all that an index needs. An index level is the suffix
array of some batches over these suffixes, cut after the gram and kept as sorted names with their numbers of suffixes. A new batch gets
its own array, is merge-scanned against the levels there are (equal names mean a common beginning), and joins the family: two levels
of equal size are merged into one of twice the size, so every suffix is merged a logarithmic number of times.

A name that occurs twice is only a candidate. What decides is the whole string that the windows of an anchor cover: where it occurs
twice, all its windows are repeated. The windows of the other candidates, at the edges of repeated passages, are compared in blocks,
and one by one only in the blocks that an edge runs through, always by 128 bits of their bytes. Everything is counted by keys with partial sums; no group is ever gathered in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import FIRST, SECOND, drop, let_go, prefix_hashes, remove, scratch_path, span_hashes, text_chunks, written

LENGTH = 200
GRAM = 64
BATCHES = 4
#: Windows that are compared together before single ones are.
BLOCK = 16
_CHUNK_BYTES = 1 << 20
_PLACE_BITS = 22  # of a chunk with its overlap


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """Runs of bytes of at most about a chunk: (bytes, offsets, row of the first text, place of the first byte in that text).

    Texts beyond a chunk are cut with an overlap of ``length - 1`` bytes, so that every window lies in one run."""
    if len(data) <= 2 * _CHUNK_BYTES:
        yield data, offsets, 0, 0
        return
    for start in range(0, len(data), _CHUNK_BYTES):  # one long text
        part = data[start : start + _CHUNK_BYTES + length - 1]
        yield part, np.array([0, len(part)]), 0, start
        if start + _CHUNK_BYTES + length - 1 >= len(data):
            return


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each anchor: text number, first and last window start and own place (within the run), gram name, name of the covered string."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return (none,) * 6
    prefix = prefix_hashes(data)
    at = np.arange(len(data) - gram + 1)
    names = span_hashes(prefix, at, at + gram)
    low = (names & ~np.uint64((1 << _PLACE_BITS) - 1)) | at.astype(np.uint64)
    size, reach = length - gram + 1, 1
    while reach * 2 <= size:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = size - reach
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    place = (low & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    inside = np.arange(len(place)) + length <= offsets[text + 1]
    window = np.flatnonzero(inside)
    if not len(window):
        return (none,) * 6
    new = np.append(True, (place[window][1:] != place[window][:-1]) | (text[window][1:] != text[window][:-1]) | (np.diff(window) != 1))
    first = window[new]
    last = window[np.append(np.flatnonzero(new)[1:] - 1, len(window) - 1)]
    return text[first], first, last, place[first], names[place[first]].view(np.int64), span_hashes(prefix, first, last + length).view(np.int64)


class SuffixFamily:
    """Levels of the index, one per size; ``add`` returns the names of a batch and of the levels that occur more than once."""

    def __init__(self) -> None:
        self.levels: dict[int, tuple[DataFrame, str]] = {}
        self.found: list[str] = []  # paths of what ``add`` returned

    @staticmethod
    def _sorted(names: DataFrame, label: str) -> tuple[DataFrame, str]:
        path = scratch_path(names.sparkSession, label)
        names.sortWithinPartitions("name").write.parquet(path)
        return names.sparkSession.read.schema(names.schema).parquet(path), path

    def add(self, names: DataFrame) -> DataFrame:
        """``names``: one row per suffix of the batch (name)."""
        array, path = self._sorted(names.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "suffix-batch")
        repeated = array.filter(F.col("n") > 1).select("name")
        for level, _ in self.levels.values():
            repeated = repeated.unionByName(array.select("name").join(level.select("name"), "name"))
        held: dict[str, str] = {}
        repeated = written(repeated.distinct(), "suffix-repeated", held)
        self.found += held.values()
        size = 1
        while size in self.levels:
            other, old = self.levels.pop(size)
            merged, new = self._sorted(array.unionByName(other).groupBy("name").agg(F.sum("n").alias("n")), "suffix-level")
            for gone in (old, path):
                remove(names.sparkSession, gone)
            array, path, size = merged, new, size * 2
        self.levels[size] = (array, path)
        return repeated


def _source(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), F.xxhash64(whole).alias("text_key"), whole.alias("text"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """doc_id, text_key and spans: byte ranges [start, end) that strings of ``length`` bytes cover which start elsewhere, too.

    Ranges may overlap. Rows without any are absent. Rows that repeat id and text share one entry (they repeat each other).
    """
    spark = docs.sparkSession
    source = _source(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()
    row = ["doc_id", "text_key"]

    def found(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for first, data, offsets in text_chunks(b.column("text"), _CHUNK_BYTES):
                for run, at, number, base in _pieces(data, offsets, length):
                    t, low, high, place, name, cover = anchors(run, at, length, gram)
                    take = pa.array(t + first + number)
                    shift = base - at[t] if len(t) else 0
                    yield pa.record_batch([b.column("doc_id").take(take), b.column("text_key").take(take), pa.array(low + shift), pa.array(high + shift), pa.array(place + shift), pa.array(name), pa.array(cover)], [*row, "low", "high", "place", "name", "cover"])

    held: dict[str, str] = {}  # scratch tables, deleted as soon as nothing reads them any more
    let_go(spark)
    entries = source.mapInArrow(found, f"doc_id {kind}, text_key long, low long, high long, place long, name long, cover long")
    entries = entries.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(batches)))
    entries = written(entries, "suffix-anchors", held)

    family, names = SuffixFamily(), None
    for b in range(batches):
        more = family.add(entries.filter(F.col("batch") == b).select("name"))
        names = more if names is None else names.unionByName(more)
        let_go(spark)
    names = written(names.distinct(), "suffix-names", held)
    for old in (*(path for _, path in family.levels.values()), *family.found):
        remove(spark, old)
    open_ones = None
    for b in range(batches):  # one after the other, so that only a share of the anchors is shuffled at a time
        more = entries.filter(F.col("batch") == b).drop("batch").join(names, "name", "left_semi")
        more = written(more, f"suffix-open-{b}", held)
        open_ones = more if open_ones is None else open_ones.unionByName(more)
        let_go(spark)
    drop(spark, held, "suffix-anchors", "suffix-names")

    covers = open_ones.groupBy("name", "cover").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull(), *row, "low", "high", "place")).alias("one"))
    covers = written(covers, "suffix-covers", held)
    whole = open_ones.join(covers.filter(F.col("n") > 1).select("name", "cover"), ["name", "cover"], "left_semi")
    whole = written(whole.select(*row, F.col("low").alias("start"), (F.col("high") + length).alias("end")), "suffix-covered", held)
    drop(spark, held, *(f"suffix-open-{b}" for b in range(batches)))

    alone = F.col("n") == 1
    edges = covers.groupBy("name").agg(F.count(F.lit(1)).alias("kinds"), F.max(alone).alias("any")).filter((F.col("kinds") > 1) & F.col("any"))
    edges = covers.join(written(edges.select("name"), "suffix-edge-names", held), "name", "left_semi").select("one.*", alone.alias("alone"))
    edges = edges.groupBy(*row).agg(F.collect_list(F.struct("low", "high", "place", "alone")).alias("parts"))
    edges = written(edges.withColumnsRenamed({"doc_id": "d", "text_key": "t"}), "suffix-edges", held)
    drop(spark, held, "suffix-covers", "suffix-edge-names")
    texts = source.join(edges, (F.col("text_key") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")))
    texts = written(texts.select(*row, "text", "parts"), "suffix-edge-texts", held)
    drop(spark, held, "suffix-edges")

    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for i, data, (low, high, place, own) in _texts_with(b, "low", "high", "place", "alone"):
                for run, _, _, base in _pieces(data, np.array([0, len(data)]), length):
                    here = (low >= base) & (high + length <= base + len(run)) & ((low < base + _CHUNK_BYTES) | (len(run) == len(data)))
                    k0, k1 = ((x[here] - place[here]) // BLOCK for x in (low, high))
                    n = k1 - k0 + 1
                    which = np.repeat(np.flatnonzero(here), n)
                    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n - k0, n)
                    p = place[which] + k * BLOCK
                    a, z = np.maximum(p, low[which]), np.minimum(p + BLOCK - 1, high[which])
                    first, second = prefix_hashes(run, FIRST), prefix_hashes(run, SECOND)
                    core = span_hashes(first, p + BLOCK - 1 - base, p + length - base).view(np.int64)
                    w1, w2 = span_hashes(first, a - base, z + length - base).view(np.int64), span_hashes(second, a - base, z + length - base, SECOND).view(np.int64)
                    take = pa.array(np.full(len(a), i))
                    yield pa.record_batch([b.column("doc_id").take(take), b.column("text_key").take(take), pa.array(a), pa.array(z), pa.array(own[which].astype(bool)), pa.array(core), pa.array(w1), pa.array(w2)], [*row, "a", "z", "alone", "core", "w1", "w2"])

    # blocks of neighbouring windows: all of one are repeated if their whole string is, none if not even the part common to all is
    grouped = written(texts.mapInArrow(blocks, f"doc_id {kind}, text_key long, a long, z long, alone boolean, core long, w1 long, w2 long"), "suffix-blocks", held)
    twice = grouped.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("w1", "w2", F.lit(True).alias("whole"))
    grouped = written(grouped.join(written(twice, "suffix-whole", held), ["w1", "w2"], "left").withColumn("open", F.col("alone") & F.col("whole").isNull()).drop("w1", "w2"), "suffix-judged", held)
    drop(spark, held, "suffix-blocks", "suffix-whole")
    whole = whole.unionByName(grouped.filter(F.col("alone") & F.col("whole")).select(*row, F.col("a").alias("start"), (F.col("z") + length).alias("end")))
    cores = grouped.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("any")).filter((F.col("n") > 1) & F.col("any")).select("core")
    single = grouped.join(written(cores, "suffix-cores", held), "core", "left_semi").groupBy(*row).agg(F.collect_list(F.struct("a", "z", "open")).alias("ranges"))
    single = single.withColumnsRenamed({"doc_id": "d", "text_key": "t"})
    single = texts.drop("parts").join(single, (F.col("text_key") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")))

    def windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for i, data, (low, high, own) in _texts_with(b, "a", "z", "open"):
                for run, _, _, base in _pieces(data, np.array([0, len(data)]), length):
                    here = (low >= base) & (high + length <= base + len(run)) & ((low < base + _CHUNK_BYTES) | (len(run) == len(data)))
                    a, n = low[here], (high - low + 1)[here]
                    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - a, n)
                    local = at - base
                    w1, w2 = (span_hashes(prefix_hashes(run, t), local, local + length, t).view(np.int64) for t in (FIRST, SECOND))
                    take = pa.array(np.full(len(at), i))
                    yield pa.record_batch([b.column("doc_id").take(take), b.column("text_key").take(take), pa.array(at), pa.array(np.repeat(own[here], n).astype(bool)), pa.array(w1), pa.array(w2)], [*row, "at", "open", "w1", "w2"])

    seen = single.select(*row, "text", F.col("ranges").alias("parts")).mapInArrow(windows, f"doc_id {kind}, text_key long, at long, open boolean, w1 long, w2 long")
    seen = written(seen, "suffix-windows", held)
    drop(spark, held, "suffix-edge-texts", "suffix-cores")
    twice = seen.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("any")).filter((F.col("n") > 1) & F.col("any")).select("w1", "w2")
    hits = seen.filter("open").join(written(twice, "suffix-twice", held), ["w1", "w2"], "left_semi").select(*row, F.col("at").alias("start"), (F.col("at") + length).alias("end"))
    spans = written(whole.unionByName(hits).groupBy(*row).agg(F.collect_list(F.struct("start", "end")).alias("spans")), "suffix-spans")
    drop(spark, held, *held)
    return spans


def _texts_with(b: pa.RecordBatch, *fields: str):
    """Row number, bytes and the arrays of the fields of ``parts`` of each row of a batch."""
    for i in range(b.num_rows):
        struct = b.column("parts")[i].values
        yield i, np.frombuffer(b.column("text")[i].as_buffer(), np.uint8), [struct.field(n).to_numpy(zero_copy_only=False) for n in fields]


def _mask(n: int, spans) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    if spans is not None:
        values = spans.values
        np.add.at(step, values.field("start").to_numpy(), 1)
        np.add.at(step, values.field("end").to_numpy(), -1)
    return np.cumsum(step[:-1]) > 0


def _with_spans(docs: DataFrame, key: str, text: str, **options) -> DataFrame:
    """``docs`` with its spans in a struct column that no column of ``docs`` can clash with (see :func:`without_repeats`)."""
    spans = repeated_spans(docs, key, text, **options).withColumnsRenamed({"doc_id": "__d", "text_key": "__t", "spans": "__spans"})
    whole = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    boxed = docs.select(F.struct("*").alias("__row"), F.col(key).alias("__key"), whole.alias("__text_key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return boxed.join(spans, (F.col("__text_key") == F.col("__t")) & F.col("__key").eqNullSafe(F.col("__d")), "left")


def removal_report(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: what removing all repeated strings of 200 bytes leaves of each row.

    Texts count as UTF-8 bytes, null as empty; matches never cross texts; both copies of a repeat go, also within one text. A text
    shorter than ``length`` loses nothing. Rows that repeat an id and a text repeat each other. Other columns are not read; an
    empty table gives an empty result.
    """

    def report(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            out = []
            for value, spans in zip(b.column("text"), b.column("spans"), strict=True):
                data = np.frombuffer(value.as_buffer(), np.uint8) if value.as_buffer() is not None else np.zeros(0, np.uint8)
                gone = _mask(len(data), spans if spans.is_valid else None)
                out.append((len(data), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _with_spans(docs, key, text, **options).select(F.col("__key").alias("doc_id"), F.col("__text").alias("text"), F.col("__spans").alias("spans"))
    return rows.mapInArrow(report, f"doc_id {docs.schema[key].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated bytes cut out of its text, all other columns as they are. Of a character that a cut splits, nothing
    stays. A null text stays null. See :func:`removal_report` for the rest."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        out = []
        for t, s in zip(texts, spans, strict=True):
            if t is not None and s is not None and len(s):
                data = np.frombuffer(t.encode(), np.uint8)
                step = np.zeros(len(data) + 1, np.int64)
                np.add.at(step, np.fromiter((x["start"] for x in s), np.int64), 1)
                np.add.at(step, np.fromiter((x["end"] for x in s), np.int64), -1)
                t = data[np.cumsum(step[:-1]) <= 0].tobytes().decode("utf-8", "ignore")
            out.append(t)
        return pd.Series(out, dtype=object)

    rows = _with_spans(docs, key, text, **options)
    changed = F.when(F.col("__spans").isNotNull() & F.col("__row")[text].isNotNull(), cut(F.col("__row")[text], F.col("__spans"))).otherwise(F.col("__row")[text])
    rows = rows.select("__row", changed.alias("__cut"))
    return rows.select(*(F.col("__cut").alias(c) if c == text else F.col("__row")[c].alias(c) for c in docs.columns))

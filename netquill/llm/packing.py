"""Packing documents into sequences along a space-filling curve.

The words of a document are hashed into a vector, the vector is projected to a few dimensions by a fixed random matrix, and the place of
the projected point on a Hilbert curve is the document's sort key: neighbours on the curve are similar documents. The keys are
range-sorted into ranges of about equal size, and along the curve the token ids of a range are laid end to end and cut every
``length`` tokens, so sequences hold neighbouring documents and only a range's last tokens are left over. These are cut at powers of
two, which need no padding.

A first pass computes the keys, from which the exact borders of the ranges follow; the second one tokenises, sends each document to
its range and packs while it streams through the sorted range. Copies share a key: ties are broken by a hash of id and text, so that
even a key that a third of all documents have is dealt over many ranges.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import LOWER_ASCII, prefix_hashes, random_words, row_key, span_hashes, text_chunks, word_spans, written

LENGTH = 2048
END_ID = 1
#: Text bytes of a range; a range is one task's work and has at most one leftover.
RANGE_BYTES = 16 << 20
DIMENSIONS, BITS, BUCKETS = 4, 12, 256
_CHUNK_BYTES = 1 << 20


def _projection() -> np.ndarray:
    uniform = random_words(23, BUCKETS * DIMENSIONS).astype(np.float64) / 2.0**64
    return (uniform.reshape(BUCKETS, DIMENSIONS) - 0.5) * np.sqrt(12)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with whole coordinates of ``bits`` bits (rows x dimensions).

    The coordinates are turned into the curve's transposed index by undoing, from the highest bit down, the exchanges and inversions of
    each level, then by Gray coding; the bits are interleaved at the end.
    """
    x = points.astype(np.uint64).copy()
    n = x.shape[1]
    q = np.uint64(1) << np.uint64(bits - 1)
    while q > 1:
        low = q - np.uint64(1)
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap
        q >>= np.uint64(1)
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.uint64)
    q = np.uint64(1) << np.uint64(bits - 1)
    while q > 1:
        flip ^= np.where((x[:, n - 1] & q) != 0, q - np.uint64(1), np.uint64(0))
        q >>= np.uint64(1)
    x ^= flip[:, None]
    out = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << np.uint64(1)) | ((x[:, i] >> np.uint64(b)) & np.uint64(1))
    return out.astype(np.int64)


def curve_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The Hilbert key of each text from its hashed words; a text without words is the origin."""
    n = len(offsets) - 1
    low = LOWER_ASCII[data]
    start, end, text = word_spans(low, offsets)
    hashes = span_hashes(prefix_hashes(low), start, end)
    bucket = (hashes >> np.uint64(56)).astype(np.int64)
    sign = np.where((hashes & np.uint64(1)).astype(bool), 1.0, -1.0)
    vectors = np.bincount(text * BUCKETS + bucket, weights=sign, minlength=n * BUCKETS).reshape(n, BUCKETS)
    points = vectors @ _projection()
    points /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    grid = np.floor((np.tanh(points / 2) + 1) / 2 * (1 << BITS))
    return hilbert_keys(np.clip(grid, 0, (1 << BITS) - 1))


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _encoder(path: str):
    """Ids by the byte-level vocabulary at ``path``: its ids are the ranks of its merges, which the faster of the two libraries takes as
    they are. A text that spells a special token goes through the file's own tokenizer."""
    import tiktoken
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    whole = Tokenizer.from_file(path)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    letter = _byte_letters()
    ranks = {bytes(letter[c] for c in token): i for token, i in whole.get_vocab(with_added_tokens=False).items()}
    cut = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("byte-level", pat_str=cut, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [
            np.array(whole.encode(t, add_special_tokens=False).ids if any(s in t for s in special) else fast.encode_ordinary(t), dtype=np.uint32)
            for t in texts
        ]

    return encode


def _tail_cuts(left: int, length: int) -> list[int]:
    """Where a last sequence of ``left`` tokens is cut so that every part is a power of two."""
    cuts, at = [], 0
    bit = length
    while bit:
        if left & bit:
            at += bit
            cuts.append(at)
        bit >>= 1
    return cuts


def pack(
    docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID,
    range_bytes: int = RANGE_BYTES, with_ids: bool = False,
) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; also ids if asked for.

    A document is its ids and ``end_id``; an empty or null text is that one id. A sequence never exceeds ``length``; a document is cut
    wherever a sequence ends. Every sequence is full, but for at most one group per range whose sizes are powers of two. Rows that repeat
    an id are documents of their own. Other columns are not read. An empty table gives no pieces.
    """
    tie, _ = row_key(F.col(key), F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), tie.alias("tie"))
    kind = docs.schema[key].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in text_chunks(b.column("text"), _CHUNK_BYTES):
                n = len(offsets) - 1
                yield pa.record_batch([pa.array(curve_keys(data, offsets)), b.column("tie").slice(first, n), pa.array(np.diff(offsets))], ["curve", "tie", "bytes"])

    keys = written(rows.mapInArrow(keyed, "curve long, tie long, bytes long"), "pack-keys")
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    ranges = int(max(1, -(-total // range_bytes)))
    # one row per range comes back: its lowest key
    sorted_keys = keys.select("curve", "tie").repartitionByRange(ranges, "curve", "tie").withColumn("part", F.spark_partition_id())
    borders = sorted(tuple(r) for r in sorted_keys.groupBy("part").agg(F.min(F.struct("curve", "tie")).alias("low")).select("low.*").collect())[1:]
    low = np.array(borders, dtype=[("c", np.int64), ("t", np.int64)])

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        for b in batches:
            for first, data, offsets in text_chunks(b.column("text"), _CHUNK_BYTES):
                n = len(offsets) - 1
                curve, tie = curve_keys(data, offsets), b.column("tie").slice(first, n).to_numpy()
                own = np.empty(n, dtype=low.dtype)
                own["c"], own["t"] = curve, tie
                place = np.searchsorted(low, own, side="right").astype(np.int32) if len(low) else np.zeros(n, np.int32)
                ids = encode(b.column("text").slice(first, n).to_pylist())
                raw = [np.append(i, np.uint32(end_id)).astype("<u2" if i.max(initial=0) < 65536 else "<u4") for i in ids]
                yield pa.record_batch(
                    [b.column("doc_id").slice(first, n), pa.array(place), pa.array(curve), b.column("tie").slice(first, n), pa.array([r.itemsize for r in raw], pa.int32()), pa.array([r.tobytes() for r in raw], pa.binary())],
                    ["doc_id", "part", "curve", "tie", "width", "ids"],
                )

    sent = rows.mapInArrow(tokenised, f"doc_id {kind}, part int, curve long, tie long, width int, ids binary")
    sent = sent.repartition(ranges, "part").sortWithinPartitions("part", "curve", "tie", "doc_id", "ids")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    types = [kind, "long", "long", "long", "long", "long", "long"] + ["array<int>"] * with_ids

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, used, open_pieces, out = None, 0, 0, [], []

        def close(final: bool) -> None:
            """Put the open sequence out; a last one is cut at powers of two."""
            nonlocal number, used, open_pieces
            cuts = _tail_cuts(used, length) if final else [used]
            at, left = 0, list(open_pieces)
            for cut in cuts:
                offset = 0
                while left and at < cut:
                    doc, start, ids, tokens = left.pop(0)
                    if at + len(ids) > cut:
                        left.insert(0, (doc, start + cut - at, ids[cut - at :], tokens))
                        ids = ids[: cut - at]
                    four = ids.astype("<u4")
                    out.append((doc, start, len(ids), zlib.crc32(four), tokens, (part << 40) + number, offset, *([four.astype(np.int32)] * with_ids)))
                    offset, at = offset + len(ids), at + len(ids)
                number += 1
            used, open_pieces = 0, []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow_types, strict=True)]
            out.clear()
            return pa.record_batch(columns, names)

        arrow_types = None
        for b in batches:
            arrow_types = [b.column("doc_id").type, *[pa.int64()] * 6, *[pa.list_(pa.int32())] * with_ids]
            for doc, p, width, raw in zip(b.column("doc_id").to_pylist(), b.column("part").to_pylist(), b.column("width").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if p != part:
                    if part is not None:
                        close(final=True)
                    part, number = p, 0
                ids = np.frombuffer(raw, "<u2" if width == 2 else "<u4")
                at = 0
                while at < len(ids):
                    piece = ids[at : at + length - used]
                    open_pieces.append((doc, at, piece, len(ids)))
                    used, at = used + len(piece), at + len(piece)
                    if used == length:
                        close(final=False)
            if len(out) > 5000:
                yield flush()
        if part is not None:
            close(final=True)
        if out:
            yield flush()

    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))
    return sent.mapInArrow(packed, schema)

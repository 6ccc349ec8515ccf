"""Sampled subword segmentation over the piece lattice, and lossless decoding.

The vocabulary file gives the pieces; the lattice of a text has an arc for every occurrence of a piece, and the bytes of a character that
no piece spells alone are arcs of their own. Forward filtering sums the weights of all paths to each place, backward sampling then
draws a path from the end with probability in proportion to its weight. The draws are a hash of the row key, of the segment and
of the step, so a row is cut alike in every run, on every executor and beside any other rows.

A blank occurs at the start of a piece only, or in pieces of blanks alone, so no piece crosses from other characters into a blank and
the lattice falls apart into segments: equal segments of a batch share one lattice, and the sampling runs for all occurrences at once.
Choices are made on whole numbers (probabilities in units of 2**-32), so they do not depend on what else is in the batch.
The text is taken byte by byte as it is: no normalisation, no added blank, hence decoding gives back exactly the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import mix64, prefix_hashes, span_hashes, text_chunks

_CHUNK_BYTES = 2 << 20
#: Weight of a byte arc; below that of every piece.
_BYTE_WEIGHT = 1e-7
_UNITS = 2.0**32


class Pieces:
    """The pieces of a model file as bytes, their weights 1 / (rank + 10) ** alpha, and a trie of them: ``below`` has a row of 256 for each of
    the first ``inner`` nodes (0: no such node), ``piece`` the piece that ends at a node or -1, ``one`` the pieces of one character."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.raw: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int64)
        score = np.array([model.get_score(i) for i in range(n)])
        usable = np.zeros(n, bool)
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.raw[i], self.byte_id[value] = bytes([value]), i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.raw[i], usable[i] = model.id_to_piece(i).replace("▁", " ").encode(), True
        self.objects = np.array(self.raw, dtype=object)
        rank = np.empty(n)
        rank[np.argsort(-score, kind="stable")] = np.arange(n)
        self.log_weight = -alpha * np.log(rank + 10)
        self.log_weight[self.byte_id] = np.log(_BYTE_WEIGHT) * alpha
        self.one = np.array([sum(c & 0xC0 != 0x80 for c in raw) == 1 for raw in self.raw])
        arcs: dict[int, int] = {}
        named: dict[int, int] = {}
        for i in np.flatnonzero(usable).tolist():
            node = 0
            for c in self.raw[i]:
                node = arcs.setdefault(node << 8 | c, len(arcs) + 1)
            named.setdefault(node, i)
        above, byte = np.divmod(np.fromiter(arcs, np.int64, len(arcs)), 256)
        inner = np.zeros(len(arcs) + 1, bool)
        inner[0] = inner[above] = True
        self.inner = int(inner.sum())
        number = np.where(inner, np.cumsum(inner) - 1, self.inner + np.cumsum(~inner) - 1)
        self.below = np.zeros(self.inner << 8, np.int32)
        self.below[number[above] << 8 | byte] = number[1:]
        self.piece = np.full(len(arcs) + 1, -1, np.int64)
        self.piece[number[list(named)]] = list(named.values())


@lru_cache(maxsize=2)
def load(path: str, alpha: float = 1.0) -> Pieces:
    return Pieces(path, alpha)


def _segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the independent segments: a cut before a run of blanks, and around a line end."""
    blank, line = data == 0x20, data == 0x0A
    cut = np.zeros(len(data), bool)
    cut[1:] = (blank[1:] & ~blank[:-1]) | line[1:] | line[:-1]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], len(data))


class Lattice:
    """The lattices of distinct segments, longest first. Node (t, s): place t of segment s, numbered by place, then segment."""

    def __init__(self, p: Pieces, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        length = end - start
        most = int(length.max())
        reach = np.searchsorted(-length, -np.arange(most + 2), side="right")  # segments of at least t bytes
        self.base = np.concatenate([[0], np.cumsum(reach[:-1])])
        place = np.repeat(np.arange(most), reach[1:-1])  # the bytes in the order of the nodes they follow
        shift = np.concatenate([[0], np.cumsum(reach[1:-1])])
        own = np.arange(len(place)) - shift[place]
        at = start[own] + place
        byte, heads = data[at], np.append((data & 0xC0) != 0x80, True)
        begins, last = heads[at], heads[at + 1] | (own >= reach[place + 2])
        begins[: reach[0]] = True
        single = np.zeros(len(at), bool)
        froms, tos, ids = [], [], []
        tail = np.flatnonzero(begins)
        row, goal, node = own[tail], place[tail], np.zeros(len(tail), np.int64)
        while len(tail):  # all pieces of n bytes, then of n + 1; a place is dropped where no piece goes on
            here = shift[goal] + row
            node = p.below[node << 8 | byte[here]]
            found = p.piece[node]
            hit = np.flatnonzero(found >= 0)
            goal += 1
            froms.append(tail[hit])
            tos.append(self.base[goal[hit]] + row[hit])
            ids.append(found[hit])
            single[tail[hit]] |= p.one[ids[-1]] & last[here[hit]]
            on = np.flatnonzero((node > 0) & (node < p.inner) & (row < reach[goal + 1]))
            tail, row, goal, node = tail[on], row[on], goal[on], node[on].astype(np.int64)
        some = np.flatnonzero(begins & ~single)
        alone = [some]
        while len(some := some[~last[some]]):  # the other bytes of characters that no piece spells alone
            some = shift[place[some] + 1] + own[some]
            alone.append(some)
        left = np.concatenate(alone)
        froms.insert(0, left)
        tos.insert(0, self.base[place[left] + 1] + own[left])
        ids.insert(0, p.byte_id[byte[left]])
        count = np.zeros(self.base[-1], np.int64)
        for head in tos:
            count[head] += 1
        ends = np.cumsum(count)
        self.first = ends - count
        self.tail, self.ids = np.empty(ends[-1], np.int64), np.empty(ends[-1], np.int64)
        free, follows = ends.copy(), self.base[place] + own
        for tail, head, found in zip(froms, tos, ids, strict=True):  # the arcs into a node lie together, the longest first
            free[head] -= 1
            self.tail[free[head]], self.ids[free[head]] = follows[tail], found
        nodes = np.flatnonzero(count)
        first, head, weight = self.first[nodes], np.repeat(nodes, count[nodes]), p.log_weight[self.ids]
        self.alpha = np.full(self.base[-1], -np.inf)
        self.alpha[: len(start)] = 0
        by_place = np.searchsorted(nodes, self.base[1:])
        ends = np.append(first, len(head))
        for a, b in zip(by_place[:-1], by_place[1:], strict=True):  # forward filtering, one place of all segments at a time
            if a < b:
                arcs = slice(ends[a], ends[b])
                self.alpha[nodes[a:b]] = np.logaddexp.reduceat(self.alpha[self.tail[arcs]] + weight[arcs], first[a:b] - first[a])
        with np.errstate(invalid="ignore"):
            share = np.exp(self.alpha[self.tail] + weight - self.alpha[head])
        units = np.round(np.nan_to_num(share) * _UNITS).astype(np.int64)
        self.weight = weight
        self.total = np.cumsum(units)
        self.before, self.sum = np.zeros(self.base[-1], np.int64), np.zeros(self.base[-1], np.int64)
        self.before[nodes] = self.total[first] - units[first]
        self.sum[nodes] = self.total[ends[1:] - 1] - self.before[nodes]

    def sample(self, node: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling from the end node of each occurrence: the arcs of all, each one's in text order, and how many each has."""
        active, stop, steps = np.arange(len(node)), self.base[1], 0
        who, arcs, count = [], [], np.zeros(len(node), np.int64)
        while len(active):
            with np.errstate(over="ignore"):
                draw = mix64(seed[active] + np.uint64(steps) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)
            target = self.before[node] + ((draw >> np.uint64(2)).astype(np.int64) * self.sum[node] >> 30)
            arc = self.first[node]
            beyond = np.flatnonzero(self.total[arc] <= target)
            while len(beyond):
                arc[beyond] += 1
                beyond = beyond[self.total[arc[beyond]] <= target[beyond]]
            who.append(active)
            arcs.append(arc)
            count[active] += 1
            node = self.tail[arc]
            on = np.flatnonzero(node >= stop)
            active, node = active[on], node[on]
            steps += 1
        ends = np.cumsum(count)
        out = np.empty(ends[-1], np.int64)
        for step, (some, arc) in enumerate(zip(who, arcs, strict=True)):
            out[ends[some] - 1 - step] = arc
        return out, count


def encode_chunk(p: Pieces, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled piece ids of all texts one after the other, how many each text has, and each text's sum of log weights."""
    texts = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(texts, np.int64), np.zeros(texts)
    prefix = prefix_hashes(data)
    start, end = _segments(data, offsets)
    _, first, kind = np.unique(span_hashes(prefix, start, end), return_index=True, return_inverse=True)
    longest_first = np.argsort(-(end - start)[first], kind="stable")
    rank = np.empty(len(first), np.int64)
    rank[longest_first] = np.arange(len(first))
    first = first[longest_first]
    lattice = Lattice(p, data, start[first], end[first])
    text = np.searchsorted(offsets, start, side="right") - 1
    number = np.arange(len(start)) - np.searchsorted(text, np.arange(texts))[text]
    with np.errstate(over="ignore"):
        seed = mix64(seeds[text] ^ mix64(number.astype(np.uint64) + np.uint64(1)))
    arc, pieces = lattice.sample(lattice.base[end - start] + rank[kind], seed)
    own = np.repeat(text, pieces)
    return lattice.ids[arc], np.bincount(own, minlength=texts), np.bincount(own, weights=lattice.weight[arc], minlength=texts)


def decode_ids(p: Pieces, ids: np.ndarray) -> bytes:
    return b"".join(p.objects[ids])


def _seeded(docs: DataFrame, key: str, text: str, seed: int) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(F.lit(seed), F.col(key)).alias("seed"))


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", seed: int = 0, alpha: float = 1.0) -> DataFrame:
    """doc_id and ids (array<int>), one sampled segmentation per row, by the row's id and ``seed``.

    A null text is an empty one and has no pieces. Rows that repeat an id and a text get the same pieces; rows without an id share
    one seed. ``alpha`` sharpens (above 1) or flattens the weights. Other columns are not read.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(model, alpha)
        for b in batches:
            for first, data, offsets in text_chunks(b.column("text"), _CHUNK_BYTES):
                n = len(offsets) - 1
                seeds = b.column("seed").slice(first, n).to_numpy().view(np.uint64)
                ids, per_text, _ = encode_chunk(p, data, offsets, seeds)
                places = pa.array(np.append(0, np.cumsum(per_text)).astype(np.int32))
                yield pa.record_batch([b.column("doc_id").slice(first, n), pa.ListArray.from_arrays(places, pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return _seeded(docs, key, text, seed).mapInArrow(encoded, f"doc_id {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """The rows with their text in ``text``; null ids are an empty text."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(model)
        for b in batches:
            lists = [decode_ids(p, np.asarray(x, np.int64)).decode("utf-8", "replace") if x else "" for x in b.column(ids).to_pylist()]
            kept = [i for i, n in enumerate(b.schema.names) if n != "text"]
            yield pa.record_batch([*(b.column(i) for i in kept), pa.array(lists, pa.string())], [*(b.schema.names[i] for i in kept), "text"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != "text"]
    return encoded.mapInArrow(texts, ", ".join([*fields, "text string"]))


def round_trip(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", seed: int = 0, alpha: float = 1.0) -> DataFrame:
    """Encode and decode every row: doc_id, n_bytes, n_pieces, ids_crc32 (ids as little-endian unsigned 32-bit numbers), log_weight,
    lossless (whether decoding gave back the text). Edge cases as in :func:`encode`."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(model, alpha)
        for b in batches:
            for first, data, offsets in text_chunks(b.column("text"), _CHUNK_BYTES):
                n = len(offsets) - 1
                ids, per_text, weight = encode_chunk(p, data, offsets, b.column("seed").slice(first, n).to_numpy().view(np.uint64))
                at, raw = np.append(0, np.cumsum(per_text)), data.tobytes()
                four = ids.astype("<u4")
                crc = [zlib.crc32(four[at[i] : at[i + 1]]) for i in range(n)]
                same = [decode_ids(p, ids[at[i] : at[i + 1]]) == raw[offsets[i] : offsets[i + 1]] for i in range(n)]
                yield pa.record_batch(
                    [b.column("doc_id").slice(first, n), pa.array(np.diff(offsets)), pa.array(per_text.astype(np.int64)), pa.array(crc, pa.int64()), pa.array(weight), pa.array(same)],
                    ["doc_id", "n_bytes", "n_pieces", "ids_crc32", "log_weight", "lossless"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return _seeded(docs, key, text, seed).mapInArrow(digests, f"doc_id {kind}, n_bytes long, n_pieces long, ids_crc32 long, log_weight double, lossless boolean")

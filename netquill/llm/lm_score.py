"""Language-model scoring over an Elias-Fano n-gram trie in shards, learned from the training share of the documents.

1. The texts are cut into chunks of a bounded number of bytes. A chunk is one row: its distinct words (as 64-bit hashes, packed as gaps), how often
   each occurs, in training texts and in all, and its texts as numbers of these words, the commonest first.
2. Each chunk sends its words, packed, with their training counts to shards by ranges of the hash. A shard adds up the counts, numbers its words and
   answers each chunk with both. Every word of the training texts has its own count and number; no row is made for a word.
3. All bigrams and trigrams of the training texts are counted, none is cut off. A gram is a context (one word, or two) and the word after it.
   The tokens are dealt with in turns, by the word before them, so that a turn has all grams of its contexts and only a share of the
   shuffled bytes is on disk at a time. In its turn, each chunk sends its distinct grams, packed, with their training counts to the shards of their contexts, and each
   shard makes one trie of them. The number of shards follows the number of tokens. Contexts of frequent words only are spread over several
   shards by the word that follows.
4. The same grams are the chunk's questions: the shard looks all of them up in its trie, and the chunk adds up the scores of the turn's tokens
   text by text; the sums of all turns make the scores. Nothing that grows with the input is gathered or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import LOWER_ASCII, crc_mod, drop, mix64, prefix_hashes, span_hashes, text_chunks, word_spans, written
from netquill.llm.ngram_trie import Trie

#: Contexts whose words all have this share of the tokens are spread over ``_PARTS`` shards; that changes no count.
WORD_SHARE = 2.0**-11
#: Tokens for each shard, and the least number of shards.
SHARD_TOKENS, MIN_SHARDS = 1 << 18, 64
#: A chunk's distinct words count as one entry each; entries for each shard of words.
SHARD_WORDS = 1 << 19
#: Turns that the tokens are dealt with in.
TURNS = 4
DISCOUNT = 0.75
CHUNK_BYTES = 8 << 20
_RUN_BYTES = 1 << 20
_PARTS = 16
#: The end of a text, as a word hash.
END_HASH = np.uint64(0x5555AAAA12345678)
_ODD, _PAIR, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _words(column, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of ``n`` texts, each followed by the end, and the number of tokens of each text."""
    hashes, counts = [], []
    for _, data, offsets in text_chunks(column.slice(first, n), _RUN_BYTES):
        low = LOWER_ASCII[data]
        start, end, text = word_spans(low, offsets)
        size = np.bincount(text, minlength=len(offsets) - 1)
        out = np.empty(len(start) + len(size), np.uint64)
        ends = np.cumsum(size + 1) - 1
        is_word = np.ones(len(out), bool)
        is_word[ends] = False
        out[is_word], out[ends] = span_hashes(prefix_hashes(low), start, end), END_HASH
        hashes.append(out)
        counts.append(size + 1)
    return np.concatenate(hashes), np.concatenate(counts)


def chunked(docs: DataFrame, held: Column, key: str, text: str, chunk_bytes: int) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), held.alias("held"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for first, _, offsets in text_chunks(b.column("text"), chunk_bytes):
                n = len(offsets) - 1
                hashes, size = _words(b.column("text"), first, n)
                out = b.column("held").slice(first, n).to_numpy(zero_copy_only=False)
                words, place, times = np.unique(hashes, return_inverse=True, return_counts=True)
                order = np.argsort(-times, kind="stable")  # small numbers for common words take less room
                rank = np.empty(len(order), np.int32)
                rank[order] = np.arange(len(order))
                counts = np.bincount(place, weights=np.repeat(~out, size), minlength=len(words)).astype(np.int64)
                one = lambda a: pa.array([a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes()], pa.binary())
                ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), b.column("doc_id").slice(first, n))
                yield pa.record_batch([pa.array([number]), ids, one(out.astype(np.uint8)), one(size.astype(np.int64)), one(_squeezed(rank[place])), one(_gaps(words)), one(_squeezed(counts)), one(_squeezed(times)),
                                       pa.array([len(words)]), pa.array([int(counts.sum())])],
                                      ["chunk", "doc_ids", "held", "size", "place", "words", "counts", "times", "n_words", "learned"])
                number += 1

    return rows.mapInArrow(chunks, f"chunk long, doc_ids array<{kind}>, held binary, size binary, place binary, words binary, counts binary, times binary, n_words long, learned long")


def _array(b: pa.RecordBatch, name: str, i: int, kind) -> np.ndarray:
    buffer = b.column(name)[i].as_buffer()
    return np.frombuffer(buffer, kind) if buffer.size else np.zeros(0, kind)


def _squeezed(a: np.ndarray) -> bytes:
    """Whole numbers from 0, byte by byte: the lowest of all, then the next. The head has their number and whether they take 64 bits each."""
    wide = int(a.max(initial=0)) >> 32 > 0
    width = 8 if wide else 4
    planes = np.ascontiguousarray(a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return (2 * len(a) + wide).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _numbers(raw) -> np.ndarray:
    """The numbers of a :func:`_squeezed` value, as 64 bits."""
    n, wide = divmod(int.from_bytes(bytes(raw[:8]), "little"), 2)
    width = 8 if wide else 4
    planes = pa.decompress(raw[8:], decompressed_size=width * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def _gaps(words: np.ndarray) -> bytes:
    """Rising 64-bit hashes as a :func:`_squeezed` value."""
    return _squeezed(np.diff(words, prepend=np.uint64(0)))


def _rising(raw) -> np.ndarray:
    return np.cumsum(_numbers(raw).view(np.uint64), dtype=np.uint64)


def _joined(*parts: bytes) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def _parted(raw) -> list:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(bytes(raw[at : at + 8]), "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _contexts(numbers: np.ndarray, size: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The two numbers before each token; before a text there are ends."""
    first = np.cumsum(size) - size
    w2 = np.append(end, numbers[:-1])
    w1 = np.append([end, end], numbers[:-2])[: len(numbers)]
    w2[first], w1[first] = end, end
    second = first[size > 1] + 1
    w1[second] = end
    return w1, w2


def _names(one: np.ndarray, two: np.ndarray, part: np.ndarray) -> np.ndarray:
    """64-bit names of contexts of word numbers: ``one`` is 0 where there is one word only; parts that are spread (from 1) have names of their own."""
    return mix64(mix64(mix64(one.astype(np.uint64)) * _PAIR + two.astype(np.uint64)) + part.astype(np.uint64) * _ODD)


class Grams:
    """The distinct bigrams and trigrams of a turn's tokens in a chunk, by shard, and where they are dealt with.

    Entries (``one``, ``two``, ``three``) are word numbers, 0 for the first of a bigram, and questions about a part of a context that
    is spread over shards, with the part as the last. ``shard`` is sorted; within a shard bigrams come first, questions about parts last, as many as
    ``kinds`` says. Bigrams and trigrams are numbered in that order: ``second`` is each trigram's bigram, ``token`` each token's trigram, ``last`` the place
    of the word that a bigram ends with, ``spread`` the number of the spread context of each bigram, then trigram, plus 1, and ``parts``
    what the last questions are about: number of the context times ``_PARTS`` plus part. ``texts`` is the number of the turn's tokens in each text.
    """

    def __init__(self, ids: np.ndarray, place: np.ndarray, size: np.ndarray, held: np.ndarray, turn: int, turns: int, end: int, frequent: np.ndarray, shards: int):
        m, w3 = len(ids), place
        w1, w2 = _contexts(w3, size, int(np.argmax(ids == end)))
        mine = (mix64(ids.astype(np.uint64) ^ _TURN) % np.uint64(turns) == turn)[w2]
        text = np.repeat(np.arange(len(size)), size)[mine]
        self.texts, learned = np.bincount(text, minlength=len(size)), ~held[text]
        w1, w2, w3 = w1[mine], w2[mine], w3[mine]
        if m < 1 << 21:
            grams3, token = np.unique((w2 * m + w1) * m + w3, return_inverse=True)
            one, two, three = grams3 // m % m, grams3 // (m * m), grams3 % m
        else:
            pairs, pair = np.unique(w2 * m + w1, return_inverse=True)
            grams3, token = np.unique(pair * m + w3, return_inverse=True)
            one, two, three = pairs[grams3 // m] % m, pairs[grams3 // m] // m, grams3 % m
        grams2, second = np.unique(two * m + three, return_inverse=True)
        n3 = np.bincount(token[learned], minlength=len(grams3))
        n2 = np.bincount(second, weights=n3, minlength=len(grams2)).astype(np.int64)
        often = (ids == end) | np.isin(ids, frequent)
        wide = np.concatenate([often[grams2 // m], often[one] & often[two]])
        a = np.concatenate([np.zeros(len(grams2), np.int64), ids[one]])
        b, c = np.concatenate([ids[grams2 // m], ids[two]]), np.concatenate([ids[grams2 % m], ids[three]])
        spread, part = np.zeros(len(c), np.int64), np.where(wide, c % _PARTS + 1, 0)
        names, first, at = np.unique(_names(a[wide], b[wide], np.zeros(1)), return_index=True, return_inverse=True)
        spread[wide] = at + 1
        each = np.tile(np.arange(_PARTS), len(names))
        a, b = (np.append(x, np.repeat(x[wide][first], _PARTS)) for x in (a, b))
        c, part, n = np.append(c, each), np.append(part, each + 1), np.concatenate([n2, n3, np.zeros(len(each), np.int64)])
        shard = (_names(a, b, part) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
        self.fields, self.shard = [x[order] for x in (a, b, c, part, n)], shard[order]
        kind = (order >= len(grams2)).astype(np.int8) + (order >= len(grams2) + len(grams3))
        self.kinds = np.bincount(self.shard * 3 + kind, minlength=3 * shards)
        bi, tri, self.parts = order[kind == 0], order[kind == 1] - len(grams2), order[kind == 2] - len(grams2) - len(grams3)
        rank2, rank3 = np.empty(len(bi), np.int64), np.empty(len(tri), np.int64)
        rank2[bi], rank3[tri] = np.arange(len(bi)), np.arange(len(tri))
        self.second, self.token, self.last = rank2[second[tri]], rank3[token], (grams2 % m)[bi]
        self.spread = np.concatenate([spread[bi], spread[len(bi) + tri]])

    def dealt(self) -> Iterator[tuple[int, bytes]]:
        """Each shard that has entries, and these: their words, the parts they lie in and how often they occur in training texts."""
        edge = [0, *(np.flatnonzero(self.shard[1:] != self.shard[:-1]) + 1).tolist(), len(self.shard)]
        for a, z in zip(edge[:-1], edge[1:], strict=True):
            if z > a:
                yield int(self.shard[a]), _squeezed(np.concatenate([x[a:z] for x in self.fields]))


def _worded(chunks: DataFrame, shards: int, least: float, held_paths: dict[str, str]) -> DataFrame:
    """chunk, shard, answer: training count and number (id) of each word of a chunk, by its hash, for every shard that has any. An id is small for a
    common word: from 2, its rank in its shard, then the shard; 1 is in no training text. A row of each shard also has ``distinct`` (how many words
    it numbered), ``often`` (ids of words that occur ``least`` times, without the end) and ``end`` (the end's id, if it is there)."""
    bounds = np.array([(k << 64) // shards for k in range(1, shards)], np.uint64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                words, counts = _rising(b.column("words")[i].as_buffer()), _numbers(b.column("counts")[i].as_buffer())
                edge = np.concatenate([[0], np.searchsorted(words, bounds), [len(words)]])
                to = np.flatnonzero(np.diff(edge))
                bodies = [_joined(_gaps(words[edge[k] : edge[k + 1]]), _squeezed(counts[edge[k] : edge[k + 1]])) for k in to]
                yield pa.record_batch([pa.array(np.full(len(to), b.column("chunk")[i].as_py())), pa.array(to.astype(np.int64)), pa.array(bodies, pa.binary())], ["chunk", "shard", "body"])

    def numbered(messages: pa.Table) -> pa.Table:
        shard, rows = messages.column("shard")[0].as_py(), messages.num_rows
        parts = [_parted(x.as_buffer()) for x in messages.column("body")]
        words = [_rising(x) for x, _ in parts]
        edge = np.cumsum([0, *map(len, words)])
        words, place = np.unique(np.concatenate(words), return_inverse=True)
        c = np.bincount(place, weights=np.concatenate([_numbers(x) for _, x in parts])).astype(np.int64)
        rank = np.empty(len(c), np.int64)
        rank[np.argsort(-c, kind="stable")] = np.arange(len(c))
        ids, is_end = np.where(c > 0, rank * shards + shard + 2, 1), words == END_HASH
        answers = [_joined(_squeezed(ids[at]), _squeezed(c[at])) for at in (place[a:z] for a, z in zip(edge[:-1], edge[1:], strict=True))]
        once = lambda x, kind: pa.array([x] + [None] * (rows - 1), kind)
        return pa.table({"chunk": messages.column("chunk"), "shard": messages.column("shard"), "answer": pa.array(answers, pa.binary()), "distinct": once(int((c > 0).sum()), pa.int64()),
                         "often": once(ids[(c >= least) & ~is_end].tolist(), pa.list_(pa.int64())), "end": once(next(iter(ids[is_end & (c > 0)].tolist()), None), pa.int64())})

    messages = chunks.select("chunk", "words", "counts").mapInArrow(dealt, "chunk long, shard long, body binary")
    return written(messages.groupBy("shard").applyInArrow(numbered, "chunk long, shard long, answer binary, distinct long, often array<long>, end long"), "lm-words", held_paths)


def score(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text", word_share: float = WORD_SHARE, shard_tokens: int = SHARD_TOKENS, chunk_bytes: int = CHUNK_BYTES, turns: int = TURNS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; rows where ``held`` is true teach nothing.

    A null or empty text is the end alone. ``base_score`` is the sum of log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens, ``score`` the
    log10 probability of the text by trigrams, interpolated with bigrams and words by absolute discounting; a context that was not seen
    leaves it to the shorter one, and a word's own probability is that of ``base_score``. If there is nothing to learn from, all counts are 0 and both scores are those of that
    formula. Repeated rows count and are scored one by one; a null id stays null. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    held_paths: dict[str, str] = {}
    chunks = written(chunked(docs, F.coalesce(held, F.lit(False)), key, text, chunk_bytes), "lm-chunks", held_paths)

    tokens, entries = (int(x or 0) for x in chunks.agg(F.sum("learned"), F.sum("n_words")).first())
    words = _worded(chunks, max(MIN_SHARDS, -(-entries // SHARD_WORDS)), max(tokens * word_share, 1), held_paths)
    distinct, end, often = words.agg(F.sum("distinct"), F.max("end"), F.flatten(F.collect_list("often"))).first()  # at most 1 / word_share ids
    distinct, end, often = distinct or 0, -1 if end is None else end, np.array(often, np.int64)
    shards, base_mass = -(-max(MIN_SHARDS, -(-tokens // shard_tokens)) // turns), tokens + 0.5 * (distinct + 1)
    drop(spark, held_paths)

    known = words.groupBy("chunk").agg(F.collect_list(F.struct("shard", "answer")).alias("known"))

    def informed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                size = _array(b, "size", i, np.int64)
                place, times = (_numbers(b.column(x)[i].as_buffer()) for x in ("place", "times"))
                known = b.column("known")[i].values
                answers = [_parted(known.field("answer")[int(k)].as_buffer()) for k in np.argsort(known.field("shard").to_numpy())]
                order = np.argsort(-times, kind="stable")  # as the chunk numbered its words
                ids, c = (np.concatenate([_numbers(x[j]) for x in answers])[order] for j in (0, 1))
                text = np.repeat(np.arange(len(size)), size)
                add = lambda x: np.bincount(text, weights=x, minlength=len(size))  # noqa: E731, B023
                sums = (_squeezed(ids), _squeezed(c), add(c[place] > 0).astype(np.int64).tobytes(), add(np.log10((c + 0.5) / base_mass)[place]).tobytes())
                yield pa.record_batch([*(b.column(x).slice(i, 1) for x in kept), *(pa.array([x], pa.binary()) for x in sums)], [*kept, "ids", "c", "n_known", "base"])

    kept = ("chunk", "doc_ids", "held", "size", "place")
    schema = f"chunk long, doc_ids array<{kind}>, held binary, size binary, place binary, ids binary, c binary, n_known binary, base binary"
    chunks = written(chunks.select(*kept, "times").join(known, "chunk").mapInArrow(informed, schema), "lm-known", held_paths)
    drop(spark, held_paths, "lm-chunks", "lm-words")

    def answered(questions: pa.Table) -> pa.Table:
        shard = questions.column("shard")[0].as_py()
        if shard < 0:  # what a chunk keeps for itself
            bodies = questions.column("body").to_pylist()
        else:
            grams = [_numbers(x.as_buffer()).reshape(5, -1) for x in questions.column("body")]
            one, two, three, part, n = np.concatenate(grams, axis=1)
            context, word, learned = _names(one, two, part) >> np.uint64(1), three.astype(np.uint64), n > 0
            found = np.zeros((3, len(n)), np.int64)
            if learned.any():
                found[:] = Trie.of(context[learned], word[learned], n[learned]).find(context, word)
            edge = np.cumsum([0, *(g.shape[1] for g in grams)])
            bodies = [_squeezed(found[:, a:z].ravel()) for a, z in zip(edge[:-1], edge[1:], strict=True)]
        return pa.table({"chunk": questions.column("chunk"), "shard": questions.column("shard"), "answer": pa.array(bodies, pa.binary())})

    def scored(replies: pa.Table) -> pa.Table:
        body = dict(zip(replies.column("shard").to_pylist(), replies.column("answer").to_pylist(), strict=True))
        texts, token, second, c, spread, parts, kinds = (_numbers(x) for x in _parted(body.pop(min(body))))
        kind = np.repeat(np.tile(np.arange(3), len(kinds) // 3), kinds)
        found = np.concatenate([_numbers(body[k]).reshape(3, -1) for k in sorted(body)], axis=1)
        n, total, follow = np.concatenate([found[:, kind == 0], found[:, kind == 1]], axis=1)
        wide, split = spread > 0, np.zeros((2, len(parts)), np.int64)
        split[:, parts] = found[1:, kind == 2]
        total[wide], follow[wide] = split.reshape(2, -1, _PARTS).sum(2)[:, spread[wide] - 1]
        own, left = np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1), np.where(total > 0, DISCOUNT * follow / np.maximum(total, 1), 1.0)
        p2 = own[: len(c)] + left[: len(c)] * ((c + 0.5) / base_mass)
        p3 = own[len(c) :] + left[len(c) :] * p2[second]
        sums = np.bincount(np.repeat(np.arange(len(texts)), texts), weights=np.log10(p3)[token], minlength=len(texts))
        return pa.table({"chunk": replies.column("chunk").slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})

    def turned(turn: int) -> DataFrame:
        """chunk and sums: of each text, the log10 probability of the turn's tokens."""

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    ids, place = (_numbers(b.column(x)[i].as_buffer()) for x in ("ids", "place"))
                    g = Grams(ids, place, _array(b, "size", i, np.int64), _array(b, "held", i, np.uint8) > 0, turn, turns, end, often, shards)
                    if not len(g.token):
                        continue
                    chunk, c = b.column("chunk").slice(i, 1), _numbers(b.column("c")[i].as_buffer())[g.last]
                    own = _joined(*map(_squeezed, (g.texts, g.token, g.second, c, g.spread, g.parts, g.kinds)))  # goes through the answers, as a group of its own
                    yield pa.record_batch([chunk, pa.array([-1 - chunk[0].as_py()]), pa.array([own], pa.binary())], ["chunk", "shard", "body"])
                    for k, body in g.dealt():
                        yield pa.record_batch([chunk, pa.array([k]), pa.array([body], pa.binary())], ["chunk", "shard", "body"])

        questions = chunks.select("chunk", "c", "held", "size", "place", "ids").mapInArrow(asked, "chunk long, shard long, body binary")
        answers = questions.groupBy("shard").applyInArrow(answered, "chunk long, shard long, answer binary")
        sums = written(answers.groupBy("chunk").applyInArrow(scored, "chunk long, sums binary"), f"lm-turn-{turn}", held_paths)
        drop(spark, held_paths)
        return sums

    sums = turned(0)
    for turn in range(1, turns):
        sums = sums.unionByName(turned(turn))
    added = sums.groupBy("chunk").agg(F.collect_list("sums").alias("sums"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                size = _array(b, "size", i, np.int64)
                score = np.sort([np.frombuffer(x.as_buffer()) for x in b.column("sums")[i].values], axis=0).sum(0)  # in a fixed order
                columns = [pa.array(x) for x in (_array(b, "held", i, np.uint8).astype(bool), size, _array(b, "n_known", i, np.int64), np.full(len(size), tokens), _array(b, "base", i, np.float64), score)]
                yield pa.record_batch([b.column("doc_ids")[i].values, *columns], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    results = chunks.select("chunk", "doc_ids", "held", "size", "n_known", "base").join(added, "chunk")
    results = results.mapInArrow(told, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    results = written(results, "lm-scores")
    drop(spark, held_paths, *held_paths)
    return results


def held_fold(key: str = "doc_id", folds: int = 5, fold: int = 1) -> Column:
    return crc_mod(F.col(key), folds) == fold

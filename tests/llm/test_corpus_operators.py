"""The corpus operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import functools
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquill.llm import langid, lm_score, near_dedup, packing, piece_sampling, suffix_dedup, topk_search, toxicity
from netquill.llm.common import importable, mix64, written
from netquill.llm.exact_dedup import exact_duplicates, without_copies
from netquill.llm.license_scan import scan
from netquill.llm.ngram_trie import EliasFano
from netquill.llm.queries import ORACLES, QUERIES, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, name string, cid long, text_key string, part int, a string, n long"


def _texts():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(12)]
    texts = list(base) + base[:4] + [t.replace(" ", "\n ") for t in base[:3]]
    for t in base[:6]:  # near copies
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [base[0] + " " + base[1], "start " + base[2][50:400] + " end", base[3][:205], base[3][1:201]]
    texts += [None, "", "   \t", "one", "One", "two words", "a" * 900, "MIT. Released under the MIT License.", "x <|endoftext|> y", "漢字 \U0001f600▁ ▁"]
    texts.append(" ".join(rng.choice(words) for _ in range(60_000)))
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    importable(spark)
    rows = [(i, t, ("de", "en")[i % 2], "clash", 1, "clash", 2, "clash", 3) for i, t in enumerate(_texts())]
    rows += [rows[0], (None, "no id", None, *rows[0][3:]), (None, _texts()[1], "en", *rows[0][3:])]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    importable(spark)
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    got = exact_duplicates(docs, block_bytes=64).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i is None, i or 0, i))
    want = collections.Counter()
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t)
        best = min(groups[norm])[3]
        want[(i, best, len(groups[norm]), i == best, hashlib.sha256(norm.encode()).hexdigest())] += 1
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want
    stay = without_copies(docs)
    assert stay.columns == docs.columns and stay.count() == len(groups)
    assert exact_duplicates(empty).count() == 0


def _sets(rows):
    out = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out.append((i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}))
    return out


def _components(rows, percent):
    """For each row the place of the smallest row it is linked with, by all pairs."""
    sets = [x for _, x in _sets(rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                root[find(x)] = find(y)
    return sets, [find(x) for x in range(len(rows))]


@pytest.mark.parametrize("percent", [85, 80])
def test_near_dedup(docs, empty, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets, found = _components(rows, percent)
    want = collections.Counter()
    for x, (i, _) in enumerate(rows):
        ids = [rows[y][0] for y in range(len(rows)) if found[y] == found[x] and rows[y][0] is not None]
        want[(i, len(sets[x]), min(ids, default=None))] += 1
    got = near_dedup.near_duplicates(docs, percent=percent, block=4)
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == want
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.without_near_copies(docs).columns == docs.columns


def test_suffix_dedup(docs, empty):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    seen = collections.Counter(b[p : p + 200] for _, b in rows for p in range(len(b) - 199))
    want = collections.Counter()
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[(i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    got = suffix_dedup.removal_report(docs).collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert suffix_dedup.removal_report(empty).count() == 0
    cut = suffix_dedup.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()


def test_packing_covers_every_id(docs, empty):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    named = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows if i not in (None, 0)}
    got = packing.pack(docs, path, range_bytes=100_000).collect()
    done = collections.Counter()
    for r in sorted((r for r in got if r["doc_id"] in named), key=lambda r: (r["doc_id"], r["start"])):
        ids = named[r["doc_id"]]
        assert r["start"] == done[r["doc_id"]] and r["doc_tokens"] == len(ids)
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        done[r["doc_id"]] += r["length"]
    assert all(done[i] == len(x) for i, x in named.items())
    places = collections.defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in places.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048 and (end == 2048 or end & (end - 1) == 0)
    assert packing.pack(empty, path).count() == 0


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_keys(grid, bits=3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_pieces_round_trip_and_repeat(docs, empty):
    path = vocabulary("piece_bpe_32k.model")
    first, again = (piece_sampling.encode(docs.repartition(n), path) for n in (1, 5))
    key = lambda r: (str(r["doc_id"]), len(r["ids"]), r["ids"])
    assert sorted(map(key, first.collect())) == sorted(map(key, again.collect()))
    texts = piece_sampling.decode(first, path).select("text").collect()
    assert sorted(r["text"] for r in texts) == sorted(r["text"] or "" for r in docs.collect())
    assert piece_sampling.round_trip(docs, path).filter(~F.col("lossless")).count() == 0
    assert piece_sampling.encode(empty, path).count() == 0


def plain_pieces(p, text, seed):
    """Sampled pieces of one text, place by place in plain Python."""
    named = {p.raw[i]: int(i) for i in p.piece[p.piece >= 0]}
    cuts = [i for i in range(len(text)) if i == 0 or text[i] == 32 != text[i - 1] or 10 in text[i - 1 : i + 1]]
    out, weight = [], 0.0
    for number, (a, b) in enumerate(itertools.pairwise([*cuts, len(text)])):
        part = text[a:b]
        starts = [i for i in range(len(part)) if i == 0 or part[i] & 0xC0 != 0x80]
        alone = {i for c, d in itertools.pairwise([*starts, len(part)]) if part[c:d] not in named for i in range(c, d)}
        alpha, into = [0.0], [None]
        for head in range(1, len(part) + 1):
            arcs = [(t, named[part[t:head]]) for t in starts if t < head and part[t:head] in named]
            arcs += [(head - 1, int(p.byte_id[part[head - 1]]))] if head - 1 in alone else []
            sums = [alpha[t] + p.log_weight[i] for t, i in arcs]
            alpha.append(functools.reduce(np.logaddexp, sums) if arcs else -np.inf)
            into.append([(t, i, round(float(np.exp(x - alpha[head])) * 2**32)) for (t, i), x in zip(arcs, sums, strict=True)])
        with np.errstate(over="ignore"):
            own = mix64(np.uint64(seed) ^ mix64(np.uint64(number + 1)))
            draws = [int(mix64(own + np.uint64(k) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(34)) for k in range(len(part))]
        at, path = len(part), []
        while at:
            target = draws[len(path)] * sum(u for _, _, u in into[at]) >> 30
            sums = itertools.accumulate(u for _, _, u in into[at])
            at, i, _ = into[at][next(k for k, x in enumerate(sums) if x > target)]
            path.append(i)
        out += path[::-1]
        for i in path[::-1]:
            weight += p.log_weight[i]
    return out, weight


PIECE_TEXTS = [
    b"the internationalisation of  governments and their documentation", b"", b" ", b"\n\n  \nx", "Stra\u00dfe \u4e2d\u6587 \U0001f600\u0301 \ue000\ue001a".encode(),
    b"a" * 90, b"\x80\x80ab\x80 \xc3 \xe4\xb8", b"the the the the international the", bytes(range(256)),
]


def test_pieces_against_plain_python():
    p = piece_sampling.load(vocabulary("piece_bpe_32k.model"))
    seeds = mix64(np.arange(1, len(PIECE_TEXTS) + 1, dtype=np.uint64))
    offsets = np.append(0, np.cumsum([len(t) for t in PIECE_TEXTS]))
    ids, per_text, weight = piece_sampling.encode_chunk(p, np.frombuffer(b"".join(PIECE_TEXTS), np.uint8), offsets, seeds)
    got = np.split(ids, np.cumsum(per_text)[:-1])
    for text, seed, some, w in zip(PIECE_TEXTS, seeds, got, weight, strict=True):
        plain, plain_weight = plain_pieces(p, text, seed)
        assert some.tolist() == plain and w == plain_weight


def test_pieces_work_follows_the_pieces_present(monkeypatch):
    """Spans are hashed once a segment, not at every place for every length; the trie is entered only as deep as pieces go."""
    p = piece_sampling.load(vocabulary("piece_bpe_32k.model"))
    data = np.frombuffer(b"".join(PIECE_TEXTS), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in PIECE_TEXTS]))
    hashed, looked = [], []
    spans = piece_sampling.span_hashes

    def counted(prefix, start, end):
        hashed.append(len(start))
        return spans(prefix, start, end)

    class Counted:
        def __init__(self, table):
            self.table = table

        def __getitem__(self, at):
            looked.append(len(at))
            return self.table[at]

    monkeypatch.setattr(piece_sampling, "span_hashes", counted)
    segments = sum(len(piece_sampling._segments(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]) for t in PIECE_TEXTS if t)
    plain = piece_sampling.encode_chunk(p, data, offsets, np.zeros(len(PIECE_TEXTS), np.uint64))
    assert sum(hashed) == segments
    monkeypatch.setattr(p, "below", Counted(p.below))
    again = piece_sampling.encode_chunk(p, data, offsets, np.zeros(len(PIECE_TEXTS), np.uint64))
    assert all((a == b).all() for a, b in zip(plain, again, strict=True))
    begun = {p.raw[i][:n] for i in p.piece[p.piece >= 0] for n in range(len(p.raw[i]) + 1)}
    most = sum(next((n for n in range(len(t) - a + 1) if t[a : a + n] not in begun), len(t) - a) for t in PIECE_TEXTS for a in range(len(t)))
    assert 0 < sum(looked) <= most


def test_lm_scores(docs, empty):
    named = docs.filter("doc_id is not null and doc_id > 0")
    got = {r["doc_id"]: r for r in lm_score.score(named, lm_score.held_fold(), chunk_bytes=5000).collect()}
    tokens = {r["doc_id"]: [*WORD.findall((r["text"] or "").translate(LOWER)), None] for r in named.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        base = sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    assert lm_score.score(empty, lm_score.held_fold()).count() == 0


@pytest.mark.parametrize("sizes", [{"word_share": 1.0, "shard_tokens": 1000}, {"word_share": 1e-4, "chunk_bytes": 5000}])
def test_lm_scores_equal_a_plain_model(docs, sizes):
    """Every word and every n-gram of the training texts counts, wherever it is dealt with."""
    named = docs.filter("doc_id is not null and doc_id > 0")
    got = {r["doc_id"]: r["score"] for r in lm_score.score(named, lm_score.held_fold(), **sizes).collect()}
    tokens = {r["doc_id"]: [None, None, *WORD.findall((r["text"] or "").translate(LOWER)), None] for r in named.collect()}
    counts, total, kinds = (collections.Counter() for _ in range(3))
    for i, ws in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for j in range(2, len(ws)):
                counts.update([tuple(ws[k : j + 1]) for k in (j - 2, j - 1, j)])
    for g, n in counts.items():
        total[g[:-1]] += n
        kinds[g[:-1]] += 1

    def p(gram):
        if not gram[:-1]:
            return (counts[gram] + 0.5) / (total[()] + 0.5 * (kinds[()] + 1))
        t = total[gram[:-1]]
        return (max(counts[gram] - 0.75, 0) + 0.75 * kinds[gram[:-1]] * p(gram[1:])) / t if t else p(gram[1:])

    for i, ws in tokens.items():
        assert got[i] == pytest.approx(sum(np.log10(p(tuple(ws[j - 2 : j + 1]))) for j in range(2, len(ws))), rel=1e-9)


def test_elias_fano():
    rng = np.random.default_rng(1)
    for top in (1, 50, 10**9):
        values = np.sort(rng.integers(0, top, 3000))
        assert (EliasFano.of(values)[np.arange(3000)] == values).all()


def test_top_k(spark):
    importable(spark)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(700)]
    rows += [(700 + i, rows[100][1]) for i in range(30)] + [(800, None), (801, [float("nan")] * 6), (802, [1.0, None]), (803, []), (900, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_search.top_k(df, F.col("vec_id") % 100 == 0, block_rows=64).collect())
    whole = {i: np.pad(np.floor(1024 * np.array(e)), (0, 6 - len(e))).astype(np.int64) for i, e in rows if e is not None and None not in e and np.isfinite(e).all()}
    want = []
    for q in whole:
        if q % 100 == 0:
            best = sorted((-int(whole[q] @ e), i) for i, e in whole.items() if i != q)[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_language_and_toxicity_on_given_labels(spark, sf):
    importable(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES["op5_language_id"](spark, sf).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.filter("lang = lang_pred").count() >= 0.95 * got.count()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    large = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marked = toxicity.score(large, toxicity.fit(large, labels)).join(labels.withColumnRenamed("toxic", "y"), "doc_id")
    assert marked.filter("y = 1 and toxic").count() >= 0.9 * marked.filter("y = 1").count()
    assert marked.filter("y = 0 and toxic").count() <= 0.02 * marked.filter("y = 0").count()


def test_classifiers_on_edges(docs, empty, spark):
    found = langid.identify(docs).collect()
    assert len(found) == docs.count() and all(r["lang_pred"] == "und" for r in found if r["doc_id"] in (30, 31) and r["score"] == 0)
    assert langid.identify(empty).count() == 0
    labels = spark.createDataFrame([(i, i % 2, None if i == 5 else int(i % 3 == 0)) for i in range(30)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    assert out.count() == docs.count() and out.filter("toxic is null").count() == 0
    assert toxicity.fit(docs, labels.limit(0)) is None and toxicity.without_toxic(empty, labels).count() == 0


def test_license_rules(docs, empty, spark):
    texts = ["Hello. Licensed under the Apache License, Version 2.0.\nBye", "This work is licensed under the GNU General Public Licence, version 3.",
             "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", None]
    got = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["licenses"] for r in got] == [["Apache-2.0"], ["GPL-3.0"], [], []]
    assert got[2]["sentence_ids"] == ["BSD-SOURCE"]
    assert scan(docs).count() == docs.count() and scan(empty).count() == 0


_BSD = """Copyright (c) 2020, X
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
_NOTICES = {
    "GPL-3.0-or-later": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one.""",
    "Apache-2.0": """   Licensed under the
   Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.""",
    "BSD-2-Clause": _BSD,
    "BSD-3-Clause": _BSD + """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the
Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.""",
    "CC-BY-4.0": "Text.\nThis work is licensed under\nCC-BY 4.0.\nMore",
    "Unlicense": "This is free and unencumbered software\nreleased into the public domain.",
}


def test_licenses_of_wrapped_notices(spark):
    rows = [(k, t if wrapped else " ".join(t.split())) for k, t in _NOTICES.items() for wrapped in (True, False) if wrapped or "BSD" not in k]
    got = scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [(r["doc_id"], r["licenses"]) for r in got if r["licenses"] != [r["doc_id"]]] == [] and len(got) == len(rows)


def test_every_license_sentence_is_found_however_wrapped(spark):
    from netquill.llm.license_scan import MORE_SENTENCES, SENTENCES

    known = [(k, s) for k, v in {**SENTENCES, **MORE_SENTENCES}.items() for s in v]
    rows = [(k, f"Before.\n{f(s)}.\nAfter") for k, s in known for f in (str.title, lambda s: s.title().replace(" ", "\n"), lambda s: s.replace(" ", "; "))]
    got = scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [r["doc_id"] for r in got if r["sentence_ids"] != [r["doc_id"]]] == [] and len(got) == len(rows)


def test_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
    assert set(ORACLES) == {"op4_exact_dedup", "op7_license_scan", "op10_exact_topk"}


def test_pipeline_stages_by_kept_ids_and_texts(spark, sf):
    """Exact, near and suffix dedup on what the stage before kept, against brute force; packing loses no token."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns

    def kept(rows):
        assert rows.columns == columns
        return [(r["doc_id"], r["text"]) for r in rows.collect()]

    docs = written(stages["toxicity"](spark, docs, sf), "test")
    rows = kept(docs)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i, t))
    docs = written(stages["exact_dedup"](spark, docs, sf), "test")
    after_exact = kept(docs)
    assert sorted(after_exact) == sorted((i, t) for _, i, t in map(min, groups.values()))

    _, found = _components(after_exact, corpus_pipeline.NEAR_PERCENT)
    least = {}
    for x, (i, _) in enumerate(after_exact):
        least[found[x]] = min(least.get(found[x], i), i)
    docs = written(stages["near_dedup"](spark, docs, sf), "test")
    after_near = kept(docs)
    assert sorted(i for i, _ in after_near) == sorted(least.values()) and set(after_near) <= set(after_exact)

    raw = {i: (t or "").encode() for i, t in after_near}
    times = collections.Counter(b[p : p + 200] for b in raw.values() for p in range(len(b) - 199))
    want = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if times[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        want[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    docs = written(stages["suffix_dedup"](spark, docs, sf), "test")
    after_suffix = kept(docs)
    assert {i: (t or "").encode("utf-8", "surrogateescape") for i, t in after_suffix}.keys() == want.keys()
    whole = {i for i, b in want.items() if _is_text(b)}
    assert {i: (t or "").encode() for i, t in after_suffix if i in whole} == {i: b for i, b in want.items() if i in whole}

    pieces = stages["packing"](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == len(after_suffix)
    assert pieces.groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("all")).filter(~F.col("all")).count() == 0


def _is_text(b):
    try:
        b.decode()
    except UnicodeDecodeError:
        return False
    return True

"""Turn repair, whitening and the n-gram join against brute force on small fixtures, with nulls, empty and long values, ties and repeats."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquill.llm import ngram_join, turn_repair, whitening
from netquill.llm.common import importable

SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# --- conversations -------------------------------------------------------------------------------------------------


def _cheapest(rows):
    """(cost, audit, kept rows) by a search over whole edit strings: cheapest first, then ASCII-least."""
    seen, heap = set(), [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, tail, kept = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", tail):
            return cost, audit, kept
        state = "" if not tail else tail[-1]
        if (i, state) in seen:
            continue
        seen.add((i, state))
        wanted = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
        heapq.heappush(heap, (cost + 5, audit + "I", i, tail + wanted[0], (*kept, wanted + ":")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, tail, kept))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, tail + wanted[0], (*kept, wanted + ":" + text)))
                if role[:1] == wanted[0] or (role[:1] == "s" and not tail):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, tail + role[0], (*kept, role + ":" + text)))


def _expected(rows):
    out = {}
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv, members in groups.items():
        after = []
        for turn, role, text in members:
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            code = zlib.crc32(name.encode()) % 20
            if code == 0:
                continue
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            after += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in after:
            bare = text.rstrip(SPACES)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in after if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        first = [r[:1] for _, r, _ in after]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        cost, audit, kept = _cheapest([(r, t, f) for (_, r, t), f in zip(after, faults)])
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(1, 12)):
            text = rng.choice(["Yes.", "No!", "why", " ", "", None, "Well?", "x" * rng.randrange(1, 30) + rng.choice([".", "", "!\n ", "\t"])])
            rows.append((conv, turn + rng.choice([0, 0, 0, 3]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]), text))
    rows += [(None, t, r, "Fine.") for t, r in enumerate(["user", "assistant"] * 4)] + [(7, None, "user", "No turn."), (7, None, None, None)]
    rows += [(900, t, ("user", "assistant")[t % 2], f"Turn {t} " + "word " * (t % 7) + (".", "")[t % 11 == 0]) for t in range(3000)]
    rows += [(901, 0, "user", "Long text. " * 40_000), (901, 1, "assistant", "Same."), (901, 1, "assistant", "Same.")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [64, 1 << 16])
def test_turn_repair(spark, talks, block, monkeypatch):
    importable(spark)
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    df = spark.createDataFrame([(*r, "clash", 1) for r in talks], SCHEMA + ", pos string, block int").repartition(4)
    got = turn_repair.report(turn_repair.damaged(df), present=F.col("present")).collect()
    assert len(got) == len({r[0] for r in talks})
    want = _expected(talks)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]], r["conv_id"]


def test_turn_repair_rows_and_empty(spark):
    importable(spark)
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi!"), (1, 2, "user", "cut"), (1, 3, "assistant", "Bye."), (2, 0, "user", " ")]
    got = turn_repair.repaired(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "step").collect()
    assert [(r["conv_id"], r["step"], r["edit"], r["place"], r["role"]) for r in got] == [
        (1, 0, "D", None, "assistant"), (1, 1, "K", 0, "user"), (1, 2, "D", None, "user"), (1, 3, "K", 1, "assistant"), (2, 0, "D", None, "user")]
    empty = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repaired(empty).count() == 0 and turn_repair.report(empty).count() == 0
    none_left = turn_repair.report(spark.createDataFrame(rows, SCHEMA), present=F.lit(False)).collect()
    assert {tuple(r)[1:] for r in none_left} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and len(none_left) == 2


# --- whitening -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_rank_one_updates(seed):
    rng = np.random.default_rng(seed)
    d = [1, 2, 5, 20, 33, 64][seed]
    x = whitening.whole(rng.normal(size=(70, d)) * rng.choice([1e-2, 1, 30], size=d))
    x[10:20] = x[3]  # copies, and below a dimension that never changes
    x[:, 0] = x[0, 0]
    whole = whitening.Spectrum.empty(d)
    for i in range(len(x)):
        whole.take_block(x[i : i + 1])
    left, right = whitening.Spectrum.empty(d), whitening.Spectrum.empty(d)
    left.take_block(x[:69])
    right.take_block(x[69:])
    left.take_spectrum(whitening.Spectrum.unpacked(right.packed()))
    scatter = np.cov(x.T, bias=True).reshape(d, d) * len(x)
    for s in (whole, left):
        assert s.n == 70 and s.sums == [int(v) for v in x.sum(0)]
        assert np.allclose(s.values, np.linalg.eigvalsh(scatter), atol=1e-12 * max(1, scatter.max()))
        assert np.allclose(s.vectors.T @ s.vectors, np.eye(d), atol=1e-12)
        assert np.allclose(s.vectors @ np.diag(s.values) @ s.vectors.T, scatter, atol=1e-11 * max(1, abs(scatter).max()))


def _vectors(spark, d=40, n=400):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.2
    rows = [(i, [float(v) for v in x[i]], "clash") for i in range(n)] + [(3, [float(v) for v in x[3]], "clash"), (None, [float(v) for v in x[4]], "clash")]
    bad = [(1001, None, ""), (1002, [], ""), (1003, [1.0] * (d - 1) + [None], ""), (1004, [float("nan")] * d, ""), (1005, [float("inf")] * d, ""), (1006, [1.0, 2.0], "")]
    return rows, spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, component string").repartition(5)


def test_whitening(spark):
    importable(spark)
    rows, df = _vectors(spark)
    got = whitening.whiten(df).collect()
    x = np.floor(64 * np.array([v for _, v, _ in rows])).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    centre = (n * x - sums) / n
    values, vectors = np.linalg.eigh(centre.T @ centre / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == n * 32 and {r["n"] for r in got} == {n}
    by = collections.defaultdict(dict)
    for r in got:
        by[r["vec_id"]].setdefault(r["component"], []).append(r)
    scores = centre @ vectors / np.sqrt(values)
    for k in range(32):
        mine = np.array([by[i][k + 1][0]["whitened"] for i in range(n - 2)])
        sign = np.sign(mine[0] * scores[0, k])
        assert np.allclose(mine, sign * scores[: n - 2, k], atol=1e-9)
        assert abs(by[0][k + 1][0]["explained"] / (values[k] / values.sum()) - 1) < 1e-9
    for i in range(n - 2):
        assert by[i][1][0]["deviation"] == sum(int(v) ** 2 for v in n * x[i] - sums) == int(by[i][1][0]["deviation_exact"])
    assert len(by[3][1]) == 2 and len(by[None][32]) == 1
    assert max(r["identity_error"] for r in got) < 1e-9


def test_whitening_without_spread(spark):
    importable(spark)
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 6.0]), (3, [9.0, 18.0])], schema)).collect()
    assert {r["component"] for r in flat} == {1} and abs(sum(r["whitened"] for r in flat)) < 1e-9
    big = whitening.deviations(np.array([[2**45, 1], [5, 2]]), 2, [2**45 + 5, 3])
    assert big == [(2 * 2**45 - 2**45 - 5) ** 2 + 1, (10 - 2**45 - 5) ** 2 + 1]


# --- n-gram join ---------------------------------------------------------------------------------------------------


def _components(rows, words, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, (True, 0)), (k is None, k or 0))
    return collections.Counter((k, len(s), None if least[find(i)][0] else least[find(i)][1]) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def _prose():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgß") for _ in range(rng.randint(2, 6))) for _ in range(600)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    passage, texts = say(30), []
    for n in (40, 60, 90, 130, 300):
        for _ in range(12):
            base = say(n) + (passage if rng.random() < 0.5 else [])
            texts.append(base)
            for k in range(rng.randrange(4)):  # chains of near copies on both sides of the threshold
                base = list(base)
                for _ in range(rng.randrange(1, 1 + max(1, n // 40))):
                    base[rng.randrange(len(base))] = "changed" + str(k)
                texts.append(base)
    star = say(50)
    texts += [[*star[:i], "other" + str(i), *star[i + 1 :]] for i in range(50)]
    texts = [" ".join(t) for t in texts]
    texts += [None, "", " \t\n", "one", "One ", "two words", "a b c", "A b  c", "a b c d", texts[0].upper(), texts[0], "z" * 5000, " ".join(say(30_000))]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[5]), (None, "nobody has an id here at all"), (None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("words", "percent", "block"), [(4, 85, 256), (4, 85, 5), (3, 60, 16)])
def test_ngram_join(spark, words, percent, block):
    importable(spark)
    rows = _prose()
    df = spark.createDataFrame([(*r, 1, 2, "clash") for r in rows], "doc_id long, text string, cid int, n int, token string")
    got = ngram_join.similar_components(df, words=words, percent=percent, block=block).collect()
    assert collections.Counter(map(tuple, got)) == _components(rows, words, percent)


def test_ngram_join_of_nothing(spark):
    importable(spark)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similar_components(empty).count() == 0
    assert [tuple(r) for r in ngram_join.similar_components(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect()] == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("seed", range(5))
def test_dual_traversal_loses_no_link(seed):
    rng = np.random.default_rng(seed)
    sets, component = [], []
    for k in range(60):
        base = rng.integers(0, 2**63, rng.integers(1, 80)).astype(np.uint64)
        for _ in range(rng.integers(1, 4)):
            keep = base[rng.random(len(base)) > 0.06]
            sets.append(np.unique(np.append(keep, rng.integers(0, 2**63, 1).astype(np.uint64))))
            component.append(int(rng.integers(0, 3)) if k % 5 else 100)
    maps = [ngram_join.bitmap(s) for s in sets]
    bits = np.stack([ngram_join.folded(m, min(map(len, maps))) for m in maps])
    n, component = np.array([len(s) for s in sets]), np.array(component)
    links = {(i, j) for i in range(len(sets)) for j in range(i) if component[i] != component[j] and 100 * (x := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (n[i] + n[j] - x)}
    i, j = ngram_join.dual_traversal(ngram_join.SignatureTree(n, component, bits), None, 85)
    found = list(zip(np.maximum(i, j).tolist(), np.minimum(i, j).tolist(), strict=True))
    assert links <= set(found) and len(found) == len(set(found))
    half = len(sets) // 3
    trees = [ngram_join.SignatureTree(n[s], component[s], bits[s]) for s in (slice(0, half), slice(half, None))]
    i, j = ngram_join.dual_traversal(*trees, 85)
    assert {(a, b) for a, b in links if a >= half > b} <= set(zip((j + half).tolist(), i.tolist(), strict=True))

"""N-gram Jaccard self-join with signature trees.

1. One pass over the texts counts all shingles in a fixed number of cells, for a common order of shingles: those in rarer cells first.
   The order decides only how much work there is, never the result.
2. A second pass makes of each text the size and 128-bit name of its shingle set, a bitmap of the whole set and the set's first shingles
   in the order, so many that two similar sets share one of them. Texts with the same set form a class and count once from here on.
3. Classes that share such a shingle meet below it. Each class is first compared with one other, the class that meets most others; that
   links most groups, stars of copies in particular.
4. What a shingle still holds of several components is cut by size and into blocks. In each pair of blocks, trees whose nodes hold the
   OR of the bitmaps, the range of sizes and of components below them are traversed together; a pair of nodes is left as soon as their
   sizes, the bits that they share or a common component rule every link between them out. The few members of a rare shingle are
   paired without a tree: one level, whose leaves are tested alike, once for each pair instead of once for each shingle.
5. Pairs of leaves that remain are counted on the full sets, and components labelled with their smallest id.

Nothing in it is approximate but the names: shingles have 64 bits, sets 128.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.llm import setsketch
from netquill.llm.common import combined, let_go, remove, scratch_path, text_chunks, written
from netquill.llm.components import components

WORDS, PERCENT = 4, 85
#: Cells in which shingles are counted: one for about CELL_BYTES bytes of text, MOST_CELLS (eight megabytes of levels) at most.
CELL_BYTES, LEAST_CELLS, MOST_CELLS = 128, 1 << 12, 1 << 23
#: Members of a block, children of a node, and members up to which the pairs of a block are taken without a tree.
BLOCK, FAN, FEW = 256, 4, 8
#: Words of the bitmaps in trees, which every shingle of a set carries along; a longer bitmap is folded there and used whole for the leaves that remain.
TREE_WORDS = 64
_CHUNK_BYTES = 1 << 20


def _source(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("text_key"))


def _levels(source: DataFrame, words: int) -> np.ndarray:
    """For each cell, how many doublings its count lies above twice the mean: the first key of the order."""
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    width = min(max(LEAST_CELLS, 1 << int(size // CELL_BYTES).bit_length()), MOST_CELLS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = np.zeros(width, np.int64), False
        for b in batches:
            for _, data, offsets in text_chunks(b.column("text"), _CHUNK_BYTES):
                elements, _ = setsketch.shingles(data, offsets, words)
                at, n = np.unique((elements & np.uint64(width - 1)).astype(np.int64), return_counts=True)
                cells[at] += n
                seen = seen or len(at) > 0
        if seen:
            yield pa.record_batch([pa.array([zlib.compress(cells.tobytes(), 1)], pa.binary())], ["state"])

    def added(states: list[bytes]) -> bytes:
        total = np.zeros(width, np.int64)
        for s in states:
            total += np.frombuffer(zlib.decompress(s), np.int64)
        return zlib.compress(total.tobytes(), 1)

    states = source.select("text").mapInArrow(counted, "state binary").select(F.spark_partition_id().cast("long").alias("part"), "state")
    total = combined(states, added, "join-cells")
    if total is None:
        return np.zeros(width, np.uint8)
    cells = np.frombuffer(zlib.decompress(total), np.int64)
    return np.log2(np.maximum(cells / (2 * cells.mean()), 1)).astype(np.uint8)


def bitmap(elements: np.ndarray) -> np.ndarray:
    """Bits of a set, at least four times as many as it has elements, a power of two."""
    width = max(64, 1 << int(4 * len(elements) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(elements & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits."""
    return bits if len(bits) == words else np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def signed(docs: DataFrame, key: str, text: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n (set size), d1 and d2 (the set's name), bits, prefix; nulls in the last two for a text without words."""
    source = _source(docs, key, text)
    levels = docs.sparkSession.sparkContext.broadcast(_levels(source, words))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in text_chunks(b.column("text"), _CHUNK_BYTES):
                elements, at = setsketch.shingles(data, offsets, words)
                n = np.diff(at)
                level = levels.value[(elements & np.uint64(len(levels.value) - 1)).astype(np.int64)]
                ordered = elements[np.lexsort((elements, level, np.repeat(np.arange(len(n)), n)))]
                some = n - (percent * n + 99) // 100 + 1
                names = [setsketch.digest(elements[at[i] : at[i + 1]]) for i in range(len(n))]
                yield pa.record_batch(
                    [b.column("doc_id").slice(first, len(n)), b.column("text_key").slice(first, len(n)), pa.array(n), pa.array([x for x, _ in names], pa.int64()),
                     pa.array([x for _, x in names], pa.int64()), pa.array([bitmap(elements[at[i] : at[i + 1]]).tobytes() if n[i] else None for i in range(len(n))], pa.binary()),
                     pa.array([ordered[at[i] : at[i] + some[i]].tobytes() if n[i] else None for i in range(len(n))], pa.binary())],
                    ["doc_id", "text_key", "n", "d1", "d2", "bits", "prefix"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return source.mapInArrow(sign, f"doc_id {kind}, text_key long, n long, d1 long, d2 long, bits binary, prefix binary")


def linkable(most: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of at least ``a`` and ``b`` elements that share at most ``most`` can reach the similarity."""
    return (100 + percent) * most >= percent * (np.maximum(a, most) + np.maximum(b, most))


class SignatureTree:
    """Classes in order of component and size, and nodes of FAN children above them; level 0 are the classes, the last is the root."""

    def __init__(self, n: np.ndarray, component: np.ndarray, bits: np.ndarray):
        self.order = np.lexsort((n, component))
        n, component, bits = n[self.order], component[self.order], bits[self.order]
        excess = n - np.bitwise_count(bits).sum(1).astype(np.int64)  # elements that share a bit with another of their set
        self.levels = [(n, n, component, component, excess, bits)]
        while len(n) > 1:
            low, high, first, last, excess, bits = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            n = np.minimum.reduceat(low, at)
            self.levels.append((n, np.maximum.reduceat(high, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at),
                                np.maximum.reduceat(excess, at), np.bitwise_or.reduceat(bits, at, axis=0)))


def _open(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes may hold a link between two components: no set below shares more than the common bits and its excess."""
    (low, high, first, last, excess, bits), (low2, high2, first2, last2, excess2, bits2) = x, y
    apart = ~((first[i] == last2[j]) & (last[i] == first2[j]) & (first[i] == last[i]))
    most = np.minimum(high[i], high2[j])
    keep = apart & linkable(most, low[i], low2[j], percent)
    i, j, most = i[keep], j[keep], most[keep]
    for at in range(0, len(i), 4096):
        part = slice(at, at + 4096)
        shared = np.bitwise_count(bits[i[part]] & bits2[j[part]]).sum(1).astype(np.int64)
        most[part] = np.minimum(most[part], shared + np.minimum(excess[i[part]], excess2[j[part]]))
    keep[keep] = linkable(most, low[i], low2[j], percent)
    return keep


def dual_traversal(x: SignatureTree, y: SignatureTree | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in x's input, place in y's) that can't be ruled out; with None for ``y``, pairs within x, each once."""
    other = x if y is None else y
    at, at2 = len(x.levels) - 1, len(other.levels) - 1
    i = j = np.zeros(1, np.int64)
    while True:
        keep = _open(x.levels[at], other.levels[at2], i, j, percent)
        i, j = i[keep], j[keep]
        if at == 0 and at2 == 0 or len(i) == 0:
            break
        down, down2 = at >= at2, at2 >= at  # the taller tree goes down, equally tall ones together
        at, at2 = at - down, at2 - down2
        if down:
            i, j = (i[:, None] * FAN + np.arange(FAN)).ravel(), np.repeat(j, FAN)
        if down2:
            i, j = np.repeat(i, FAN), (j[:, None] * FAN + np.arange(FAN)).ravel()
        inside = (i < len(x.levels[at][0])) & (j < len(other.levels[at2][0]))
        if y is None:
            inside &= (i < j) if at == 0 else (i <= j)
        i, j = i[inside], j[inside]
    if y is None:
        i, j = i[i != j], j[i != j]
    return x.order[i], other.order[j]


def _candidates(blocks: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components that a block leaves open. The rows of a block arrive one after the other."""

    def matrix(maps: list[np.ndarray]) -> np.ndarray:
        words = min(map(len, maps))
        return np.stack([folded(m, words) for m in maps])

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            if not rows.num_rows:
                return
            part = {c: rows.column(c).to_numpy() for c in ("token", "ci", "cj", "cid", "component", "n", "side")}
            maps = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in rows.column("bits").chunks for x in chunk]
            edge = np.flatnonzero(np.append(True, np.any([part[c][1:] != part[c][:-1] for c in ("token", "ci", "cj")], axis=0)))
            few: list[tuple[np.ndarray, np.ndarray]] = []
            found = []
            for a, z in zip(edge, np.append(edge[1:], rows.num_rows), strict=True):
                within, side = part["ci"][a] == part["cj"][a], part["side"][a:z]
                if z - a <= FEW:
                    i, j = np.triu_indices(z - a, 1) if within else (v.ravel() for v in np.meshgrid(np.flatnonzero(side == 0), np.flatnonzero(side == 1), indexing="ij"))
                    few.append((i + a, j + a))
                    continue
                bits = matrix(maps[a:z])
                sides = [np.arange(a, z)] if within else [a + np.flatnonzero(side == s) for s in (0, 1)]
                if min(map(len, sides)) == 0:
                    continue
                trees = [SignatureTree(part["n"][s], part["component"][s], bits[s - a]) for s in sides]
                i, j = dual_traversal(trees[0], trees[1] if len(trees) > 1 else None, percent)
                found.append((sides[0][i], sides[-1][j]))
            if few:
                i, j = np.concatenate([x for x, _ in few]), np.concatenate([x for _, x in few])
                size, component = part["n"], part["component"]
                fit = (component[i] != component[j]) & linkable(np.minimum(size[i], size[j]), size[i], size[j], percent)
                i, j = i[fit], j[fit]
                width = np.array([len(m) for m in maps])
                common = np.minimum(width[i], width[j])
                for w in np.unique(common):
                    x, y = i[common == w], j[common == w]
                    for at in range(0, len(x), 4096):
                        p, q = x[at : at + 4096], y[at : at + 4096]
                        u, v = np.stack([folded(maps[k], w) for k in p]), np.stack([folded(maps[k], w) for k in q])
                        shared = np.bitwise_count(u & v).sum(1).astype(np.int64)
                        spare = np.minimum(size[p] - np.bitwise_count(u).sum(1), size[q] - np.bitwise_count(v).sum(1)).astype(np.int64)
                        stay = linkable(np.minimum(np.minimum(size[p], size[q]), shared + spare), size[p], size[q], percent)
                        found.append((p[stay], q[stay]))
            if found:
                p, q = part["cid"][np.concatenate([x for x, _ in found])], part["cid"][np.concatenate([x for _, x in found])]
                yield pa.record_batch([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])

        for b in batches:
            held.append(b)
            rows = pa.Table.from_batches(held)
            keys = [rows.column(c).to_numpy() for c in ("token", "ci", "cj")]
            other = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0)) if rows.num_rows else np.zeros(0, int)
            same = int(other[-1]) + 1 if len(other) else 0
            yield from emit(rows.slice(0, same))  # the last block may go on in the next batch
            held = rows.slice(same).to_batches()
        if held:
            yield from emit(pa.Table.from_batches(held))

    return blocks.mapInArrow(traverse, "a long, b long").distinct()


def _counted(pairs: DataFrame, docs: DataFrame, classes: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link, counted on the sets of their representatives' texts."""
    ends = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    wanted = ends.join(classes.select("cid", "first.doc_id", "first.text_key"), "cid")
    source = _source(docs, key, text).withColumnsRenamed({"doc_id": "d", "text_key": "t"})
    met = source.join(wanted, (F.col("t") == F.col("text_key")) & F.col("d").eqNullSafe(F.col("doc_id"))).select("cid", "text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in text_chunks(b.column("text"), _CHUNK_BYTES):
                elements, at = setsketch.shingles(data, offsets, words)
                n = len(offsets) - 1
                yield pa.record_batch([b.column("cid").slice(first, n), pa.array([elements[at[i] : at[i + 1]].tobytes() for i in range(n)], pa.binary())], ["cid", "elements"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("ea"), b.column("eb"), strict=True)):
                both = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)]))
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * shared >= percent * (len(both) - shared)
            yield pa.record_batch([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep))

    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "join-sets")
    met.mapInArrow(shingled, "cid long, elements binary").dropDuplicates(["cid"]).write.parquet(path)
    sets = spark.read.schema("cid long, elements binary").parquet(path)
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("elements").alias("ea")), "a").join(sets.select(F.col("cid").alias("b"), F.col("elements").alias("eb")), "b")
    links = written(both.select("a", "b", "ea", "eb").mapInArrow(compared, "a long, b long"), "join-links")
    remove(spark, path)
    let_go(spark)
    return links


def _not_ruled_out(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps allow a link."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            most = np.minimum(na, nb)
            for i, (x, y) in enumerate(zip(b.column("xa"), b.column("xb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                w = min(len(x), len(y))
                x, y = folded(x, w), folded(y, w)
                spare = min(int(na[i]) - int(np.bitwise_count(x).sum()), int(nb[i]) - int(np.bitwise_count(y).sum()))
                most[i] = min(int(most[i]), int(np.bitwise_count(x & y).sum()) + spare)
            yield pa.record_batch([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(linkable(most, na, nb, percent)))

    def side(c: str) -> DataFrame:
        return classes.select(F.col("cid").alias(c), F.col("n").alias("n" + c), F.col("bits").alias("x" + c))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(checked, "a long, b long")


def _few_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components and of sizes that can match, from shingles with FEW members at most."""
    held = placed.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("cid", "component", "n"))).alias("held"))
    each = held.select(F.explode(F.flatten(F.transform("held", lambda x, i: F.transform(F.slice("held", 1, i), lambda y: F.struct(y.alias("x"), x.alias("y")))))).alias("p"))
    sizes = (100 * F.least("p.x.n", "p.y.n") >= percent * F.greatest("p.x.n", "p.y.n"))
    return each.filter((F.col("p.x.component") != F.col("p.y.component")) & sizes).select(F.col("p.x.cid").alias("a"), F.col("p.y.cid").alias("b")).distinct()


def _blocks(placed: DataFrame, classes: DataFrame, percent: int, block: int) -> DataFrame:
    """(token, ci, cj, side, cid, component, n, bits): the members of each pair of blocks whose sizes can match, in order.

    A block holds members of one size class of one token; two sizes that match are in the same class or in neighbouring ones."""
    scale = max(float(-np.log(percent / 100)), 1e-6) * 1.000001
    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column("bits")]
            yield pa.record_batch([b.column("cid"), pa.array([folded(m, min(len(m), TREE_WORDS)).tobytes() for m in maps], pa.binary())], ["cid", "bits"])

    inside = classes.join(placed.select("cid").distinct(), "cid", "left_semi")
    sized = placed.join(inside.select("cid", "bits").mapInArrow(short, "cid long, bits binary"), "cid").withColumn("z", F.floor(F.log(F.col("n").cast("double")) / scale).cast("int"))
    cells = sized.groupBy("token", "z").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    higher = cells.select("token", (F.col("z") - 1).alias("z"), F.col("parts").alias("above"))
    lower = cells.select("token", (F.col("z") + 1).alias("z"), F.col("parts").alias("below"))
    cells = cells.join(higher, ["token", "z"], "left").join(lower, ["token", "z"], "left").na.fill(0, ["above", "below"])
    told = sized.join(cells, ["token", "z"]).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    node = lambda z, part: F.struct(z.alias("z"), part.alias("part"))
    own = node(F.col("z"), F.col("own"))

    def others(z: Column, count: Column) -> Column:
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda p: node(z, p))).otherwise(F.array().cast("array<struct<z:int,part:int>>"))

    partners = F.concat(others(F.col("z") - 1, F.col("below")), others(F.col("z"), F.col("parts")), others(F.col("z") + 1, F.col("above")))
    told = told.withColumn("own_node", own).withColumn("other", F.explode(partners))
    pairs = told.select("token", F.least("own_node", "other").alias("ci"), F.greatest("own_node", "other").alias("cj"), (F.col("own_node") > F.col("other")).cast("int").alias("side"), "cid", "component", "n", "bits")
    pairs = pairs.withColumns({c: F.col(c)["z"].cast("long") * F.lit(1 << 32) + F.col(c)["part"] for c in ("ci", "cj")})
    return pairs.repartition("token", "ci", "cj").sortWithinPartitions("token", "ci", "cj")


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Components of texts whose sets of ``words``-word shingles link: 100 * intersection >= percent * union.

    One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links, itself included). A-Z is lower-cased;
    a text with fewer words has its whole sequence as its one shingle; one that is null, empty or without words is linked with nothing.
    Rows with equal sets are linked, repeated rows too. A null id is the largest; a component of null ids only has a null id. Texts of
    any length are read whole. Other columns are not read; an empty table gives an empty result.
    """
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "join-signed")
    made = signed(docs, key, text, words, percent)
    made.write.parquet(path)
    rows = spark.read.schema(made.schema).parquet(path)
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    classes = rows.filter(F.col("n") > 0).groupBy("d1", "d2").agg(F.min(order).alias("first"), F.max("n").alias("n"), F.max("bits").alias("bits"), F.max("prefix").alias("prefix"))
    classes = written(classes.sortWithinPartitions("d1", "d2").withColumn("cid", F.monotonically_increasing_id()), "join-classes")
    rows = written(rows.select("doc_id", "n", "d1", "d2"), "join-rows")
    remove(spark, path)
    let_go(spark)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                lists = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("prefix")]
                yield pa.record_batch([pa.array(np.concatenate(lists)), pa.array(np.repeat(part.column("cid").to_numpy(), [len(x) for x in lists]))], ["token", "cid"])

    tokens = classes.select("cid", "prefix").mapInArrow(listed, "token long, cid long")
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    members = written(tokens.join(shared, "token"), "join-members")
    let_go(spark)

    met = members.groupBy("cid").agg(F.sum("size").alias("met"))
    leaders = members.join(met, "cid").groupBy("token").agg(F.max(F.struct("met", "cid")).alias("lead")).select("token", F.col("lead.cid").alias("leader"))
    led = members.join(leaders, "token").filter(F.col("cid") != F.col("leader")).groupBy("cid", "leader").agg(F.count(F.lit(1)).alias("common"))
    led = led.groupBy("cid").agg(F.max(F.struct("common", "leader")).alias("best")).select(F.col("cid").alias("a"), F.col("best.leader").alias("b"))
    stars = written(_not_ruled_out(led, classes, percent), "join-stars")
    let_go(spark)
    roots = written(components(_counted(stars, docs, classes, key, text, words, percent)), "join-roots")

    placed = members.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("root", "cid")).drop("root")
    mixed = placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter(F.col("x") < F.col("y")).select("token")
    placed = written(placed.join(mixed, "token").join(classes.select("cid", "n"), "cid"), "join-placed")
    let_go(spark)
    few = _few_pairs(placed.filter(F.col("size") <= FEW), percent)
    many = _candidates(_blocks(placed.filter(F.col("size") > FEW).drop("size"), classes, percent, block), percent)
    met = written(few.union(many).distinct(), "join-met")
    let_go(spark)
    pairs = written(_not_ruled_out(met, classes, percent), "join-pairs")
    more = _counted(pairs, docs, classes, key, text, words, percent)
    known = roots.filter(F.col("node") != F.col("root")).select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = written(components(known.unionByName(more)), "join-components")

    least = roots.join(classes.select(F.col("cid").alias("node"), "first"), "node").groupBy("root").agg(F.min("first").alias("best"))
    named = roots.join(least, "root").select(F.col("node").alias("cid"), "best")
    resolved = classes.join(named, "cid", "left").select("d1", "d2", F.coalesce("best", "first").alias("best"))
    out = rows.join(written(resolved, "join-resolved"), ["d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"))

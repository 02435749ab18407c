"""MinHash near-duplicates by a chosen-path set similarity join.

A document is its set of distinct five-word shingles (as 64-bit hashes), lower-cased A-Z; with fewer words, all of them are one
shingle. Documents are linked if the Jaccard similarity of their sets is at least 0.75, and grouped by connected components.

1. Equal sets are one class, represented by its least doc_id; only classes go on. A class of any size is one row.
2. ``TREES`` independent trees: a document branches by the minwise token at the coordinate that belongs to the tree and level alone. A node
   with one document ends; one with at most ``NODE`` is compared exhaustively by signature, and yields a spanning forest of
   the pairs that may reach the threshold (never all pairs); a larger one branches on, down to ``DEPTH`` levels. What is still
   larger there is joined to its least document without comparison: a superset, so nothing is lost. Node sizes come from partial
   counts; large nodes are told by their (few) sizes, broadcast or on salted keys, and never gathered. A pair of similarity s ends in one
   node with probability s**level per tree, so ``TREES`` trees miss it with (1 - s**level)**TREES: at 0.75 with 4e-15 at the first level,
   where almost all nodes are small, 3e-9 at the second, 4e-6 at the third, 1e-4 at the fourth, 2e-3 at the fifth and nothing at the last.
3. The forests' components gather documents that may be linked. Only these documents' texts are read again, and links are
   confirmed on full shingle sets: every pair of a component is compared unless it is connected already. Components of
   more than ``BLOCK`` documents (or ``BLOCK_SHINGLES``) are dealt into blocks twice, by two hashes, and compared within the blocks; only where
   that leaves more than one cluster are blocks compared with each other, each pair of blocks a task, and only across clusters.
4. Components of the confirmed links.

A text of any length is whole: its set has a hash a shingle, and is confirmed with all of them. Null and empty texts, and texts without words, have an empty set and are linked with nothing. Rows with equal doc_id have
the links of their own text each. A null doc_id is linked with nothing: its component is null, and it is kept. An empty table
gives no rows. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, kept_table, small_batches, tidy
from .graph import components

SHINGLE = 5
#: A link: PART * intersection >= WHOLE * union.
PART, WHOLE = 100, 75
TREES = 24
DEPTH = 6
#: One for each tree and level: those of the first level come first.
COORDINATES = TREES * DEPTH
NODE = 256
BLOCK, BLOCK_SHINGLES = 1000, 4_000_000
#: Coordinates whose low bytes are compared, and how many must agree for a pair to be looked at: 5.8 standard deviations below the threshold.
#: AGREE of 0 switches this off: all pairs of a small node are then looked at.
LOW, AGREE = 64, 28
SALTS = 64
CACHE_WORDS = 250_000
SEED = 20_260_101

_rng = np.random.default_rng(SEED)
_MULTIPLY = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_hashes: dict[bytes, bytes] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _forget() -> None:
    _hashes.clear()


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    split = [(t or b"").lower().split() for t in texts]
    if len(_hashes) > CACHE_WORDS:
        _hashes.clear()
    for w in set().union(*split).difference(_hashes) if split else ():
        _hashes[w] = xxhash.xxh64_intdigest(w).to_bytes(8, "little")
    get = _hashes.__getitem__
    out = []
    step = np.uint64(0x9E3779B97F4A7C15)
    for words in split:
        if not words:
            out.append(np.zeros(0, dtype=np.uint64))
            continue
        w = np.frombuffer(b"".join(map(get, words)), dtype=np.uint64)
        k = min(SHINGLE, len(w))
        h = np.full(len(w) - k + 1, k, dtype=np.uint64)
        for j in range(k):
            h = _mix((h + step) ^ w[j : len(w) - k + 1 + j]) if j == k - 1 else (h * step) ^ (w[j : len(w) - k + 1 + j] * np.uint64(2 * j + 3))
        out.append(np.unique(h))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise values of nonempty sets, a row each."""
    sizes = np.asarray([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    out = np.empty((len(sets), COORDINATES), dtype=np.uint32)
    for i in range(COORDINATES):
        out[:, i] = np.minimum.reduceat((((flat ^ _FLIP[i]) * _MULTIPLY[i]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text (binary) to doc_id, n, key of the set, minwise values of the first level, 16 bits of those of deeper ones, low bytes.

    Deeper values only tell members of one node apart, for which 16 bits do: that two agree by chance makes a node larger, no more.
    """
    for batch in batches:
        texts, at = batch.column(1).to_pylist(), 0
        while at < len(texts):
            upto, total = at, 0
            while upto < len(texts) and (total < 4 << 20 or upto == at):
                total += len(texts[upto] or b"")
                upto += 1
            sets = shingle_sets(texts[at:upto])
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = np.zeros((len(sets), COORDINATES), dtype=np.uint32)
            if full:
                sig[full] = signatures([sets[i] for i in full])
            n = len(sets)
            values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * TREES), pa.array(np.ascontiguousarray(sig[:, :TREES]).reshape(-1).view(np.int32)))
            deep = np.ascontiguousarray(sig[:, TREES:].astype(np.uint16))
            low = sig[:, :LOW].astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, n),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                    values,
                    pa.array([x.tobytes() for x in deep], pa.binary()),
                    pa.array([x.tobytes() for x in low], pa.binary()),
                ],
                names=["doc_id", "n", "key", "sig", "deep", "low"],
            )
            at = upto


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of consecutive rows that agree in the first ``keys`` columns (long)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([np.asarray(batch.column(i)) for i in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = tuple(k[a])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union by least index."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def of(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return int(i)

    def labels(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return up
            self.root = up

    def join(self, a: int, b: int) -> bool:
        a, b = self.of(a), self.of(b)
        if a == b:
            return False
        self.root[max(a, b)] = min(a, b)
        return True


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])


def _compare_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, rep, low) sorted by node: a spanning forest of each node's similar pairs."""
    out: list[tuple[int, int]] = []
    for node in runs(batches, 1):
        reps = np.asarray(node.column(1))
        if len(reps) < 2:
            continue
        low = np.frombuffer(b"".join(node.column(2).to_pylist()), dtype=np.uint8).reshape(-1, LOW)
        forest = Forest(len(reps))
        for i in range(len(reps) - 1):
            alike = np.flatnonzero((low[i + 1 :] == low[i]).sum(axis=1) >= AGREE)
            out += [(int(reps[i]), int(reps[j])) for j in (alike + i + 1).tolist() if forest.join(i, j)]
        if len(out) > 50_000:
            yield _edges(out)
            out = []
    yield _edges(out)


def linked(sets: list[np.ndarray], side: np.ndarray | None = None, cluster: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that reach the threshold; with ``side``, only pairs from different sides are compared.

    Sets of equal ``cluster`` count as connected.
    """
    n = len(sets)
    sizes = np.asarray([len(s) for s in sets], dtype=np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    forest, out = Forest(n), []
    if cluster is not None:
        _, first, back = np.unique(cluster, return_index=True, return_inverse=True)
        forest.root = first[back]
    for i in range(n - 1):
        roots = forest.labels()
        todo = (roots[i + 1 :] != roots[i]) & (PART * np.minimum(sizes[i + 1 :], sizes[i]) >= WHOLE * np.maximum(sizes[i + 1 :], sizes[i]))
        if side is not None:
            todo &= side[i + 1 :] != side[i]
        others = np.flatnonzero(todo) + i + 1
        if not len(others):
            continue
        mine = np.zeros(flat.max() + 1, dtype=np.int64)
        mine[flat[starts[i] : starts[i] + sizes[i]]] = 1
        for part in np.array_split(others, -(-int(sizes[others].sum()) // 4_000_000)):
            own = sizes[part]
            at = np.repeat(starts[part] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
            both = np.add.reduceat(mine[flat[at]], np.cumsum(own) - own)
            for j in part[PART * both >= WHOLE * (sizes[i] + own - both)].tolist():
                if forest.join(i, j):
                    out.append((i, j))
    return out


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (component, first block, second block, block, cluster, doc_id, text) sorted by the first three: confirmed links."""
    for group in runs(batches, 3):
        if group.num_rows < 2:
            continue
        sets = shingle_sets(group.column(6).to_pylist())
        ids = np.asarray(group.column(5))
        full = [i for i, s in enumerate(sets) if len(s)]
        side = np.asarray(group.column(3))[full] if group.column(1)[0].as_py() != group.column(2)[0].as_py() else None
        found = linked([sets[i] for i in full], side, np.asarray(group.column(4))[full]) if len(full) > 1 else []
        yield _edges([(int(ids[full[i]]), int(ids[full[j]])) for i, j in found if ids[full[i]] != ids[full[j]]])


def _with_sizes(rows: DataFrame, level: int) -> DataFrame:
    """Rows of nodes with two documents or more, with ``size`` and the least document."""
    sizes = kept_table(rows.groupBy(F.col("node").alias("n2")).agg(F.count("*").alias("size"), F.min("rep").alias("least")).where("size > 1"), f"sizes{level}")
    big, small = sizes.where(F.col("size") > NODE), sizes.where(F.col("size") <= NODE)
    same = F.col("node") == F.col("n2")
    if fits_broadcast(big):
        told = rows.join(F.broadcast(big), same, "left")
    else:
        salted = big.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        told = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("own") == F.col("salt")), "left").drop("own", "salt")
    rest = told.where("size is null").drop("n2", "size", "least").join(small, same)
    return told.where("size is not null").unionByName(rest).drop("n2")


def _candidates(reps: DataFrame) -> DataFrame:
    """Edges (a, b) whose components hold every pair that may be linked; ``reps``: rep, sig, deep, low."""
    spark = reps.sparkSession
    found = []
    rows = reps.select("rep", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sig").select("rep", "tree", F.xxhash64("tree", F.element_at("sig", F.col("tree") + 1)).alias("node"))
    step = 2 * (DEPTH - 1)
    for level in range(1, DEPTH + 1):
        rows = _with_sizes(rows, level)
        if level == 1:  # rows of nodes that go on carry what all further levels need: the tree's own path and the low bytes
            path = F.expr(f"substring(deep, tree * {step} + 1, {step})").alias("path")
            rows = rows.join(reps.select(F.col("rep").alias("r2"), "deep", "low"), F.col("rep") == F.col("r2")).select("rep", "tree", "node", "size", "least", "low", path)
        rows = kept_table(rows, f"level{level}")
        leaves = rows.where(F.col("size") <= NODE).select("node", "rep", "low")
        found.append(kept_table(leaves.repartition("node").sortWithinPartitions("node").mapInArrow(tidy(_compare_nodes), "a long, b long").distinct(), "pairs"))
        large = rows.where(F.col("size") > NODE)
        if large.isEmpty():
            break
        if level == DEPTH:
            found.append(large.select(F.col("rep").alias("a"), F.col("least").alias("b")))
        else:
            rows = large.select("rep", "tree", "low", "path", F.xxhash64("node", F.expr(f"substring(path, {2 * level - 1}, 2)")).alias("node"))
    out = spark.createDataFrame([], "a long, b long")
    for f in found:
        out = out.unionByName(f)
    return out


def _links(rows: DataFrame, dealt: DataFrame) -> DataFrame:
    """Confirmed links (a, b) of documents (doc_id, t), from ``dealt``: node, component, one, two, block, cluster."""
    texts = rows.join(F.broadcast(dealt) if fits_broadcast(dealt) else dealt, F.col("doc_id") == F.col("node")).select("component", "one", "two", "block", "cluster", "doc_id", "t")
    return texts.repartition("component", "one", "two").sortWithinPartitions("component", "one", "two").mapInArrow(tidy(_confirm, _forget), "a long, b long")


def _confirmed(rows: DataFrame, maybe: DataFrame) -> DataFrame:
    """Components (node, component) of the links within the components of ``maybe``: node, component, blocks."""
    zero = F.lit(0).cast("long")
    alone = F.col("node").alias("cluster")
    links = _links(rows, maybe.where("blocks = 1").select("node", "component", zero.alias("one"), zero.alias("two"), zero.alias("block"), alone))
    large = maybe.where("blocks > 1")
    if large.isEmpty():
        return components(links)
    for turn in (1, 2):
        block = F.pmod(F.xxhash64("node", F.lit(turn)), F.col("blocks"))
        links = links.unionByName(_links(rows, large.withColumn("block", block).select("node", "component", F.col("block").alias("one"), F.col("block").alias("two"), "block", alone)))
    links = kept_table(links, "links")
    groups = components(links)
    told = large.join(groups.select(F.col("node").alias("g_node"), F.col("component").alias("cluster")), F.col("node") == F.col("g_node"), "left").withColumn("cluster", F.coalesce("cluster", "node"))
    open_ = told.groupBy(F.col("component").alias("o")).agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low < high").select("o")
    open_ = kept_table(told.join(open_, F.col("component") == F.col("o"), "left_semi").select(*maybe.columns, "cluster"), "open")
    if open_.isEmpty():
        return groups
    other = F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("other")
    pairs = open_.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))).select("node", "component", "block", "cluster", other).where("block <> other")
    pairs = kept_table(pairs.select("node", "component", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "cluster"), "blocks")
    return components(links.unionByName(_links(rows, pairs)))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id reachable) and kept (doc_id = component_id)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    every = kept_table(rows.mapInArrow(tidy(_profile, _forget), "doc_id long, n long, key binary, sig array<int>, deep binary, low binary"), "sets")
    some = every.where("n > 0 and doc_id is not null")
    classes = kept_table(some.groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("sig").alias("sig"), F.first("deep").alias("deep"), F.first("low").alias("low")), "classes")
    maybe = components(_candidates(classes.select("rep", "sig", "deep", "low")))
    maybe = maybe.unionByName(maybe.select(F.col("component").alias("node"), "component").distinct())
    maybe = maybe.join(classes.select(F.col("rep").alias("r2"), "n"), F.col("node") == F.col("r2")).select("node", "component", "n")
    size = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("long")
    size = maybe.groupBy(F.col("component").alias("c2")).agg(size.alias("blocks"))
    maybe = kept_table(maybe.join(size, F.col("component") == F.col("c2")).select("node", "component", "blocks"), "maybe")
    groups = _confirmed(rows, maybe)
    least = classes.select("key", "rep").join(groups, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    out = every.select("doc_id", F.col("n").alias("n_shingles"), "key").join(least.withColumnRenamed("key", "k2"), F.col("key") == F.col("k2"), "left")
    known = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", known.alias("component_id"), F.coalesce(F.col("doc_id") == known, F.lit(True)).alias("kept"))

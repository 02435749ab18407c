"""Approximate nearest neighbours by inner product: a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on at most ``SAMPLE`` vectors (those with the smallest hash of their id): every node splits its vectors into
``BRANCH`` centres by k-means, down to about ``LEAF`` rows of the whole table a leaf. Every row is then filed in one leaf. Inner
product is turned into distance by one more coordinate, sqrt(M^2 - |x|^2) with M the greatest norm; a query has 0 there.

A query walks the tree with a priority queue: it follows the nearest centre to a leaf and puts the others, by distance, into
the queue; the next leaf starts from the queue's best. How many leaves are visited is calibrated: for ``PROBES`` queries the
true neighbours among all rows are found by comparing with every row, in blocks, and visits widen until the leaves visited
hold the ``target`` share of them. On data without structure that takes most leaves; recall is what is promised.

Neighbouring leaves are packed into groups of about ``ROWS`` rows, and a leaf of more (copies of one vector, say) is cut into
several blocks. A task compares the rows of one group or block with up to ``QUERIES`` queries that visit leaves of it, as one
matrix product with the other leaves masked, and returns only the ``k`` best a query. Scores are inner products of the original vectors in
double precision, so the index decides which rows are compared, never how they score.

Extra columns are not carried, whatever their names. Repeated rows are candidates each, with ties to the smaller id.
Vectors that are null, of another length than most, zero, or that hold null or non-finite components take no part, as query or
candidate. A null id takes no part. Rows that repeat an id are candidates each, but one query: the one with the least vector; none of them is its neighbour.
An empty table gives no rows.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept_table, small_batches

SAMPLE = 40_000
BRANCH = 8
LEAF = 256
#: Rows of a group, and queries that are compared with it at a time: alike, since each side is sent once for every batch of the other.
ROWS = QUERIES = 8192
PROBES = 200
#: The share of true neighbours that calibration aims at; 0.9 is asked for.
TARGET = 0.97
#: Distances that a walk holds at a time.
HELD = 1 << 20
ROUNDS = 8
SEED = 5


@dataclass(frozen=True)
class Tree:
    """Centres of all nodes; ``child[i]`` is the first of node i's children, or -1 for a leaf."""

    centres: np.ndarray
    child: np.ndarray
    count: np.ndarray
    leaf: np.ndarray
    n_leaves: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each (augmented) vector."""
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.child[at] >= 0)
            if not len(inner):
                return self.leaf[at]
            nodes = at[inner]
            for node in np.unique(nodes):
                rows = inner[nodes == node]
                first, n = self.child[node], self.count[node]
                at[rows] = first + _nearest(x[rows], self.centres[first : first + n])

    def distances(self, q: np.ndarray) -> Iterator[list[float]]:
        """Squared distances of each (augmented) query to all centres, added up component by component: they depend on the pair alone. ``HELD`` numbers are held at a time."""
        step = max(1, HELD // max(1, len(self.centres)))
        for at in range(0, len(q), step):
            own = q[at : at + step]
            out = np.zeros((len(own), len(self.centres)))
            for j in range(q.shape[1]):
                out += (own[:, j, None] - self.centres[None, :, j]) ** 2
            for row in out:
                yield row.tolist()

    def visit(self, distance: list[float], most: int) -> list[int]:
        """Leaves of one query, given its distances, best bin first, at most ``most``."""
        child, count = self.links
        out: list[int] = []
        queue = [(0.0, 0)]
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            while child[node] >= 0:
                first = child[node]
                best, *others = sorted(zip(distance[first : first + count[node]], range(first, first + count[node]), strict=True))
                for other in others:
                    heapq.heappush(queue, other)
                node = best[1]
            out.append(int(self.leaf[node]))
        return out

    @functools.cached_property
    def links(self) -> tuple[list[int], list[int]]:
        """Children of nodes as plain numbers."""
        return self.child.tolist(), self.count.tolist()


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, centres)
        for c in range(k):
            if (own == c).any():
                centres[c] = x[own == c].mean(axis=0)
    return centres, _nearest(x, centres)


def fit_tree(x: np.ndarray, leaf: int, branch: int = BRANCH, seed: int = SEED) -> Tree:
    """A tree over (augmented) sample vectors, with at most about ``leaf`` of them in a leaf."""
    rng = np.random.default_rng(seed)
    centres, child, count = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])], [-1], [0]
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        distinct = len(np.unique(x[rows[:2000]], axis=0)) if len(rows) > leaf else 0
        if len(rows) <= leaf or distinct < 2:
            continue
        found, own = _k_means(x[rows], min(branch, distinct), rng)
        used = [c for c in range(len(found)) if (own == c).any()]
        if len(used) < 2:
            continue
        child[node], count[node] = len(centres), len(used)
        for c in used:
            todo.append((len(centres), rows[own == c]))
            centres.append(found[c])
            child.append(-1)
            count.append(0)
    child_ = np.asarray(child)
    leaves = np.full(len(child_), -1)
    leaves[child_ < 0] = np.arange((child_ < 0).sum())
    return Tree(np.asarray(centres), child_, np.asarray(count), leaves, int((child_ < 0).sum()))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _augment(x: np.ndarray, norm: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(0.0, norm * norm - (x**2).sum(axis=1)))[:, None]], axis=1)


def usable(vectors: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """``id`` and ``v`` (array of double) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & F.exists("v", lambda x: x != 0))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up component by component so that a pair's value depends on nothing else."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += q[j] * x[:, j]
    return out


def _best(queries: np.ndarray, y: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, seen: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its ``k`` best rows but its own, nearest first, ties to the smaller id.

    A matrix product finds the rows that may be among them; those are scored again, one way for all. ``seen``: which leaves
    each query visits (a matrix), and the leaf of each row.
    """
    for at in range(0, len(queries), 256):
        rough = y[at : at + 256] @ x.T
        slack = 1e-9 * (1.0 + np.abs(rough).max(initial=0.0))
        for i, (q, near) in enumerate(zip(queries[at : at + 256], rough, strict=True)):
            other = np.flatnonzero(ids != q) if seen is None else np.flatnonzero((ids != q) & seen[0][at + i][seen[1]])
            if len(other) > k:
                edge = np.partition(near[other], len(other) - k)[len(other) - k]
                other = other[near[other] >= edge - slack]
            scores = exact(y[at + i], x[other])
            order = np.lexsort((ids[other], -scores))[:k]
            yield int(q), ids[other][order], scores[order]


def _found(best: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> dict[str, pa.Array]:
    parts = [(np.full(len(i), q), i, s) for q, i, s in best]
    flat = lambda n, kind: pa.array(np.concatenate([p[n] for p in parts]).astype(kind) if parts else np.zeros(0, dtype=kind))
    return {"query": flat(0, np.int64), "id": flat(1, np.int64), "score": flat(2, np.float64)}


def _block_best(k: int, dim: int):
    def best(rows: pa.Table, asked: pa.Table) -> pa.Table:
        """The best of one block of rows for each query that asks for it."""
        if not rows.num_rows or not asked.num_rows:
            return pa.table(_found(iter(())))
        ids, x = np.asarray(rows.column("id")), _matrix(rows.column("v").combine_chunks(), dim)
        queries, y = np.asarray(asked.column("query")), _matrix(asked.column("w").combine_chunks(), dim)
        leaves, at = np.unique(np.asarray(rows.column("leaf")), return_inverse=True)
        visits = np.zeros((len(queries), len(leaves)), dtype=bool)
        for i, own in enumerate(asked.column("leaves").to_pylist()):
            visits[i, np.searchsorted(leaves, np.intersect1d(own, leaves))] = True
        return pa.table(_found(_best(queries, y, ids, x, k, (visits, at))))

    return best


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _true_neighbours(rows: DataFrame, probes: np.ndarray, probe_ids: np.ndarray, k: int, dim: int) -> dict[int, list[int]]:
    """Exact neighbours of a bounded number of probe queries among all rows."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = np.zeros(0, dtype=np.int64), np.zeros((0, dim))
        for batch in batches:
            if batch.num_rows:
                ids, x = np.concatenate([ids, np.asarray(batch.column(0))]), np.concatenate([x, _matrix(batch.column(1), dim)])
                # Only rows that are among the best of some probe stay.
                stay = np.isin(ids, np.unique(np.concatenate([i for _, i, _ in _best(probe_ids, probes, ids, x, k)])))
                ids, x = ids[stay], x[stay]
        yield pa.RecordBatch.from_pydict(_found(_best(probe_ids, probes, ids, x, k)))

    out: dict[int, list[int]] = {}
    for r in _top(rows.mapInArrow(compare, "query long, id long, score double"), k).select("query", "id").collect():
        out.setdefault(r["query"], []).append(r["id"])
    return out


def nearest(vectors: DataFrame, queries: Column, k: int = 20, vector: str = "embedding", vec_id: str = "vec_id", target: float = TARGET, sample: int = SAMPLE, probes: int = PROBES) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found for every row for which ``queries`` (over ``id``) holds."""
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable(vectors, vector, vec_id)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return empty
    dim, n, norm = sizes["dim"], sizes["n"], float(np.sqrt(sizes["norm2"])) * (1 + 1e-12)
    rows = rows.where(F.size("v") == dim)
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    x = _augment(_matrix(drawn.column("v").combine_chunks(), dim), norm)
    tree = fit_tree(x, max(2, LEAF * min(sample, n) // n))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.assign(_augment(_matrix(b.column(1), dim), norm)) if b.num_rows else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int64)), b.column(0), b.column(1)], names=["leaf", "id", "v"])

    filed = kept_table(rows.mapInArrow(file, "leaf long, id long, v array<double>"), "filed")
    asking = kept_table(rows.where(queries).groupBy("id").agg(F.min("v").alias("v")), "asking")
    # Calibration: probes are drawn from the queries by hash.
    probe = asking.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(probes).toArrow()
    if not probe.num_rows:
        return empty
    p, ids = _matrix(probe.column("v").combine_chunks(), dim), np.asarray(probe.column("id"))
    true = _true_neighbours(rows, p, ids, k, dim)
    wanted = filed.join(F.broadcast(spark.createDataFrame([(i,) for i in sorted({i for v in true.values() for i in v})], "want long")), F.col("id") == F.col("want"), "left_semi")
    home = {r["id"]: r["leaf"] for r in wanted.select("id", "leaf").collect()}
    depth = []
    for d, i in zip(tree.distances(np.pad(p, ((0, 0), (0, 1)))), ids, strict=True):
        order = {leaf: at for at, leaf in enumerate(tree.visit(d, tree.n_leaves))}
        depth += [order[home[t]] + 1 for t in true.get(int(i), [])]
    visits = int(np.quantile(depth, target, method="higher")) if depth else tree.n_leaves

    load = kept_table(filed.groupBy("leaf").agg(F.count("*").alias("rows")), "load")
    held = np.zeros(tree.n_leaves, dtype=np.int64)
    for r in load.collect():  # one number a leaf of a tree over a bounded sample
        held[r["leaf"]] = r["rows"]

    # Groups of leaves in tree order; a leaf above ROWS is a group of its own, in blocks.
    blocks = np.maximum(1, -(-held // ROWS))
    group = np.zeros(tree.n_leaves, dtype=np.int64)
    now = filled = 0
    for leaf in range(tree.n_leaves):
        if filled and filled + held[leaf] > ROWS:
            now, filled = now + 1, 0
        group[leaf] = now
        filled += int(held[leaf])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for i, d in enumerate(tree.distances(np.pad(_matrix(b.column(1), dim), ((0, 0), (0, 1)))) if b.num_rows else ()):
                most = visits
                leaves = np.asarray(tree.visit(d, most))
                while len(leaves) < tree.n_leaves and held[leaves].sum() <= k:
                    most *= 2
                    leaves = np.asarray(tree.visit(d, most))
                for g in np.unique(group[leaves]):
                    out[0].append(int(g))
                    out[1].append(b.column(0)[i].as_py())
                    out[2].append(leaves[group[leaves] == g])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], names=["group", "query", "leaves"])

    asked = kept_table(asking.mapInArrow(ask, "group long, query long, leaves array<long>"), "asked")
    places = spark.createDataFrame([(i, int(group[i]), int(blocks[i])) for i in range(tree.n_leaves)], "l2 long, group long, blocks long")
    parts = asked.groupBy("group").agg(F.ceil(F.count("*") / QUERIES).cast("long").alias("parts")).select(F.col("group").alias("g2"), "parts")
    cuts = places.join(parts, F.col("group") == F.col("g2"))  # a row a leaf
    spread = lambda c, m: F.pmod(F.xxhash64(c), m)
    each = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), m - 1))
    left = filed.join(F.broadcast(cuts), F.col("leaf") == F.col("l2")).withColumn("block", spread("id", F.col("blocks"))).withColumn("part", each(F.col("parts"))).select("group", "block", "part", "leaf", "id", "v")
    by_group = cuts.groupBy(F.col("group").alias("g3")).agg(F.max("blocks").alias("blocks"), F.max("parts").alias("parts"))
    right = asked.join(F.broadcast(by_group), F.col("group") == F.col("g3")).withColumn("part", spread("query", F.col("parts"))).withColumn("block", each(F.col("blocks")))
    right = right.join(asking.select(F.col("id").alias("q2"), F.col("v").alias("w")), F.col("query") == F.col("q2")).select("group", "block", "part", "query", "leaves", "w")
    keys = ["group", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block_best(k, dim), "query long, id long, score double")
    return _top(found, k).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")

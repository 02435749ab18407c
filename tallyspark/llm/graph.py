"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_table


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


#: Edges that one task joins at once (16 bytes each); they are counted first.
SMALL = 500_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a small graph: every node but the least of its component, with that least one."""
    held = [np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))]) for b in batches if b.num_rows]
    if not held:
        return
    names, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
    a, b = ends.reshape(2, -1)
    label = np.arange(len(names))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    other = np.flatnonzero(label != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[other]), pa.array(names[label[other]])], names=["node", "component"])


def components(edges: DataFrame, rounds: int = 60, small: int = SMALL) -> DataFrame:
    """``node, component`` for every node of ``edges`` (a, b: long) but each component's least one, which names it.

    Alternates large-star and small-star contraction (each an aggregate and an equi-join on the node, so a node with many
    neighbours is pre-aggregated and its join side can be split) until only stars are left; every round is written to the shared folder.
    A graph of at most ``small`` edges, counted first, is joined in one task of an executor instead; contraction goes on only as long as there are more.
    """
    e = kept_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _mark(e)
    for _ in range(rounds):
        if before[0] <= small:
            return kept_table(e.coalesce(1).mapInArrow(_joined, "node long, component long"), "components")
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "u")
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = kept_table(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        stars = large.join(low, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        e = kept_table(stars.select("x.a", "x.b").where("a <> b").distinct(), "edges")
        after = _mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))

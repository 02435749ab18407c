"""Mixing sources to target weights: capped water-filling and seeded repetitions of whole documents.

The mix holds ``share`` times the words of the corpus. Sources in code-point order (null last) weigh ``weights``, repeated.
A source stops at ``max_epochs`` times its own size; what it leaves is shared among the others by weight until none exceeds
its cap. With sources ordered by cap/weight, the water level is the greatest of (total - caps before) / (weight - weights
before), so the redistribution is one window over the (few) sources instead of a loop.

A source taken ``e`` epochs takes every document ``floor(e)`` times, and documents in seeded order once more until the rest
of its target is met as nearly as whole documents allow. That running total is no sort of the source: documents fall into
4096 cells by the leading digits of their hash, and cell totals show in which cell the rest ends. Cells before it are
taken whole, cells after it not; only in that one are documents ordered. So texts are not shuffled, but for one cell in 4096.

Null texts have size 0; null sources are one source; a null doc_id is hashed as the word ``null``. Rows that repeat are
documents of their own (equal ones are interchangeable). Input columns named like the new ones are replaced; others are kept. An empty table, or one without words, gives targets of 0. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fits_broadcast, kept_table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Hexadecimal digits of the hash that name a cell: 4096 cells a source.
CELL_DIGITS = 3


def word_count(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes``: one row per source (source, source_size). Adds ``weight``, ``cap`` and ``target`` (double).

    One partition orders the sources; they are one row each, already aggregated.
    """
    every = Window.partitionBy()
    named = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int")))
    named = named.withColumn("cap", F.col("source_size") * max_epochs)
    before = every.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), zero)) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero))
    named = named.withColumn("level", level)
    water = F.max("level").over(every) * F.col("weight")
    return named.withColumn("target", F.when(F.col("cap") <= water, F.col("cap").cast("double")).otherwise(water)).drop("level")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` for every row."""
    new = ("size", "source_size", "target", "copies", "taken")
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c.lower() not in new)
    # The input's columns travel as one struct, so that none of their names meets one of the operator's.
    base = docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("row"),
        F.col(text).alias("text"),
        F.col(source).alias("source"),
        F.col(doc_id).alias("id"),
        F.coalesce(F.concat(F.lit("v"), F.col(source)), F.lit("n")).alias("key"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))).alias("place"),
    ).withColumn("cell", F.substring("place", 1, CELL_DIGITS))
    cells = base.groupBy(F.col("key").alias("k"), F.col("cell").alias("c")).agg(F.sum(word_count(F.col("text"))).alias("words"), F.min("source").alias("source"))
    plan = kept_table(_plan(kept_table(cells, "cells"), weights, share, max_epochs), "mix")
    # Words are counted after the rows of a source's last cell are told from the others: once a row.
    placed = base.join(F.broadcast(plan) if fits_broadcast(plan) else plan, F.col("key") == F.col("k"))
    ends = F.col("cell") == F.col("last_cell")
    last, others = (placed.where(x).withColumn("size", word_count(F.col("text"))) for x in (ends, ~ends))
    order = Window.partitionBy("key").orderBy("place", F.col("id").asc_nulls_last(), "size")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    more = F.when(2 * (F.col("start") + upto) - F.col("size") <= 2 * F.col("rest"), 1).otherwise(0)
    others = others.withColumn("more", F.when(F.col("cell") < F.col("last_cell"), 1).otherwise(0))
    out = others.unionByName(last.withColumn("more", more)).withColumn("copies", F.col("whole") + F.when(F.col("whole") < max_epochs, F.col("more")).otherwise(F.lit(0)))
    return out.withColumn("taken", F.col("copies") * F.col("size")).select(*[F.col("row")[c].alias(c) for c in keep], *new)


def _plan(cells: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """Per source, from the words of its cells: its size and target, the whole repetitions, the rest, and the cell in which it ends with the words before that."""
    sources = cells.groupBy("k").agg(F.sum("words").alias("source_size"), F.min("source").alias("source"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = water_fill(sources, weights, share, max_epochs).withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    upto = cells.withColumn("upto", F.sum("words").over(Window.partitionBy("k").orderBy("c"))).join(targets.select(F.col("k").alias("tk"), "rest"), F.col("k") == F.col("tk"))
    ends = upto.where(F.col("upto") > F.col("rest")).groupBy("k").agg(F.min(F.struct("c", (F.col("upto") - F.col("words")).alias("start"))).alias("end"))
    ends = ends.select(F.col("k").alias("ek"), F.col("end.c").alias("c"), F.col("end.start").alias("start"))
    # A source without words ends nowhere: all its (empty) documents count as taken.
    joined = targets.join(ends, F.col("k") == F.col("ek"), "left")
    return joined.select("k", "source_size", "target", "whole", "rest", F.coalesce("c", F.lit("g")).alias("last_cell"), F.coalesce("start", F.lit(0)).cast("long").alias("start"))

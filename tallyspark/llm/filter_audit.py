"""What each filter removes, in every order: permutations run as a trie of persisted survivors.

The orders of the filters form a trie whose edge from a prefix is the filter applied next. What survives a prefix does not depend
on its order, so prefixes with the same filters are one state. The states are visited depth first: survivors are persisted, all edges
that leave the state are counted over them in one aggregate (rows that the next filter really removes there), and a next
state is made by applying that filter to the survivors at hand, unless it was visited before. A state is released when the walk leaves it, so as
many are held as there are filters. What the walk starts from is written to the shared folder: if an executor is lost, Spark makes the survivors
anew from there. Counts of a state go straight to a table, a row for each part and edge.

``kept`` and ``removed`` are rows after and at a step; ``redundant`` rows fail the step's filter but went earlier; ``unique_fails`` fail this filter alone;
``shapley`` is the filter's removals added up over all orders. Outcomes (good, toxic) are counted among the removed.

The filters here measure every text once. A null text is empty; a null part is the empty string; a null doc_id is no smaller than any and has no smaller one, so
such rows are neither copies nor originals. Rows that repeat an id count each, and are no copies of each other. An id that has several label rows is good (toxic) if one of them says so.
Texts of any length are whole. Extra columns, whatever their names, are not carried. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, kept_table, scratch, words_of

MARKS = "#$%&*|"
#: Failure conditions over the measures of ``measured``.
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_upper > 3 * n_points",
    "D": "has_mark",
    "E": "is_copy",
}


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """``doc_id``, ``part`` and what the filters ask of each document, written once."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = words_of(F.col(text))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(part), F.lit("")).alias("part"),
        F.size(words).alias("n_words"),
        F.size(F.array_distinct(words)).alias("n_distinct"),
        F.regexp_count(t, F.lit("[A-Z]")).alias("n_upper"),
        F.length(t).alias("n_points"),
        t.rlike(f"[{MARKS}]").alias("has_mark"),
        F.unhex(F.sha2(t, 256)).alias("digest"),
    )
    rows = kept_table(rows, "measured")
    # Texts that stand under more than one id. Groups combine before the shuffle; of a text with a million copies one row is left.
    least = rows.where("doc_id is not null").groupBy(F.col("digest").alias("d2")).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    least = kept_table(least.where("least < most").select("d2", "least"), "copied")
    joined = rows.join(F.broadcast(least) if fits_broadcast(least) else least, F.col("digest") == F.col("d2"), "left")
    return joined.withColumn("is_copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).drop("digest", "d2", "least")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``good`` and ``toxic``."""
    said = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    joined = rows.join(known, F.col("doc_id") == F.col("labelled"), "left").drop("labelled")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})


def edge_counts(rows: DataFrame, filters: dict[str, Column], outcomes: dict[str, Column], part: str = "part") -> DataFrame:
    """``part, gone, letter, n, removed, <outcomes>`` for every edge of the trie whose state has rows of the part.

    ``gone`` is the set of filters applied before, as bits in the order of ``filters``; ``letter`` the filter of the edge.
    """
    spark, letters = rows.sparkSession, list(filters)
    fails = {x: F.coalesce(c, F.lit(False)).alias(f"fails_{i}") for i, (x, c) in enumerate(filters.items())}
    marks = {x: F.coalesce(c, F.lit(False)).alias(f"mark_{i}") for i, (x, c) in enumerate(outcomes.items())}
    start = kept_table(rows.select(F.col(part).alias("part"), *fails.values(), *marks.values()), "audited")
    path, full, seen = scratch(spark, "edges"), (1 << len(letters)) - 1, set()

    edges = []
    for i, letter in enumerate(letters):
        fails = F.col(f"fails_{i}")
        lost = [F.count_if(fails & F.col(f"mark_{j}")).alias(x) for j, x in enumerate(outcomes)]
        edges.append(F.struct(F.lit(letter).alias("letter"), F.lit(i).alias("bit"), F.count_if(fails).alias("removed"), *lost))

    def count(gone: int, survivors: DataFrame) -> None:
        # One expression for all states, so that it is compiled once; a filter that was applied has nothing left to remove.
        counts = survivors.groupBy("part").agg(F.count("*").alias("n"), F.array(*edges).alias("edges"))
        counts.select("part", "n", F.inline("edges")).coalesce(1).write.parquet(f"{path}/gone={gone}")

    def visit(gone: int, survivors: DataFrame) -> None:
        seen.add(gone)
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        count(gone, survivors)
        for i in range(len(letters)):
            after = gone | 1 << i
            if after not in seen and after != full:
                visit(after, survivors.where(~F.col(f"fails_{i}")))
        survivors.unpersist()

    visit(0, start)
    return spark.read.parquet(path).where(F.expr("gone >> bit & 1") == 0).drop("bit")


def every_order(edges: DataFrame, letters: list[str], outcomes: dict[str, str]) -> DataFrame:
    """A row per part, order and step, from the counts of edges; ``outcomes``: columns of ``edges`` to their names here."""
    spark, k = edges.sparkSession, len(letters)
    bit = {x: 1 << i for i, x in enumerate(letters)}
    steps = []
    for order in permutations(letters):
        gone = 0
        for step, letter in enumerate(order, 1):
            steps.append((len(steps), "".join(order), step, letter, gone))
            gone |= bit[letter]
    plan = spark.createDataFrame(steps, "at int, filter_order string, step int, letter string, gone int")  # k * k! rows
    before = F.bit_count("gone")
    ways = F.element_at(F.array(*[F.lit(factorial(s) * factorial(k - 1 - s)).cast("long") for s in range(k)]), before.cast("int") + 1)
    last = F.lit((1 << k) - 1)
    whole = edges.groupBy(F.col("part").alias("p2"), F.col("letter").alias("l2")).agg(
        F.sum(F.when(F.col("gone") == 0, F.col("removed")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("gone") + F.element_at(F.create_map(*[F.lit(x) for p in bit.items() for x in p]), F.col("letter")) == last, F.col("removed")).otherwise(0)).alias("unique_fails"),
        F.sum(F.col("removed") * ways).alias("shapley"),
    )
    parts = edges.where("gone = 0").select(F.col("part")).distinct().withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
    rows = parts.join(F.broadcast(plan), "at").join(edges.select("part", "gone", "letter", "n", "removed", *outcomes), ["part", "gone", "letter"], "left")
    rows = rows.join(whole, (F.col("part") == F.col("p2")) & (F.col("letter") == F.col("l2")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    removed = zero(F.col("removed"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        (zero(F.col("n")) - removed).alias("kept"),
        removed.alias("removed"),
        (zero(F.col("fails")) - removed).alias("redundant"),
        zero(F.col("unique_fails")).alias("unique_fails"),
        *[zero(F.col(x)).alias(name) for x, name in outcomes.items()],
        zero(F.col("shapley")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over ``docs``, in all orders, by language."""
    rows = with_labels(measured(docs), labels)
    edges = edge_counts(rows, {x: F.expr(c) for x, c in FILTERS.items()}, {"good": F.col("good"), "toxic": F.col("toxic")})
    return every_order(edges, list(FILTERS), {"good": "good_lost", "toxic": "toxic_lost"})

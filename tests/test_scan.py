"""Prefix scans against Python, in one partition and in many."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import consensus as C
from tallyspark.operators import scan


@pytest.fixture(params=["true", "false"])
def split(spark, request):
    """With and without coalesced partitions: few rows are one range, or many."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield
    spark.conf.set(key, before)


def test_scans(spark, split):
    draw = random.Random(1)
    rows = [(i, draw.randint(0, 30), draw.choice([None, 1.0, 2.0, 3.5, 7.0])) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, at int, v double")
    got = {r["id"]: r["n"] for r in scan.numbered(df, [F.col("at").desc(), F.col("id").asc()], "n").collect()}
    assert got == {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    got = {r["id"]: r["m"] for r in scan.max_before(df, F.col("at"), F.col("v"), "m").collect()}
    assert got == {i: max((v for _, a, v in rows if a < at and v is not None), default=None) for i, at, _ in rows}
    got = {r["id"]: r["m"] for r in scan.last_before(df, [F.col("id")], F.col("v"), "m").collect()}
    assert got == {i: next((v for j, _, v in reversed(rows[:i]) if v is not None), None) for i, _, _ in rows}
    none = df.limit(0)
    assert scan.numbered(none, [F.col("id")], "n").count() == scan.max_before(none, F.col("at"), F.col("v"), "m").count() == scan.last_before(none, [F.col("id")], F.col("v"), "m").count() == 0


def test_nothing_grows_in_one_task(spark):
    """A single partition gets a row a range, never the rows."""
    df = spark.range(1000).select(F.col("id").alias("block"), F.col("id").cast("string").alias("miner"), (F.col("id") % 7 / 10).alias("win_rate"), F.lit(9).alias("total"), F.lit(True).alias("eligible"), F.lit(False).alias("is_owner"), F.lit(3).alias("eligible_validator_count"), F.lit(1.0).alias("weighted_evals"), (F.col("id") % 7 / 10).alias("known_rate"))
    for out in (C.margin_passes(df, 0.02), C.ranking(df), C.report_order(df)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = [x for x in plan.split("\n") if "Window [" in x]
        assert len(windows) == 2 and sum("handed_" in x for x in windows) == 1  # one by partition, one over what partitions hand on
    assert C.margin_passes(df, 0.02).where("passed").count() == len([1 for i in range(1000) if all(i % 7 / 10 >= (j % 7) / 10 + 0.02 for j in range(min(i, 7)))])


def test_sums_do_not_depend_on_partitions(spark):
    draw = random.Random(2)
    values = [draw.choice([1, -1]) * draw.random() * 10.0 ** draw.randint(-12, 9) for _ in range(3000)] + [0.1] * 500 + [1e15, -1e15, 0.0, 2.0**-70]
    seen = set()
    for n in (1, 3, 7):
        draw.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(n)
        seen.add(df.agg(C.exact_sum(F.col("v")).alias("s")).first()["s"])
    assert len(seen) == 1 and abs(seen.pop() - math.fsum(values)) <= 1e-6
    assert spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "v double").agg(C.exact_sum(F.col("v")).alias("s")).first()["s"] == 0.6
    plan = spark.range(9).groupBy((F.col("id") % 2).alias("k")).agg(C.exact_sum(F.col("id") / 7).alias("s"))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "partial_sum" in plan

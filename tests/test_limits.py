"""The limiter and the replay check in batch against the rules, row by row."""

from __future__ import annotations

import random

import pytest

from tallyspark.streaming import limits as L


def ruled(rows, most, window):
    state, out = {}, {}
    for key, seq, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        state[key], ok, wait = L.limiter_step(state.get(key, []), ts, most, window)
        out[key, seq] = ok, wait
    return out


@pytest.mark.parametrize("seed", range(3))
def test_limiter_is_the_rule(spark, seed):
    """Bursts, quiet times, equal times, requests at the very horizon."""
    draw = random.Random(seed)
    rows = []
    for key in "abc":
        t = 0.0
        for _ in range(150):
            t += draw.choice([0, 0, 1, 1, 2, 5, 10, 40])
            rows.append((key, len(rows), t))
    rows += [(None, 9_000 + i, float(i)) for i in range(5)]
    draw.shuffle(rows)
    for most in (1, 3):
        got = {(r["key"], r["seq"]): (r["allowed"], r["retry_after"]) for r in L.limit_batch(spark.createDataFrame(rows, "key string, seq long, ts double").where("key is not null"), most, 10.0).collect()}
        assert got == ruled([r for r in rows if r[0]], most, 10.0)


def test_limiter_without_crowds(spark):
    df = spark.createDataFrame([("a", i, 100.0 * i) for i in range(20)], "key string, seq long, ts double")
    assert {(r["allowed"], r["retry_after"]) for r in L.limit_batch(df, 3, 10.0).collect()} == {(True, 0)}
    assert L.limit_batch(df.limit(0), 3, 10.0).count() == 0


def test_one_key_is_many_stretches(spark, monkeypatch):
    """A key with all rows: the fold sees as many stretches as there are bursts."""
    rows = [("hot", 100 * b + i, 1000.0 * b + i) for b in range(30) for i in range(8)]
    seen = []
    fold = L._in_order
    monkeypatch.setattr(L, "_in_order", lambda df, keys, *a: (seen.append(df.select(*keys).distinct().count()), fold(df, keys, *a))[1])
    got = {(r["key"], r["seq"]): (r["allowed"], r["retry_after"]) for r in L.limit_batch(spark.createDataFrame(rows, "key string, seq long, ts double"), 3, 10.0).collect()}
    assert got == ruled(rows, 3, 10.0) and seen == [30]


@pytest.mark.parametrize("seed", range(2))
def test_replays_are_the_rule(spark, seed):
    draw = random.Random(seed)
    rows = []
    for key, nonce in (("a", "x"), ("a", "y"), ("b", "x"), ("b", None), (None, "x")):
        t = 0.0
        for _ in range(120):
            t += draw.choice([0, 1, 1, 2, 7, 25])
            rows.append((key, nonce, len(rows), t))
    draw.shuffle(rows)
    seen, want = {}, {}
    for key, nonce, seq, ts in sorted(rows, key=lambda r: (r[3], r[2])):
        last = seen.get((key, nonce))
        want[seq] = last is None or ts - last > 10
        if want[seq]:
            seen[key, nonce] = ts
    df = spark.createDataFrame(rows, "key string, nonce string, seq long, ts double")
    out = L.replay_batch(df, 10.0)
    assert {r["seq"]: r["accepted"] for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan
    assert L.replay_batch(df.limit(0), 10.0).count() == 0

"""Sliding-window limiter, replay protection and leases: the same decisions in batch and as a stream.

A key's state is bounded: at most ``most`` times for the limiter, nonces of one time-to-live for the replay check. In batch, replays are found by
pointer jumping and the limiter's requests are cut at quiet times, so that one key is many tasks; a stretch without quiet times is read in order, in Arrow
batches, with the state of one key at a time. As a stream, events of a micro-batch are handled in time order within their key,
and a key's state goes when the event-time watermark has passed its last event by the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from tallyspark.operators.scan import last_before
from tallyspark.shared import kept_table

DECISIONS = "key string, seq long, ts double, allowed boolean, retry_after int"
VERDICTS = "key string, nonce string, seq long, ts double, accepted boolean"
WRITES = ("POST", "PUT", "PATCH", "DELETE")


def limiter_step(times: list[float], now: float, most: int, window: float) -> tuple[list[float], bool, int]:
    """One request: times at the horizon stay, denied requests are not recorded."""
    times = [t for t in times if not t < now - window]
    if len(times) >= most:
        return times, False, max(1, int(times[0] + window - now))
    return [*times, now], True, 0


def replay_step(seen: dict[str, float], nonce: str, now: float, ttl: float) -> bool:
    """Whether a nonce is new within the time to live; a rejected repeat does not refresh it."""
    if nonce in seen and now - seen[nonce] <= ttl:
        return False
    seen[nonce] = now
    return True


def _in_order(events: DataFrame, keys: list[str], order: list[str], step: Callable[[list, tuple], tuple], out: str) -> DataFrame:
    """Folds rows sorted by ``keys`` and ``order``: ``step`` gets the key's state (a list, empty at first) and a row, and returns the row's decision."""
    names = [*keys, *order, *[c for c in events.columns if c not in keys and c not in order]]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = object()
        state: list = []
        for b in batches:
            found = []
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if row[: len(keys)] != now:
                    now, state = row[: len(keys)], []
                found.append(step(state, row))
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    schema = to_arrow_schema(T.StructType.fromDDL(out))
    return events.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(fold, out)


def limit_batch(events: DataFrame, most: int, window: float) -> DataFrame:
    """Decisions for (key, seq, ts).

    A request before which fewer than ``most`` others stand within the window is allowed, whatever was decided. Where that holds for all requests of a
    window, what the limiter remembers is known, and the key's requests are cut there: stretches of a key are decided apart from each other, so
    a key of any size is as many tasks as it has quiet times. Which requests are quiet is counted by (key, span of one window), a span with the one before it. Only stretches
    with more requests than the limit are folded in order, for there each decision depends on those before.
    """
    rows = events.select("key", F.col("ts").cast("double").alias("ts"), F.col("seq").cast("long").alias("seq"))
    span = F.floor(F.col("ts") / (window + 1e-6)).cast("long")
    both = rows.withColumn("span", F.explode(F.array(span, span + 1))).withColumn("own", span == F.col("span"))
    # The frame of times counts requests of the same time that come later too; those are taken off by places.
    # A microsecond more than the window, so that no rounding takes a request for a quiet one.
    wide, micros = window + 1e-6, F.round(F.col("ts") * 1e6).cast("long")
    within = F.count("*").over(Window.partitionBy("key", "span").orderBy(micros).rangeBetween(-round(wide * 1e6), Window.currentRow))
    after = F.count("*").over(Window.partitionBy("key", "span", micros)) - F.row_number().over(Window.partitionBy("key", "span", micros).orderBy("ts", "seq"))
    counted = both.withColumn("before", within - after - 1)
    counted = kept_table(counted.where("own").select("key", "ts", "seq", (F.col("before") < most).alias("quiet")), "requests")
    # A cut: a quiet request with only quiet ones in its window.
    loud = counted.where("not quiet").select("key", F.col("ts").alias("loud_ts"), "seq")
    if loud.isEmpty():
        return counted.select("key", "seq", "ts", F.lit(True).alias("allowed"), F.lit(0).alias("retry_after"))
    marks = last_before(counted, [F.col("key"), F.col("ts"), F.col("seq")], F.when(~F.col("quiet"), F.struct("key", "ts")), "loud")
    marks = marks.withColumn("cut", F.col("quiet") & (F.col("loud").isNull() | (F.col("loud.key") != F.col("key")) | (F.col("loud.ts") < F.col("ts") - wide)))
    marks = last_before(marks.drop("loud"), [F.col("key"), F.col("ts"), F.col("seq")], F.when(F.col("cut"), F.struct("key", "ts", "seq")), "since")
    # Behind a cut the requests of its window are what the limiter remembers; a stretch begins with the last cut that has a loud request behind it.
    begin = F.when(F.col("cut"), F.struct("key", "ts", "seq")).otherwise(F.col("since"))
    marks = kept_table(marks.select("key", "ts", "seq", "quiet", "cut", begin["ts"].alias("b_ts"), begin["seq"].alias("b_seq")), "cuts")
    busy = marks.where("not cut").select("key", "b_ts", "b_seq").distinct()
    # Stretches begin more than a window apart, so a span meets two beginnings at most.
    begun = F.floor(F.col("b_ts") / wide).cast("long")
    starts = busy.withColumn("span", F.explode(F.array(begun, begun - 1)))
    lead = marks.select("key", "ts", "seq", span.alias("span")).join(starts, ["key", "span"]).drop("span").where((F.col("ts") >= F.col("b_ts") - wide) & (F.struct("ts", "seq") < F.struct("b_ts", "b_seq")))
    inside = marks.join(busy, ["key", "b_ts", "b_seq"], "left_semi").select("key", "ts", "seq", "b_ts", "b_seq", F.lit(False).alias("known"))
    folded = inside.unionByName(lead.withColumn("known", F.lit(True)))
    free = marks.where("cut").join(busy, ["key", "b_ts", "b_seq"], "left_anti").select("key", "seq", "ts", F.lit(True).alias("allowed"), F.lit(0).alias("retry_after"))

    def step(times: list, row: tuple) -> dict:
        if row[5]:  # decided before the stretch
            times.append(row[3])
            return {"key": row[0], "seq": row[4], "ts": row[3], "allowed": True, "retry_after": 0, "known": True}
        times[:], ok, wait = limiter_step(times, row[3], most, window)
        return {"key": row[0], "seq": row[4], "ts": row[3], "allowed": ok, "retry_after": wait, "known": False}

    decided = _in_order(folded, ["key", "b_ts", "b_seq"], ["ts", "seq"], step, f"{DECISIONS}, known boolean")
    return free.unionByName(decided.where("not known").drop("known"))


def limit_stream(events: DataFrame, most: int, window: float) -> DataFrame:
    """The same over a streaming DataFrame; with a watermark on a column ``at``, idle keys are forgotten after ``window`` seconds of event time."""
    timed = "at" in events.columns

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        out = []
        for seq, ts in pd.concat(list(batches)).sort_values(["ts", "seq"])[["seq", "ts"]].itertuples(index=False):
            times, ok, wait = limiter_step(times, float(ts), most, window)
            out.append((k[0], int(seq), float(ts), ok, wait))
        state.update((times,))
        _expire(state, timed, max(x[2] for x in out) + window)
        yield pd.DataFrame(out, columns=["key", "seq", "ts", "allowed", "retry_after"])

    return events.groupBy("key").applyInPandasWithState(step, DECISIONS, "times array<double>", "append", _timeout(events))


def replay_batch(events: DataFrame, ttl: float) -> DataFrame:
    """Whether each (key, nonce) is new within the time to live; a rejected repeat does not refresh it.

    After an accepted time the next one accepted is the first beyond it by more than the time to live: a link from each time to one other, found by a
    scan. What is accepted are the times reached from those with nothing in the time to live before them; they are found by
    pointer jumping, in as many rounds as the longest chain has binary digits. All of it is joins, so a nonce of any size is many tasks. Times count in whole microseconds.
    """
    rows = events.select("key", "nonce", F.col("ts").cast("double").alias("ts"), F.col("seq").cast("long").alias("seq"))
    who, micros, life = F.struct("key", "nonce"), F.round(F.col("ts") * 1e6).cast("long"), round(ttl * 1e6)
    times = kept_table(rows.groupBy(who.alias("who"), micros.alias("t")).agg(F.min("seq").alias("first")), "times")
    # In falling order: the last time seen before ``t + life`` is the least one beyond it.
    asked = times.select("who", (F.col("t") + life).alias("at"), F.lit(0).alias("kind"), "t").unionByName(times.select("who", F.col("t").alias("at"), F.lit(1).alias("kind"), "t"))
    ordered = [F.xxhash64("who"), F.col("who"), -F.col("at"), F.col("kind")]
    found = last_before(asked, ordered, F.when(F.col("kind") == 1, F.struct("who", "t")), "next").where("kind = 0 and next.who <=> who")
    links = kept_table(found.select("who", "t", F.col("next.t").alias("to")), "links")
    back = last_before(times, [F.xxhash64("who"), F.col("who"), F.col("t")], F.struct("who", "t"), "before")
    free = back.where(~F.col("before.who").eqNullSafe(F.col("who")) | (F.col("t") - F.col("before.t") > life))
    accepted = kept_table(free.select("who", "t"), "accepted")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    while True:
        step = links.select(F.col("who").alias("w2"), F.col("t").alias("t2"), "to")
        more = accepted.join(step, same("who", "w2") & (F.col("t") == F.col("t2"))).select("who", F.col("to").alias("t")).distinct()
        new = kept_table(more.join(accepted.select(F.col("who").alias("w3"), F.col("t").alias("t3")), same("who", "w3") & (F.col("t") == F.col("t3")), "left_anti"), "reached")
        if new.isEmpty():
            break
        accepted = kept_table(accepted.unionByName(new), "accepted")
        links = kept_table(links.join(step.withColumnRenamed("to", "further"), same("who", "w2") & (F.col("to") == F.col("t2"))).select("who", "t", F.col("further").alias("to")), "links")
    once = times.join(accepted.select(F.col("who").alias("w4"), F.col("t").alias("t4")), same("who", "w4") & (F.col("t") == F.col("t4"))).select("w4", "t4", "first")
    out = rows.withColumns({"who": who, "t": micros}).join(once, same("who", "w4") & (F.col("t") == F.col("t4")), "left")
    return out.select("key", "nonce", "seq", "ts", F.coalesce(F.col("seq") == F.col("first"), F.lit(False)).alias("accepted"))


def replay_stream(events: DataFrame, ttl: float) -> DataFrame:
    """The same over a streaming DataFrame; with a watermark on a column ``at``, idle keys are forgotten after ``ttl`` seconds of event time."""
    timed = "at" in events.columns

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = dict(zip(*state.get, strict=True)) if state.exists else {}
        out = []
        for nonce, seq, ts in pd.concat(list(batches)).sort_values(["ts", "seq"])[["nonce", "seq", "ts"]].itertuples(index=False):
            out.append((k[0], nonce, int(seq), float(ts), replay_step(seen, nonce, float(ts), ttl)))
        last = max(x[3] for x in out)
        seen = {n: t for n, t in seen.items() if last - t <= ttl}
        state.update((list(seen), list(seen.values())))
        _expire(state, timed, last + ttl)
        yield pd.DataFrame(out, columns=["key", "nonce", "seq", "ts", "accepted"])

    return events.groupBy("key").applyInPandasWithState(step, VERDICTS, "nonces array<string>, times array<double>", "append", _timeout(events))


def _timeout(events: DataFrame) -> str:
    """Event-time expiry where the stream has a watermark column ``at``, else none."""
    return GroupStateTimeout.EventTimeTimeout if "at" in events.columns else GroupStateTimeout.NoTimeout


def _expire(state: GroupState, timed: bool, seconds: float) -> None:
    if timed:
        state.setTimeoutTimestamp(max(int(seconds * 1000) + 1, state.getCurrentWatermarkMs() + 1))


def limited_scope(requests: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Requests that the limiter counts: writes with a key under one of the prefixes."""
    under = F.lit(False)
    for p in prefixes:
        under = under | F.col("path").startswith(p)
    return requests.where(F.upper("method").isin(*WRITES) & under & (F.coalesce("key", F.lit("")) != ""))


def fresh(requests: DataFrame, now: float, ttl: float) -> DataFrame:
    """Requests neither older nor further ahead than the time to live, with a nonce of 8 to 128 characters."""
    return requests.where((F.abs(F.lit(now) - F.col("ts")) <= ttl) & F.length("nonce").between(8, 128))


def append_latest(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends every micro-batch to a parquet log; ``operators.state.latest`` reads the view."""
    return stream.writeStream.foreachBatch(lambda df, epoch: df.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

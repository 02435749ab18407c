"""Streams whose state lies by key: requests that wait, leases, recent windows and slots.

Each is a ``transformWithState`` over the key (requests: over buckets of keys, as they are many and small), so a micro-batch reads and writes the state of its own keys or buckets only, and event-time timers
drop what is over. What comes out is a log of changes, appended once each; its view is what the table holds (``open_requests``,
``current_leases``, ``recent_rows_of``), and ``compacted`` writes a shorter log with the same view. State is kept in RocksDB, in the checkpoint folder, from which
a query goes on after a restart.

Rows without a key or a time take no part. Within a micro-batch a key's rows are handled in time order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Rows that a partition gathers before it reduces them.
FEW = 200_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which keyed state needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def append_changes(changes: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Starts a query that appends a stream of changes to a parquet log; with ``once`` it ends when all input is read."""
    with keyed_state(changes.sparkSession):
        writer = changes.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start(path)


def _millis(seconds: float) -> int:
    return int(seconds * 1000)


class _Keyed(StatefulProcessor):
    """What the processors share: the columns of what they return, a key of one or several columns, event times as seconds."""

    names: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open()

    def open(self) -> None:
        """Declares the state."""

    def close(self) -> None:
        pass

    def row(self, *values: object) -> Row:
        return Row(*self.names)(*values)

    def timer(self, at: int) -> None:
        """One timer a key: those set before go."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)


# Requests that wait for an answer


#: Keys of requests lie in so many buckets, each a key of the state; a checkpoint goes on with the number that it began with.
BUCKETS = 1 << 14


class _Pending(_Keyed):
    """State by bucket of keys: of each key ``answered`` (whether its submission came) and ``last``; a key goes ``keep`` seconds after its last event, answered or not.

    The calls for state and timers are by bucket, of which there are at most ``BUCKETS``, not by key. ``due`` is the bucket's timer: when its first key goes.
    """

    def __init__(self, keep: float, keys: str) -> None:
        self.keep, self.keys = keep, keys

    def open(self) -> None:
        self.seen = self.handle.getValueState("requests", f"due long, items array<struct<{self.keys}, answered: boolean, last: double>>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n = len(self.names) - 2
        before, held = self.held()
        for r in sorted(rows, key=lambda r: (r[n + 1], r[n + 2])):
            own, at, submitted = tuple(r[:n]), r[n + 1], r[n + 2]
            answered, last = held.get(own, (None, 0.0))
            if answered is not None and at > last + self.keep:  # forgotten before this row, though the timer was not due yet
                if not answered:
                    yield self.row(*own, "dropped", last)
                answered = None
            if answered is None and not submitted:
                yield self.row(*own, "opened", at)
            if submitted and not answered:
                yield self.row(*own, "answered", at)
            held[own] = bool(answered) or submitted, max(last, at)
        yield from self.settle(held, before, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, held = self.held()
        yield from self.settle(held, None, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def held(self) -> tuple[int | None, dict[tuple, tuple[bool, float]]]:
        """The bucket's timer, and its keys."""
        known = self.seen.get()
        return (known[0], {tuple(x[:-2]): (x[-2], x[-1]) for x in known[1]}) if known else (None, {})

    def settle(self, held: dict[tuple, tuple[bool, float]], before: int | None, now: int) -> Iterator[Row]:
        """Drops the keys that are over at ``now``, keeps the others, and sets the timer to the first of them."""
        ends = {own: _millis(last + self.keep) + 1 for own, (_, last) in held.items()}
        for own, end in ends.items():
            if end <= now:
                answered, last = held.pop(own)
                if not answered:
                    yield self.row(*own, "dropped", last)
        due = min((ends[own] for own in held), default=None)
        if before is not None and before != due:
            self.handle.deleteTimer(before)
        if due is None:
            self.seen.clear()
            return
        if before != due:
            self.handle.registerTimer(due)
        self.seen.update((due, [(*own, *x) for own, x in held.items()]))


def _run(groups: GroupedData, step: _Keyed, schema: str, time: str) -> DataFrame:
    out = T.StructType.fromDDL(schema)
    step.names = tuple(out.names)
    return groups.transformWithState(step, out, "Append", time)


def _types(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def pending_changes(events: DataFrame, keys: list[str], keep: float, at: str = "at") -> DataFrame:
    """``keys, change, at`` from a stream of ``kind`` (pending or submission), ``keys`` and a time ``at`` with a watermark.

    A key is opened by its first request and answered by its first submission, whichever comes first; one that was answered first never opens. A key of
    which nothing was heard for ``keep`` seconds of event time is forgotten; if it was open it is dropped.
    """
    rows = events.select(*keys, at, (F.unix_micros(at).cast("double") / 1e6).alias("at_"), (F.col("kind") == "submission").alias("submitted_"))
    rows = rows.where(" and ".join(f"`{k}` is not null" for k in [*keys, "at_", "submitted_"])).withColumn("bucket_", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    types = ", ".join(f"`{k}`: {events.schema[k].dataType.simpleString()}" for k in keys)
    return _run(rows.groupBy("bucket_"), _Pending(keep, types), f"{_types(events, keys)}, change string, at double", "eventTime")


def open_requests(log: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that were opened and neither answered nor dropped since; an aggregate over changes."""
    order = F.struct("at", F.when(F.col("change") == "opened", 0).when(F.col("change") == "answered", 1).otherwise(2))
    return log.groupBy(*keys).agg(F.max_by("change", order).alias("change")).where("change = 'opened'").select(*keys)


# Leases


class _Leases(_Keyed):
    def open(self) -> None:
        self.lease = self.handle.getValueState("lease", "status string, started double, updated double, expires double")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.lease.get()
        status, started, updated, expires = held if held else (None, float("inf"), float("-inf"), float("-inf"))
        for r in sorted(rows, key=lambda r: (r["at_"], r["expires_"], r["status"] or "")):
            if held and r["at_"] > expires:  # it had run out before this refresh, though its timer was not due yet
                yield self.row(*key, "expired", status, started, updated, expires)
                started = float("inf")
            started, held = min(started, r["at_"]), True
            if (r["at_"], r["expires_"]) >= (updated, expires):
                status, updated, expires = r["status"], r["at_"], r["expires_"]
        yield self.row(*key, "held", status, started, updated, expires)
        self.lease.update((status, started, updated, expires))
        # A lease holds up to the very time at which it expires.
        self.timer(max(_millis(expires) + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.lease.get()
        self.lease.clear()
        if held:
            yield self.row(*key, "expired", *held)


LEASE = "activity_key string, change string, status string, started double, updated double, expires double"


def lease_changes(refreshes: DataFrame) -> DataFrame:
    """Changes of leases from a stream of refreshes (activity_key, status, at, ttl), with a watermark on ``at``.

    A lease has the last refresh's status and expiry (a ttl is one second at least) and the first one's start. When event time has passed its expiry it is
    expired and forgotten; a refresh after that starts a new one.
    """
    seconds = F.unix_micros("at").cast("double") / 1e6
    rows = refreshes.select("activity_key", "status", "at", seconds.alias("at_"), (seconds + F.greatest(F.lit(1), F.coalesce("ttl", F.lit(1)))).alias("expires_"))
    return _run(rows.where("activity_key is not null and at_ is not null").groupBy("activity_key"), _Leases(), LEASE, "eventTime")


def current_leases(log: DataFrame, now: float | None = None) -> DataFrame:
    """Leases that the log says are held, unexpired at ``now`` (seconds) if that is given."""
    order = F.struct("updated", "expires", F.when(F.col("change") == "expired", 1).otherwise(0))
    last = log.groupBy("activity_key").agg(F.max_by(F.struct("change", "status", "started", "updated", "expires"), order).alias("x")).select("activity_key", "x.*")
    return last.where("change = 'held'" + (f" and expires >= {float(now)!r}" if now is not None else "")).drop("change")


# Recent windows


class _Recent(_Keyed):
    """The newest ``n`` ids of a key. An id that was pushed out stays out, since what is in the window only grows."""

    def __init__(self, n: int, parts: tuple[str, ...]) -> None:
        self.n, self.parts = n, parts

    def open(self) -> None:
        self.ids = self.handle.getListState("ids", "id string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = [x[0] for x in self.ids.get()]
        new: list[Row] = []
        before = set(held)
        for r in rows:  # no more rows wait here than stand in the window
            if len(held) < self.n or r["id_"] >= min(held):
                new.append(r)
                if r["id_"] not in held:
                    held.append(r["id_"])
                    if len(held) > self.n:
                        gone = min(held)
                        held.remove(gone)
                        new = [x for x in new if x["id_"] != gone]
        self.ids.put([(x,) for x in held])
        for r in new:
            yield self.row("entered", *[r[i] for i in range(len(self.parts))])
        for x in sorted(before.difference(held)):
            yield self.row("left", *[x if c == "id_" else key[0] if c == "key_" else None for c in self.parts])


def recent_changes(rows: DataFrame, n: int, key: str = "validator", id_: str = "evaluation_id") -> DataFrame:
    """``change`` and all columns: rows that enter the window of the newest ``n`` ids of their key, and ids (other columns null) that leave it.

    State is ``n`` ids a key. An id is text here, as in the order of evaluations.
    """
    cols = rows.columns
    given = rows.where(F.col(key).isNotNull() & F.col(id_).isNotNull()).select("*", F.col(id_).cast("string").alias("id_"))
    step = _Recent(n, tuple("key_" if c == key else "id_" if c == id_ else "" for c in cols))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return _run(given.groupBy(key), step, f"change string, {fields}", "None")


def recent_rows_of(log: DataFrame, key: str = "validator", id_: str = "evaluation_id") -> DataFrame:
    """The rows whose id has entered and not left."""
    gone = log.where("change = 'left'").select(key, id_).distinct()
    return log.where("change = 'entered'").drop("change").join(gone, [key, id_], "left_anti")


# Slots


def _first_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """clock, slot, block: of each clock and slot the least block of a partition."""
    held: list[pa.RecordBatch] = []
    kept = 0

    def least() -> pa.Table:
        found = pa.Table.from_batches(held).group_by(["clock", "slot"]).aggregate([("block", "min")])
        return found.select(["clock", "slot", "block_min"]).rename_columns(["clock", "slot", "block"]).combine_chunks()

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) > 2 * kept + FEW:
            held = least().to_batches()
            kept = sum(x.num_rows for x in held)
    if held:
        yield from least().to_batches()


class _Slots(_Keyed):
    def open(self) -> None:
        self.last = self.handle.getValueState("slot", "slot long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.last.get()
        last = held[0] if held else None
        for block, slot in sorted({(r["block"], r["slot"]) for r in rows}):
            if last is None or slot > last:
                last = slot
                yield self.row(*key, slot, block)
        if last is not None:
            self.last.update((last,))


def slots_due(heights: DataFrame, length: int, offset: int, tolerance: int | None = None, clock: str = "clock") -> DataFrame:
    """``clock, slot, block``: each slot once, at the first height that reaches it, from a stream of heights (``clock``, ``block``).

    With a tolerance only heights up to so far into a slot count; a slot of which no such height comes is skipped. State is one number a clock.
    A slot's first height is its least one, so before a clock's rows meet in one task each partition keeps the least of a slot, and sends on as many rows as it has slots.
    """
    block, end = F.col("block"), F.lit(length)
    into = F.pmod(F.pmod(block, end) - F.lit(offset % length), end)
    rows = heights.where(F.col(clock).isNotNull() & F.col("block").isNotNull()).select(F.col(clock).alias("clock"), F.col("block").cast("long").alias("block"))
    rows = rows if tolerance is None else rows.where(into <= tolerance)
    first = rows.select("clock", (block - into).alias("slot"), "block").mapInArrow(_first_blocks, f"clock {heights.schema[clock].dataType.simpleString()}, slot long, block long")
    return _run(first.groupBy("clock"), _Slots(), f"{_types(heights, [clock])}, slot long, block long", "None")


def run_slots(due: DataFrame, checkpoint: str, act: Callable[[DataFrame], None], once: bool = True):
    """Starts a query that calls ``act`` with the slots of each micro-batch that has any. If it fails the query fails; the state is not
    committed then, and a restart tries the same slots again."""

    def write(df: DataFrame, epoch: int) -> None:
        df = df.persist()
        try:
            if not df.isEmpty():
                act(df)
        finally:
            df.unpersist()

    with keyed_state(due.sparkSession):
        writer = due.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()

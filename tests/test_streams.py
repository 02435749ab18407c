"""Streams with keyed state: results of the batch forms, bounded state, restarts, failures."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

import oracle
from tallyspark.operators import state as K
from tallyspark.plans import registry, streams
from tallyspark.streaming import keyed

ZERO = datetime.datetime(2025, 1, 1, tzinfo=datetime.UTC)
OWN = sorted(n for n, f in registry.QUERIES.items() if f.__module__ == streams.__name__)


@pytest.mark.parametrize("name", OWN)
def test_query_matches_sql(spark, sf_dir, name):
    assert oracle.differences(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], oracle.connect(sf_dir)) == []


def at(x):
    return ZERO + datetime.timedelta(seconds=x)


class Feed:
    """A folder that a stream reads, one file a micro-batch; ``run`` reads what is new and goes on from the checkpoint."""

    def __init__(self, spark, folder, schema, timed=True):
        self.spark, self.folder, self.schema, self.timed, self.files = spark, str(folder), schema, timed, 0

    def put(self, *batches):
        for rows in batches:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/in/{self.files:05d}")
            self.files += 1

    def stream(self):
        rows = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in/*")
        return rows.withWatermark("at", "0 seconds") if self.timed else rows

    def run(self, changes):
        q = keyed.append_changes(changes(self.stream()), f"{self.folder}/out", f"{self.folder}/state")
        q.awaitTermination()
        self.state = [[o["numRowsTotal"] for o in p["stateOperators"]][0] for p in q.recentProgress if p["stateOperators"]]
        return self.spark.read.parquet(f"{self.folder}/out")


def test_requests(spark, tmp_path):
    feed = Feed(spark, tmp_path, "kind string, validator string, evaluation_id string, at timestamp")
    changes = lambda s: keyed.pending_changes(s, ["validator", "evaluation_id"], 100)
    feed.put([("pending", "v", "e1", at(0)), ("pending", "v", "e2", at(1)), (None, "v", "e7", at(1)), ("pending", None, "e7", at(1))], [("submission", "v", "e1", at(2)), ("submission", "w", "e9", at(3))])
    feed.run(changes)
    feed.put([("pending", "w", "e9", at(4)), ("pending", "w", "e3", at(5)), ("submission", "v", "e1", at(6))])  # a restart goes on from the state
    log = feed.run(changes)
    assert sorted(tuple(r) for r in keyed.open_requests(log, ["validator", "evaluation_id"]).collect()) == [("v", "e2"), ("w", "e3")]
    assert log.where("change = 'answered'").count() == 2 and log.where("evaluation_id = 'e9' and change = 'opened'").count() == 0
    feed.put([("pending", "x", "e1", at(103))], [("pending", "w", "e3", at(300)), ("submission", "x", "e1", at(301))])
    log = feed.run(changes)
    assert sorted(tuple(r) for r in keyed.open_requests(log, ["validator", "evaluation_id"]).collect()) == [("w", "e3")]  # e3 was dropped and opened anew
    assert log.where("evaluation_id = 'e3'").groupBy("change").count().orderBy("change").collect() == [("dropped", 1), ("opened", 2)]


def test_state_stays_small(spark, tmp_path):
    """50 micro-batches of 40 new keys each: the state holds the keys of the last ones; the view is that of the batch form. Half of them after a restart."""
    draw = random.Random(3)
    feed = Feed(spark, tmp_path, "kind string, validator string, evaluation_id string, at timestamp")
    changes = lambda s: keyed.pending_changes(s, ["validator", "evaluation_id"], 60)
    every = []
    for i in range(50):
        batch = [("pending", "v", f"{i}-{k}", at(20 * i + k % 20)) for k in range(40)]
        batch += [("submission", "v", f"{i - 1}-{k}", at(20 * i + 19)) for k in range(40) if i and draw.random() < 0.7]
        every += batch
        feed.put(batch)
        if i == 24:
            feed.run(changes)
    log = feed.run(changes)
    assert len(feed.state) >= 25 and max(feed.state) <= 40 * 6 and feed.state[-1] <= 40 * 5
    rows = spark.createDataFrame(every, feed.schema)
    pending, done = rows.where("kind = 'pending'"), rows.where("kind = 'submission'")
    alive = F.col("at") >= F.lit(at(20 * 49 + 19 - 60))
    want = K.open_pending(pending.where(alive), done, ["validator", "evaluation_id"]).select("validator", "evaluation_id")
    assert sorted(map(tuple, keyed.open_requests(log, ["validator", "evaluation_id"]).collect())) == sorted(map(tuple, want.collect()))


def test_leases(spark, tmp_path):
    feed = Feed(spark, tmp_path, "activity_key string, status string, at timestamp, ttl int")
    feed.put([("k", "on", at(0), 10), ("q", "on", at(1), 0), (None, "on", at(1), 5)], [("k", "off", at(8), 10)], [("z", "on", at(20), 9)])
    log = feed.run(keyed.lease_changes)
    zero = ZERO.timestamp()
    seen = lambda log: {r["activity_key"]: (r["status"], r["started"] - zero, r["updated"] - zero, r["expires"] - zero) for r in keyed.current_leases(log).collect()}
    assert seen(log) == {"z": ("on", 20, 20, 29)} and feed.state[-1] == 1
    assert {(r["activity_key"], r["started"] - zero, r["expires"] - zero) for r in log.where("change = 'expired'").collect()} == {("q", 1, 2), ("k", 0, 18)}
    feed.put([("k", "again", at(25), 5)], [("k", "kept", at(30), 1), ("z", "on", at(29), 1)])
    assert seen(feed.run(keyed.lease_changes)) == {"k": ("kept", 25, 30, 31), "z": ("on", 20, 29, 30)}
    assert keyed.current_leases(spark.read.parquet(f"{tmp_path}/out"), zero + 30.5).count() == 1


def test_recent_window(spark, tmp_path):
    feed = Feed(spark, tmp_path, "validator string, evaluation_id string, miner string, at timestamp", timed=False)
    changes = lambda s: keyed.recent_changes(s, 2)
    row = lambda v, e, m: (v, e, m, ZERO)
    feed.put([row("v", "1", "a"), row("v", "1", "b"), row("w", "5", "a"), row(None, "1", "a")], [row("v", "3", "a")], [row("v", "2", "a"), row("w", "4", "a")])
    view = lambda log: sorted((r["validator"], r["evaluation_id"], r["miner"]) for r in keyed.recent_rows_of(log).collect())
    assert view(feed.run(changes)) == [("v", "2", "a"), ("v", "3", "a"), ("w", "4", "a"), ("w", "5", "a")]
    feed.put([row("v", "1", "late"), row("v", "2", "late")], [row("w", "9", "x"), row("w", "8", "x"), row("w", "7", "x")])
    assert view(feed.run(changes)) == [("v", "2", "a"), ("v", "2", "late"), ("v", "3", "a"), ("w", "8", "x"), ("w", "9", "x")]


def test_slots_run_once_and_again_after_a_failure(spark, tmp_path):
    feed = Feed(spark, tmp_path, "clock string, block long", timed=False)
    ran, broken = [], [True]

    def act(df):
        slots = sorted(r["slot"] for r in df.collect())
        if 315 in slots and broken.pop():
            raise RuntimeError("the cycle failed")
        ran.append(slots)

    def run(tolerance=None):
        q = keyed.run_slots(keyed.slots_due(feed.stream(), 150, 15, tolerance), f"{feed.folder}/slots", act)
        q.awaitTermination()

    feed.put([("c", 15), ("c", 16), ("c", 170)], [("c", 171), ("c", 171)])
    run()
    assert ran == [[15, 165]]
    feed.put([("c", 170), ("c", 320)])
    with pytest.raises(Exception, match="cycle failed"):
        run()
    broken.append(False)
    run()
    assert ran == [[15, 165], [315]]
    feed.put([("c", 470)], [("c", 600), ("c", 616)])
    run(2)  # 465 is reached too late, 615 in time
    assert ran == [[15, 165], [315], [615]]


def test_requests_in_few_buckets(spark, tmp_path, monkeypatch):
    """State grows with buckets, not with keys, and keys of one bucket open, end and start anew each for itself, though the bucket is touched in every micro-batch."""
    monkeypatch.setattr(keyed, "BUCKETS", 2, raising=False)
    draw = random.Random(4)
    feed = Feed(spark, tmp_path, "kind string, validator string, evaluation_id long, at timestamp")
    every = []
    for i in range(12):
        batch = [(draw.choice(["pending", "pending", "submission"]), draw.choice("vw"), draw.randrange(40), at(30 * i + draw.randrange(30))) for _ in range(40)]
        every += batch
        feed.put(batch)
        if i == 5:
            feed.run(lambda s: keyed.pending_changes(s, ["validator", "evaluation_id"], 60))
    log = feed.run(lambda s: keyed.pending_changes(s, ["validator", "evaluation_id"], 60))
    assert max(feed.state) <= 2 * 3  # a bucket's value and its timer
    want, end = set(), max(r[3] for r in every)
    for key in {(v, e) for _, v, e, _ in every}:
        last, done = None, False
        for t, submitted in sorted((t, k == "submission") for k, v, e, t in every if (v, e) == key):
            done = submitted or done and t - last <= datetime.timedelta(seconds=60)
            last = t
        if not done and end - last <= datetime.timedelta(seconds=60):
            want.add(key)
    assert want and set(map(tuple, keyed.open_requests(log, ["validator", "evaluation_id"]).collect())) == want
    dropped = log.where("change = 'dropped'").count()
    assert dropped and dropped + log.where("change = 'answered'").count() > 20


def test_slots_meet_as_first_heights(spark, tmp_path, monkeypatch):
    """A partition sends on the least height of a slot, whatever it gathers at once; negative heights and tolerances as by hand."""
    import pyarrow as pa

    monkeypatch.setattr(keyed, "FEW", 10)
    draw = random.Random(6)
    rows = [(c, b // 10 * 10, b) for c in "cd" for b in (draw.randrange(200) for _ in range(300))]
    batches = [pa.RecordBatch.from_pydict({k: [r[j] for r in rows[i : i + 7]] for j, k in enumerate(("clock", "slot", "block"))}) for i in range(0, len(rows), 7)]
    got = [tuple(r.values()) for b in keyed._first_blocks(iter(batches)) for r in b.to_pylist()]
    assert sorted(got) == sorted({(c, s, min(b for k, z, b in rows if (k, z) == (c, s))) for c, s, _ in rows})
    feed = Feed(spark, tmp_path, "clock string, block long", timed=False)
    heights = [[(c, draw.randrange(-3000 + 900 * i, 900 * i)) for c in "ccd" for _ in range(40)] for i in range(5)]
    feed.put(*heights)
    log = feed.run(lambda s: keyed.slots_due(s, 150, -35, 20))
    want, last = [], {}
    for batch in heights:
        for c, b in sorted(batch):
            slot = (b + 35) // 150 * 150 - 35
            if slot > last.get(c, -(10**9)) and b - slot <= 20:
                last[c] = slot
                want.append((c, slot, b))
    assert len(want) > 10 and sorted(tuple(r) for r in log.collect()) == sorted(want)

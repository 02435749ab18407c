"""Python data sources: many buckets in one scan, pages in batch and as a stream, the block clock."""

from __future__ import annotations

import hashlib
import json
import os
import random
import struct

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from tallyspark.sources import connectors
from tallyspark.sources import documents as J
from tallyspark.streaming import keyed


def put(root, name, text="{}"):
    (root / name).mkdir(parents=True, exist_ok=True)
    (root / name / "metadata.json").write_text(text)


@pytest.mark.parametrize("seed", range(3))
def test_newest_ids(tmp_path, seed):
    """Ids of any depth, names that sort on both sides of the slash."""
    draw = random.Random(seed)
    ids = {"/".join(draw.choice(["a", "a-b", "a.b", "a0", "b", "2025-01"]) for _ in range(draw.randint(1, 3))) for _ in range(25)}
    for x in ids:
        put(tmp_path, x)
    (tmp_path / "metadata.json").write_text("root")  # has no id
    (tmp_path / "a" / "x_metadata.json").parent.mkdir(exist_ok=True)
    (tmp_path / "a" / "x_metadata.json").write_text("another name")
    for n in (0, 1, 4, 100):
        assert connectors.newest_ids(fs.LocalFileSystem(), str(tmp_path), n) == sorted(ids, reverse=True)[: n or None]
    assert connectors.newest_ids(fs.LocalFileSystem(), f"{tmp_path}/none", 3) == []


def test_only_the_end_of_a_bucket_is_listed(tmp_path):
    for i in range(40):
        put(tmp_path, f"2025-01-{i:02}")
    opened = []

    class Counting:
        def get_file_info(self, x):
            opened.append(getattr(x, "base_dir", x))
            return fs.LocalFileSystem().get_file_info(x)

    assert connectors.newest_ids(Counting(), str(tmp_path), 3) == ["2025-01-39", "2025-01-38", "2025-01-37"] and len(opened) <= 6


def test_many_buckets_are_one_scan(spark, tmp_path):
    for b in range(500):
        for i in range(3):
            put(tmp_path / f"b{b}", f"2025/{i}", f'{{"b": {b}, "i": {i}}}')
    roots = {f"b{b}": (f"file://{tmp_path}/b{b}" if b % 2 else f"{tmp_path}/b{b}") for b in range(500)} | {"empty": f"{tmp_path}/none"}
    docs = J.recent_documents(spark, roots, 2)
    got = {(r["bucket"], r["evaluation_id"]): json.loads(r["content"]) for r in docs.collect()}
    assert got == {(f"b{b}", f"2025/{i}"): {"b": b, "i": i} for b in range(500) for i in (1, 2)}
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and "Union" not in plan and "Join" not in plan
    one = docs.where("bucket in ('b7', 'b8')")
    assert one.count() == 4 and one.rdd.getNumPartitions() == 1 and docs.rdd.getNumPartitions() == 16
    assert docs.where("bucket = 'none of them'").count() == 0


def pages(folder, *sizes):
    for i, n in enumerate(sizes):
        (folder / f"{10 * i}.json").write_text(json.dumps({"books": [{"id": 10 * i + j, "é": None} for j in range(n)]}))


def test_pages(spark, tmp_path):
    connectors.register(spark)
    read = lambda **o: spark.read.format("tally_pages").options(path=str(tmp_path), limit=10, **o).load()
    assert read().count() == 0
    pages(tmp_path, 10, 10, 4)
    got = read().orderBy("offset", "position").collect()
    assert [json.loads(r["row"])["id"] for r in got] == list(range(24)) and read().rdd.getNumPartitions() == 3 and read(pages=1).count() == 10


def test_pages_as_a_stream(spark, tmp_path):
    """A restart reads only what is new."""
    connectors.register(spark)
    folder = tmp_path / "pages"
    folder.mkdir()

    def run():
        stream = spark.readStream.format("tally_pages").options(path=str(folder), limit=10).load()
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
        return sum(p["numInputRows"] for p in q.recentProgress)

    pages(folder, 10, 10, 4)
    assert run() == 20
    pages(folder, 10, 10, 10, 10, 1)
    assert run() == 20 and run() == 0
    assert sorted(json.loads(r["row"])["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(40))


def test_slots_follow_the_clock(spark, tmp_path):
    """Skipped and repeated heights, a line that is not whole, a restart."""
    connectors.register(spark)
    path = tmp_path / "heights"

    def run():
        heights = spark.readStream.format("tally_blocks").options(path=str(path), clock="main").load()
        due = keyed.slots_due(heights, 150, 15)
        q = keyed.append_changes(due, f"{tmp_path}/out", f"{tmp_path}/state", once=False)
        q.processAllAvailable()
        q.stop()
        return sorted(tuple(r) for r in spark.read.schema(due.schema).parquet(f"{tmp_path}/out").collect())

    path.write_text("10\n14\n16\n16\n170\n169\n17")
    assert run() == [("main", -135, 10), ("main", 15, 16), ("main", 165, 170)]
    with open(path, "a") as f:
        f.write("1\n171\n620\n620\n")
    assert run() == [("main", -135, 10), ("main", 15, 16), ("main", 165, 170), ("main", 615, 620)]


def test_a_stale_clock_stops_its_query(spark, tmp_path):
    connectors.register(spark)
    (tmp_path / "heights").write_text("5\n")
    os.utime(tmp_path / "heights")
    query = spark.readStream.format("tally_blocks").options(path=str(tmp_path / "heights")).load().writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").start()
    clock = [0.0]
    guard = connectors.StaleGuard(query, 60, lambda: clock[0])
    query.processAllAvailable()
    guard._seen(True)
    clock[0] = 59.0
    guard._seen(False)
    assert query.isActive and not guard.stale
    clock[0] = 61.0
    guard._seen(False)
    query.awaitTermination(20)
    assert not query.isActive and guard.stale == {str(query.id)}


def test_tensors_by_ranges(spark, tmp_path):
    """Two tensors of one file are two tasks; URIs; broken files are rows with reasons."""

    def write(name, header, data, size=None):
        text = json.dumps(header).encode() if isinstance(header, dict) else header
        (tmp_path / name).write_bytes(struct.pack("<Q", len(text) if size is None else size) + text + data)

    good = {"__metadata__": {"a": "b"}, "v": {"dtype": "F32", "shape": [2, 1], "data_offsets": [0, 4]}, "w": {"dtype": "I8", "shape": [], "data_offsets": [4, 7]}, "bad": {"data_offsets": [5, 2]}, "none": {"dtype": "I8"}}
    write("a.safetensors", good, b"abcdefg")
    write("short.safetensors", {"v": {"dtype": "I8", "shape": [9], "data_offsets": [0, 9]}}, b"abc")
    write("text.safetensors", b"{no json", b"")
    write("long.safetensors", b"{}", b"", 1 << 60)
    (tmp_path / "tiny.safetensors").write_bytes(b"123")
    names = [f"file://{tmp_path}/a.safetensors", *[f"{tmp_path}/{x}.safetensors" for x in ("short", "text", "long", "tiny", "absent")]]
    rows = J.tensor_rows(spark.createDataFrame([(x,) for x in names], "path string"), 8)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    got = {(r["path"].split("/")[-1].split(".")[0], r["name"]): (r["hash"], r["reason"]) for r in rows.collect()}
    assert got == {("a", "v"): (digest(b"v|F32|(2, 1)|abcd"), None), ("a", "w"): (digest(b"w|I8|()|efg"), None), ("short", "v"): (digest(b"v|I8|(9,)|abc"), None)} | {(x, None): (None, "bad_header") for x in ("text", "long", "tiny")} | {("absent", None): (None, "no_file")}
    parts = rows.where("path like '%a.safetensors' and name is not null").select(F.spark_partition_id()).distinct().count()
    assert parts == 2

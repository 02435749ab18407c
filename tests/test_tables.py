"""Tables in buckets: what an upsert touches, what it leaves."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import functions as F

from tallyspark.operators import tables as B

SCHEMA = "k string, label string, n long"


def files(path):
    return {f"{d}/{x}": os.stat(f"{d}/{x}").st_mtime_ns for d, _, names in os.walk(path) for x in names if x.endswith(".parquet")}


def rows(table):
    return sorted(map(tuple, table.read().collect()))


def test_upsert_rewrites_one_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    table = B.KeyedTable(spark, path, SCHEMA, ["k"], 8)
    assert rows(table) == [] and table.upsert(spark.createDataFrame([], SCHEMA)) == 0
    first = [(f"k{i}", "a", i) for i in range(60)]
    assert table.upsert(spark.createDataFrame(first, SCHEMA)) == 8 and rows(table) == sorted(first)
    before = files(path)
    assert table.upsert(spark.createDataFrame([("k7", "b", 100), ("k7", "z", 1)], SCHEMA), order=["n"]) == 1  # the last by n wins
    after = files(path)
    changed = {os.path.dirname(f) for f in set(before) ^ set(after)}
    assert len(changed) == 1 and all(before[f] == after[f] for f in set(before) & set(after))
    assert rows(table) == sorted([r for r in first if r[0] != "k7"] + [("k7", "b", 100)])


def test_values_that_stay(spark, tmp_path):
    table = B.KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], 4)
    table.upsert(spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], SCHEMA))
    keep = {"label": F.coalesce(F.nullif(F.col("new.label"), F.lit("")), F.col("old.label")), "n": F.least("old.n", "new.n")}
    table.upsert(spark.createDataFrame([("a", "", 5), ("b", "z", 1), ("c", "", 9)], SCHEMA), keep=keep)
    assert rows(table) == [("a", "x", 1), ("b", "z", 1), ("c", "", 9)]
    table.upsert(spark.createDataFrame([("a", None, None)], SCHEMA))
    assert rows(table)[0] == ("a", None, None)


def test_deletes(spark, tmp_path):
    table = B.KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], 4)
    table.upsert(spark.createDataFrame([(c, c, 1) for c in "abcdefgh"], SCHEMA))
    assert table.delete(spark.createDataFrame([("a",), ("zz",), ("a",)], "k string")) in (1, 2)
    assert [r[0] for r in rows(table)] == list("bcdefgh")
    table.delete(table.read().select("k"))
    assert rows(table) == []
    table.upsert(spark.createDataFrame([("q", "q", 1)], SCHEMA))
    assert rows(table) == [("q", "q", 1)]


def test_fingerprints(spark, tmp_path):
    tensors = spark.createDataFrame([("m", "r", 5, "b", "2", 10), ("m", "r", 5, "a", "1", 20), ("é", "r", 7, "ä", "x", 1)], "model string, revision string, block long, name string, hash string, bytes long")
    table = B.fingerprint_table(spark, str(tmp_path / "t"), 4)
    table.upsert(B.fingerprint_rows(tensors))
    got = {r["model"]: r for r in table.read().collect()}
    for model, want in (("m", {"a": "1", "b": "2"}), ("é", {"ä": "x"})):
        text = json.dumps(want, sort_keys=True, separators=(",", ":"))
        assert (got[model]["tensors"], got[model]["tensors_hash"], got[model]["tensor_count"]) == (text, hashlib.sha256(text.encode()).hexdigest(), len(want))
    assert (got["m"]["total_bytes"], got["m"]["commit_block"]) == (30, 5)

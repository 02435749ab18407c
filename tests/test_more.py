"""Hand-made cases of chains, replies, documents, sinks and streams."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

import oracle
from tallyspark import shared
from tallyspark.functions import scoring as S
from tallyspark.operators import consensus as C
from tallyspark.operators import registry as R
from tallyspark.operators import sinks
from tallyspark.operators import state as K
from tallyspark.plans import more, registry
from tallyspark.sources import connectors
from tallyspark.sources import documents as J
from tallyspark.streaming import limits as L


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


OWN = sorted(n for n, f in registry.QUERIES.items() if f.__module__ == more.__name__)


@pytest.mark.parametrize("name", OWN)
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert oracle.differences(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], duck) == []


def test_every_query_has_sql():
    assert set(registry.ORACLES) == set(registry.QUERIES)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_weak_elements_round_first(spark):
    weak = lambda v: one(spark, S.weak_elements({"script": F.lit(v)}))
    assert [weak(0.49996), weak(0.49994), weak(0.5), weak(0.49995)] == ["", "script", "", "" if round(0.49995, 4) >= 0.5 else "script"]
    assert round(S.least_rounding_to(0.5), 4) == 0.5


@pytest.mark.parametrize(
    ("reply", "failed", "gender", "text"),
    [
        (None, False, "neutral", ""),
        ("", False, "neutral", ""),
        ("no json", False, "neutral", ""),
        ("[1]", True, "neutral", ""),
        ("null", True, "neutral", ""),
        ("5", True, "neutral", ""),
        ('{"gender": " MALE ", "transcription": "  x  "}', False, "male", "x"),
        ('a ``` b ``` ```json\n{"gender": "female"}``` ', False, "female", ""),
        ('{"gender": null, "transcription": null}', False, "neutral", ""),
    ],
)
def test_replies(spark, reply, failed, gender, text):
    got = one(spark, S.parsed_traits(F.lit(reply).cast("string")))
    assert (got["failed"], got["gender"], got["transcription"]) == (failed, gender, text) and got["accent"] == "neutral" and got["instruction"] == ""


def test_displays_round_half_to_even(spark):
    assert one(spark, S.percent(F.lit(0.125 / 100))) == f"{0.125 / 100:.1%}" and one(spark, S.two_places(F.lit(0.125))) == "0.12" and one(spark, S.whole_percent(F.lit(0.125))) == 12
    assert one(spark, S.number_or_zero(F.lit("x"))) == 0 and one(spark, S.number_or_zero(F.lit(" 2.5 "))) == 2.5


def test_strict_shape(spark):
    shape = lambda raw: one(spark, S.strict_shape(F.lit(raw).cast("string")))
    plain = shape("")
    assert plain["transcript"] == "" and plain["audio_quality"]["clarity"] == "slightly noisy" and plain["voice_traits"]["timbre"] == ["clear"] and plain["voice_traits"]["gender_confidence"] == 0
    assert shape(None) == plain == shape("{}") and shape("no json") is None and shape("[1]") is None
    got = shape('```json {"transcript": "t", "audio_quality": {"clarity": 5, "noise_type": "hum", "confidence": "0.5"}, "voice_traits": {"pitch": "high", "pitch_confidence": 3, "energy_confidence": -1, "timbre": ["a", 1, "b", "c", "d", "e"], "timbre_confidence": true}}```')
    assert (got["transcript"], got["audio_quality"]["clarity"], got["audio_quality"]["noise_type"], got["audio_quality"]["confidence"]) == ("t", "slightly noisy", "hum", 0.5)
    v = got["voice_traits"]
    assert (v["pitch"], v["pitch_confidence"], v["energy_confidence"], v["timbre"], v["timbre_confidence"], v["emotion"]) == ("high", 1, 0, ["a", "b", "c", "d"], 1, "neutral")
    assert shape('{"voice_traits": {"timbre": "warm"}}')["voice_traits"]["timbre"] == ["warm"] and shape('{"voice_traits": {"timbre": [1]}, "audio_quality": 5}')["voice_traits"]["timbre"] == ["clear"]


def test_slot_pins(spark):
    pin = lambda block, last: one(spark, S.slot_pin(F.lit(block), F.lit(last).cast("long"), 300, 50))
    assert [pin(650, 600), pin(650, 300), pin(651, 300), pin(651, None), pin(600, None), pin(899, 300)] == [None, 600, None, 651, 600, None]


CHAIN = {
    "chute_id": "c", "model_name": "m", "model_revision": "a" * 40, "chute_found": True, "chute_name": "A Word b", "chute_slug": "s", "hot": True, "chute_status": "cold", "code_found": True, "wrapper_ok": True, "wrapper_reason": None,
    "wrapper_revision": "a" * 40, "wrapper_repo": "m", "audit_known": True, "audit_valid": True, "audit_reason": None, "audit_hash": "h",
}


@pytest.mark.parametrize(
    ("change", "reason", "hash_"),
    [
        ({}, None, "h"),
        ({"chute_id": "base", "chute_found": False, "audit_valid": None}, None, "pin"),
        ({"model_name": "bm", "wrapper_repo": "bm", "model_revision": "b" * 40, "wrapper_revision": "b" * 40}, None, "pin"),
        ({"chute_found": False, "chute_name": None}, "chute_fetch_failed", None),
        ({"chute_name": "", "chute_slug": "x-word"}, None, "h"),
        ({"chute_name": "other", "chute_slug": "word"}, "chute_name_missing_word", None),
        ({"code_found": None, "wrapper_ok": False}, "chute_code_fetch_failed", None),
        ({"wrapper_ok": False, "hot": False}, "wrapper_hash_mismatch", None),
        ({"hot": False}, "chute_not_running", None),
        ({"hot": None, "chute_status": "HOT"}, None, "h"),
        ({"wrapper_revision": "main"}, "wrapper_revision_not_sha:main", None),
        ({"wrapper_revision": None}, "wrapper_revision_not_sha:missing", None),
        ({"wrapper_revision": "c" * 40, "wrapper_repo": "z"}, "revision_mismatch:wrapper=" + "c" * 40, None),
        ({"wrapper_repo": None}, "repo_mismatch:wrapper=None", None),
        ({"audit_known": False, "audit_valid": None}, "repo_audit_fetch_failed", None),
        ({"audit_valid": False, "audit_reason": "config_missing"}, "config_missing", None),
        ({"audit_valid": False}, "repo_audit_failed", None),
    ],
)
def test_validity_chain(spark, change, reason, hash_):
    row = CHAIN | change
    kind = lambda v: "boolean" if isinstance(v, bool) else "string"
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kind(CHAIN[k])}" for k in row))
    got = df.select(*[c.alias(n) for n, c in R.validity_chain({"chute": "base", "model": "bm", "revision": "b" * 40, "hash": "pin"}, "word").items()]).first()
    assert tuple(got) == (reason is None, reason, hash_)


FILES = [("w.safetensors", 60), ("x.safetensors", 0), ("config", 1)]


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, (True, True, None, 60, "h")),
        ({"files": None}, (False, None, None, None, None)),
        ({"files": [("x.safetensors", 0)], "config_failed": True}, (True, False, "safetensors_missing", 0, None)),
        ({"files": [("w.safetensors", 49), ("evil", 1)]}, (True, False, "safetensors_below_min_size:49<50", 49, None)),
        ({"files": [*FILES, ("evil", 1)]}, (True, False, "extra_files:evil", 60, None)),
        ({"config_failed": True, "config_text": None}, (False, None, None, None, None)),
        ({"config_text": None}, (True, False, "config_missing", 60, None)),
        ({"source_reason": "miner_py_hash_mismatch", "weights_failed": True}, (True, False, "miner_py_hash_mismatch", 60, None)),
        ({"weights_failed": True}, (False, None, None, None, None)),
        ({"collision": ("old", "0123456789abcdef", 0.95)}, (True, False, "tensor_clone_of_existing:old@0123456789ab:ratio=0.950", 60, None)),
        ({"model_hash": None}, (True, False, "tensor_fingerprint_failed", 60, None)),
    ],
)
def test_audit_chain(spark, change, want):
    row = {"files": FILES, "files_failed": False, "config_text": "t", "config_reason": None, "config_failed": False, "source_text": "t", "source_reason": None, "source_failed": False, "weights_failed": False, "collision": None, "model_hash": "h"} | change
    schema = "files array<struct<name: string, size: bigint>>, files_failed boolean, config_text string, config_reason string, config_failed boolean, source_text string, source_reason string, source_failed boolean, weights_failed boolean, collision struct<model: string, revision: string, ratio: double>, model_hash string"
    df = spark.createDataFrame([tuple(row.values())], schema)
    assert tuple(df.select(*[c.alias(n) for n, c in R.audit_chain(50, ["w.safetensors", "x.safetensors", "config"], ["config"]).items()]).first()) == want


def test_participants_without_lock(spark):
    places = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "uid long, hotkey string")
    commits = spark.createDataFrame([("a", 0, 9, "{}"), ("a", 1, 5, '{"model_name":"m","model_revision":"r","chute_id":"c"}'), ("b", 0, 1, "nothing"), ("z", 0, 1, "")], "hotkey string, pos int, block long, raw string")
    blocked = spark.createDataFrame([("c",), ("b",)], "hotkey string")
    got = {r["hotkey"]: (r["block"], r["is_valid"], r["invalid_reason"]) for r in R.participants_table(places, commits, blocked, 0, 2).collect()}
    assert got == {"a": (5, None, None), "b": (None, False, "blocked")}


def test_weights_burn(spark):
    places = spark.createDataFrame([(0, "burn"), (1, "x"), (2, "y")], "uid long, hotkey string")
    lead, none = (spark.createDataFrame([(w,)], "winner string") for w in ("y", None))
    active = spark.createDataFrame([(1,), (2,)], "v long")
    weights = lambda leader, buckets: [tuple(r) for r in C.set_weights(places, places.where("uid > 0"), leader, buckets, 2, 0).collect()]
    assert weights(lead, active) == [(1, 0.0), (2, 1.0)] and weights(none, active) == weights(lead, active.limit(1)) == weights(lead, active.limit(0)) == [(0, 1.0)]


def test_first_failures_match_the_pairs(spark):
    import random

    draw = random.Random(4)
    rows = [(f"m{i:02}", draw.randint(0, 12), draw.choice([0.1, 0.3, 0.31, 0.32, 0.5, 0.52]), draw.randint(0, 1) * 9, draw.choice([1, 2, 3])) for i in range(40)]
    st = spark.createDataFrame(rows, "miner string, block long, win_rate double, total long, n long").withColumn("is_owner", F.col("miner") == "m03").withColumn("eligible", (F.col("total") > 0) & (F.col("n") >= 2))
    priors = sorted((b, m, r) for m, b, r, t, n in rows if t and (m == "m03" or n >= 2))
    want, checks = {}, set()
    for m, b, r, t, n in rows:
        if not (t and n >= 2):
            continue
        for pb, pm, pr in priors:
            if pb < b:
                checks.add((m, pm, r >= pr + 0.02))
                if not r >= pr + 0.02:
                    want[m] = (pm, pb)
                    break
    assert {r["f_miner"]: (r["prior_miner"], r["prior_block"]) for r in C.first_failures(st, 0.02).collect()} == want
    assert {(r["miner"], r["prior_miner"], r["passed"]) for r in C.margin_checks(st, 0.02).collect()} == checks


# Sources and sinks


def test_only_the_window_is_read(spark, tmp_path, monkeypatch):
    def put(name, text):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "metadata.json").write_text(text)

    put("a/2025/01", "x" * 5000)
    put("a/2025/02", '{"participants": {"m": {"evaluation": {"score": 1}}}}')
    put("b/2025/01", '{"participants": {"m": {"evaluation": {"score": 0}}}}')
    roots = {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")}
    assert sorted((r["bucket"], r["evaluation_id"]) for r in J.recent_documents(spark, roots, 1).collect()) == [("a", "2025/02"), ("b", "2025/01")]
    read = []
    monkeypatch.setattr(connectors, "_content", lambda place, path: read.append(path) or "")
    reader = connectors.EvaluationReader({"buckets": json.dumps(roots), "newest": "1"})
    assert len([list(reader.read(p)) for p in reader.partitions()]) == 1
    assert read == [f"{tmp_path}/a/2025/02/metadata.json", f"{tmp_path}/b/2025/01/metadata.json"]
    assert {r["bytes"] for r in J.file_listing(spark, str(tmp_path), ".json").collect()} == {5000, 53}


def test_document_stats(spark):
    doc = lambda score, slug="": '{"participants": {"m": {"slug": "%s", "evaluation": {"score": %s, "generated_wins": true}}, "x": {"evaluation": {}}}}' % (slug, score)  # noqa: E731, UP031
    docs = spark.createDataFrame([("b", "4", doc("0.95")), ("b", "3", "{corrupt"), ("b", "2", doc("0.5", "new")), ("b", "1", doc("null", "old")), ("b", "0", doc("1", "older")), ("c", "9", doc('"0.9"'))], "bucket string, evaluation_id string, content string")
    valid = spark.createDataFrame([("m",), ("m",)], "miner string")
    got = {r["bucket"]: (r["total"], r["wins"], round(r["mean_score"], 4), r["slug"]) for r in C.document_stats(docs, valid, 4).collect()}
    assert got == {"b": (3, 2, round((0.95 + 0.5 + 1) / 3, 4), "old"), "c": (1, 1, 0.9, "unknown")}


def test_sample_tables_and_report(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    assert sinks.publish_sample(spark, folder, {"a.wav": b"abc", "b.wav": b"", "c.wav": None}, "{}") == ["a.wav", "metadata.json"]
    assert (tmp_path / "s" / "a.wav").read_bytes() == b"abc" and (tmp_path / "s" / "metadata.json").read_text() == "{}"
    assert sinks.report(spark.createDataFrame([(1, None), (20, "x")], "a int, bb string").orderBy("a")).split("\n") == ["a  | bb", "---+---", "1  |", "20 | x"]
    spark.sql("DROP DATABASE IF EXISTS tally_test CASCADE")
    spark.sql("CREATE DATABASE tally_test")
    spark.sql("CREATE TABLE tally_test.blocklist (id INT, hotkey STRING) USING parquet")
    sinks.create_tables(spark, "tally_test")
    sinks.create_tables(spark, "tally_test")
    assert spark.table("tally_test.blocklist").columns == ["id", "hotkey", "reason", "added_by", "created_at"] and spark.table("tally_test.snapshots").count() == 0
    sinks.drop_tables(spark, "tally_test")
    assert spark.sql("SHOW TABLES IN tally_test").count() == 0
    spark.sql("DROP DATABASE tally_test CASCADE")


def test_batches_keep_the_first_bucket(spark):
    rows = spark.createDataFrame([("e", i, f"m{i}", "first" if not i else "later") for i in range(5)], "evaluation_id string, pos int, miner string, bucket string")
    got = sinks.batches(rows, 2).orderBy("page").collect()
    assert [[x["pos"] for x in r["rows"]] for r in got] == [[0, 1], [2, 3], [4]] and {r["bucket"] for r in got} == {"first"}


def test_keyed_writes(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert K.one_row(rows, "k", 1) == {"k": 1, "v": "a"} and K.one_row(rows, "k", 9) is None
    with pytest.raises(ValueError, match="several"):
        K.one_row(rows, "k", 2)
    new = spark.createDataFrame([(0, 2, "x"), (1, 2, None), (0, 5, "y")], "pos int, k int, v string")
    old = spark.createDataFrame([(1, "a", True), (2, "b", True)], "k int, v string, ok boolean")
    assert sorted(map(tuple, K.upsert_bulk(old, new, "k", {"ok": False}).collect())) == [(1, "a", True), (2, None, False), (5, "y", False)]


def test_shared_folder(spark):
    assert shared.shared_dir(spark)
    t = shared.kept_table(spark.range(3), "x")
    assert t.count() == 3


# Streams


def test_idle_keys_are_forgotten(spark, tmp_path):
    """With a watermark, the state of a key goes when its window has passed; decisions stay the same."""
    schema = "key string, seq long, ts double, nonce string, at timestamp"
    row = lambda k, seq, ts: (k, seq, float(ts), "n", datetime.datetime.fromtimestamp(ts, datetime.UTC))
    rows = [[row("a", 1, 100), row("a", 2, 101), row("a", 3, 102)], [row("b", 4, 500)], [row("b", 5, 501)], [row("a", 6, 502)]]
    for name, run, key in (("lim", lambda s: L.limit_stream(s, 2, 10.0), "allowed"), ("rep", lambda s: L.replay_stream(s, 10.0), "accepted")):
        left = None
        for some in rows:
            spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"{name}-in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / f"{name}-in")).withWatermark("at", "1 second")
            q = run(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start(str(tmp_path / f"{name}-out"))
            q.awaitTermination()
            left = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress and q.lastProgress["stateOperators"] else left
        got = {r["seq"]: r[key] for r in spark.read.parquet(str(tmp_path / f"{name}-out")).collect()}
        assert got == ({1: True, 2: True, 3: False, 4: True, 5: True, 6: True} if key == "allowed" else {1: True, 2: False, 3: False, 4: True, 5: False, 6: True})
        assert left <= 2


# Small ones


def test_small_sources_and_predicates(spark):
    files = spark.sql("select array(named_struct('name','a.safetensors','size',5L), named_struct('name','b.safetensors','size',0L), named_struct('name','c.bin','size',9L)) as f")
    assert [x["name"] for x in files.select(J.weight_files(F.col("f")).alias("x")).first()["x"]] == ["a.safetensors"] and files.select(R.weight_bytes(F.col("f")).alias("x")).first()["x"] == 5
    requests = spark.createDataFrame([("post", "/evals/x", "k"), ("GET", "/evals/x", "k"), ("PUT", "/other", "k"), ("DELETE", "/evals", None), ("PATCH", "/evals", "")], "method string, path string, key string")
    assert [r["method"] for r in L.limited_scope(requests, ("/evals",)).collect()] == ["post"]
    commits = spark.createDataFrame([("a", 1), ("b", 2)], "hotkey string, snapshot_block long")
    assert [tuple(r) for r in J.commits_at(commits, 2).collect()] == [("b",)]
    graph = spark.createDataFrame([(["a", "b"], [1.0, 2.0])], "h array<string>, s array<double>").select(F.inline(R.metagraph(F.col("h"), F.col("s"))))
    assert [tuple(r) for r in graph.collect()] == [(0, "a", 1.0), (1, "b", 2.0)]
    rows = spark.createDataFrame([(None, None, None)], "t string, n int, f boolean")
    assert tuple(R.participant_defaults(rows).first()) == ("", 0, False)


def test_leases_in_order(spark):
    at = lambda x: datetime.datetime(2025, 1, 1, 0, 0, x)
    rows = spark.createDataFrame([(1, at(1), at(9)), (2, at(3), at(9)), (3, at(3), at(8)), (4, at(5), at(2))], "id int, started_at timestamp, expires_at timestamp")
    now = F.lit(at(8))
    assert [r["id"] for r in K.live_leases(rows, now).collect()] == [3, 2, 1] and [r["id"] for r in K.expired(rows, now).collect()] == [4]
    assert sorted(r["id"] for r in K.delete_expired(rows, now).collect()) == [1, 2, 3]


def test_labels_and_reports(spark):
    rows = spark.createDataFrame([("validator-1",), ("v2",)], "hotkey string")
    configs = spark.createDataFrame([("v2", "samples-x")], "hotkey string, bucket_name string")
    assert {r["hotkey"]: (r["bucket_name"], r["label"]) for r in C.bucket_labels(rows, configs, "samples-").collect()} == {"validator-1": ("", "validato"), "v2": ("samples-x", "x")}
    results = spark.createDataFrame([("e", True, 0.9), ("e", False, None)], "evaluation_id string, wins boolean, score double")
    assert tuple(C.round_summary(results).first()) == ("e", 2, 1, 0.45)

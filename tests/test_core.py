"""Hand-made cases of the engine's operators, and every query with SQL against DuckDB."""

from __future__ import annotations

import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

import oracle
from tallyspark.config import Settings
from tallyspark.functions import scoring as S
from tallyspark.operators import consensus as C
from tallyspark.operators import duplicates as D
from tallyspark.operators import registry as R
from tallyspark.operators import state as K
from tallyspark.plans import core
from tallyspark.sources import documents as J
from tallyspark.streaming import limits as L


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert oracle.differences(core.QUERIES[name](spark, sf_dir), core.ORACLES[name], duck) == []


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


@pytest.mark.parametrize(
    ("name", "value", "want"),
    [("gender", "unknown", "neutral"), ("pitch", "normal", "mid"), ("age_group", "twenties", "young_adult"), ("emotion", "bored", "neutral"), ("tone", "neutral", "casual"), ("accent", " American\n", "us"), ("age_group", "Young-Adult", "young_adult"), ("speed", None, "normal"), ("speed", "warp", "normal")],
)
def test_traits(spark, name, value, want):
    assert one(spark, S.normalize_trait(name, lit(value))) == want


@pytest.mark.parametrize(("a", "b", "want"), [("hello world", "hello world", 0), ("hello world", "hello there", 0.5), ("", "x", 1), ("", "", 0), ("the cat sat on the mat", "the cat sit on mat", 2 / 6), ("déjà vu", "DÉJÀ VU!", 0), ("a", "b c d", 1)])
def test_word_error_rate(spark, a, b, want):
    assert one(spark, S.word_error_rate(S.tokens(F.lit(a)), S.tokens(F.lit(b)))) == pytest.approx(want)


@pytest.mark.parametrize(("raw", "flag", "want"), [("0.9", None, 0.9), ("0.8999", None, 0.8999), ('"0.95"', None, 0.95), ("true", None, 1), ("1.7", None, 1), ("-1", None, 0), ("abc", None, 0), ("NaN", None, 1), (None, True, 1), (None, False, 0)])
def test_score_coercion(spark, raw, flag, want):
    assert one(spark, S.score_from_json(lit(raw), F.lit(flag).cast("boolean"))) == want


def test_element_scores(spark):
    ordinal = lambda a, b: one(spark, S.element_score("pitch", F.lit(a), F.lit(b)))
    assert (ordinal("low", "mid"), ordinal("low", "high"), ordinal("mid", "mid"), ordinal("mid", "zzz")) == (0.5, 0, 1, 0)
    all_ = {n: F.lit(1.0) for n in S.RAW_WEIGHTS if n != "naturalness"}
    assert one(spark, S.weighted_score(all_ | {"naturalness": F.lit(None).cast("double")})) == pytest.approx(1)
    off = all_ | {"pitch": F.lit(0.5), "emotion": F.lit(0.0), "tone": F.lit(0.0), "accent": F.lit(0.0)}
    assert one(spark, S.weighted_score(off)) == pytest.approx(0.625 / 0.85)
    assert one(spark, S.weak_elements(off)) == "emotion,accent,tone"


def test_small_functions(spark):
    assert one(spark, S.numeric_map(F.lit('{"a": 1, "b": "2", "c": true, "d": null}'))) == {"a": 1.0, "c": 1.0}
    assert one(spark, S.numeric_map(F.lit("[1]"))) is None and one(spark, S.numeric_map(F.lit("nope"))) is None
    parts = lambda p: tuple(one(spark, x) for x in S.prompt_parts(lit(p)))
    assert parts("hi | calm") == ("hi", "calm") and parts("gender: x | y") == ("Hello.", "gender: x | y") and parts("hi") == ("hi", "Neutral tone.") and parts(None) == ("Hello.", "Neutral tone.")
    assert one(spark, S.prompt_text(F.lit("t"), F.lit(""), {"pitch": F.lit("low"), "tone": F.lit("")})) == "t | pitch: low"
    assert one(spark, S.trait_object(F.lit('x ```json\n{"a":1}\n``` y'))) == '{"a":1}'
    assert one(spark, S.judge_verdict(F.lit("The First\nSECOND"), F.lit("first"))) and not one(spark, S.judge_verdict(F.lit("?"), F.lit("first")))
    assert one(spark, S.exact_round4(F.lit(0.00005))) == round(0.00005, 4)
    assert one(spark, S.canonical_json(F.lit('{"b":1, "a":[ ]}'))) == '{"a":[],"b":1}'
    slot = {k: one(spark, v) for k, v in S.cycle_slot(F.lit(317), 150, 15, 2).items()}
    assert slot == {"slot_start": 315, "slot_distance": 2, "in_slot": True}
    with pytest.raises(ValueError):
        Settings(stake_exponent=float("nan"))


def stats(spark, rows):
    return spark.createDataFrame(rows, "validator string, miner string, total long, wins long")


def test_global_scores(spark):
    w = C.stake_weights(spark.createDataFrame([("a", 16.0), ("b", 81.0), ("c", 0.0), ("d", -5.0)], "validator string, stake double"), 0.25)
    r = C.global_scores(stats(spark, [("a", "m", 10, 5), ("b", "m", 20, 20), ("c", "m", 7, 7)]), w, 10).first()
    assert (r["weighted_sum"], r["weight_sum"], r["weighted_evals"], r["eligible_validator_count"], r["validator_count"]) == (4, 5, 80, 1, 2) and r["win_rate"] == pytest.approx(0.8)
    none = C.stake_weights(spark.createDataFrame([("a", 0.0), ("b", None)], "validator string, stake double"), 0.25)
    assert [x["weight"] for x in none.collect()] == [1.0, 1.0]


def standing(spark, rows):
    people = spark.createDataFrame([(m, b) for m, b, *_ in rows], "miner string, block long")
    scores = spark.createDataFrame([(m, r, r, float(e), t, t, e, e) for m, _, r, t, e in rows if r is not None], "miner string, win_rate double, raw_win_rate double, weighted_evals double, total long, wins long, eligible_validator_count long, validator_count long")
    return C.standings(people, scores, 2, F.col("miner") == "own")


def test_margin_rule(spark):
    rows = [("own", 0, 0.5, 5, 0), ("a", 1, 0.51, 9, 2), ("b", 1, 0.75, 9, 2), ("c", 2, 0.76, 9, 2), ("d", 2, 0.99, 9, 1), ("e", 3, None, 0, 0)]
    st = standing(spark, rows)
    got = {r["miner"]: r["passed"] for r in C.margin_passes(st, 0.02).collect()}
    assert got == {"own": False, "a": False, "b": True, "c": False, "d": False, "e": False}
    checks = [(r["miner"], r["prior_miner"], r["passed"]) for r in C.margin_checks(st, 0.02).orderBy("miner", "prior_block", "prior_miner").collect()]
    assert checks == [("a", "own", False), ("b", "own", True), ("c", "own", True), ("c", "a", True), ("c", "b", False)]
    assert C.winner(C.margin_passes(st, 0.02)).first()["winner"] == "b"
    assert [r["miner"] for r in C.ranking(st).orderBy("rank").collect()][-1] == "e"


def test_ties_and_burn(spark):
    tied = standing(spark, [("x", 5, 0.5, 9, 2), ("y", 5, 0.5, 9, 2)])
    lead = C.winner(C.margin_passes(tied, 0.02))
    assert lead.first()["winner"] == "y" and C.ranking(tied).where("rank = 1").first()["miner"] == "x"
    none = C.winner(C.margin_passes(standing(spark, [("x", 5, 0.5, 9, 1)]), 0.02))
    assert none.first()["winner"] is None
    people = spark.createDataFrame([("burn",), ("x",)], "miner string")
    assert {r["miner"]: r["weight"] for r in C.weight_vector(people, none, "burn").collect()} == {"burn": 1.0, "x": 0.0}


def test_registry(spark):
    commits = spark.createDataFrame([("a", 0, 9, "{}"), ("a", 1, 5, "{}"), ("b", 0, 1, "{}"), ("c", 0, 7, "{}"), ("c", 1, 8, "{}"), ("c", 2, 9, "{}")], "hotkey string, pos int, block long, raw string")
    assert {r["hotkey"]: r["block"] for r in R.latest_commit(commits).collect()} == {"a": 5, "b": 1, "c": 9}
    got = {r["hotkey"]: r["invalid_reason"] for r in R.commits_after_lock(commits, F.lit(True), 5, 2).collect()}
    assert got == {"a": None, "c": "too_many_commits:3_post_cutover_max_2_after_block_5"}
    for raw in ("", None, "not json", "{", "[1,2,3]", '"s"'):
        assert one(spark, R.missing_field({"model_name": R.parse_commitment(lit(raw))["model_name"]})) == "missing_model_name"
    ok = "a" * 40
    assert [one(spark, R.is_revision(lit(x))) for x in (ok, ok + "\n", ok + "\r", "main", ok.upper(), ok[1:], "", None)] == [True, True, False, False, False, False, False, False]
    files = lambda *x: one(spark, R.manifest_reason(F.array(*[F.lit(f) for f in x]), ["a", "b", "o"], ["a", "b"]))
    assert (files("a", "b"), files("a", "b", "z", "y"), files("a", "a")) == (None, "extra_files:y,z", "missing_required_files:b")


def test_duplicates(spark, tmp_path):
    rows = spark.createDataFrame([(9, 5, "h"), (3, 5, "h"), (1, 7, "h"), (2, 1, ""), (4, 1, None)], "uid long, block long, model_hash string")
    got = {r["uid"]: r["invalid_reason"] for r in D.exact_duplicates(rows).collect()}
    assert got == {9: "duplicate_model:earliest_uid=3", 3: None, 1: "duplicate_model:earliest_uid=3", 2: None, 4: None}
    a = {i: "x" for i in range(20)}
    b, c = a | {0: "y"}, a | {0: "y", 1: "z"}
    t = spark.createDataFrame([(u, u, n, h) for u, m in ((1, a), (2, b), (3, c)) for n, h in m.items()], "uid long, block long, name int, hash string")
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    lost = [tuple(r) for r in D.near_duplicates(D.overlap_pairs(t, 0.95)).select("uid", "reason").collect()]
    assert lost == [(2, "tensor_near_clone_of:earliest_uid=1:ratio=0.950")]


def test_state(spark):
    log = spark.createDataFrame([("k", 1, "a", 5), ("k", 2, None, 6)], "k string, seq int, v string, w int")
    assert tuple(K.latest(log, ["k"], ["seq"]).first()) == ("k", 2, None, 6)
    rows, none = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([], "k string")
    assert K.keep_listed(rows, none, "k").count() == 2 and K.keep_listed(rows, rows.where("k = 'a'"), "k").count() == 1
    assert K.mirror_changes(rows, none, "k", authoritative=False).count() == 0
    h = spark.createDataFrame([(1, "t1", 5), (2, "t2", 5), (3, "t3", 6)], "seq int, generated_at string, v int")
    assert [(r["seq"], r["is_latest"]) for r in K.snapshot_changes(h, ["generated_at"]).orderBy("seq").collect()] == [(1, False), (3, True)]


REQUESTS = [("k", 1, 0.0), ("k", 2, 1.0), ("k", 3, 2.0), ("k", 4, 10.0), ("k", 5, 10.5), ("q", 6, 2.0)]
DECIDED = {1: (True, 0), 2: (True, 0), 3: (False, 8), 4: (False, 1), 5: (True, 0), 6: (True, 0)}


def test_limiter_batch_and_stream(spark, tmp_path):
    e = spark.createDataFrame(REQUESTS, "key string, seq long, ts double")
    key = lambda rows: {r["seq"]: (r["allowed"], r["retry_after"]) for r in rows}
    assert key(L.limit_batch(e, 2, 10.0).collect()) == DECIDED
    for i in (1, 2):  # two micro-batches: the state goes on
        e.where(f"seq {'<=' if i == 1 else '>'} 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
        q = L.limit_stream(stream, 2, 10.0).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    assert key(spark.read.parquet(str(tmp_path / "out")).collect()) == DECIDED


def test_replay_and_freshness(spark):
    e = spark.createDataFrame([("k", 1, 0.0, "n"), ("k", 2, 299.0, "n"), ("k", 3, 301.0, "n")], "key string, seq long, ts double, nonce string")
    assert {r["seq"]: r["accepted"] for r in L.replay_batch(e, 300.0).collect()} == {1: True, 2: False, 3: True}
    r = spark.createDataFrame([(0.0, "12345678"), (701.0, "12345678"), (400.0, "short"), (100.0, "12345678")], "ts double, nonce string")
    assert [x["ts"] for x in L.fresh(r, 400.0, 300.0).collect()] == [100.0]


def test_documents(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "metadata.json").write_text(text)

    put("2025/01/s1", '{"miners": {"m": {"slug": "x", "evaluation": {"generated_wins": true}}}}')
    put("2025/02/s2", '{"participants": {"m": {"evaluation": {"score": "0.5"}}, "n": {"evaluation": {"score": NaN}}}}')
    put("2025/03/s3", "{corrupt")
    (tmp_path / "metadata.json").write_text("{}")
    rows = lambda n: sorted((r["miner"], r["score"], r["wins"]) for r in J.participant_rows(J.recent_documents(spark, str(tmp_path), n)).collect())
    assert rows(0) == [("m", 0.5, False), ("m", 1.0, True), ("n", 1.0, True)] and rows(1) == [] and len(rows(2)) == 2


def test_small_sources(spark, tmp_path):
    good = [{"hotkey": "a", "bucket_name": "b", "access_key": "c", "secret_key": "d"}]
    assert J.bucket_config(json.dumps({"validators": [*good, 5]})) == good
    for bad in ("", "[]", json.dumps(good * 2), json.dumps([{"hotkey": "a"}])):
        with pytest.raises(ValueError):
            J.bucket_config(bad)
    header = json.dumps({"__metadata__": {}, "w": {"dtype": "F32", "shape": [1], "data_offsets": [0, 4]}, "bad": {"data_offsets": [4, 0]}}).encode()
    (tmp_path / "x.safetensors").write_bytes(struct.pack("<q", len(header)) + header + b"abcd")
    paths = spark.createDataFrame([(str(tmp_path / "x.safetensors"),)], "path string")
    assert [(r["name"], r["hash"]) for r in J.tensor_rows(paths).collect()] == [("w", hashlib.sha256(b"w|F32|(1,)|abcd").hexdigest())]
    assert one(spark, J.scale_text(F.lit("0x14" + b"hello".hex()))) == "hello" and one(spark, J.scale_text(F.lit("0x" + (1 | 5 << 2).to_bytes(2, "little").hex() + b"hello".hex()))) == "hello"

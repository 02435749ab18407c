"""The language network: gradients, labels, pooling, held-out accuracy, odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import language, queries
from tallyspark.llm.common import table

WORDS = {"aa": {b"ab": 3, b"abba": 2, b"cab": 1}, "bb": {b"xyx": 2, b"yy": 2, "żz".encode(): 1}}


@pytest.fixture(scope="module")
def net():
    return language.train(WORDS, steps=60, batch=64)


def loss(net, words, langs):
    at = [net.positions(w) for w in words]
    letters = [language.LETTER[np.frombuffer(w, dtype=np.uint8)] for w in words]
    return -sum(np.log(p[n, k]).sum() for p, n, k in zip(at, letters, langs, strict=True)) / sum(n.sum() for n in letters)


def test_gradients_are_those_of_the_loss():
    net = language.Network.fresh(["a", "b", "c"])
    for x in (net.ahead, net.back):
        x.byte, x.state = x.byte.astype(np.float64), x.state.astype(np.float64)
    net.out, net.bias = net.out.astype(np.float64), net.bias.astype(np.float64)
    words, langs = [b"ab", b"hello", b"c", b"a1b!"], np.array([0, 1, 2, 0])
    rng = np.random.default_rng(0)
    for w, g in zip(net.weights, net.learn(words, langs), strict=True):
        places = np.argwhere(np.abs(g) > 1e-4)
        for i in places[rng.permutation(len(places))[:6]]:
            i, e, was = tuple(i), 1e-3, w[tuple(i)]
            w[i] = was + e
            up = loss(net, words, langs)
            w[i] = was - e
            down = loss(net, words, langs)
            w[i] = was
            assert abs((up - down) / (2 * e) - g[i]) < 2e-3 * max(1, abs(g[i]))


def test_both_ends_reach_every_position(net):
    a, b = net.positions(b"abba"), net.positions(b"abbx")
    assert a.shape == (4, 2) and np.allclose(a.sum(axis=1), 1, atol=1e-5)
    assert (np.abs(a - b).max(axis=1) > 0).all()  # the last byte tells at the first position too
    assert (np.abs(net.positions(b"abba") - net.positions(b"xbba")).max(axis=1) > 0).all()


def test_sums_are_those_of_single_words(net):
    words = [b"ab", b"xyx", b"1-2", "żż".encode(), b"a" * language.CUT, b"q"]
    for w, got in zip(words, net.sums(words), strict=True):
        p = net.positions(w)[language.LETTER[np.frombuffer(w, dtype=np.uint8)]]
        assert np.abs(got / language.UNIT - p.sum(axis=0)).max() < 1e-3
    text = b"Ab xyx " * 50 + b"yy" * 100
    reader = language.Reader(net)
    whole = reader.totals([text, b"", b"yy"])
    one = sum(net.sums([p]).astype(np.int64)[0] for w in text.lower().split() for p in language.pieces_of(w))
    assert (np.abs(whole[0] - one) <= 150 * 2).all() and not whole[1].any()
    reader.most = 1  # forgets between groups
    assert (reader.totals([text]) == whole[0]).all()


def test_odd_rows(spark, net):
    rows = [(1, "abba cab", 7), (1, "abba cab", 7), (None, "XYX yy", 7), (2, None, 7), (3, "", 7), (4, "12 — 34!", 7), (5, "1 yy", None), (6, "yy " * 300_000, 7), (7, "y" * 50_000, 7), (8, "żż", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").withColumn("text_to_read", F.lit("clash"))
    got = language.identify(docs, net)
    assert got.columns == ["doc_id", "text", "text_to_read", "lang_pred", "score"]
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in got.collect()]
    assert [(a, b) for a, b, _ in found] == [(1, "aa"), (1, "aa"), (None, "bb"), (2, "und"), (3, "und"), (4, "und"), (5, "bb"), (6, "bb"), (7, "bb"), (8, "bb")]
    assert found[0] == found[1] and all(0.5 < c <= 1 if b != "und" else c == 0 for _, b, c in found)
    assert language.identify(docs.limit(0), net).count() == 0
    labels = {r["doc_id"]: r["labels"] for r in language.label_positions(docs, net).collect()}
    assert labels[5] == [labels[5][0], -1, 1, 1] and labels[2] is None and labels[3] == [] and len(labels[7]) == 50_000


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, None, "x"), (None, "a", "x"), (3, "12", "x")], "doc_id long, text string, lang string")
    words = language.training_words(docs, language.fold_of(F.col("doc_id")) != 9)
    assert words == {} and [tuple(r)[3:] for r in language.identify(docs, language.train(words)).collect()] == [("und", 0.0)] * 4
    one = language.train({"x": {b"a": 1}})
    assert [tuple(r)[3:] for r in language.identify(docs, one).collect()] == [("x", 1.0), ("und", 0.0), ("x", 1.0), ("und", 0.0)]


def test_sample_is_bounded_and_spread(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 50 + f"end{i}", "ab"[i % 2]) for i in range(40)] + [(0, "again", "a")], "doc_id long, text string, lang string")
    words = language.training_words(docs, F.lit(True), per_lang=5, per_doc=10)
    assert {k: sum(v.values()) <= 50 for k, v in words.items()} == {"a": True, "b": True}
    assert sum(map(len, language.training_words(docs, F.lit(True), sample=3, per_lang=5, per_doc=1).values())) <= 3


def test_held_out_documents(spark):
    got = queries.op11_language(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    known = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    right = got.where("held_out").join(known, "doc_id").agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert right[0] > 200 and right[1] >= 0.99

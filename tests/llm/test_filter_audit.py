"""The filter audit against direct counting, on odd rows."""

from __future__ import annotations

import re
from itertools import permutations

from pyspark.sql import functions as F

from tallyspark.llm import filter_audit

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and x(q, t) == 1} for x in (lambda q, t: q, lambda q, t: t))
    rows = []
    for d, text, lang in docs:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = d is not None and any(o is not None and o < d and (x or "") == t for o, x, _ in docs)
        rows.append((lang or "", fails, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if r[1][x]]
                left = [r for r in left if not r[1][x]]
                shapley[x] += len(gone)
                all_fail = sum(r[1][x] for r in own)
                out[part, "".join(order), step] = [len(left), len(gone), all_fail - len(gone), sum(r[1][x] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def rows_of(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in df.collect()}


def test_counts_of_every_order(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [(1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long + " #", "de"), (4, "A B", "de"), (5, None, None), (6, "", None), (None, long, "en"), (7, "x " * 300, ""), (8, long.upper(), "de"), (9, long + " é", "fr"), (10, "long " * 100_000, "fr"), (None, None, "zz")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (4, 0, 1), (None, 1, 1), (8, 1, 1), (99, 1, 1)]
    table = spark.createDataFrame(docs, DOCS).withColumns({"good": F.lit("clash"), "n_words": F.lit(1), "part": F.lit(2), "digest": F.lit(0)})
    got = rows_of(filter_audit.audit(table, spark.createDataFrame(labels, LABELS)))
    assert got == brute(docs, labels) and len(got) == 5 * 600


def test_states_are_shared(spark, monkeypatch):
    """31 states are persisted, not the 206 prefixes of 120 orders, and no more than five at a time."""
    held, most, made = set(), [], []
    frame = type(spark.range(1))
    persist, release = frame.persist, frame.unpersist

    def keep(self, *level):
        held.add(id(self))
        made.append(1)
        most.append(len(held))
        return persist(self, *level)

    monkeypatch.setattr(frame, "persist", keep)
    monkeypatch.setattr(frame, "unpersist", lambda self, *x: (held.discard(id(self)), release(self, *x))[1])
    rows = spark.range(100).selectExpr("'p' as part", "id")
    filters = {x: F.col("id") % p == 0 for x, p in zip("VWXYZ", (2, 3, 5, 7, 11), strict=True)}
    edges = {(r["gone"], r["letter"]): (r["n"], r["removed"]) for r in filter_audit.edge_counts(rows, filters, {}).collect()}
    assert len(made) == 31 and max(most) == 5 and not held and len(edges) == 80
    left = [i for i in range(100) if i % 2 and i % 5]
    assert edges[0b101, "W"] == (len(left), sum(i % 3 == 0 for i in left))


def test_no_documents(spark):
    got = filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert got.count() == 0 and got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

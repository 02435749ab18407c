"""The pipeline's stages against what they must keep."""

from __future__ import annotations

import duckdb
import sentencepiece

import corpus_pipeline
from tallyspark.llm import oracles, queries, ranking
from tallyspark.llm.common import table

SF = "/root/testdata/sf0.001"


def by_sql(docs, sql, tmp_path, name):
    """What DuckDB makes of a query over these documents."""
    where = str(tmp_path / name)
    docs.coalesce(1).write.parquet(where)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{where}/*.parquet'")
    found = c.execute(sql)
    return [dict(zip([x[0] for x in found.description], r, strict=True)) for r in found.fetchall()]


def test_stages(spark, tmp_path):
    """Each stage against SQL, brute force or the library, on what the stage before it kept."""
    from test_operators import brute_components

    docs = table(spark, SF, "documents")
    names = docs.columns
    ruled = corpus_pipeline.rules(spark, docs, SF).cache()
    judged = by_sql(docs, oracles.op10(), tmp_path, "rules")
    assert {r["doc_id"] for r in ruled.collect()} == {r["doc_id"] for r in judged if r["kept"]} and ruled.columns == names
    classed = corpus_pipeline.classifier(spark, ruled, SF).cache()
    model = queries.quality_model(spark, SF)
    scores = {r["doc_id"]: model.scores(ranking.features([(r["text"] or "").encode()]))[0] for r in ruled.collect()}
    assert {r["doc_id"] for r in classed.collect()} == {i for i, x in scores.items() if x >= 0.3} and classed.columns == names
    single = corpus_pipeline.deduplicate(spark, classed, SF).cache()
    rows = sorted(classed.collect(), key=lambda r: r["doc_id"])
    want = {rows[c]["doc_id"] for i, (n, c) in enumerate(brute_components([r["text"] for r in rows])) if c == i}
    assert {r["doc_id"] for r in single.collect()} == want and single.columns == names
    mixed = corpus_pipeline.mixture(spark, single, SF)
    taken = {r["doc_id"]: r["copies"] for r in by_sql(single, oracles.OP2, tmp_path, "mixture")}
    got = [r["doc_id"] for r in mixed.collect()]
    assert mixed.columns == names and all(got.count(i) == n for i, n in taken.items()) and len(got) == sum(taken.values())
    out = corpus_pipeline.encode(spark, mixed, SF).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_bpe())
    text = {r["doc_id"]: r["text"] for r in rows}
    assert len(out) == len(got) and all(r["ids"] == library.encode(text[r["doc_id"]]) for r in out)


ODD = "doc_id long, text string, lang string, source string, n_chars long"


def run_on(spark, tmp_path, rows, monkeypatch):
    """The pipeline over other documents, with the model of the supplied ones."""
    where = str(tmp_path / "sf")
    spark.createDataFrame(rows, ODD).write.parquet(f"{where}/documents.parquet")
    model = queries.quality_model(spark, SF)
    monkeypatch.setattr(queries, "quality_model", lambda *_: model)
    return corpus_pipeline.run(spark, where)


def test_odd_documents(spark, tmp_path, monkeypatch):
    text = [r["text"] for r in table(spark, SF, "labels").where("quality = 1").join(table(spark, SF, "documents"), "doc_id").orderBy("doc_id").limit(12).collect()]
    rows = [(None, text[0], "en", "a", 1), (1, None, "en", "a", 1), (2, "", None, None, None), (3, text[1], None, None, None), (3, text[1], "en", "a", 1), (4, text[1], "en", "b", 1), (5, text[2] * 20, "en", "b", 1), (6, text[3], "en", "b", 1), (6, text[4], "en", "b", 1)]
    rows += [(10 + i, t, "en", "a", 1) for i, t in enumerate(text[5:])]
    kept = {r["doc_id"] for r in corpus_pipeline.deduplicate(spark, spark.createDataFrame(rows, ODD), SF).collect()}
    again = corpus_pipeline.deduplicate(spark, spark.createDataFrame(rows, ODD), SF).groupBy("doc_id").count().collect()
    assert 4 not in kept and {r["doc_id"]: r["count"] for r in again}[3] == 1 and {r["doc_id"]: r["count"] for r in again}[6] == 2 and None in kept
    out = run_on(spark, tmp_path, rows, monkeypatch).collect()
    assert {r["doc_id"] for r in out} <= {None, 3, 5, 6, *range(10, 17)} and not {1, 2, 4} & {r["doc_id"] for r in out} and len(out) > 5


def test_no_documents(spark, tmp_path, monkeypatch):
    out = run_on(spark, tmp_path, [], monkeypatch)
    assert out.count() == 0 and {"doc_id", "ids"} <= set(out.columns)

"""Registered queries over the corpus operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, filter_audit, html_text, language, mixing, neardup, oracles, pieces, ppm, quality_rules, ranking, token_files, url_rules
from .common import scratch, table

#: The site rules that the URL query applies.
SITE_RULES = (
    url_rules.site_rule("allow", "com", "/"),
    url_rules.site_rule("block", "example.com", "/en/"),
    url_rules.site_rule("allow", "www.example.com", "/en/"),
    url_rules.site_rule("block", "net", "/es/"),
    url_rules.site_rule("block", "net", "/fr/"),
)


def word_bpe() -> str:
    """Where the public word tokenizer lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_bpe() -> str:
    """Where the public piece model lies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_bpe() -> str:
    """Where the public byte-level tokenizer lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=("doc_id", "source"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), scratch(spark, "tokens"), word_bpe())
    return token_files.read_token_files(spark, manifest)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(table(spark, sf_dir, "documents"))


def op7_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(spark, sf_dir)
    held = F.coalesce(ranking.fold_of(F.col("doc_id")) == 0, F.lit(False))
    return ranking.score_quality(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def quality_model(spark: SparkSession, sf_dir: str) -> ranking.Model:
    """Fitted on the labels of the documents that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return ranking.fit(*ranking.training_rows(docs, labels, ranking.fold_of(F.col("doc_id")) != 0))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, "url", SITE_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), piece_bpe())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = quality_rules.quality_rules(docs)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(language.fold_of(F.col("doc_id")) == 2, F.lit(False))
    net = language.train(language.training_words(docs, language.fold_of(F.col("doc_id")) != 2))
    return language.identify(docs.select("doc_id", "text", held.alias("held_out")), net).select("doc_id", "held_out", "lang_pred", "score")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), byte_bpe(), piece_bpe())


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_mixing": op2_mixing,
    "op6_token_files": op6_token_files,
    "op3_ann": op3_ann,
    "op4_neardup": op4_neardup,
    "op5_ppm": op5_ppm,
    "op7_pairwise_quality": op7_pairwise_quality,
    "op8_url_rules": op8_url_rules,
    "op9_pieces": op9_pieces,
    "op10_quality_rules": op10_quality_rules,
    "op11_language": op11_language,
    "op12_filter_audit": op12_filter_audit,
    "op13_alignment": op13_alignment,
}

ORACLES: dict[str, str] = {"op2_mixing": oracles.OP2, "op4_neardup": oracles.OP4, "op8_url_rules": oracles.op8(SITE_RULES), "op10_quality_rules": oracles.op10(), "op12_filter_audit": oracles.op12()}

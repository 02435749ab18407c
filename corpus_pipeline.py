"""From raw documents to piece ids: rules, classifier, near-duplicates, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the columns of documents.
A document of a duplicate group stays if it is the group's least doc_id. The mixture repeats a document as often as it is taken.

Null, empty and wordless texts fail the quality rules. Null languages and sources are groups, and a source, of their own. Rows with a null
doc_id are never duplicates of anything and go through all stages. Of rows with one doc_id and one text, one stays; rows with one doc_id and
different texts stay or go together, and stay if one of them would. An empty table gives no rows, with the same columns. Extra columns
of ``docs`` are carried to the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import mixing, neardup, pieces, quality_rules, queries, ranking
from tallyspark.llm.common import fits_broadcast, kept_table, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.quality_rules(docs).where("kept").select(*docs.columns)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is fitted on the labelled part of the raw documents."""
    return ranking.score_quality(docs, queries.quality_model(spark, sf_dir)).where("predicted = 1").select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    gone = neardup.near_duplicates(docs).groupBy(F.col("doc_id").alias("gone_id")).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    told = kept_table(gone.where("gone_id is not null and (not kept or n > 1)"), "gone")
    fits = fits_broadcast(told)
    marked = docs.join(F.broadcast(told) if fits else told, F.col("doc_id") == F.col("gone_id"), "left").where("kept is null or kept")
    single = marked.where("n is null").select(*docs.columns)
    if told.where("kept").isEmpty():
        return single
    return single.unionByName(marked.where("n is not null").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    mixed = mixing.mix(docs).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row."""
    return pieces.encode_documents(docs, queries.piece_bpe(), keep=("doc_id", "lang", "source"))


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("near-duplicates", deduplicate), ("mixture", mixture), ("pieces", encode)]

#: The classifier, the similarity join and the encoder have no SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The driver's tables in the roles of the engine's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ID_FORMAT = "yyyy-MM-dd_HH-mm-ss"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers evaluate brands: one row per line item."""
    part = load(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("miner"))
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    score = F.col("l_quantity") / 50
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("validator"), "miner", F.date_format("l_shipdate", ID_FORMAT).alias("evaluation_id"), score.alias("score"), (score >= 0.9).alias("wins"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate",
    )


def row_tie():
    return F.struct("l_orderkey", "l_linenumber", "l_partkey", "score", "l_extendedprice")


def stakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("validator"), F.col("s_acctbal").alias("stake"))


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands with the block of their first part."""
    return load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("miner")).agg(F.min("p_partkey").alias("block"))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as registered models: uid and block from doc_id, hash of the text, labels as validity."""
    labels = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = load(spark, sf_dir, "documents")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("uid"), F.col("doc_id").alias("block"), "source", "lang", "text", F.sha2(F.col("text"), 256).alias("model_hash"), "quality", "toxic")


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as tensors: place and hash. Null texts have none."""
    lines = load(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return lines.select(F.col("doc_id").alias("uid"), F.col("doc_id").alias("block"), F.posexplode("lines").alias("name", "line")).select("uid", "block", "name", F.sha2(F.col("line"), 256).alias("hash"))

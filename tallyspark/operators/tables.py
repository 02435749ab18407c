"""Tables kept by key in buckets: an upsert reads and rewrites only the buckets that its keys fall in.

A table is a folder of parquet, partitioned by ``bucket_``, a hash of the key. An upsert joins what is new with the touched buckets alone, writes
the result aside and puts it in their place by dynamic partition overwrite; other buckets are not opened. The buckets to read go to the
scan as a list of at most ``buckets`` numbers. One writer at a time; a failure before the last step leaves the table as it was, and an upsert that is repeated gives the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.scoring import canonical_json
from tallyspark.shared import kept_table

BUCKET = "bucket_"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class KeyedTable:
    """A table under ``path`` with a unique ``keys``; its schema and number of buckets are fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 256) -> None:
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets

    def _exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _rows(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], f"{self.schema}, {BUCKET} int")
        return self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(self.path)

    def read(self) -> DataFrame:
        return self._rows().drop(BUCKET)

    def _replace(self, touched: list[int], merged: DataFrame) -> int:
        """Puts the rows of the touched buckets in their place. A bucket that is left empty keeps a file without rows."""
        merged = kept_table(merged, "merged")
        left = {r[0] for r in merged.select(BUCKET).distinct().collect()}
        if left:
            merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        jvm = self.spark.sparkContext._jvm
        for b in set(touched) - left:
            where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={b}")
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        return len(touched)

    def _touched(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(bucket_of(self.keys, self.buckets)).distinct().collect())  # numbers of buckets

    def upsert(self, new: DataFrame, order: list[str] | None = None, keep: dict[str, Column] | None = None) -> int:
        """Puts rows in by key and says how many buckets were rewritten. Of equal keys the last by ``order`` wins.

        ``keep``: columns whose value is computed where the key is known already, from ``old`` and ``new`` (structs); the others take the new value.
        """
        rest = [c for c in self.read().columns if c not in self.keys]
        last = new.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*(order or rest))).alias("new"))
        last = kept_table(last.withColumn(BUCKET, bucket_of(self.keys, self.buckets)), "upsert")
        touched = sorted(r[0] for r in last.select(BUCKET).distinct().collect())
        if not touched:
            return 0
        old = self._rows().where(F.col(BUCKET).isin(touched)).select(*self.keys, BUCKET, F.struct(*rest).alias("old"))
        both = old.join(last, [*self.keys, BUCKET], "full_outer")
        value = lambda c: F.when(F.col("new").isNull(), F.col(f"old.{c}")).when(F.col("old").isNull(), F.col(f"new.{c}")).otherwise((keep or {}).get(c, F.col(f"new.{c}")))
        return self._replace(touched, both.select(*self.keys, *[value(c).alias(c) for c in rest], BUCKET))

    def delete(self, gone: DataFrame) -> int:
        """Takes keys out; says how many buckets were rewritten."""
        gone = gone.select(*self.keys).distinct()
        touched = self._touched(gone)
        if not touched:
            return 0
        left = self._rows().where(F.col(BUCKET).isin(touched)).join(gone, self.keys, "left_anti")
        return self._replace(touched, left)


FINGERPRINTS = "model string, revision string, total_bytes long, tensor_count int, tensors string, tensors_hash string, commit_block long"


def fingerprint_rows(tensors: DataFrame) -> DataFrame:
    """A row per (model, revision) from ``model, revision, block, name, hash, bytes``: the map of hashes as canonical JSON (sorted keys, no blanks, ASCII), its sha256, counts."""
    rows = tensors.groupBy("model", "revision").agg(
        F.sum("bytes").cast("long").alias("total_bytes"),
        F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col("name").cast("string"), "hash")))).alias("m"),
        F.max("block").cast("long").alias("commit_block"),
    )
    text = canonical_json(F.to_json("m"))
    return rows.select("model", "revision", "total_bytes", F.size("m").alias("tensor_count"), text.alias("tensors"), F.sha2(text, 256).alias("tensors_hash"), "commit_block")


def fingerprint_table(spark: SparkSession, path: str, buckets: int = 256) -> KeyedTable:
    """The store of fingerprints by (model, revision)."""
    return KeyedTable(spark, path, FINGERPRINTS, ["model", "revision"], buckets)

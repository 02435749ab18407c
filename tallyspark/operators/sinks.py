"""Writes with an order to them, and picks that remember."""

from __future__ import annotations

import random
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BATCH = 100


def write_evaluations(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Evaluation documents as JSON, one folder per evaluation id; the commit protocol publishes a file only when it is whole."""
    rows.write.mode(mode).partitionBy("evaluation_id").json(path)


def publish_sample(spark: SparkSession, folder: str, files: dict[str, bytes | None], metadata: str, attempts: int = 3) -> list[str]:
    """Writes a sample's files and, last, ``metadata.json``, by which readers find it; names of what was written.

    Missing and empty files are skipped. A write that fails is tried again after 1, 2, 4 ... seconds.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = []
    for name, data in [*((n, b) for n, b in files.items() if b), ("metadata.json", metadata.encode())]:
        where = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        for attempt in range(attempts):
            try:
                out = where.getFileSystem(conf).create(where, True)
                out.write(data)
                out.close()
                break
            except Py4JJavaError:
                if attempt == attempts - 1:
                    raise
                time.sleep(2**attempt)
        done.append(name)
    return done


def report(rows: DataFrame, limit: int = 50) -> str:
    """The first rows as a text table, for a log."""
    names = rows.columns
    cells = [names, *[["" if v is None else str(v) for v in r] for r in rows.limit(limit).collect()]]
    widths = [max(len(c[i]) for c in cells) for i in range(len(names))]
    lines = [" | ".join(v.ljust(w) for v, w in zip(c, widths, strict=True)).rstrip() for c in cells]
    return "\n".join([lines[0], "-+-".join("-" * w for w in widths), *lines[1:]])


# The tables of the engine and their columns.
TABLES = {
    "participants": "uid INT, hotkey STRING, block INT, model_name STRING, model_revision STRING, model_hash STRING, chute_id STRING, chute_slug STRING, is_valid BOOLEAN, invalid_reason STRING, last_validated_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP",
    "evaluations": "id INT, validator STRING, evaluation_id STRING, miner STRING, prompt STRING, bucket STRING, prefix STRING, wins BOOLEAN, confidence INT, reasoning STRING, score DOUBLE, element_scores MAP<STRING, DOUBLE>, original_url STRING, generated_url STRING, evaluated_at TIMESTAMP",
    "blocklist": "id INT, hotkey STRING, reason STRING, added_by STRING, created_at TIMESTAMP",
    "validators": "uid INT, hotkey STRING, stake DOUBLE, bucket STRING, last_seen_at TIMESTAMP, created_at TIMESTAMP",
    "pending": "validator STRING, evaluation_id STRING, prompt_summary STRING, miners ARRAY<STRING>, created_at TIMESTAMP",
    "fingerprints": "model_name STRING, model_revision STRING, total_bytes BIGINT, tensor_count INT, tensors MAP<STRING, STRING>, commit_block BIGINT, computed_at TIMESTAMP",
    "snapshots": "id INT, snapshot_hash STRING, winner STRING, is_latest BOOLEAN, snapshot STRING, generated_at TIMESTAMP, updated_at TIMESTAMP",
    "leases": "activity_key STRING, activity_type STRING, validator STRING, status STRING, payload STRING, started_at TIMESTAMP, expires_at TIMESTAMP, updated_at TIMESTAMP",
}


def create_tables(spark: SparkSession, database: str) -> None:
    """Creates the database and the tables that it lacks; existing tables get the columns they lack."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, ddl in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({ddl}) USING parquet")
        have = {c.lower() for c in spark.table(f"{database}.{name}").columns}
        new = [f for f in T.StructType.fromDDL(ddl).fields if f.name.lower() not in have]
        if new:
            spark.sql(f"ALTER TABLE `{database}`.`{name}` ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")


def drop_tables(spark: SparkSession, database: str) -> None:
    """Drops the engine's tables."""
    for name in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}`")


def hand_over(leases: DataFrame, done: DataFrame, result_ttl: int) -> DataFrame:
    """The lease table after results: evaluation leases of finished keys go, result leases come, in one new version of the table.

    ``leases``: activity_key, kind, expires_at; ``done``: activity_key, at.
    """
    over = done.select("activity_key").distinct()
    kept = leases.join(over, "activity_key", "left_anti").unionByName(leases.where("kind <> 'evaluation'").join(over, "activity_key", "left_semi"))
    new = done.groupBy("activity_key").agg(F.max("at").alias("at")).select("activity_key", F.lit("result").alias("kind"), F.timestamp_seconds(F.unix_micros("at") / 1e6 + result_ttl).alias("expires_at"))
    return kept.unionByName(new)


def batches(rows: DataFrame, size: int = BATCH) -> DataFrame:
    """Rows (evaluation_id, pos, miner, perhaps bucket) as arrays of at most ``size`` per evaluation id, for a paged sink, with the id's first bucket.

    Keys are bounded: one id holds one round.
    """
    numbered = rows.withColumn("n_", F.row_number().over(Window.partitionBy("evaluation_id").orderBy("pos")) - 1)
    pages = numbered.groupBy("evaluation_id", F.floor(F.col("n_") / size).alias("page")).agg(F.array_sort(F.collect_list(F.struct("pos", "miner"))).alias("rows"))
    return pages.join(rows.groupBy("evaluation_id").agg(F.min_by("bucket", "pos").alias("bucket")), "evaluation_id") if "bucket" in rows.columns else pages


class Picker:
    """Seeded random picks without recent repeats: a driver-side choice, not a data operator."""

    def __init__(self, seed: int = 0, history: int = 50, kept_when_exhausted: int = 5) -> None:
        self.random, self.most, self.kept = random.Random(seed), history, kept_when_exhausted
        self.recent: list[str] = []

    def pick(self, names: list[str]) -> str | None:
        """One of the names, not picked recently; when all were, only the last few stay excluded."""
        if not names:
            return None
        free = sorted(set(names) - set(self.recent))
        if not free:
            self.recent = self.recent[-self.kept :] if len(self.recent) >= self.kept else []
            free = sorted(set(names) - set(self.recent)) or sorted(set(names))
        chosen = self.random.choice(free)
        self.recent = [*self.recent, chosen][-self.most :]
        return chosen

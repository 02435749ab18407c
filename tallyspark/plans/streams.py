"""Queries that run the streams with keyed state over the driver's tables to their end, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.plans import tables as T
from tallyspark.plans.core import query
from tallyspark.shared import scratch
from tallyspark.streaming import keyed

_TTL, _KEEP, _NEWEST = 86_400, 5 * 86_400, 5
_SECONDS = "epoch_us(ts) / 1e6"


def _read(s: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream; a pattern, since a plain path has to be a folder."""
    return s.readStream.schema(T.load(s, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _stream(s: SparkSession, d: str) -> DataFrame:
    """The events as a stream with event times."""
    return _read(s, d, "events").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "0 seconds")


def _log(s: SparkSession, changes: DataFrame, name: str) -> DataFrame:
    """The changes of a stream that has read all its input."""
    path = scratch(s, name)
    keyed.append_changes(changes, path, scratch(s, f"{name}-state")).awaitTermination()
    return s.read.schema(changes.schema).parquet(path)


@query("stream_leases", f"""WITH e AS (SELECT user_id, event_type, {_SECONDS} AS t, max({_SECONDS}) OVER () AS now FROM events), g AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_type) AS before FROM e),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR t > before + {_TTL} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_type ROWS UNBOUNDED PRECEDING) AS lease FROM g)
SELECT user_id, arg_max(event_type, (t, event_type)) AS status, round(min(t), 6) AS started, round(max(t), 6) AS updated FROM i GROUP BY user_id, lease, now HAVING max(t) + {_TTL} >= now""")
def stream_leases(s, d):
    log = _log(s, keyed.lease_changes(_stream(s, d).select(F.col("user_id").cast("string").alias("activity_key"), F.col("event_type").alias("status"), "at", F.lit(_TTL).alias("ttl"))), "leases")
    return keyed.current_leases(log).select(F.col("activity_key").cast("long").alias("user_id"), "status", F.round("started", 6).alias("started"), F.round("updated", 6).alias("updated"))


@query("stream_pending", f"""WITH e AS (SELECT user_id, event_type = 'purchase' AS done, {_SECONDS} AS t, max({_SECONDS}) OVER () AS now, event_id % 7 AS part FROM events), g AS (SELECT *, lag(t) OVER (PARTITION BY user_id, part ORDER BY t, done) AS before FROM e),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR t > before + {_KEEP} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, part ORDER BY t, done ROWS UNBOUNDED PRECEDING) AS spell FROM g)
SELECT user_id, part FROM i GROUP BY user_id, part, spell, now HAVING NOT max(done) AND max(t) + {_KEEP} >= now""")
def stream_pending(s, d):
    events = _stream(s, d).select(F.when(F.col("event_type") == "purchase", "submission").otherwise("pending").alias("kind"), "user_id", (F.col("event_id") % 7).alias("part"), "at")
    return keyed.open_requests(_log(s, keyed.pending_changes(events, ["user_id", "part"], _KEEP), "pending"), ["user_id", "part"])


@query("stream_recent", f"SELECT user_id, event_id, event_type FROM (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= {_NEWEST}")
def stream_recent(s, d):
    name = F.concat(F.date_format("at", "yyyy-MM-dd_HH-mm-ss.SSSSSS"), F.lit("_"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    events = _stream(s, d).select("user_id", name.alias("evaluation_id"), "event_id", "event_type")
    return keyed.recent_rows_of(_log(s, keyed.recent_changes(events, _NEWEST, "user_id"), "recent"), "user_id").select("user_id", "event_id", "event_type")


@query("stream_slots", "SELECT (o_orderkey // 1500) * 1500 + 15 AS slot, min(o_orderkey + 15) AS block FROM orders GROUP BY 1")
def stream_slots(s, d):
    heights = _read(s, d, "orders").select(F.lit("chain").alias("clock"), (F.col("o_orderkey") + 15).alias("block"))
    return _log(s, keyed.slots_due(heights, 1500, 15), "slots").select("slot", "block")

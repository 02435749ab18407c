"""Operational state as logs and views: upserts, deletes, leases, mirrors, retention, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.scan import last_before


def latest(log: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """The last row per key by ``seq``: the view after all upserts; nulls of the last row stand. An aggregate, so it combines before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("row_")).select(*keys, "row_.*")


def merge_keep(old: DataFrame, new: DataFrame, key: str, keep_if_empty: list[str]) -> DataFrame:
    """Upsert where an empty new value does not replace the old one in the named columns."""
    cols = [c for c in new.columns if c != key]
    o, n = old.select(key, *[F.col(c).alias(f"o_{c}") for c in cols], F.lit(True).alias("o_")), new.select(key, *[F.col(c).alias(f"n_{c}") for c in cols], F.lit(True).alias("n_"))
    pick = lambda c: F.coalesce(F.nullif(F.col(f"n_{c}"), F.lit("")), F.col(f"o_{c}")) if c in keep_if_empty else F.when(F.col("n_"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))
    return o.join(n, key, "full_outer").select(key, *[pick(c).alias(c) for c in cols])


def keep_listed(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed; an empty list deletes nothing."""
    listed = names.select(F.col(key).alias("listed")).distinct()
    some = F.broadcast(listed.agg((F.count("*") > 0).alias("some")))
    marked = rows.join(listed, F.col(key) == F.col("listed"), "left").crossJoin(some)
    return marked.where(F.col("listed").isNotNull() | ~F.col("some")).drop("listed", "some")


def mirror_changes(current: DataFrame, target: DataFrame, key: str, authoritative: bool = True) -> DataFrame:
    """``key, action``: what to add to and remove from ``current``; nothing if the target is not authoritative."""
    c, t = current.select(key).distinct(), target.select(key).distinct()
    add, gone = t.join(c, key, "left_anti").withColumn("action", F.lit("add")), c.join(t, key, "left_anti").withColumn("action", F.lit("remove"))
    return add.unionByName(gone).where(F.lit(authoritative))


def open_pending(pending: DataFrame, submitted: DataFrame, keys: list[str]) -> DataFrame:
    """Pending rows without submission."""
    return pending.join(submitted.select(*keys).distinct(), keys, "left_anti")


def leases(log: DataFrame, now: Column, clock: DataFrame | None = None) -> DataFrame:
    """Current leases from refreshes (activity_key, status, at, ttl): the last status, the first start, unexpired at ``now``.

    ``clock``: one row with columns that ``now`` names.
    """
    ends = F.timestamp_seconds(F.unix_micros("at") / 1e6 + F.greatest(F.lit(1), F.col("ttl")))
    out = log.groupBy("activity_key").agg(F.min("at").alias("started_at"), F.max_by(F.struct("status", ends.alias("expires_at"), F.col("at").alias("updated_at")), F.struct("at", "seq")).alias("x")).select("activity_key", "started_at", "x.*")
    return (out if clock is None else out.crossJoin(clock)).where(F.col("expires_at") >= now)


def live_leases(leases: DataFrame, now: Column) -> DataFrame:
    """Leases that have not expired, latest start first, then greater id."""
    return leases.where(F.col("expires_at") >= now).orderBy(F.desc("started_at"), F.desc("id"))


def newest_rows(rows: DataFrame, where: Column, order: list[Column], limit: int) -> DataFrame:
    """A page: filter, order, limit; the order must be total."""
    return rows.where(where).orderBy(*order).limit(limit)


def beyond_newest(files: DataFrame, keep: int, order: list[Column]) -> DataFrame:
    """The rows that retention removes: all after the newest ``keep``.

    Only the ``keep`` newest are ordered (top-k); the others come from an anti-join, so no task sorts the table.
    """
    newest = files.orderBy(*order).limit(keep).select(F.col("path").alias("kept_path"))
    return files.join(newest, F.col("path") == F.col("kept_path"), "left_anti")


def submission_groups(rows: DataFrame) -> DataFrame:
    """Per evaluation id: its miners in arrival order (once each) and the first bucket.

    Rows are reduced to the first of each (id, miner) before they are gathered, so a group is as long as its miners are many.
    """
    first = rows.groupBy("evaluation_id", "miner").agg(F.min(F.struct("pos", "bucket")).alias("first"))
    items = F.array_sort(F.collect_list(F.struct(F.col("first.pos").alias("pos"), "miner")))
    return first.groupBy("evaluation_id").agg(F.transform(items, lambda x: x["miner"]).alias("miners"), F.min("first").getField("bucket").alias("bucket"))


def update_where(rows: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Rows with the values replaced where the condition holds, and ``updated`` to count them."""
    hit = F.coalesce(condition, F.lit(False))
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()} | {"updated": hit})


def expired(rows: DataFrame, now: Column) -> DataFrame:
    """Leases that a clean-up deletes."""
    return rows.where(F.col("expires_at") < now)


def snapshot_changes(history: DataFrame, ignore: list[str]) -> DataFrame:
    """Snapshots (seq, ...) that differ from the one before, hashed without the ignored columns (the time of writing).

    Only (seq, hash) are put in order, by a prefix scan; the snapshots are joined back.
    """
    used = [c for c in history.columns if c not in (*ignore, "seq")]
    hashed = history.withColumn("snapshot_hash", F.sha2(F.to_json(F.struct(*used)), 256))
    marks = last_before(hashed.select("seq", "snapshot_hash"), [F.col("seq")], F.col("snapshot_hash"), "before")
    marks = marks.withColumn("changed", F.col("before").isNull() | (F.col("before") != F.col("snapshot_hash"))).select(F.col("seq").alias("m_seq"), "changed")
    last = F.broadcast(history.agg(F.max("seq").alias("last_seq")))
    return hashed.join(marks.where("changed"), F.col("seq") == F.col("m_seq")).crossJoin(last).withColumn("is_latest", F.col("seq") == F.col("last_seq")).drop("changed", "m_seq", "last_seq")


def one_row(rows: DataFrame, key: str, value: object) -> dict | None:
    """The row whose unique key has the value; none if there is none, an error if there are several."""
    found = rows.where(F.col(key) == F.lit(value)).limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"several rows with {key} = {value!r}")
    return found[0].asDict(recursive=True) if found else None


def in_order_asked(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the wanted keys (with ``pos``, their place) in that order; keys without a row are left out."""
    return rows.join(wanted, keys).orderBy("pos")


def without_keys(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows after a delete by key."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def upsert_bulk(old: DataFrame, new: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """A table after rows (with ``pos``) are put in by key: the last of equal keys wins; a missing column is null, or its default."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in new.columns if c != key]), "pos").alias("r")).select(key, "r.*").drop("pos")
    cols = [c for c in old.columns if c != key]
    have = lambda c: F.col(c) if c in last.columns else F.lit(None)
    types = dict(old.dtypes)
    last = last.select(key, *[F.coalesce(have(c).cast(types[c]), F.lit(defaults[c])).alias(c) if c in defaults else have(c).cast(types[c]).alias(c) for c in cols])
    return without_keys(old, last, [key]).unionByName(last)


def broken_constraints(rows: DataFrame, unique: list[list[str]]) -> DataFrame:
    """``columns, n``: how many keys of each unique constraint stand more than once (nulls are no key)."""
    out = None
    for cols in unique:
        some = rows.where(" and ".join(f"`{c}` is not null" for c in cols)).groupBy(*cols).agg(F.count("*").alias("k")).where("k > 1")
        own = some.agg(F.count("*").alias("n")).select(F.lit(",".join(cols)).alias("columns"), "n")
        out = own if out is None else out.unionByName(own)
    return out


def delete_expired(rows: DataFrame, now: Column) -> DataFrame:
    """What a clean-up of leases leaves."""
    return rows.where(~(F.col("expires_at") < now))

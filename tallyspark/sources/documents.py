"""Evaluation documents and small formats: JSON scan with a recent-N prune, bucket configuration, tensors, prefixes."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.scoring import number_or_zero, score_from_json, strip
from tallyspark.sources.connectors import evaluation_documents, place_of

_RESULT = "struct<slug: string, evaluation: struct<score: string, generated_wins: boolean>>"
DOCUMENT = f"struct<participants: map<string, {_RESULT}>, miners: map<string, {_RESULT}>>"


def evaluation_id(path: Column) -> Column:
    """Everything before ``/metadata.json``; null for other names and for a file at the root."""
    return F.nullif(F.regexp_extract(path, "^(.+)/metadata\\.json$", 1), F.lit(""))


def recent_documents(spark: SparkSession, roots: str | dict[str, str], n: int) -> DataFrame:
    """``bucket, evaluation_id, content`` of the newest ``n`` ids under each root (all if n is not positive); one root is bucket ``''``.

    Names are listed and ranked without reading contents, so unreadable files use up places of the window too; then only the
    files of the window are read. Listing, ranking and reading are one scan on executors: no path passes through the driver.
    """
    return evaluation_documents(spark, {"": roots} if isinstance(roots, str) else roots, n)


def participant_rows(docs: DataFrame, keys: tuple[str, ...] = ("evaluation_id",)) -> DataFrame:
    """``keys``, ``miner, slug, score, wins``: one row per participant; an empty ``participants`` falls back to ``miners``."""
    d = docs.withColumn("d", F.from_json("content", DOCUMENT))
    people = F.when(F.coalesce(F.size("d.participants"), F.lit(0)) > 0, F.col("d.participants")).otherwise(F.col("d.miners"))
    rows = d.select(*keys, F.explode(people).alias("miner", "p"))
    score = score_from_json(F.col("p.evaluation.score"), F.col("p.evaluation.generated_wins"))
    return rows.select(*keys, "miner", F.col("p.slug").alias("slug"), score.alias("score"), (score >= 0.9).alias("wins"))


def file_listing(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """``path, modified, bytes`` of the files with a suffix; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def commits_at(commits: DataFrame, snapshot: int) -> DataFrame:
    """The commitments of one snapshot: a filter on the table's ``snapshot_block``, by which it may be partitioned."""
    return commits.where(F.col("snapshot_block") == snapshot).drop("snapshot_block")


def commits_as_of(commits: DataFrame, block: Column, clock: DataFrame | None = None) -> DataFrame:
    """The commitments of the last snapshot not after a block; ``clock``: one row with columns that ``block`` names. The snapshot is an aggregate of ``snapshot_block`` alone."""
    heights = commits.select("snapshot_block").distinct()
    heights = heights if clock is None else heights.crossJoin(clock)
    last = F.broadcast(heights.where(F.col("snapshot_block") <= block).agg(F.max("snapshot_block").alias("last_block")))
    return commits.join(last, F.col("snapshot_block") == F.col("last_block")).drop("snapshot_block", "last_block")


def is_language(language: Column, wanted: str) -> Column:
    """Trimmed, in any case."""
    return F.lower(strip(F.coalesce(language, F.lit("")))) == wanted


def playtime(c: Column) -> Column:
    """Seconds from text; 0 for what is no number."""
    return number_or_zero(strip(c))


def within(c: Column, least: float, most: float) -> Column:
    """Whether a size or duration lies in a range, ends included (null: no)."""
    return F.coalesce(c.between(least, most), F.lit(False))


def newest_age(prefixes: DataFrame, now: Column, clock: DataFrame | None = None) -> DataFrame:
    """Seconds since the greatest first path segment; null if that is no time (even if smaller ones are). ``clock``: one row with columns that ``now`` names."""
    top = prefixes.groupBy("bucket").agg(F.max("prefix").alias("newest"))
    top = top if clock is None else top.crossJoin(clock)
    return top.withColumn("age", F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp("newest", F.lit("yyyy-MM-dd_HH-mm-ss"))))


def bucket_config(text: str) -> list[dict[str, str]]:
    """Validated bucket entries from JSON: a list, or an object with ``validators``. Stays on the driver (it holds secrets)."""
    found = json.loads(text) if text.strip() else []
    entries = found.get("validators", []) if isinstance(found, dict) else found
    fields = ("hotkey", "bucket_name", "access_key", "secret_key")
    out = []
    for e in (x for x in entries if isinstance(x, dict)):
        row = {f: str(e.get(f) or "").strip() for f in fields}
        if not all(row.values()):
            raise ValueError(f"bucket entry lacks {[f for f in fields if not row[f]]}")
        out.append(row)
    for f in fields[:2]:
        if len({r[f] for r in out}) < len(out):
            raise ValueError(f"duplicate {f}")
    if not out:
        raise ValueError("no buckets")
    return out


#: Bytes of a tensor that are read at a time.
PIECE = 4 << 20
#: A header of more bytes than this is taken for a broken one.
MOST_HEADER = 256 << 20


def header_ranges(path: str) -> list[tuple[str, str | None, str | None, int, int, str | None]]:
    """``path, name, tag, start, bytes, reason`` of every tensor of a safetensors file; a file that cannot be read, or whose header is broken, is one row with a reason."""
    try:
        place, at = place_of(path)
        with place.open_input_file(at) as f:
            (n,) = struct.unpack("<Q", f.read(8))
            if n > MOST_HEADER:
                raise ValueError("header too long")
            header = json.loads(f.read(n))
            out = []
            for name, t in header.items():
                span = t.get("data_offsets") if isinstance(t, dict) else None
                if name == "__metadata__" or not isinstance(span, list) or len(span) != 2 or int(span[1]) < int(span[0]):
                    continue
                tag = f"{name}|{t.get('dtype', '')}|{tuple(t.get('shape') or [])}|"
                out.append((path, name, tag, 8 + n + int(span[0]), int(span[1]) - int(span[0]), None))
            return out
    except FileNotFoundError:
        return [(path, None, None, 0, 0, "no_file")]
    except (OSError, ValueError, AttributeError, TypeError, struct.error):
        return [(path, None, None, 0, 0, "bad_header")]


def range_hash(path: str, tag: str, start: int, size: int) -> str:
    """sha256 over a tag and a range of bytes of a file (as many as there are), a piece at a time."""
    place, at = place_of(path)
    h = hashlib.sha256(tag.encode())
    with place.open_input_file(at) as f:
        f.seek(min(start, f.size()))
        while size > 0 and (piece := f.read(min(size, PIECE))):
            h.update(piece)
            size -= len(piece)
    return h.hexdigest()


def tensor_rows(paths: DataFrame, tasks: int | None = None) -> DataFrame:
    """``path, name, hash, reason`` of every tensor: sha256 over ``name|dtype|shape|`` and its bytes.

    Headers are read first; each tensor is then a row of its own that is dealt to a task by name, so the tensors of one file are many tasks. Executors
    read byte ranges through ``pyarrow.fs``, from local paths or URIs; no bytes enter rows. A broken file is a row with a reason.
    """

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                yield pd.DataFrame(header_ranges(p), columns=["path", "name", "tag", "start", "bytes", "reason"]).astype({"start": "int64", "bytes": "int64"})

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [None if r.tag is None else range_hash(r.path, r.tag, r.start, r.bytes) for r in b.itertuples()]
            yield pd.DataFrame({"path": b["path"], "name": b["name"], "hash": found, "reason": b["reason"]})

    ranges = paths.select("path").mapInPandas(headers, "path string, name string, tag string, start long, bytes long, reason string")
    dealt = ranges.repartition(tasks, "path", "name") if tasks else ranges.repartition("path", "name")
    return dealt.mapInPandas(hashes, "path string, name string, hash string, reason string")


def scale_text(raw: Column) -> Column:
    """The text of a length-prefixed hexadecimal string: one, two or four prefix bytes, or a length of its own."""
    hexes = F.when(raw.startswith("0x"), F.substring(raw, 3, F.length(raw))).otherwise(F.hex(F.encode(raw, "ISO-8859-1")))
    first = F.conv(F.substring(hexes, 1, 2), 16, 10).cast("int")
    mode = first.bitwiseAND(3)
    skip = F.when(mode == 0, 1).when(mode == 1, 2).when(mode == 2, 4).otherwise(F.shiftright(first, 2) + 5)
    return F.trim(F.decode(F.unhex(F.substring(hexes, skip * 2 + 1, F.length(hexes))), "UTF-8"))


def weight_files(files: Column, least: int = 0) -> Column:
    """Files that hold weights, from an array of structs (name, size)."""
    return F.filter(files, lambda f: f["name"].endswith(".safetensors") & (f["size"] > least))

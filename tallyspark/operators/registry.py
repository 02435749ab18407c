"""Registry checks: latest commits, field and rule chains, blocklists, manifests, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED_FIELDS = ("model_name", "model_revision", "chute_id")


def parse_commitment(raw: Column) -> Column:
    """The commitment's fields; all null for what is no JSON object."""
    schema = "struct<" + ",".join(f"{f}: string" for f in REQUIRED_FIELDS) + ">"
    return F.from_json(F.when(F.ltrim(raw).startswith("{"), raw), schema)


def latest_commit(commits: DataFrame) -> DataFrame:
    """Per hotkey the commit at the last list position (not the highest block)."""
    return commits.groupBy("hotkey").agg(F.max_by(F.struct("pos", "block", "raw"), "pos").alias("c")).select("hotkey", "c.*")


def commits_after_lock(commits: DataFrame, valid: Column, lock: int, most: int) -> DataFrame:
    """The commit that counts per hotkey.

    With a lock: among valid commits at or after it, the last by position; more than ``most`` are a reason to reject; hotkeys with
    none are absent. Without a lock: the last commit, valid or not.
    """
    if lock <= 0:
        return latest_commit(commits).withColumn("invalid_reason", F.lit(None).cast("string"))
    kept = commits.where(valid & (F.col("block") >= lock))
    out = kept.groupBy("hotkey").agg(F.count("*").alias("n"), F.max_by(F.struct("pos", "block", "raw"), "pos").alias("c"))
    reason = F.when(F.col("n") > most, F.format_string(f"too_many_commits:%d_post_cutover_max_{most}_after_block_{lock}", F.col("n")))
    return out.select("hotkey", "c.*", reason.alias("invalid_reason"))


def missing_field(fields: dict[str, Column]) -> Column:
    """``missing_<field>`` for the first field that is null or empty; null if all are there."""
    out = F.lit(None).cast("string")
    for name, c in reversed(list(fields.items())):
        out = F.when(F.coalesce(c, F.lit("")) == "", f"missing_{name}").otherwise(out)
    return out


def is_revision(c: Column) -> Column:
    """40 lower-case hexadecimal digits, perhaps with one line feed after them."""
    return F.coalesce(c.rlike("^[0-9a-f]{40}\\n?\\z"), F.lit(False))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds (null counts as no), else null."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def mark_blocked(rows: DataFrame, blocked: DataFrame, key: str) -> DataFrame:
    """Adds ``blocked``: whether the key is on the blocklist; no row goes."""
    b = blocked.select(F.col(key).alias("blocked_key")).distinct()
    return rows.join(b, F.col(key) == F.col("blocked_key"), "left").withColumn("blocked", F.col("blocked_key").isNotNull()).drop("blocked_key")


def manifest_reason(files: Column, allowed: list[str], required: list[str]) -> Column:
    """``extra_files:..`` or ``missing_required_files:..`` (sorted, with commas), else null."""
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    extra, missing = F.array_sort(F.array_except(files, lit(allowed))), F.array_sort(F.array_except(lit(required), files))
    return F.when(F.size(extra) > 0, F.concat(F.lit("extra_files:"), F.array_join(extra, ","))).when(F.size(missing) > 0, F.concat(F.lit("missing_required_files:"), F.array_join(missing, ",")))


def url_allowed(url: Column, hosts: list[str]) -> Column:
    """http(s) and a host that is, or lies under, one of ``hosts``."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    fits = F.lit(False)
    for h in hosts:
        fits = fits | (host == h) | host.endswith(f".{h}")
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & fits, F.lit(False))


def with_owner(invalid: DataFrame, validated: DataFrame, owner: DataFrame) -> DataFrame:
    """Invalid rows, validated rows, and the owner's row if no validated row has its uid."""
    extra = owner.join(validated.select("uid"), "uid", "left_anti")
    return invalid.unionByName(validated, allowMissingColumns=True).unionByName(extra, allowMissingColumns=True)


def metagraph(hotkeys: Column, stakes: Column) -> Column:
    """Positional arrays as rows: use with ``select(F.inline(metagraph(..)))``: uid, hotkey, stake."""
    return F.transform(F.arrays_zip(hotkeys.alias("h"), stakes.alias("s")), lambda x, i: F.struct(i.alias("uid"), x["h"].alias("hotkey"), x["s"].alias("stake")))


def participant_defaults(rows: DataFrame) -> DataFrame:
    """Empty text, zero and false for what is null."""
    texts = [c for c, t in rows.dtypes if t == "string"]
    numbers = [c for c, t in rows.dtypes if t in ("int", "bigint", "double")]
    flags = [c for c, t in rows.dtypes if t == "boolean"]
    return rows.fillna("", texts).fillna(0, numbers).fillna(False, flags)


def participants_table(places: DataFrame, commits: DataFrame, blocked: DataFrame, lock: int, most: int) -> DataFrame:
    """One row per place (uid, hotkey) whose hotkey has a commit that counts: ``uid, hotkey, block, raw, is_valid, invalid_reason``.

    Blocked hotkeys come first and need any commit only; then too many commits, then the first missing field. Null ``is_valid``: to be
    validated further. Hotkeys whose commits are all before the lock are absent.
    """
    fields = parse_commitment(F.col("raw"))
    lacks = missing_field({n: fields[n] for n in REQUIRED_FIELDS})
    counted = commits_after_lock(commits, lacks.isNull(), lock, most).withColumnRenamed("invalid_reason", "too_many")
    marked = mark_blocked(places.join(commits.select("hotkey").distinct(), "hotkey", "left_semi"), blocked, "hotkey")
    out = marked.join(counted, "hotkey", "left").where(F.col("blocked") | F.col("pos").isNotNull())
    reason = F.when(F.col("blocked"), "blocked").otherwise(F.coalesce("too_many", lacks))
    shown = lambda c: F.when(~F.col("blocked"), F.col(c)).alias(c)
    return out.select("uid", "hotkey", shown("block"), shown("raw"), F.when(reason.isNotNull(), F.lit(False)).alias("is_valid"), reason.alias("invalid_reason"))


def validity_counts(rows: DataFrame) -> DataFrame:
    """``invalid_reason, n, valid``: participants per reason (up to its first colon), valid ones under no reason."""
    reason = F.when(~F.coalesce("is_valid", F.lit(False)), F.substring_index("invalid_reason", ":", 1))
    return rows.select(reason.alias("invalid_reason"), F.coalesce("is_valid", F.lit(False)).alias("valid")).groupBy("invalid_reason", "valid").agg(F.count("*").alias("n"))


def name_contains(name: Column, fallback: Column, word: str) -> Column:
    """Whether the name (else, the fallback) contains a word in any case."""
    return F.contains(F.lower(F.coalesce(F.nullif(name, F.lit("")), fallback, F.lit(""))), F.lit(word.lower()))


def weight_bytes(files: Column) -> Column:
    """Bytes of the weight files among structs (name, size) that hold any."""
    return F.aggregate(F.filter(files, lambda f: f["name"].endswith(".safetensors") & (f["size"] > 0)), F.lit(0).cast("long"), lambda a, f: a + f["size"])


def audit_chain(least_bytes: int, allowed: list[str], required: list[str]) -> dict[str, Column]:
    """The audit of a repository's files as ``audit_known``, ``audit_valid``, ``audit_reason``, ``audit_bytes`` and ``audit_hash``; the first step that decides counts.

    Columns: ``files`` (structs name, size), ``config_text``, ``config_reason``, ``source_text``, ``source_reason``, ``collision``
    (struct model, revision, ratio), ``model_hash``; and per step whether its fetch failed for now: ``files_failed``, ``config_failed``,
    ``source_failed``, ``weights_failed``. Such a step leaves the audit unknown (null), to be tried again; an earlier step's verdict stands.
    """
    size = weight_bytes(F.col("files"))
    some = F.size(F.filter("files", lambda f: f["name"].endswith(".safetensors") & (f["size"] > 0))) > 0
    clone = F.concat(F.lit("tensor_clone_of_existing:"), F.col("collision.model"), F.lit("@"), F.substring("collision.revision", 1, 12), F.lit(":ratio="), F.format_string("%.3f", F.col("collision.ratio")))
    manifest = manifest_reason(F.transform("files", lambda f: f["name"]), allowed, required)
    again = F.lit("")  # stands for a step that could not be taken
    steps = [
        (F.col("files_failed") | F.col("files").isNull(), again),
        (~some, F.lit("safetensors_missing")),
        (size < least_bytes, F.concat(F.lit("safetensors_below_min_size:"), size.cast("string"), F.lit(f"<{least_bytes}"))),
        (manifest.isNotNull(), manifest),
        (F.col("config_failed"), again),
        (F.col("config_text").isNull(), F.lit("config_missing")),
        (F.col("config_reason").isNotNull(), F.col("config_reason")),
        (F.col("source_failed"), again),
        (F.col("source_text").isNull(), F.lit("miner_py_missing")),
        (F.col("source_reason").isNotNull(), F.col("source_reason")),
        (F.col("weights_failed"), again),
        (F.col("collision").isNotNull(), clone),
        (F.col("model_hash").isNull(), F.lit("tensor_fingerprint_failed")),
    ]
    found = _first(steps)
    known = ~F.coalesce(found == "", F.lit(False))
    valid = found.isNull()
    return {"audit_known": known, "audit_valid": F.when(known, valid), "audit_reason": F.when(known, found), "audit_bytes": F.when(known, size), "audit_hash": F.when(valid, F.col("model_hash"))}


def _first(steps: list[tuple[Column, Column]]) -> Column:
    """The value of the first step whose condition holds (null counts as no), else null."""
    out = F.lit(None).cast("string")
    for holds, value in reversed(steps):
        out = F.when(F.coalesce(holds, F.lit(False)), value).otherwise(out)
    return out


def validity_chain(base: dict[str, str], word: str) -> dict[str, Column]:
    """``is_valid``, ``invalid_reason`` and ``model_hash`` of a participant: the first failure counts.

    ``base``: chute, model, revision and hash of the owner's base model; its chute is always valid, and whoever commits the same
    repository gets its hash, so that duplicates are found. Columns: chute_id, model_name, model_revision; chute_found, chute_name, chute_slug,
    hot, chute_status; code_found, wrapper_ok, wrapper_reason, wrapper_repo, wrapper_revision; and those of ``audit_chain``'s result.
    """
    own = F.coalesce(F.col("chute_id") == base["chute"], F.lit(False))
    hot = F.coalesce("hot", F.lit(False)) | (F.lower(F.coalesce("chute_status", F.lit(""))) == "hot")
    steps = [
        (~F.coalesce("chute_found", F.lit(False)), F.lit("chute_fetch_failed")),
        (~name_contains(F.col("chute_name"), F.col("chute_slug"), word), F.lit(f"chute_name_missing_{word}")),
        (~F.coalesce("code_found", F.lit(False)), F.lit("chute_code_fetch_failed")),
        (~F.coalesce("wrapper_ok", F.lit(False)), F.coalesce(F.nullif("wrapper_reason", F.lit("")), F.lit("wrapper_hash_mismatch"))),
        (~hot, F.lit("chute_not_running")),
        (~is_revision(F.col("wrapper_revision")), F.concat(F.lit("wrapper_revision_not_sha:"), F.coalesce(F.nullif("wrapper_revision", F.lit("")), F.lit("missing")))),
        (~F.col("wrapper_revision").eqNullSafe(F.col("model_revision")), F.concat(F.lit("revision_mismatch:wrapper="), F.col("wrapper_revision"))),
        (~F.col("wrapper_repo").eqNullSafe(F.col("model_name")), F.concat(F.lit("repo_mismatch:wrapper="), F.coalesce("wrapper_repo", F.lit("None")))),
        (~F.coalesce("audit_known", F.lit(False)), F.lit("repo_audit_fetch_failed")),
        (~F.coalesce("audit_valid", F.lit(False)), F.coalesce(F.nullif("audit_reason", F.lit("")), F.lit("repo_audit_failed"))),
    ]
    reason = F.when(~own, _first(steps))
    same = F.coalesce((F.col("model_name") == base["model"]) & (F.col("model_revision") == base["revision"]), F.lit(False))
    return {"is_valid": reason.isNull(), "invalid_reason": reason, "model_hash": F.when(reason.isNull(), F.when(own | same, F.lit(base["hash"])).otherwise(F.col("audit_hash")))}


def last_match(items: Column, fields: tuple[str, ...], value: Column, wanted: str) -> Column:
    """A field of the last struct of a list in which one of ``fields`` has the value."""
    hit = lambda x: F.greatest(*[F.coalesce(x[f] == value, F.lit(False)) for f in fields]) if len(fields) > 1 else F.coalesce(x[fields[0]] == value, F.lit(False))
    return F.get(F.reverse(F.filter(items, hit)), F.lit(0))[wanted]


def participants_view(participants: DataFrame, valid_only: bool) -> DataFrame:
    """Participants (with ``is_valid``), all or the valid ones, each row with ``total`` and ``valid`` counts of all; an undecided one is not valid."""
    valid = F.coalesce(F.col("is_valid"), F.lit(False))
    counts = F.broadcast(participants.agg(F.count("*").alias("total"), F.count_if(valid).alias("valid")))
    return (participants.where(valid) if valid_only else participants).crossJoin(counts)

"""More queries: documents, validation chains, replies, buckets and weights.

Inputs that the driver's tables do not hold are derived from ids by expressions that Spark and DuckDB read alike (``INPUTS``); what is
computed from them is written twice, by the operators here and by the SQL beside them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.config import DEFAULTS
from tallyspark.functions import scoring as S
from tallyspark.operators import consensus as C
from tallyspark.operators import registry as R
from tallyspark.operators import state as K
from tallyspark.operators import tables as B
from tallyspark.operators.scan import numbered
from tallyspark.plans import tables as T
from tallyspark.plans.core import EV, GLOBAL, LEAST, WINDOW_IDS, _commits, _passes, _standings, query
from tallyspark.shared import kept_table, scratch
from tallyspark.sources import documents as J

INPUTS = {
    "validity": {
        "chute_id": "CASE WHEN doc_id % 41 = 0 THEN 'base' ELSE 'c' END",
        "model_name": "'m' || CAST(doc_id % 7 AS VARCHAR(9))",
        "model_revision": "repeat(substr('abc', CAST(doc_id % 3 AS INT) + 1, 1), 40)",
        "chute_found": "doc_id % 13 <> 1",
        "chute_name": "CASE WHEN doc_id % 17 = 2 THEN NULL WHEN doc_id % 17 = 3 THEN '' WHEN doc_id % 17 = 4 THEN 'other' ELSE 'My-TALLY-x' END",
        "chute_slug": "CASE WHEN doc_id % 2 = 0 THEN 'tally-x' ELSE 'x' END",
        "hot": "doc_id % 5 <> 0",
        "chute_status": "CASE WHEN doc_id % 10 = 0 THEN 'HOT' END",
        "code_found": "doc_id % 19 <> 5",
        "wrapper_ok": "doc_id % 23 <> 6",
        "wrapper_reason": "CASE WHEN doc_id % 2 = 0 THEN 'wrapper_parse_error' ELSE '' END",
        "wrapper_revision": "CASE WHEN doc_id % 29 = 7 THEN NULL WHEN doc_id % 29 = 8 THEN 'main' WHEN doc_id % 29 = 9 THEN repeat('d', 40) ELSE repeat(substr('abc', CAST(doc_id % 3 AS INT) + 1, 1), 40) END",
        "wrapper_repo": "CASE WHEN doc_id % 31 = 10 THEN 'zz' WHEN doc_id % 31 = 11 THEN NULL ELSE 'm' || CAST(doc_id % 7 AS VARCHAR(9)) END",
        "audit_known": "doc_id % 37 <> 12",
        "audit_valid": "doc_id % 11 <> 3",
        "audit_reason": "CASE WHEN doc_id % 2 = 0 THEN 'config_missing' END",
        "audit_hash": "'h' || coalesce(lang, '')",
    },
    "audit": {
        "weights": "CASE WHEN doc_id % 7 = 1 THEN 0 ELSE coalesce(n_chars, 0) * 100 END",
        "has_extra": "doc_id % 9 = 2",
        "lacks_source": "doc_id % 10 = 3",
        "files_failed": "doc_id % 43 = 1",
        "config_failed": "doc_id % 47 = 2",
        "config_text": "CASE WHEN doc_id % 12 <> 4 THEN 'text' END",
        "config_reason": "CASE WHEN doc_id % 14 = 5 THEN 'model_name_mismatch:yaml=x' END",
        "source_failed": "doc_id % 53 = 3",
        "source_text": "CASE WHEN doc_id % 15 <> 6 THEN 'text' END",
        "source_reason": "CASE WHEN doc_id % 16 = 7 THEN 'miner_py_hash_mismatch' END",
        "weights_failed": "doc_id % 59 = 4",
        "collides": "doc_id % 18 = 8",
        "model_hash": "CASE WHEN doc_id % 20 <> 9 THEN 'h' || CAST(doc_id % 5 AS VARCHAR(9)) END",
    },
    "clips": {
        "language": "CASE WHEN doc_id % 4 = 0 THEN ' English ' WHEN doc_id % 4 = 1 THEN 'ENGLISH' WHEN doc_id % 4 = 2 THEN 'german' END",
        "time_text": "CASE WHEN doc_id % 5 = 0 THEN 'abc' WHEN doc_id % 5 = 2 THEN ' 12.5 ' WHEN doc_id % 5 > 2 THEN CAST(doc_id % 100 AS VARCHAR(9)) END",
    },
    "replies": {
        "reply": """CASE event_id % 9 WHEN 0 THEN 'Sure: ```json {"gender": "Female", "pitch": "normal", "transcription": " hi "} ``` done' WHEN 1 THEN '{"emotion": "bored", "speed": 5, "instruction": "calm"}'
 WHEN 2 THEN 'not json' WHEN 3 THEN '[1, 2]' WHEN 4 THEN '' WHEN 5 THEN '"text"' WHEN 6 THEN '{"accent": "American", "tone": null, "age_group": "Young-Adult"}' WHEN 7 THEN 'null' END""",
    },
}


def _inputs(df, name: str, *keep: str):
    return df.select(*keep, *[F.expr(e).alias(c) for c, e in INPUTS[name].items()])


def _sql(name: str) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in INPUTS[name].items())


# Documents

_DOCS = f"""{EV}, e AS (SELECT validator, evaluation_id, miner, max(score) AS s, max(l_linenumber) AS k, min(l_orderkey) AS g FROM ev GROUP BY 1, 2, 3), dm AS (SELECT *, min(g) OVER (PARTITION BY validator, evaluation_id) AS h FROM e)"""


def evaluation_documents(s, d):
    """Documents as a round writes them, with every odd form of score: one per supplier and day, some corrupt, some in the old layout."""
    e = T.evaluations(s, d).groupBy("validator", "evaluation_id", "miner").agg(F.max("score").alias("s"), F.max("l_linenumber").alias("k"), F.min("l_orderkey").alias("g"))
    score = F.when(F.col("k") % 4 == 0, F.lit("null")).when(F.col("k") % 4 == 1, F.concat(F.lit('"'), F.col("s").cast("string"), F.lit('"'))).when(F.col("k") % 4 == 2, "true").otherwise(F.col("s").cast("string"))
    slug = F.when(F.col("k") % 3 == 0, F.lit('"slug": "", ')).when(F.col("k") % 3 == 1, F.lit("")).otherwise(F.concat(F.lit('"slug": "'), F.substring("evaluation_id", 1, 7), F.lit('", ')))
    wins = F.when(F.col("s") >= 0.9, "true").otherwise("false")
    one = F.concat(F.lit('"'), F.col("miner"), F.lit('": {'), slug, F.lit('"evaluation": {"score": '), score, F.lit(', "generated_wins": '), wins, F.lit("}}"))
    docs = e.groupBy("validator", "evaluation_id").agg(F.min("g").alias("h"), F.array_join(F.array_sort(F.collect_list(one)), ", ").alias("body"))
    name = F.when(F.col("h") % 3 == 0, "miners").otherwise("participants")
    content = F.when(F.col("h") % 11 == 0, F.lit("{corrupt")).otherwise(F.concat(F.lit('{"'), name, F.lit('": {'), F.col("body"), F.lit("}}")))
    return docs.select(F.col("validator").alias("bucket"), "evaluation_id", content.alias("content"))


def valid_miners(s, d):
    return T.load(s, d, "part").select(F.col("p_brand").alias("miner")).distinct().where("miner not like '%5'")


@query("document_stats", f"""WITH {_DOCS}, n AS (SELECT validator, evaluation_id FROM (SELECT *, row_number() OVER (PARTITION BY validator ORDER BY evaluation_id DESC) AS r FROM (SELECT DISTINCT validator, evaluation_id FROM e)) WHERE r <= {WINDOW_IDS}),
x AS (SELECT dm.*, CASE k % 4 WHEN 0 THEN (CASE WHEN s >= 0.9 THEN 1.0 ELSE 0.0 END) WHEN 2 THEN 1.0 ELSE least(1.0, greatest(0.0, s)) END AS score, CASE WHEN k % 3 = 2 THEN substr(evaluation_id, 1, 7) END AS slug FROM dm JOIN n USING (validator, evaluation_id) WHERE h % 11 <> 0 AND miner NOT LIKE '%5')
SELECT validator AS bucket, miner, count(*) AS total, sum(CASE WHEN score >= 0.9 THEN 1 ELSE 0 END) AS wins, round(sum(CASE WHEN score >= 0.9 THEN 1.0 ELSE 0.0 END) / count(*), 6) AS win_rate, round(sum(score) / count(*), 6) AS mean_score, coalesce(min_by(slug, evaluation_id) FILTER (WHERE slug IS NOT NULL), 'unknown') AS slug FROM x GROUP BY 1, 2""")
def document_stats(s, d):
    out = C.document_stats(evaluation_documents(s, d), valid_miners(s, d), WINDOW_IDS)
    return out.select("bucket", "miner", "total", "wins", F.round("win_rate", 6).alias("win_rate"), F.round("mean_score", 6).alias("mean_score"), "slug")


# Validation

BASE = {"chute": "base", "model": "m1", "revision": "b" * 40, "hash": "pinned"}


@query("validity_chain", f"""WITH i AS (SELECT doc_id, {_sql("validity")} FROM documents), r AS (SELECT *, CASE WHEN chute_id = 'base' THEN NULL WHEN NOT chute_found THEN 'chute_fetch_failed' WHEN lower(coalesce(nullif(chute_name, ''), chute_slug)) NOT LIKE '%tally%' THEN 'chute_name_missing_tally'
 WHEN NOT code_found THEN 'chute_code_fetch_failed' WHEN NOT wrapper_ok THEN coalesce(nullif(wrapper_reason, ''), 'wrapper_hash_mismatch') WHEN NOT (hot OR lower(coalesce(chute_status, '')) = 'hot') THEN 'chute_not_running'
 WHEN wrapper_revision IS NULL OR NOT regexp_full_match(wrapper_revision, '[0-9a-f]{{40}}') THEN 'wrapper_revision_not_sha:' || coalesce(wrapper_revision, 'missing') WHEN wrapper_revision <> model_revision THEN 'revision_mismatch:wrapper=' || wrapper_revision
 WHEN wrapper_repo IS DISTINCT FROM model_name THEN 'repo_mismatch:wrapper=' || coalesce(wrapper_repo, 'None') WHEN NOT audit_known THEN 'repo_audit_fetch_failed' WHEN NOT audit_valid THEN coalesce(audit_reason, 'repo_audit_failed') END AS invalid_reason FROM i)
SELECT doc_id AS uid, invalid_reason IS NULL AS is_valid, invalid_reason, CASE WHEN invalid_reason IS NULL THEN (CASE WHEN chute_id = 'base' OR (model_name = 'm1' AND model_revision = repeat('b', 40)) THEN 'pinned' ELSE audit_hash END) END AS model_hash FROM r""")
def validity_chain(s, d):
    rows = _inputs(T.load(s, d, "documents"), "validity", F.col("doc_id").alias("uid"))
    return rows.select("uid", *[c.alias(n) for n, c in R.validity_chain(BASE, "tally").items()])


@query("audit_chain", f"""WITH i AS (SELECT doc_id, {_sql("audit")} FROM documents), r AS (SELECT *, CASE WHEN files_failed THEN 'again' WHEN weights = 0 THEN 'safetensors_missing' WHEN weights < 40000 THEN 'safetensors_below_min_size:' || CAST(weights AS BIGINT) || '<40000'
 WHEN has_extra THEN 'extra_files:evil.bin' WHEN lacks_source THEN 'missing_required_files:miner.py' WHEN config_failed THEN 'again' WHEN config_text IS NULL THEN 'config_missing' WHEN config_reason IS NOT NULL THEN config_reason
 WHEN source_failed THEN 'again' WHEN source_text IS NULL THEN 'miner_py_missing' WHEN source_reason IS NOT NULL THEN source_reason WHEN weights_failed THEN 'again' WHEN collides THEN 'tensor_clone_of_existing:old@' || repeat('c', 12) || ':ratio=0.972' WHEN model_hash IS NULL THEN 'tensor_fingerprint_failed' END AS reason FROM i)
SELECT doc_id AS uid, reason IS DISTINCT FROM 'again' AS audit_known, CASE WHEN reason IS DISTINCT FROM 'again' THEN reason IS NULL END AS audit_valid, nullif(reason, 'again') AS audit_reason, CASE WHEN reason IS DISTINCT FROM 'again' THEN CAST(weights AS BIGINT) END AS audit_bytes, CASE WHEN reason IS NULL THEN model_hash END AS audit_hash FROM r""")
def audit_chain(s, d):
    rows = _inputs(T.load(s, d, "documents"), "audit", F.col("doc_id").alias("uid"))
    file = lambda name, size: F.struct(F.lit(name).alias("name"), size.cast("long").alias("size"))
    files = F.array_compact(F.array(file("w.safetensors", F.col("weights")), file("config.yaml", F.lit(1)), F.when(~F.col("lacks_source"), file("miner.py", F.lit(1))), F.when(F.col("has_extra"), file("evil.bin", F.lit(1)))))
    clone = F.when(F.col("collides"), F.struct(F.lit("old").alias("model"), F.lit("c" * 40).alias("revision"), F.lit(0.9716).alias("ratio")))
    rows = rows.withColumns({"files": files, "collision": clone})
    return rows.select("uid", *[c.alias(n) for n, c in R.audit_chain(40_000, ["w.safetensors", "config.yaml", "miner.py"], ["config.yaml", "miner.py"]).items()])


_PARTICIPANTS = f"""v AS (SELECT o_custkey AS hotkey, count(*) AS n, max(o_orderkey) AS pos FROM orders WHERE o_orderstatus <> 'P' AND epoch(o_orderdate) >= 800000000 GROUP BY 1), h AS (SELECT DISTINCT o_custkey AS hotkey FROM orders),
parts AS (SELECT c_custkey - 1 AS uid, c_custkey AS hotkey, c_mktsegment = 'BUILDING' AS blocked, n, pos, CASE WHEN c_mktsegment = 'BUILDING' THEN 'blocked' WHEN n > {DEFAULTS.commits_after_lock} THEN 'too_many_commits:' || n || '_post_cutover_max_{DEFAULTS.commits_after_lock}_after_block_800000000' END AS invalid_reason
 FROM customer JOIN h ON h.hotkey = c_custkey LEFT JOIN v ON v.hotkey = c_custkey WHERE c_mktsegment = 'BUILDING' OR pos IS NOT NULL)"""


def _participants(s, d):
    c = T.load(s, d, "customer")
    places = c.select((F.col("c_custkey") - 1).alias("uid"), F.col("c_custkey").alias("hotkey"))
    return R.participants_table(places, _commits(s, d), c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("hotkey")), 800_000_000, DEFAULTS.commits_after_lock)


@query("participants_table", f"WITH {_PARTICIPANTS} SELECT uid, parts.hotkey, CASE WHEN NOT blocked THEN CAST(floor(epoch(o_orderdate)) AS BIGINT) END AS block, CASE WHEN invalid_reason IS NOT NULL THEN false END AS is_valid, invalid_reason FROM parts LEFT JOIN orders ON o_orderkey = pos")
def participants_table(s, d):
    return _participants(s, d).select("uid", "hotkey", "block", "is_valid", "invalid_reason")


@query("validity_counts", f"WITH {_PARTICIPANTS} SELECT split_part(invalid_reason, ':', 1) AS invalid_reason, invalid_reason IS NULL AS valid, count(*) AS n FROM parts GROUP BY 1, 2")
def validity_counts(s, d):
    return R.validity_counts(_participants(s, d).withColumn("is_valid", F.col("invalid_reason").isNull()))


@query("weight_bytes", "SELECT o_custkey AS hotkey, CAST(sum(CASE WHEN o_orderstatus = 'F' AND o_orderkey > 100 THEN o_orderkey - 100 ELSE 0 END) AS BIGINT) AS n_bytes FROM orders GROUP BY 1")
def weight_bytes(s, d):
    name = F.concat("o_orderpriority", F.when(F.col("o_orderstatus") == "F", ".safetensors").otherwise(".bin"))
    files = T.load(s, d, "orders").groupBy(F.col("o_custkey").alias("hotkey")).agg(F.collect_list(F.struct(name.alias("name"), (F.col("o_orderkey") - 100).alias("size"))).alias("files"))
    return files.select("hotkey", R.weight_bytes(F.col("files")).alias("n_bytes"))


@query("last_match", "SELECT o_custkey AS owner, max(CASE WHEN o_orderstatus = 'P' OR o_orderpriority = 'P' THEN o_orderkey END) AS id FROM orders GROUP BY 1")
def last_match(s, d):
    items = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"), F.col("o_orderpriority").alias("tagline"))))
    return T.load(s, d, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(items.alias("items")).select("owner", R.last_match(F.col("items"), ("name", "tagline"), F.lit("P"), "id").alias("id"))


# Replies, clips, payloads


def _accepted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _trait(name: str, path: str) -> str:
    plain = f"replace(replace(lower(trim({path})), ' ', '_'), '-', '_')"
    known = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in S.ALIASES.get(name, {}).items())
    mapped = f"CASE {plain} {known} ELSE {plain} END" if known else plain
    return f"CASE WHEN {mapped} IN ({_accepted(S.TRAITS[name])}) THEN {mapped} ELSE '{S.DEFAULT_TRAITS[name]}' END AS {name}"


_FIELD = "CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.{}') END"


@query("trait_replies", f"""WITH i AS (SELECT event_id, {_sql("replies")} FROM events), j AS (SELECT event_id, CASE WHEN reply LIKE '%```%' THEN trim(regexp_extract(reply, '```json(.*?)```', 1)) ELSE coalesce(reply, '') END AS raw FROM i)
SELECT event_id, trim(coalesce({_FIELD.format("transcription")}, '')) AS transcription, {", ".join(_trait(k, f"coalesce({_FIELD.format(k)}, '')") for k in S.TRAITS)}, trim(coalesce({_FIELD.format("instruction")}, '')) AS instruction FROM j WHERE raw NOT IN ('[1, 2]', '"text"', 'null')""")
def trait_replies(s, d):
    rows = _inputs(T.load(s, d, "events"), "replies", "event_id").withColumn("x", S.parsed_traits(F.col("reply")))
    return rows.where("not x.failed").select("event_id", "x.transcription", *[f"x.{k}" for k in S.TRAITS], "x.instruction")


@query("clip_filter", f"""WITH i AS (SELECT doc_id, n_chars, {_sql("clips")} FROM documents) SELECT doc_id, coalesce(lower(trim(language)) = 'english', false) AS is_english, coalesce(try_cast(trim(time_text) AS DOUBLE), 0.0) AS seconds, coalesce(n_chars BETWEEN 200 AND 2000, false) AS in_range FROM i""")
def clip_filter(s, d):
    rows = _inputs(T.load(s, d, "documents"), "clips", "doc_id", "n_chars")
    return rows.select("doc_id", J.is_language(F.col("language"), "english").alias("is_english"), J.playtime(F.col("time_text")).alias("seconds"), J.within(F.col("n_chars"), 200, 2000).alias("in_range"))


@query("payload_json", """SELECT event_id, '{"evaluation_id":' || event_id || CASE WHEN event_id % 3 <> 0 THEN ',"hotkey":' || user_id ELSE '' END || CASE WHEN event_id % 4 <> 1 THEN ',"wins":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END ELSE '' END || '}' AS payload FROM events""")
def payload_json(s, d):
    id_ = F.col("event_id")
    return T.load(s, d, "events").select("event_id", S.payload({"evaluation_id": id_, "hotkey": F.when(id_ % 3 != 0, F.col("user_id")), "wins": F.when(id_ % 4 != 1, id_ % 2 == 0)}).alias("payload"))


@query("kept_scores", "SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN NULL ELSE (CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN event_id % 2 <> 0 THEN 1 ELSE 0 END) END AS n, CASE WHEN event_id % 3 <> 0 THEN 0.25::DOUBLE END AS script FROM events")
def kept_scores(s, d):
    one = lambda name, c: (F.lit(name), F.struct(c.alias("score"), F.lit("why").alias("reason")))
    breakdown = F.create_map(*one("script", F.when(F.col("event_id") % 3 != 0, 0.25)), *one("pitch", F.when(F.col("event_id") % 2 != 0, 1.0)))
    kept = T.load(s, d, "events").select("event_id", S.kept_scores(breakdown).alias("m"))
    return kept.select("event_id", F.when(F.col("m").isNotNull(), F.size("m")).cast("long").alias("n"), F.element_at("m", "script").alias("script"))


@query("round_summary", f"WITH {EV} SELECT evaluation_id, count(*) AS n, sum(CASE WHEN wins THEN 1 ELSE 0 END) AS passes, round(sum(CASE WHEN l_linenumber = 3 THEN 0 ELSE score END) / count(*), 6) AS mean_score FROM ev GROUP BY 1")
def round_summary(s, d):
    rows = T.evaluations(s, d).withColumn("score", F.when(F.col("l_linenumber") != 3, F.col("score")))
    return C.round_summary(rows).select("evaluation_id", "n", F.col("passes").cast("long").alias("passes"), F.round("mean_score", 6).alias("mean_score"))


@query("with_audio", "SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL")
def with_audio(s, d):
    c = T.load(s, d, "conversations")
    key = F.concat_ws(":", "conv_id", "turn")
    return C.with_audio(c.select(key.alias("hotkey"), "conv_id", "turn"), c.select(key.alias("hotkey"), F.col("text").alias("audio")).dropDuplicates(["hotkey"]), "hotkey").select("conv_id", "turn")


@query("slot_pins", "WITH b AS (SELECT o_orderkey AS block, o_orderkey // 300 * 300 AS boundary FROM orders), l AS (SELECT *, CASE block % 3 WHEN 1 THEN boundary WHEN 2 THEN boundary - 300 END AS last FROM b) SELECT block, CASE WHEN last IS NOT NULL AND last = boundary THEN NULL WHEN block - boundary <= 50 THEN boundary WHEN last IS NULL THEN block END AS pin FROM l")
def slot_pins(s, d):
    block = F.col("block")
    boundary = F.floor(block / 300).cast("long") * 300
    last = F.when(block % 3 == 1, boundary).when(block % 3 == 2, boundary - 300)
    return T.load(s, d, "orders").select(F.col("o_orderkey").alias("block")).select("block", S.slot_pin(block, last, 300, 50).alias("pin"))


@query("displays", "SELECT event_id, format('{:.1f}%', value / 1000 * 100) AS percent, format('{:.2f}', value / 8) AS places, CAST(round_even(value / 1000 * 100, 0) AS BIGINT) AS whole FROM events WHERE value IS NOT NULL")
def displays(s, d):
    v = F.col("value")
    return T.load(s, d, "events").where("value is not null").select("event_id", S.percent(v / 1000).alias("percent"), S.two_places(v / 8).alias("places"), S.whole_percent(v / 1000).alias("whole"))


# Keyed writes


@query("bulk_upsert", "WITH o AS (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS reason FROM orders GROUP BY 1) SELECT c_custkey AS uid, CASE WHEN o_custkey IS NULL THEN c_name END AS name, reason, coalesce(o_custkey IS NULL, false) AS is_valid FROM customer LEFT JOIN o ON o_custkey = c_custkey")
def bulk_upsert(s, d):
    old = T.load(s, d, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("reason"), F.lit(True).alias("is_valid"))
    new = T.load(s, d, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("reason"))
    return K.upsert_bulk(old, new.join(old.select("uid"), "uid", "left_semi"), "uid", {"is_valid": False})


@query("broken_constraints", "SELECT 'c_custkey' AS columns, count(*) AS n FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'c_nationkey,c_mktsegment', count(*) FROM (SELECT 1 FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1)")
def broken_constraints(s, d):
    return K.broken_constraints(T.load(s, d, "customer"), [["c_custkey"], ["c_nationkey", "c_mktsegment"]])


@query("blocklist_delete", "SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def blocklist_delete(s, d):
    l = T.load(s, d, "labels")
    return K.without_keys(l.where("toxic = 1").select("doc_id"), l.where("quality = 0"), ["doc_id"])


@query("lease_cleanup", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def lease_cleanup(s, d):
    return K.delete_expired(T.load(s, d, "events").select("event_id", F.col("ts").alias("expires_at")), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id")


@query("lookup_in_order", "SELECT doc_id, quality FROM labels WHERE doc_id % 3 = 0")
def lookup_in_order(s, d):
    l = T.load(s, d, "labels").select("doc_id", "quality")
    wanted = T.load(s, d, "documents").select("doc_id", (-F.col("doc_id")).alias("pos")).where("doc_id % 3 = 0")
    return K.in_order_asked(l, wanted, ["doc_id"]).select("doc_id", "quality")


@query("newest_pending", "SELECT event_id, user_id FROM events WHERE user_id = 3 ORDER BY ts DESC, event_id DESC LIMIT 20")
def newest_pending(s, d):
    return K.newest_rows(T.load(s, d, "events"), F.col("user_id") == 3, [F.desc("ts"), F.desc("event_id")], 20).select("event_id", "user_id")


# Buckets and weights

_BUCKETS = "c AS (SELECT s_suppkey AS hotkey, CASE WHEN s_suppkey % 3 = 0 THEN 'samples-' || s_name ELSE 'own-' || s_name END AS bucket_name FROM supplier WHERE s_suppkey % 4 <> 1)"


def _configs(s, d):
    name = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "samples-").otherwise("own-"), F.col("s_name"))
    return T.load(s, d, "supplier").where("s_suppkey % 4 <> 1").select(F.col("s_suppkey").cast("string").alias("hotkey"), name.alias("bucket_name"))


@query("configured_buckets", f"WITH {_BUCKETS} SELECT CAST(s_suppkey AS VARCHAR) AS hotkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS pos, bucket_name, bucket_name IS NULL AS missing FROM supplier LEFT JOIN c ON c.hotkey = s_suppkey")
def configured_buckets(s, d):
    ranked = numbered(T.load(s, d, "supplier").select("s_suppkey", "s_acctbal"), [F.col("s_acctbal").desc(), F.col("s_suppkey").asc()], "pos")
    active = ranked.select(F.col("s_suppkey").cast("string").alias("hotkey"), F.col("pos").cast("long").alias("pos"))
    return C.configured_buckets(active, _configs(s, d)).select("hotkey", "pos", "bucket_name", "missing")


@query("bucket_labels", f"WITH {_BUCKETS} SELECT 'validator-' || s_suppkey AS hotkey, coalesce(bucket_name, '') AS bucket_name, CASE WHEN bucket_name IS NULL THEN 'validato' ELSE regexp_replace(bucket_name, '^samples-', '') END AS label FROM supplier LEFT JOIN c ON c.hotkey = s_suppkey")
def bucket_labels(s, d):
    rows = T.load(s, d, "supplier").select(F.concat(F.lit("validator-"), "s_suppkey").alias("hotkey"))
    configs = _configs(s, d).select(F.concat(F.lit("validator-"), "hotkey").alias("hotkey"), "bucket_name")
    return C.bucket_labels(rows, configs, "samples-").select("hotkey", "bucket_name", "label")


def _set_weights(s, d, active: str):
    people = T.participants(s, d)
    places = kept_table(people.select((F.col("block") - 1).alias("uid"), F.col("miner").alias("hotkey")), "places")
    return C.set_weights(places, places, C.winner(_passes(s, d)), T.stakes(s, d).where(active), LEAST, 0)


@query("set_weights", f"WITH {GLOBAL}, n AS (SELECT count(*) AS k FROM lead_) SELECT block - 1 AS uid, CASE WHEN miner = (SELECT winner FROM lead_) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM people, n WHERE k > 0 UNION ALL SELECT 0, 1.0::DOUBLE FROM n WHERE k = 0")
def set_weights(s, d):
    return _set_weights(s, d, "stake > 0")


@query("burnt_weights", f"""WITH {GLOBAL}, richest AS (SELECT max(s_acctbal) AS most FROM supplier), n AS (SELECT count(*) FILTER (WHERE s_acctbal >= most) AS active, count(*) FILTER (WHERE s_acctbal < most) AS others FROM supplier, richest),
l AS (SELECT CASE WHEN (SELECT active FROM n) >= {LEAST} THEN (SELECT winner FROM lead_) END AS leader) SELECT block - 1 AS uid, CASE WHEN miner = leader THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM people, l WHERE leader IS NOT NULL
UNION ALL SELECT (SELECT min(block) - 1 FROM people), 1.0::DOUBLE FROM l WHERE leader IS NULL""")
def burnt_weights(s, d):
    """Only validators with the greatest stake count as active, which are fewer than are needed unless stakes tie; the earliest place burns."""
    people = T.participants(s, d)
    places = kept_table(people.select((F.col("block") - 1).alias("uid"), F.col("miner").alias("hotkey")), "places")
    stakes = T.stakes(s, d)
    active = stakes.join(F.broadcast(stakes.agg(F.max("stake").alias("most"))), F.col("stake") >= F.col("most"))
    return C.set_weights(places, places, C.winner(_passes(s, d)), active, LEAST, places.agg(F.min("uid")).first()[0])


@query("report_order", f"WITH {GLOBAL} SELECT miner, row_number() OVER (ORDER BY coalesce(known_rate, -1) DESC, block, miner) AS place FROM st")
def report_order(s, d):
    return C.report_order(_standings(s, d)).select("miner", F.col("place").cast("long").alias("place"))


@query("fingerprint_upsert", """WITH t AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS name FROM documents),
r AS (SELECT doc_id, source, sum(strlen(line)) AS total_bytes, count(*) AS tensor_count, '{' || string_agg('"' || name || '":"' || sha256(line) || '"', ',' ORDER BY CAST(name AS VARCHAR)) || '}' AS tensors FROM t GROUP BY 1, 2)
SELECT CAST(doc_id AS VARCHAR) AS model, source AS revision, CAST(total_bytes AS BIGINT) AS total_bytes, CAST(tensor_count AS INT) AS tensor_count, sha256(tensors) AS tensors_hash, doc_id + CASE WHEN tensor_count > 1 THEN 1 ELSE 0 END AS commit_block FROM r""")
def fingerprint_upsert(s, d):
    """All documents' fingerprints are put in, then those of more than one line once more with a later block, and read back."""
    lines = T.load(s, d, "documents").select("doc_id", "source", F.split("text", "\n").alias("lines"))
    tensors = lines.select(F.col("doc_id").cast("string").alias("model"), F.col("source").alias("revision"), F.col("doc_id").alias("block"), F.posexplode("lines").alias("name", "line"))
    rows = kept_table(B.fingerprint_rows(tensors.select("model", "revision", "block", "name", F.sha2("line", 256).alias("hash"), F.octet_length("line").alias("bytes"))), "rows")
    table = B.fingerprint_table(s, scratch(s, "fingerprints"), 16)
    table.upsert(rows)
    table.upsert(rows.where("tensor_count > 1").withColumn("commit_block", F.col("commit_block") + 1))
    return table.read().drop("tensors")


@query("commits_as_of", "WITH c AS (SELECT o_orderkey AS hotkey, o_custkey AS raw, o_orderkey // 1000 * 1000 AS snapshot_block FROM orders), n AS (SELECT max(o_orderkey) // 2 AS now FROM orders) SELECT hotkey, raw FROM c WHERE snapshot_block = (SELECT max(snapshot_block) FROM c, n WHERE snapshot_block <= now)")
def commits_as_of(s, d):
    o = T.load(s, d, "orders")
    commits = o.select(F.col("o_orderkey").alias("hotkey"), F.col("o_custkey").alias("raw"), F.expr("o_orderkey div 1000 * 1000").alias("snapshot_block"))
    return J.commits_as_of(commits, F.col("now"), F.broadcast(o.agg(F.expr("max(o_orderkey) div 2").alias("now"))))


_PEOPLE = "WITH p AS (SELECT doc_id AS uid, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN true WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN false END AS is_valid FROM documents) SELECT *, (SELECT count(*) FROM p) AS total, (SELECT count(*) FROM p WHERE is_valid) AS valid FROM p"


def _people(s, d):
    return T.models(s, d).select("uid", (F.col("quality") == 1).alias("is_valid"))


@query("participants_all", _PEOPLE)
def participants_all(s, d):
    return R.participants_view(_people(s, d), False)


@query("participants_valid", f"{_PEOPLE} WHERE is_valid")
def participants_valid(s, d):
    return R.participants_view(_people(s, d), True)

"""From evaluations to a winner: recent windows, stake weights, global rates, margin rule, ranking.

Every function maps DataFrames to a DataFrame; ``now`` and block heights are arguments. Rows of a window are ranked per
validator, so the widest shuffle is by validator; everything after the first aggregate has a row per (validator, miner). What goes in
one order over all participants (margins, ranks, reports) is a prefix scan over ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions.scoring import file_label
from tallyspark.operators.scan import last_before, max_before, numbered
from tallyspark.sources.documents import participant_rows


def recent_rows(evals: DataFrame, n: int, tie: Column) -> DataFrame:
    """The newest ``n`` rows per validator by evaluation_id (ties by ``tie``); all rows if n is not positive."""
    if n <= 0:
        return evals
    order = Window.partitionBy("validator").orderBy(F.col("evaluation_id").desc(), tie)
    return evals.withColumn("row_rank", F.row_number().over(order)).where(F.col("row_rank") <= n).drop("row_rank")


def recent_ids(evals: DataFrame, n: int, by: Column | None = None, key: str = "validator") -> DataFrame:
    """Rows of the newest ``n`` distinct evaluation ids per validator (all rows if n is not positive).

    ``by``: what tells ids apart and puts them in order, if not the id itself: the time that the id writes out, say, so that no text is made of rows that go.

    A filter on a rank: Spark drops what is beyond the newest ``n`` ids of a task's own rows before the shuffle, so a validator of
    any size sends a short list.
    """
    if n <= 0:
        return evals
    order = Window.partitionBy(key).orderBy((F.col("evaluation_id") if by is None else by).desc())
    return evals.withColumn("id_rank", F.dense_rank().over(order)).where(F.col("id_rank") <= n).drop("id_rank")


def miner_stats(evals: DataFrame, *keys: str) -> DataFrame:
    """total, wins, win_rate and mean_score per key."""
    out = evals.groupBy(*keys).agg(F.count("*").alias("total"), F.sum(F.col("wins").cast("long")).alias("wins"), F.sum("score").alias("score_sum"))
    return out.withColumn("win_rate", F.col("wins") / F.col("total")).withColumn("mean_score", F.col("score_sum") / F.col("total"))


def stake_weights(stakes: DataFrame, exponent: float) -> DataFrame:
    """``validator, stake, weight``: max(0, stake) ** exponent, or 1 for all if no weight is positive."""
    raw = stakes.withColumn("weight", F.pow(F.greatest(F.coalesce(F.col("stake"), F.lit(0.0)), F.lit(0.0)), F.lit(float(exponent))))
    best = F.broadcast(raw.agg(F.max("weight").alias("best_weight")))
    return raw.crossJoin(best).withColumn("weight", F.when(F.col("best_weight") > 0, F.col("weight")).otherwise(F.lit(1.0))).drop("best_weight")


#: A fraction is summed in so many parts of 32 bits; what lies below 2 ** -128 is cut off.
PARTS, STEP = 4, float(1 << 32)


def exact_sum(value: Column) -> Column:
    """A sum of finite doubles whose bits do not depend on the order of rows: a partial aggregate, of which nothing is gathered.

    Each value is cut into its whole part and parts of 32 bits, without rounding (a product with a power of two and the difference to the part below are
    exact). Parts are whole numbers and add up exactly as decimals, in any order; the sums are folded once, from the least.
    """
    part, rest = F.floor(value), value
    parts = [part]
    for _ in range(PARTS):
        rest = (rest - part.cast("double")) * STEP
        part = F.floor(rest)
        parts.append(part)
    total = F.lit(0.0)
    for p in reversed(parts[1:]):
        total = (total + F.sum(p.cast("decimal(20,0)")).cast("double")) / STEP
    return total + F.sum(parts[0].cast("decimal(20,0)")).cast("double")


def global_scores(stats: DataFrame, weights: DataFrame, compete_above: int, least_per_validator: int = 1) -> DataFrame:
    """Stake-weighted rates per miner from ``validator, miner, total, wins`` and ``validator, weight``; sums do not depend on partitions, only the lists of validators are gathered."""
    w = weights.select(F.col("validator").alias("w_validator"), "weight")
    rows = stats.where(F.col("total") >= least_per_validator).join(w, F.col("validator") == F.col("w_validator"), "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    rows = rows.where(F.col("weight") > 0).withColumn("rate", F.col("wins") / F.col("total"))
    v = F.col("validator")
    out = rows.groupBy("miner").agg(
        exact_sum(F.col("weight") * F.col("rate")).alias("weighted_sum"),
        exact_sum(F.col("weight")).alias("weight_sum"),
        F.sum("total").alias("total"),
        F.sum("wins").alias("wins"),
        F.count("*").alias("validator_count"),
        F.count_if(F.col("total") > compete_above).alias("eligible_validator_count"),
        exact_sum(F.col("weight") * F.col("total")).alias("weighted_evals"),
        F.array_sort(F.collect_list(v)).alias("validators"),
        F.array_sort(F.collect_list(F.when(F.col("total") > compete_above, v))).alias("eligible_validators"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(v, F.struct("wins", "total", "rate", "weight"))))).alias("per_validator_stats"),
    )
    out = out.withColumn("win_rate", F.when(F.col("weight_sum") > 0, F.col("weighted_sum") / F.col("weight_sum")).otherwise(0.0))
    return out.withColumn("raw_win_rate", F.when(F.col("total") > 0, F.col("wins") / F.col("total")).otherwise(0.0))


def standings(participants: DataFrame, scores: DataFrame, least_validators: int, owner: Column | None = None) -> DataFrame:
    """Participants (miner, block) with their scores, zero where there are none, and whether they are eligible."""
    s = scores.withColumnRenamed("miner", "s_miner")
    out = participants.join(s, F.col("miner") == F.col("s_miner"), "left").drop("s_miner")
    out = out.withColumn("known_rate", F.col("win_rate")).fillna({"win_rate": 0.0, "raw_win_rate": 0.0, "weighted_evals": 0.0, "total": 0, "wins": 0, "eligible_validator_count": 0, "validator_count": 0})
    eligible = (F.col("total") > 0) & (F.col("eligible_validator_count") >= least_validators)
    return out.withColumn("is_owner", owner if owner is not None else F.lit(False)).withColumn("eligible", eligible)


def _is_prior() -> Column:
    return (F.col("total") > 0) & (F.col("is_owner") | F.col("eligible"))


def margin_passes(standing: DataFrame, margin: float) -> DataFrame:
    """Adds ``prior_best`` and ``passed``: whether a candidate beats every strictly earlier prior by the margin.

    Beating all is beating the best, so the greatest rate at earlier blocks, a prefix scan, replaces the pairwise comparison.
    """
    out = max_before(standing, F.col("block"), F.when(_is_prior(), F.col("win_rate")), "prior_best")
    return out.withColumn("passed", F.col("eligible") & (F.col("prior_best").isNull() | (F.col("win_rate") >= F.col("prior_best") + margin)))


def first_failures(standing: DataFrame, margin: float) -> DataFrame:
    """``f_miner, prior_miner, prior_block``: for each candidate that fails, the first prior (by block, name) that it does not beat.

    That prior sets a record among the priors before it. Records rise with their place, so the first that a candidate does not beat is the
    least one above its rate: candidates and records (at their rate plus the margin) are put in one order of rates, and a scan from the
    top gives each candidate the record next above it, which counts if its block is earlier.
    """
    p = standing.where(_is_prior()).select(F.col("block").cast("long").alias("b"), F.col("miner").alias("m"), F.col("win_rate").alias("r"))
    # Of a block's priors the first by name that exceeds all before it in the block is a record too: names are places within a block.
    named = numbered(p, [F.col("b"), F.col("m")], "place")
    records = max_before(named, F.col("place"), F.col("r"), "best").where("best is null or r > best")
    marks = records.select((F.col("r") + margin).alias("rate"), F.lit(1).alias("kind"), F.col("m").alias("name"), F.struct("b", "m").alias("mark"), F.lit(None).cast("long").alias("block"))
    asking = standing.where("eligible").select(F.col("win_rate").alias("rate"), F.lit(0).alias("kind"), F.col("miner").alias("name"), F.lit(None).cast("struct<b: bigint, m: string>").alias("mark"), F.col("block").cast("long").alias("block"))
    found = last_before(marks.unionByName(asking), [-F.col("rate"), F.col("kind"), F.col("name")], F.col("mark"), "next")
    return found.where("kind = 0 and next.b < block").select(F.col("name").alias("f_miner"), F.col("next.m").alias("prior_miner"), F.col("next.b").alias("prior_block"))


def margin_checks(standing: DataFrame, margin: float) -> DataFrame:
    """One row per recorded comparison (miner, prior_miner, needed, passed), in block order up to the first failure.

    A report: a candidate that beats all is listed with all earlier ones, so it is as long as these pairs are many; the others
    are paired only up to their first failure. ``margin_passes`` decides.
    """
    lost = first_failures(standing, margin).withColumnRenamed("prior_miner", "lost_to").withColumnRenamed("prior_block", "lost_block")
    c = standing.where("eligible").select("miner", "block", "win_rate").join(lost, F.col("miner") == F.col("f_miner"), "left")
    p = standing.where(_is_prior()).select(F.col("miner").alias("prior_miner"), F.col("block").alias("prior_block"), F.col("win_rate").alias("prior_rate"))
    upto = F.col("lost_to").isNull() | (F.struct(F.col("prior_block").cast("long"), F.col("prior_miner")) <= F.struct("lost_block", "lost_to"))
    pairs = c.join(p, (F.col("prior_block") < F.col("block")) & upto).withColumn("needed", F.col("prior_rate") + margin)
    return pairs.withColumn("passed", F.col("win_rate") >= F.col("needed")).drop("f_miner", "lost_to", "lost_block")


def winner(passes: DataFrame) -> DataFrame:
    """The candidate with the best rate, eligible validators, weighted evaluations, earliest block, then larger name."""
    key = F.struct("win_rate", "eligible_validator_count", "weighted_evals", (-F.col("block")).alias("age"), "miner")
    return passes.where("passed").agg(F.max_by("miner", key).alias("winner"), F.max("win_rate").alias("win_rate"))


def ranking(standing: DataFrame) -> DataFrame:
    """Adds ``rank``: rate (none: below zero), eligible validators, weighted evaluations, then earlier block and smaller name."""
    order = [F.coalesce("known_rate", F.lit(-1.0)).desc(), F.col("eligible_validator_count").desc(), F.col("weighted_evals").desc(), F.col("block").asc(), F.col("miner").asc()]
    return numbered(standing, order, "rank")


def status_reasons(passes: DataFrame, failures: DataFrame, leader: DataFrame, compete_above: int, least_validators: int) -> DataFrame:
    """Adds ``reason``; ``failures``: first failed check per miner (f_miner, prior_miner)."""
    out = passes.join(failures, F.col("miner") == F.col("f_miner"), "left").crossJoin(F.broadcast(leader.select(F.col("winner").alias("leader"))))
    few = F.lit(f"Needs more than {compete_above} evaluations in at least {least_validators} validators")
    lost = F.when(F.col("prior_miner").isNotNull(), F.concat(F.lit("Did not clear threshold vs "), F.substring("prior_miner", 1, 8))).otherwise("Eligible but did not clear threshold checks")
    reason = F.when(F.col("total") == 0, "No usable samples").when(F.col("eligible_validator_count") < least_validators, few).when(~F.col("passed"), lost).when(F.col("miner") == F.col("leader"), "Winner").otherwise("Eligible")
    return out.withColumn("reason", reason)


def weight_vector(participants: DataFrame, leader: DataFrame, burn: str) -> DataFrame:
    """1 for the winner (the burn entry if there is none), 0 for the others."""
    one = F.broadcast(leader.select(F.coalesce("winner", F.lit(burn)).alias("leader")))
    return participants.crossJoin(one).select("miner", F.when(F.col("miner") == F.col("leader"), 1.0).otherwise(0.0).alias("weight"))


def bucket_activity(buckets: DataFrame, now: Column, window_seconds: float, least_stake: float) -> DataFrame:
    """Adds ``status`` to (validator, stake, newest): the first reason that applies, else active. ``newest`` is text yyyy-MM-dd_HH-mm-ss."""
    newest = F.try_to_timestamp(F.col("newest"), F.lit("yyyy-MM-dd_HH-mm-ss"))
    age = F.unix_timestamp(now) - F.unix_timestamp(newest)
    status = F.when(F.col("stake").isNull(), "not_on_metagraph").when(F.col("stake") < least_stake, "stake_below_floor").when(age.isNull(), "no_evals").when(age > window_seconds, "stale").otherwise("active")
    return buckets.withColumn("status", status)


def active_since(evals: DataFrame, at: str, cutoff: Column, clock: DataFrame | None = None) -> DataFrame:
    """Validators whose newest evaluation is not older than the cutoff; ``clock``: one row with columns that the cutoff names."""
    out = evals.where("validator is not null and validator <> ''").groupBy("validator").agg(F.max(at).alias("last_seen"))
    return (out if clock is None else out.crossJoin(clock)).where(F.col("last_seen") >= cutoff).select("validator", "last_seen")


def snapshot(ranked: DataFrame, checks: DataFrame, per_validator: DataFrame) -> DataFrame:
    """One nested row per miner: its checks and per-validator figures as ordered arrays, with a hash of the row."""
    c = checks.groupBy(F.col("miner").alias("c_miner")).agg(F.array_sort(F.collect_list(F.struct("prior_block", "prior_miner", "needed", "passed"))).alias("threshold_checks"))
    v = per_validator.groupBy(F.col("miner").alias("v_miner")).agg(F.array_sort(F.collect_list(F.struct("validator", "total", "wins"))).alias("per_validator"))
    out = ranked.join(c, F.col("miner") == F.col("c_miner"), "left").join(v, F.col("miner") == F.col("v_miner"), "left").drop("c_miner", "v_miner")
    return out.withColumn("snapshot_hash", F.sha2(F.to_json(F.struct(*out.columns)), 256))


def document_stats(docs: DataFrame, valid: DataFrame, n: int) -> DataFrame:
    """Per bucket and valid miner: total, wins, win_rate, mean_score and slug, over the newest ``n`` documents of each bucket (all if n is not positive).

    ``docs``: bucket, evaluation_id, content. Names are ranked before contents are parsed, so unreadable documents use up places of the
    window. Unknown miners go before anything is summed. The slug is the oldest one in the window that is not empty, else ``unknown``.
    """
    docs = recent_ids(docs, n, key="bucket")  # one pass; a task sends its own newest documents only
    rows = participant_rows(docs, ("bucket", "evaluation_id")).join(valid.select("miner").distinct(), "miner", "left_semi")
    named = F.coalesce(F.col("slug"), F.lit("")) != ""
    out = rows.groupBy("bucket", "miner").agg(
        F.count("*").alias("total"),
        F.sum(F.col("wins").cast("long")).alias("wins"),
        F.sum("score").alias("score_sum"),
        F.coalesce(F.min_by(F.when(named, F.col("slug")), F.when(named, F.col("evaluation_id"))), F.lit("unknown")).alias("slug"),
    )
    return out.withColumn("win_rate", F.col("wins") / F.col("total")).withColumn("mean_score", F.col("score_sum") / F.col("total"))


def configured_buckets(active: DataFrame, configs: DataFrame) -> DataFrame:
    """Active hotkeys (hotkey, pos) in their order, with the bucket of their configuration; ``missing`` marks those without."""
    return active.join(configs, "hotkey", "left").withColumn("missing", F.col("bucket_name").isNull()).orderBy("pos")


def bucket_labels(rows: DataFrame, configs: DataFrame, prefix: str) -> DataFrame:
    """Adds ``bucket_name`` (empty if there is none) and ``label``: the bucket without its prefix, else the first eight characters of the hotkey."""
    out = rows.join(configs.select("hotkey", "bucket_name"), "hotkey", "left").withColumn("bucket_name", F.coalesce("bucket_name", F.lit("")))
    return out.withColumn("label", file_label(F.coalesce(F.nullif("bucket_name", F.lit("")), F.substring("hotkey", 1, 8)), prefix))


def set_weights(places: DataFrame, participants: DataFrame, leader: DataFrame, active: DataFrame, least_active: int, burn_uid: int) -> DataFrame:
    """``uid, weight`` to set: 1 for the leader and 0 for the other participants, in the order of places (uid, hotkey).

    With fewer than ``least_active`` active buckets, or without a leader, all weight goes to the burn place.
    """
    enough = active.agg((F.count("*") >= least_active).alias("enough"))
    one = F.broadcast(leader.select("winner").crossJoin(enough).select(F.when(F.col("enough"), F.col("winner")).alias("leader")))
    rows = places.join(participants.select("hotkey").distinct(), "hotkey", "left_semi").crossJoin(one).where("leader is not null")
    rows = rows.select("uid", F.when(F.col("hotkey") == F.col("leader"), 1.0).otherwise(0.0).alias("weight"))
    burnt = one.where("leader is null").select(F.lit(burn_uid).cast(places.schema["uid"].dataType).alias("uid"), F.lit(1.0).alias("weight"))
    return rows.unionByName(burnt).orderBy("uid")


def report_order(standing: DataFrame) -> DataFrame:
    """Adds ``place`` for the decision's report: rate (none: below zero), block, name."""
    return numbered(standing, [F.coalesce("known_rate", F.lit(-1.0)).desc(), F.col("block").asc(), F.col("miner").asc()], "place")


def round_summary(results: DataFrame) -> DataFrame:
    """Per evaluation id: participants, passes and the mean score (missing scores count as 0)."""
    return results.groupBy("evaluation_id").agg(F.count("*").alias("n"), F.count_if("wins").alias("passes"), (F.sum(F.coalesce("score", F.lit(0.0))) / F.count("*")).alias("mean_score"))


def with_audio(participants: DataFrame, audio: DataFrame, key: str) -> DataFrame:
    """Participants whose generation gave audio."""
    return participants.join(audio.where("audio is not null"), key)

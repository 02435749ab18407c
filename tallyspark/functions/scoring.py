"""Trait normalisation, word error rate and weighted element scores, as Column expressions."""

from __future__ import annotations

import decimal
import json
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The closed trait enums, their defaults and aliases, and the raw element weights.
TRAITS = {
    "gender": ["male", "female", "neutral"],
    "pitch": ["low", "mid", "high"],
    "speed": ["slow", "normal", "fast"],
    "age_group": ["child", "young_adult", "adult", "senior"],
    "emotion": ["neutral", "happy", "sad", "angry", "calm", "excited", "serious", "fearful"],
    "tone": ["warm", "cold", "friendly", "formal", "casual", "authoritative"],
    "accent": ["us", "uk", "au", "in", "neutral", "other"],
}
DEFAULT_TRAITS = {"gender": "neutral", "pitch": "mid", "speed": "normal", "age_group": "adult", "emotion": "neutral", "tone": "casual", "accent": "neutral"}
ALIASES = {
    "gender": {"unknown": "neutral", "nonbinary": "neutral", "non_binary": "neutral"},
    "pitch": {"normal": "mid", "medium": "mid"},
    "speed": {"medium": "normal"},
    "age_group": {"teenager": "young_adult", "twenties": "young_adult", "thirties": "adult", "forties": "adult", "fifties": "adult", "sixties": "senior", "seventies": "senior", "eighties": "senior", "nineties": "senior", "unknown": "adult"},
    "emotion": {"bored": "neutral"},
    "tone": {"neutral": "casual"},
    "accent": {"american": "us", "british": "uk", "australian": "au", "indian": "in", "english": "uk", "unknown": "neutral"},
}
ORDINAL = ("pitch", "speed", "age_group")
RAW_WEIGHTS = {"script": 0.30, "naturalness": 0.15, "gender": 0.10, "speed": 0.10, "emotion": 0.10, "age_group": 0.10, "pitch": 0.05, "accent": 0.05, "tone": 0.05}


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"^[\s\u001c-\u001f\u0085\p{Z}]+|[\s\u001c-\u001f\u0085\p{Z}]+$", "")


def coerce_enum(value: Column, allowed: list[str], default: str, aliases: dict[str, str] | None = None) -> Column:
    """Lower case, blanks and hyphens to underscores, aliases, then the default for what is not allowed (null included)."""
    plain = F.translate(F.lower(strip(value)), " -", "__")
    if aliases:
        table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        plain = F.coalesce(F.element_at(table, F.coalesce(plain, F.lit(""))), plain)
    return F.when(F.coalesce(F.array_contains(strings(allowed), plain), F.lit(False)), plain).otherwise(F.lit(default))


def normalize_trait(name: str, value: Column) -> Column:
    """One trait coerced to its enum."""
    return coerce_enum(value, TRAITS[name], DEFAULT_TRAITS[name], ALIASES.get(name))


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def distance(a: Sequence[str], b: Sequence[str]) -> int:
    """Levenshtein distance, a column of the table at a time as bits of one number (Myers 1999): exact for any length and any words."""
    if not len(a):
        return len(b)
    full, last, places = (1 << len(a)) - 1, 1 << (len(a) - 1), {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    up, down, score = full, 0, len(a)
    for w in b:
        same = places.get(w, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(across | up)), up & across
        score += bool(more & last) - bool(less & last)
        more, less, same = more << 1 | 1, less << 1, same | down
        up, down = (less | ~(same | more)) & full, more & same & full
    return score


@F.pandas_udf(T.LongType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Levenshtein distance of two arrays of words."""
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Distance over reference length, at most 1; an empty reference gives 1 if the hypothesis has words, else 0."""
    n = F.size(reference)
    return F.when(n == 0, F.when(F.size(hypothesis) > 0, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), word_distance(reference, hypothesis) / F.greatest(n, F.lit(1))))


def ordinal_score(expected: Column, actual: Column, scale: list[str]) -> Column:
    """1 for the same place of the scale, 0.5 for neighbours, else 0; unknown values score 0."""
    a, b = F.array_position(strings(scale), expected), F.array_position(strings(scale), actual)
    known = (F.coalesce(a, F.lit(0)) > 0) & (F.coalesce(b, F.lit(0)) > 0)
    return F.when(~known, 0.0).when(a == b, 1.0).when(F.abs(a - b) == 1, 0.5).otherwise(0.0)


def element_score(name: str, expected: Column, actual: Column) -> Column:
    """Score of one trait: ordinal or equality."""
    if name in ORDINAL:
        return ordinal_score(expected, actual, TRAITS[name])
    return F.when(expected == actual, 1.0).otherwise(0.0)


def weighted_score(scores: dict[str, Column]) -> Column:
    """Mean of the elements that are not null, weighted, in the order of the weights."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    total = sum(RAW_WEIGHTS.values())
    for name, raw in RAW_WEIGHTS.items():
        if name in scores:
            w = raw / total
            top = top + F.coalesce(scores[name] * w, F.lit(0.0))
            bottom = bottom + F.when(scores[name].isNotNull(), w).otherwise(0.0)
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def least_rounding_to(limit: float, places: int = 4) -> float:
    """The least number that rounds to ``limit`` or more at so many places (exact binary value, half to even)."""
    low, high = limit - 10.0**-places, limit
    while math.nextafter(low, high) < high:
        middle = (low + high) / 2
        low, high = (low, middle) if round(middle, places) >= limit else (middle, high)
    return high


def weak_elements(scores: dict[str, Column], below: float = 0.5) -> Column:
    """Names of elements whose score, rounded to four places, is below the limit, in order, with commas between.

    Rounding is monotone, so one comparison with the least number that rounds up to the limit does it.
    """
    least = least_rounding_to(below)
    return F.array_join(F.array_compact(F.array(*[F.when(scores[n] < least, n) for n in RAW_WEIGHTS if n in scores])), ",")


def score_from_json(raw: Column, flag: Column) -> Column:
    """Effective score of a raw JSON value as text.

    Null takes the flag (1 or 0); numbers, numeric strings and booleans are clamped to 0..1; NaN counts as 1; others as 0.
    """
    text = F.lower(F.trim(raw))
    number = F.when(text == "true", 1.0).when(text == "false", 0.0).when(text.isin("nan", '"nan"'), F.lit(float("nan"))).otherwise(F.regexp_replace(text, '^"|"$', "").try_cast("double"))
    return F.when(raw.isNull(), F.when(F.coalesce(flag, F.lit(False)), 1.0).otherwise(0.0)).when(number.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def numeric_map(raw: Column) -> Column:
    """A JSON object as a map of its numbers (booleans count as 1 and 0; strings and others are dropped); null for what is no object."""
    parsed = F.try_parse_json(raw)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    values = F.from_json(F.when(is_object, raw), "map<string,string>")
    kept = F.map_filter(F.transform_values(values, lambda k, v: F.when(v == "true", 1.0).when(v == "false", 0.0).otherwise(v.try_cast("double"))), lambda k, v: v.isNotNull())
    texts = F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r'"((?:[^"\\]|\\.)*)"\s*:\s*"'), F.lit(1))
    return F.map_filter(kept, lambda k, v: ~F.array_contains(texts, k))


def prompt_text(transcription: Column, instruction: Column, traits: dict[str, Column]) -> Column:
    """``transcription | instruction``; without instruction the traits as ``name: value``; empty parts are left out."""
    empty = lambda c: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))
    fallback = F.concat_ws(" | ", *[F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{k}: "), c)) for k, c in traits.items()])
    return F.concat_ws(" | ", empty(transcription), F.coalesce(empty(instruction), F.nullif(fallback, F.lit(""))))


def prompt_parts(prompt: Column) -> tuple[Column, Column]:
    """The text to speak and the instruction of a prompt."""
    p = strip(F.coalesce(prompt, F.lit("")))
    p = F.when(p == "", "Hello.").otherwise(p)
    at = F.instr(p, " | ")
    head, rest = strip(F.substring(p, 1, at - 1)), strip(F.substring(p, at + 3, F.length(p)))
    odd = (head == "") | F.contains(head, F.lit(":"))
    text = F.when(at == 0, p).when(odd, "Hello.").otherwise(head)
    return text, F.when(at == 0, "Neutral tone.").when(odd, p).when(rest == "", "Neutral tone.").otherwise(rest)


def trait_object(response: Column) -> Column:
    """The JSON text of a reply: the first fenced part that, after an optional ``json``, starts with a brace; else the reply."""
    t = strip(F.coalesce(response, F.lit("")))
    parts = F.transform(F.split(t, "```"), lambda x: strip(F.regexp_replace(strip(x), "^json", "")))
    fenced = F.get(F.filter(parts, lambda x: x.startswith("{")), F.lit(0))
    return F.when(F.contains(t, F.lit("```")), F.coalesce(fenced, t)).otherwise(t)


def parsed_traits(response: Column) -> Column:
    """A reply as a struct: transcription, the traits as enums, instruction; ``failed`` where the reply is JSON but no object.

    What is no JSON gives the defaults. The caller drops failed rows (``where("not x.failed")``).
    """
    raw = trait_object(response)
    kind = F.schema_of_variant(F.try_parse_json(raw))
    found = F.from_json(F.when(kind.startswith("OBJECT"), raw), "map<string,string>")
    text = lambda k: strip(F.coalesce(F.element_at(found, k), F.lit("")))
    traits = [normalize_trait(k, F.element_at(found, k)).alias(k) for k in TRAITS]
    failed = F.coalesce(~kind.startswith("OBJECT"), F.lit(False))
    return F.struct(text("transcription").alias("transcription"), *traits, text("instruction").alias("instruction"), failed.alias("failed"))


# The strict shape of an audio description, with its defaults.
AUDIO_QUALITY = {"clarity": "slightly noisy", "noise_type": "background", "speaker_count": "single"}
VOICE_TRAITS = {"pitch": "medium", "speaking_rate": "medium", "energy": "medium", "gender": "unknown", "age_group": "unknown", "emotion": "neutral", "accent": "unknown", "tone_style": "neutral"}
TIMBRE, MOST_TIMBRES = ["clear"], 4


def strict_shape(response: Column) -> Column:
    """A description of audio as a struct of all fields: texts of the right type over the defaults, confidences within 0..1, at most four timbres.

    Null and empty replies give the defaults; what is no JSON object gives null.
    """
    v = F.try_parse_json(trait_object(response))
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(""))
    text = lambda path, default: F.when(kind(path) == "STRING", F.try_variant_get(v, path, "string")).otherwise(F.lit(default))
    sure = lambda path: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_variant_get(v, path, "double"), F.lit(0.0))))
    quality = [*[text(f"$.audio_quality.{k}", d).alias(k) for k, d in AUDIO_QUALITY.items()], sure("$.audio_quality.confidence").alias("confidence")]
    traits = [x for k, d in VOICE_TRAITS.items() for x in (text(f"$.voice_traits.{k}", d).alias(k), sure(f"$.voice_traits.{k}_confidence").alias(f"{k}_confidence"))]
    several = F.transform(F.filter(F.coalesce(F.try_variant_get(v, "$.voice_traits.timbre", "array<variant>"), F.array()), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    one = F.try_variant_get(v, "$.voice_traits.timbre", "string")
    timbre = F.when(kind("$.voice_traits.timbre") == "STRING", F.array(one)).when(F.size(several) > 0, F.slice(several, 1, MOST_TIMBRES)).otherwise(strings(TIMBRE))
    full = F.struct(text("$.transcript", "").alias("transcript"), F.struct(*quality).alias("audio_quality"), F.struct(*traits, timbre.alias("timbre"), sure("$.voice_traits.timbre_confidence").alias("timbre_confidence")).alias("voice_traits"))
    empty = F.coalesce(response, F.lit("")) == ""
    return F.when(empty | F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), full)


def kept_scores(breakdown: Column) -> Column:
    """A map of element to (score, ...) as a map of the scores that are there; null if there are none."""
    kept = F.map_filter(F.transform_values(breakdown, lambda k, v: v["score"].cast("double")), lambda k, v: v.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def payload(fields: dict[str, Column]) -> Column:
    """JSON of the fields that are not null."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "true"})


def judge_verdict(reply: Column, own_position: Column) -> Column:
    """Whether the judge preferred the entry: FIRST in the first line means first, anything else second."""
    first = F.contains(F.upper(F.get(F.split(strip(F.coalesce(reply, F.lit(""))), "\n"), F.lit(0))), F.lit("FIRST"))
    return F.when(first, F.lit("first")).otherwise(F.lit("second")) == own_position


def slot_pin(block: Column, last_boundary: Column, length: int, most_lag: int) -> Column:
    """The block at which a slot's work is pinned, once a boundary: the boundary while it is recent, the block itself on a first start, else null."""
    boundary = F.floor(block / length).cast("long") * length
    pin = F.when(block - boundary <= most_lag, boundary).when(last_boundary.isNull(), block)
    return F.when(last_boundary.isNull() | (boundary != last_boundary), pin)


def cycle_slot(block: Column, length: int, offset: int, tolerance: int) -> dict[str, Column]:
    """The start of a block's cycle, the distance to it, and whether the block is within the tolerance."""
    start = F.floor((block - offset) / length).cast("long") * length + offset
    return {"slot_start": start, "slot_distance": block - start, "in_slot": (block - start) <= tolerance}


def file_label(name: Column, prefix: str) -> Column:
    """A bucket's name without its prefix."""
    return F.regexp_replace(name, f"^{prefix}", "")


@F.pandas_udf(T.StringType())
def percent(x: pd.Series) -> pd.Series:
    """One decimal and a per cent sign, half to even on the exact value (Spark's own format rounds half up)."""
    return x.map(lambda v: None if pd.isna(v) else f"{float(v):.1%}")


@F.pandas_udf(T.StringType())
def two_places(x: pd.Series) -> pd.Series:
    """Two decimals, half to even on the exact value."""
    return x.map(lambda v: None if pd.isna(v) else f"{float(v):.2f}")


@F.pandas_udf(T.LongType())
def whole_percent(x: pd.Series) -> pd.Series:
    """A share as a whole number of hundredths, half to even."""
    return pd.Series([None if pd.isna(v) else round(float(v) * 100) for v in x], dtype="Int64")


def number_or_zero(c: Column) -> Column:
    """A number from text; 0 for what is none."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def exact_round4(x: pd.Series) -> pd.Series:
    """Four decimals by the exact binary value, half to even; Spark's own rounding works on the shortest decimal."""
    return x.map(lambda v: None if pd.isna(v) else round(float(v), 4))


@F.pandas_udf(T.StringType())
def canonical_json(x: pd.Series) -> pd.Series:
    """JSON with sorted keys and no blanks; null for what is no JSON."""

    def one(v: str | None) -> str | None:
        try:
            return None if v is None else json.dumps(json.loads(v, parse_float=decimal.Decimal), sort_keys=True, separators=(",", ":"), default=str)
        except ValueError:
            return None

    return x.map(one)

"""Quality rules with thresholds that follow the data: mergeable quantile sketches per language and source.

Each rule compares one ratio of a text (``RATIOS``, whole numbers) with a fence on either side, derived from the quartiles of that
ratio among the documents of the same language and source: ``REACH`` times the spread below the lower quartile and above the
upper one. The quantile sketch of a group is its count per bin. Bins have no end: a ratio is its own bin up to
``2 ** BITS``, and beyond that keeps its ``BITS`` leading bits, so a bin is never wider than a 128th of what it holds. Two sketches
merge by adding counts, so partial sketches combine before the shuffle, those of sources add up to those of languages, and those
to the corpus. Quantiles are exact to one bin, and equal on every run. Every source has quartiles of its own, drawn towards
those of its language as if ``prior`` documents of the language stood beside its ``n`` (weights n / (n + prior)), and a language's towards those of the
corpus likewise; no number of documents switches from one to another.
The spread is the quartile range in use, or the greater one of the language or of the corpus, so that a group half of
which is copies of one text (range 0) does not reject its other documents; ``LEAST`` only counts where all of these are less.

A text of any length is whole: its counts are long, and its ratios have bins however large. Nulls: a null text has no words and fails the base rule; null languages and sources are groups of their own. Repeated
rows count as often as they stand, and are judged alike; ties share a bin. An empty table gives no rows. Extra columns are kept;
columns added here take precedence over those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fits_broadcast, free_name, kept_table, words_of

SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?" + SYMBOLS
WINDOW = 8
#: Leading bits that a bin keeps.
BITS = 8
#: What the sketches describe: name to (how many, of what, out of). Mean word length in hundredths; marks a thousand words; capitals a thousand characters.
RATIOS = {"word_len": (100, "word_chars", "n_words"), "mark_pm": (1000, "n_marks", "n_words"), "upper_pm": (1000, "n_upper", "word_chars")}
LEAST = {"word_len": 10, "mark_pm": 10, "upper_pm": 2}
#: Where a fence stands: beyond the quartile by this many times the spread.
REACH = 4
#: How many documents of the level above count beside a group's own.
PRIOR = 50
MIN_WORDS = 20
MAX_REPEAT_PC = 30


def dup_lines(text: Column) -> Column:
    """How many lines with a word are equal to an earlier one."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def how_many(text: Column, letters: str) -> Column:
    """How many characters of a text are in a class, given as the inside of brackets of a pattern."""
    return F.regexp_count(text, F.lit(f"[{letters}]")).cast("long")


def mark_counts(df: DataFrame, text: str) -> DataFrame:
    """Adds the marks and capitals of a text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"n_marks": how_many(t, MARKS), "n_upper": how_many(t, "A-Z")})


def repeat_words(df: DataFrame, text: str, out: str = "n_repeat_words") -> DataFrame:
    """Adds the words, their code points, and how many words stand in a window of ``WINDOW`` words that the text holds twice or more.

    A window is represented by a 64-bit hash of its words. Only texts in which two hashes agree are sorted; the words
    covered are then added up along the sorted window starts. Linear but for that sort, and all inside the row.
    """
    before = df.columns
    w, h, s, q = (free_name(df.columns, x) for x in ("words_", "hashes_", "sorted_", "starts_"))
    df = df.withColumn(w, words_of(F.col(text)))
    df = df.withColumns({f"{w}n": F.size(w).cast("long"), f"{w}c": F.length(F.array_join(w, "")).cast("long")})
    # A hash of one word, then of 2, 4 and 8 words from there: three passes over longs instead of eight words a window.
    df = df.withColumn(f"{h}1", F.when(F.size(w) > WINDOW, F.expr(f"transform({w}, x -> xxhash64(x))")))
    for k in (1, 2, 4):
        df = df.withColumn(f"{h}{2 * k}", F.expr(f"transform({h}{k}, (x, i) -> xxhash64(x, get({h}{k}, i + {k})))"))
    df = df.withColumn(h, F.expr(f"slice({h}{WINDOW}, 1, size({h}{WINDOW}) - {WINDOW - 1})"))
    repeated = F.size(F.array_distinct(h)) < F.size(h)
    df = df.withColumn(s, F.when(repeated, F.expr(f"sort_array(transform({h}, (x, i) -> struct(x as h, i as p)))")))
    df = df.withColumn(q, F.when(F.col(s).isNotNull(), F.expr(f"sort_array(transform(filter({s}, (x, i) -> get({s}, i - 1).h = x.h or get({s}, i + 1).h = x.h), x -> x.p))")))
    covered = F.expr(f"aggregate({q}, struct(0L as n, 0 as upto), (a, p) -> struct(a.n + (p + {WINDOW} - greatest(a.upto, p)) as n, p + {WINDOW} as upto), a -> a.n)")
    repeats = F.coalesce(F.when(F.col(q).isNotNull(), covered), F.lit(0).cast("long"))
    # A one-row generator: filters on these columns stay above it. Pushed below, each would be expanded into its whole expression.
    new = F.inline(F.array(F.struct(F.col(f"{w}n").alias("n_words"), F.col(f"{w}c").alias("word_chars"), repeats.alias(out))))
    return df.select(*[c for c in before if c not in ("n_words", "word_chars", out)], new)


def bin_of(ratio: Column) -> Column:
    """The bin of a ratio: its lower end."""
    drop = F.greatest(F.length(F.bin(ratio)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", ratio, drop), drop)


def ratio_bins() -> dict[str, Column]:
    """The ratios as bins, from the counts; 0 where there is nothing to divide by."""
    return {k: F.when(F.col(of) > 0, bin_of(F.expr(f"({times} * {n}) div {of}"))).otherwise(F.lit(0).cast("long")) for k, (times, n, of) in RATIOS.items()}


def sketches(df: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """Counts per (lang, source, ratio, bin) over all documents with a word."""
    t = F.coalesce(F.col(text), F.lit(""))
    counts = F.struct(
        how_many(t, MARKS).alias("n_marks"),
        how_many(t, "A-Z").alias("n_upper"),
        F.regexp_count(t, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("n_words"),
        (F.length(t) - how_many(t, "\\x20\\x09-\\x0D")).alias("word_chars"),
    )
    # A one-row generator, as in ``repeat_words``: each count is taken once, whatever uses it.
    base = df.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.inline(F.array(counts))).where("n_words > 0")
    pairs = F.array(*[F.struct(F.lit(k).alias("ratio"), v.alias("bin")) for k, v in ratio_bins().items()])
    return base.select("lang", "source", F.inline(pairs)).groupBy("lang", "source", "ratio", "bin").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """n, q1 and q3 of each merged sketch: the least bin that at least a quarter (three quarters) of the rows do not exceed."""
    merged = sketch.groupBy(*keys, "ratio", "bin").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "ratio")
    upto = merged.withColumns({"upto": F.sum("n").over(by.orderBy("bin")), "all": F.sum("n").over(by)})
    return upto.groupBy(*keys, "ratio").agg(F.max("all").alias("n"), F.min(F.when(F.col("upto") * 4 >= F.col("all"), F.col("bin"))).alias("q1"), F.min(F.when(F.col("upto") * 4 >= F.col("all") * 3, F.col("bin"))).alias("q3"))


def fences(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """One row per language and source with two fences per ratio: ``lang, source, <ratio>_min, <ratio>_max``."""
    fine, mid, top = _quartiles(sketch, ["lang", "source"]), _quartiles(sketch, ["lang"]), _quartiles(sketch, [])
    m = mid.select(F.col("lang").alias("l2"), F.col("ratio").alias("r2"), F.struct("n", "q1", "q3").alias("mid"))
    t = top.select(F.col("ratio").alias("r3"), F.struct("n", "q1", "q3").alias("top"))
    all_ = fine.join(m, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("ratio") == F.col("r2"))).join(t, F.col("ratio") == F.col("r3"))
    drawn = lambda n, own, above: (n * own + F.lit(float(prior)) * above) / (n + F.lit(float(prior)))
    ends = []
    for x in ("q1", "q3"):
        of_lang = drawn(F.col("mid.n").cast("double"), F.col(f"mid.{x}").cast("double"), F.col(f"top.{x}").cast("double"))
        ends.append(drawn(F.col("n").cast("double"), F.col(x).cast("double"), of_lang).alias(x))
    all_ = all_.withColumn("use", F.struct(*ends))
    least = F.create_map(*[x for k, v in LEAST.items() for x in (F.lit(k), F.lit(float(v)))])
    ranges = [F.col(f"{x}.q3") - F.col(f"{x}.q1") for x in ("use", "mid", "top")]
    spread = F.lit(REACH) * F.greatest(*ranges, F.element_at(least, F.col("ratio")))
    all_ = all_.select("lang", "source", "ratio", (F.col("use.q1") - spread).alias("low"), (F.col("use.q3") + spread).alias("high"))
    return all_.groupBy("lang", "source").agg(*[F.max(F.when(F.col("ratio") == k, F.col(x))).alias(f"{k}_{end}") for k in RATIOS for x, end in (("low", "min"), ("high", "max"))])


def quality_rules(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", prior: int = PRIOR) -> DataFrame:
    """All rows of ``df`` with the counts, ``base_failed``, the ratios, their fences and ``kept``.

    Base rule: fewer than ``MIN_WORDS`` words, or more than ``MAX_REPEAT_PC`` per cent of them in repeated windows. A document
    is kept if it passes the base rule and no ratio is beyond its group's fences. Two passes over the texts: one for the
    sketches, one to judge; between them go only the fences, which are broadcast if they are few and else joined on salted keys.
    """
    limits = kept_table(fences(sketches(df, text, lang, source), prior), "fences")
    ends = [f"{k}_{end}" for k in RATIOS for end in ("min", "max")]
    t = F.coalesce(F.col(text), F.lit(""))
    out = mark_counts(df, text).withColumns({"n_symbols": how_many(t, SYMBOLS), "n_dup_lines": dup_lines(t)})
    out = repeat_words(out, text).withColumns(ratio_bins()).drop(*ends)
    taken = [*out.columns, *limits.columns]
    l, s, salt = free_name(taken, "lang_"), free_name(taken, "source_"), free_name(taken, "salt_")
    limits = limits.select(F.col("lang").alias(l), F.col("source").alias(s), *ends)
    same = F.col(lang).eqNullSafe(F.col(l)) & F.col(source).eqNullSafe(F.col(s))
    if fits_broadcast(limits):
        out = out.join(F.broadcast(limits), same, "left")
    else:
        salts = 64
        limits = limits.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        other = free_name(taken, "salt2_")
        out = out.withColumn(other, F.pmod(F.xxhash64(text), F.lit(salts)).cast("int")).join(limits, same & (F.col(salt) == F.col(other)), "left").drop(salt, other)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PC * F.col("n_words"))
    kept = ~failed
    for k in RATIOS:
        kept = kept & F.coalesce(F.col(k).between(F.col(f"{k}_min"), F.col(f"{k}_max")), F.lit(True))
    return out.withColumns({"base_failed": failed, "kept": kept}).drop(l, s)

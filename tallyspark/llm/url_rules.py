"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression together with the literal tokens (lower-case runs of letters and digits) that every URL
it matches must contain. The rule is filed under the one of its tokens that the fewest URLs contain; a URL looks up its
own tokens in that index and runs only the expressions found there. Everything is DataFrame functions: the index is a
literal map from token to rules, so judging is a narrow projection without shuffle; a rule set too large for that goes
through ``judge_urls_joined``, an equi-join of exploded tokens.

Null URLs, and those without ``://``, have an empty host and path, match no rule and get ``NO_HOST_VERDICT``.
Repeated rows are judged row by row; an empty table gives an empty result; extra columns are kept, and the columns this
operator adds take precedence over columns of the same name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fits_broadcast, free_name, kept_table

TOKEN = re.compile(r"[a-z0-9]+")
#: The verdict on a URL that names no host.
NO_HOST_VERDICT = "block"
#: More rules than this go through the join instead of a literal map.
LITERAL_RULES = 2_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs on ``host + path`` for site rules, on the whole lower-cased URL for pattern rules."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    site: bool = False
    rank: int = field(default=0)


def site_rule(verdict: str, host: str, path: str = "/") -> Rule:
    """Fits ``host`` and its sub-domains if the URL's path starts with ``path``; longer rules win."""
    literal = "".join("\\" + c if not c.isalnum() else c for c in host), "".join("\\" + c if not c.isalnum() else c for c in path)
    # A token at the end of the path may run on in the URL, so it is not a whole token there.
    tokens = TOKEN.findall(host) + (TOKEN.findall(path.lower()) if not path[-1:].isalnum() else TOKEN.findall(path.lower())[:-1])
    return Rule(host + path, verdict, f"^(?:[^/]*\\.)?{literal[0]}{literal[1]}", tuple(dict.fromkeys(tokens)), True, len(host + path))


def pattern_rule(verdict: str, name: str, pattern: str, *tokens: str) -> Rule:
    """A regular expression over the lower-cased URL; ``tokens`` must stand in every URL that it matches."""
    if not tokens or any(not TOKEN.fullmatch(t) for t in tokens):
        raise ValueError(f"rule {name!r} needs literal tokens of a-z and 0-9")
    return Rule(name, verdict, pattern, tuple(tokens))


#: Pages that hold no article: feeds, carts, log-ins, adverts, scripts. Used where no site rule fits.
DEFAULT_PATTERNS = (
    pattern_rule("block", "login", "/(?:wp-)?login(?:[./?#]|$)", "login"),
    pattern_rule("block", "signin", "/signin(?:[./?#]|$)", "signin"),
    pattern_rule("block", "cart", "/(?:cart|checkout/cart)(?:[./?#]|$)", "cart"),
    pattern_rule("block", "checkout", "/checkout(?:[./?#]|$)", "checkout"),
    pattern_rule("block", "casino", "[/.-]casino[/.-]", "casino"),
    pattern_rule("block", "porn", "[/.-]porn[/.-]", "porn"),
    pattern_rule("block", "ads", "://ads[.]", "ads"),
    pattern_rule("block", "banner", "/banner[.](?:gif|png|jpe?g)", "banner"),
    pattern_rule("block", "stylesheet", "[.]css(?:[?#]|$)", "css"),
    pattern_rule("block", "script", "[.]js(?:[?#]|$)", "js"),
    pattern_rule("block", "image", "[.]png(?:[?#]|$)", "png"),
    pattern_rule("block", "archive", "[.]zip(?:[?#]|$)", "zip"),
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    """Distinct lower-case runs of a-z and 0-9."""
    return F.array_distinct(F.array_remove(F.split(ascii_lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"), ""))


def token_frequencies(urls: DataFrame, column: str, tokens: list[str]) -> dict[str, int]:
    """In how many rows each of the given rule tokens stands: one pass, as many rows back as there are rule tokens."""
    if not tokens:
        return {}
    wanted = F.array(*[F.lit(t) for t in tokens])
    found = urls.select(F.explode(F.array_intersect(url_tokens(F.col(column)), wanted)).alias("token")).groupBy("token").count()
    return {t: 0 for t in tokens} | {r["token"]: r["count"] for r in found.collect()}


def file_rules(rules: tuple[Rule, ...], seen: dict[str, int]) -> dict[str, list[Rule]]:
    """Each rule under its rarest token (ties: the smaller token)."""
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        index.setdefault(min(rule.tokens, key=lambda t: (seen.get(t, 0), t)), []).append(rule)
    return index


def _rule_struct(rule: Rule) -> Column:
    return F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"), F.lit(rule.pattern).alias("pattern"), F.lit(rule.site).alias("site"), F.lit(rule.rank).alias("rank"))


def _fits(rule: Column, url: Column, host: Column, path: Column) -> Column:
    return F.when(rule["site"], F.regexp_like(F.concat(host, path), rule["pattern"])).otherwise(F.regexp_like(ascii_lower(url), rule["pattern"]))


def _verdict(best: Column, host: Column) -> tuple[Column, Column]:
    """The name of the fitting site rule, and the verdict: a site rule's, else a pattern rule's, else allow."""
    rule = F.when(best["site"], best["name"])
    return rule, F.when(host == "", F.lit(NO_HOST_VERDICT)).otherwise(F.coalesce(best["verdict"], F.lit("allow")))


def judge_urls(urls: DataFrame, column: str = "url", site_rules: tuple[Rule, ...] = (), patterns: tuple[Rule, ...] = DEFAULT_PATTERNS) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (the fitting site rule, else null), ``verdict`` and ``n_candidates`` to every row.

    Site rules precede patterns; among site rules the longest wins, among patterns the greatest by verdict, then name.
    """
    rules = tuple(site_rules) + tuple(patterns)
    index = file_rules(rules, token_frequencies(urls, column, sorted({t for r in rules for t in r.tokens})))
    if len(rules) > LITERAL_RULES:
        return judge_urls_joined(urls, column, index)
    host, path, hits = (free_name(urls.columns, x) for x in ("host_", "path_", "hits_"))
    at = F.create_map(*[x for token, filed in index.items() for x in (F.lit(token), F.array(*[_rule_struct(r) for r in filed]))]) if index else None
    out = urls.withColumns({host: url_host(F.col(column)), path: url_path(F.col(column))})
    if at is None:
        return out.withColumns({"host": F.col(host), "path": F.col(path), "rule": F.lit(None).cast("string"), "verdict": F.when(F.col(host) == "", NO_HOST_VERDICT).otherwise("allow"), "n_candidates": F.lit(0)}).drop(host, path)
    keys = F.array(*[F.lit(t) for t in index])
    candidates = F.flatten(F.transform(F.array_intersect(url_tokens(F.col(column)), keys), lambda t: F.element_at(at, t)))
    out = out.withColumn(hits, candidates)
    url = F.coalesce(F.col(column), F.lit(""))
    fitting = F.filter(F.col(hits), lambda r: (F.col(host) != "") & _fits(r, url, F.col(host), F.col(path)))
    order = F.transform(fitting, lambda r: F.struct(r["site"].alias("site"), r["rank"].alias("rank"), r["verdict"].alias("verdict"), r["name"].alias("name")))
    best = free_name(urls.columns, "best_")
    out = out.withColumn(best, F.array_max(order))
    rule, verdict = _verdict(F.col(best), F.col(host))
    return out.withColumns({"host": F.col(host), "path": F.col(path), "rule": rule, "verdict": verdict, "n_candidates": F.size(F.col(hits))}).drop(host, path, hits, best)


def judge_urls_joined(urls: DataFrame, column: str, index: dict[str, list[Rule]]) -> DataFrame:
    """The same for rule sets too large for a literal map.

    Distinct URLs are exploded to tokens and joined to the index on the token (broadcast if the index is small), the
    expressions run on the joined rows, and the best rule of each distinct URL is joined back.
    """
    spark = urls.sparkSession
    rows = [(t, r.name, r.verdict, r.pattern, r.site, r.rank) for t, filed in index.items() for r in filed]
    rules = kept_table(spark.createDataFrame(rows, "token string, name string, verdict string, pattern string, site boolean, rank int"), "rules")
    if fits_broadcast(rules):
        rules = F.broadcast(rules)
    one = urls.select(F.col(column).alias("url")).where("url is not null").distinct().withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))}).where("host <> ''")
    rule = F.struct("name", "verdict", "pattern", "site", "rank")
    found = one.withColumn("token", F.explode(url_tokens(F.col("url")))).join(rules, "token").withColumn("r", rule)
    fits = F.when(F.col("site"), F.expr("rlike(concat(host, path), pattern)")).otherwise(F.expr("rlike(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), pattern)"))
    best_of = F.max(F.when(fits, F.struct("site", "rank", "verdict", "name"))).alias("best")
    best = found.groupBy("url").agg(best_of, F.count("*").cast("int").alias("n"))
    key, b, n = (free_name(urls.columns, x) for x in ("url_", "best_", "n_"))
    out = urls.join(best.select(F.col("url").alias(key), F.col("best").alias(b), F.col("n").alias(n)), F.col(column) == F.col(key), "left").withColumn(key, url_host(F.col(column)))
    name, verdict = _verdict(F.col(b), F.col(key))
    path = url_path(F.col(column))
    return out.withColumns({"host": F.col(key), "path": path, "rule": name, "verdict": verdict, "n_candidates": F.coalesce(F.col(n), F.lit(0))}).drop(key, b, n)

"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from . import filter_audit, mixing, quality_rules, url_rules

_W = "regexp_extract_all(coalesce({0}, ''), '[^\\x20\\x09-\\x0D]+')"

_WEIGHTS = f"CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN {mixing.WEIGHTS[0]} WHEN 1 THEN {mixing.WEIGHTS[1]} ELSE {mixing.WEIGHTS[2]} END"
OP2 = f"""WITH d AS (SELECT doc_id, source, len({_W.format("text")}) AS size, md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source), w AS (SELECT source, source_size, {_WEIGHTS} AS weight, {mixing.MAX_EPOCHS} * source_size AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ()) * {mixing.SHARE}::DOUBLE - coalesce(sum(cap) OVER o, 0)) / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER o, 0)) AS level FROM w
 WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN cap <= (max(level) OVER ()) * weight THEN cap::DOUBLE ELSE (max(level) OVER ()) * weight END AS target FROM l),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.source, d.size, u.source_size, u.target, u.whole, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(copies AS BIGINT) AS copies, CAST(copies * size AS BIGINT) AS taken FROM
 (SELECT *, whole + CASE WHEN whole < {mixing.MAX_EPOCHS} AND 2 * upto - size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END AS copies FROM r)"""

_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def op8(site_rules: tuple[url_rules.Rule, ...]) -> str:
    """Site rules from the longest down, then the patterns."""
    fits = "".join(f" WHEN regexp_matches(host || path, '{r.pattern}') THEN '{{{i}}}'" for i, r in enumerate(sorted(site_rules, key=lambda r: -r.rank)))
    ranked = sorted(site_rules, key=lambda r: -r.rank)
    rule, verdict = fits.format(*[r.name for r in ranked]), fits.format(*[r.verdict for r in ranked])
    blocked = " OR ".join(f"regexp_matches(low, '{r.pattern}')" for r in url_rules.DEFAULT_PATTERNS)
    return f"""WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM pages)
SELECT page_id, host, path, CASE WHEN host = '' THEN NULL{rule} END AS rule, CASE WHEN host = '' THEN '{url_rules.NO_HOST_VERDICT}'{verdict} WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict FROM p"""


def op10() -> str:
    """Counts, fences by language and source, verdicts."""
    q = quality_rules
    kept = lambda x: f"(({x}) >> greatest(length(bin({x})) - {q.BITS}, 0)) << greatest(length(bin({x})) - {q.BITS}, 0)"
    ratio = {k: f"CASE WHEN {of} > 0 THEN {kept(f'CAST(({times} * {n}) // {of} AS BIGINT)')} ELSE 0 END" for k, (times, n, of) in q.RATIOS.items()}
    bins = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS ratio, {x} AS bin FROM c WHERE n_words > 0" for k, x in ratio.items())
    quartiles = lambda keys: f"SELECT {keys}ratio, max(total) AS n, min(CASE WHEN upto * 4 >= total THEN bin END) AS q1, min(CASE WHEN upto * 4 >= total * 3 THEN bin END) AS q3 FROM (SELECT {keys}ratio, bin, sum(count(*)) OVER (PARTITION BY {keys}ratio ORDER BY bin) AS upto, sum(count(*)) OVER (PARTITION BY {keys}ratio) AS total FROM b GROUP BY {keys}ratio, bin) GROUP BY {keys}ratio"
    least = " ".join(f"WHEN '{k}' THEN {v}" for k, v in q.LEAST.items())
    m = f"{q.PRIOR}::DOUBLE"
    drawn = lambda n, own, above: f"({n}::DOUBLE * {own}::DOUBLE + {m} * {above}) / ({n}::DOUBLE + {m})"
    use = lambda x: f"{drawn('f1.n', f'f1.{x}', drawn('f2.n', f'f2.{x}', f'f3.{x}::DOUBLE'))} AS {x}"
    chars = lambda xs: f"length(text) - length(translate(text, '{xs}', ''))"
    ends = ", ".join(f"max(CASE WHEN ratio = '{k}' THEN q1 - {q.REACH} * spread END) AS {k}_min, max(CASE WHEN ratio = '{k}' THEN q3 + {q.REACH} * spread END) AS {k}_max" for k in q.RATIOS)
    within = " AND ".join(f"{x} BETWEEN coalesce({k}_min, 0) AND coalesce({k}_max, 1e300)" for k, x in ratio.items())
    return f"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_W.format("text")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
c AS (SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {chars(q.SYMBOLS)} AS n_symbols, {chars(q.MARKS)} AS n_marks, {chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ")} AS n_upper, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM d),
x AS (SELECT doc_id, unnest(range(greatest(len(w) - 7, 0))) AS p, unnest(list_transform(range(greatest(len(w) - 7, 0)), lambda p: md5(array_to_string(w[p + 1:p + 8], ' ')))) AS g FROM d),
y AS (SELECT doc_id, g FROM x GROUP BY 1, 2 HAVING count(*) > 1), z AS (SELECT doc_id, count(DISTINCT p + o) AS n_repeat_words FROM x JOIN y USING (doc_id, g) CROSS JOIN range(8) AS t(o) GROUP BY doc_id),
b AS ({bins}), f1 AS ({quartiles("lang, source, ")}), f2 AS ({quartiles("lang, ")}), f3 AS ({quartiles("")}),
v AS (SELECT f1.lang, f1.source, f1.ratio, {use("q1")}, {use("q3")}, greatest(f2.q3 - f2.q1, f3.q3 - f3.q1, CASE f1.ratio {least} END)::DOUBLE AS above FROM f1 JOIN f2 ON f1.lang IS NOT DISTINCT FROM f2.lang AND f1.ratio = f2.ratio JOIN f3 ON f1.ratio = f3.ratio),
u AS (SELECT lang, source, ratio, q1, q3, greatest(q3 - q1, above) AS spread FROM v),
g AS (SELECT lang, source, {ends} FROM u GROUP BY 1, 2),
j AS (SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < {q.MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {q.MAX_REPEAT_PC} * n_words AS base_failed, {within} AS within
 FROM c LEFT JOIN z USING (doc_id) LEFT JOIN g ON c.lang IS NOT DISTINCT FROM g.lang AND c.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND within AS kept FROM j"""


OP4 = """WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1:p + 5], ' ') AS x FROM (SELECT doc_id, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END)) AS p FROM d)),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1), i AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p, q FROM i JOIN n a ON a.doc_id = p JOIN n b ON b.doc_id = q WHERE 100 * i.k >= 75 * (a.k + b.k - i.k)),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.q, r.c FROM r JOIN e ON e.p = r.v), m AS (SELECT v, min(c) AS c FROM r GROUP BY 1)
SELECT doc_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_shingles, m.c AS component_id, doc_id = m.c AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN m ON m.v = doc_id"""


def op12() -> str:
    """Documents by what they fail, then every order and step."""
    letters = list(filter_audit.FILTERS)
    given = " AND ".join(f"o.p{i} <> o.p{j}" for i in range(len(letters)) for j in range(i))
    tables = ", ".join(f"(SELECT unnest({letters}) AS p{i})" for i in range(len(letters)))
    order = " || ".join(f"p{i}" for i in range(len(letters)))
    gone = " OR ".join(f"(fails_{x.lower()} AND position('{x}' IN filter_order) < step)" for x in letters)
    here = "CASE letter " + " ".join(f"WHEN '{x}' THEN fails_{x.lower()}" for x in letters) + " END"
    alone = " + ".join(f"fails_{x.lower()}::INT" for x in letters)
    return f"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_W.format("text")} AS w FROM documents),
f AS (SELECT t.doc_id, part, len(w) < 200 AS fails_a, 100 * len(list_distinct(w)) < 50 * len(w) AS fails_b, 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(text) AS fails_c,
 length(text) <> length(translate(text, '{filter_audit.MARKS}', '')) AS fails_d, coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS fails_e FROM t),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, fails_a, fails_b, fails_c, fails_d, fails_e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
o AS (SELECT {order} AS filter_order FROM (SELECT * FROM {tables}) AS o WHERE {given}), s AS (SELECT filter_order, step, substr(filter_order, CAST(step AS INT), 1) AS letter FROM o, (SELECT unnest(range(1, {len(letters) + 1})) AS step)),
x AS (SELECT *, ({gone}) AS gone, {here} AS here, {alone} AS n_fails FROM c, s),
y AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT gone AND NOT here THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND here THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND here THEN n ELSE 0 END) AS redundant,
 sum(CASE WHEN here AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND here AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND here AND toxic THEN n ELSE 0 END) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM y"""

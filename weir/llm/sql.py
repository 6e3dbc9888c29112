"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from weir.llm.url_filter import APART, ORDER, RULES, SMOOTH

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op4_decontamination(window: int = 13) -> str:
    """Windows as joined words: those of items are looked up among those of documents, for each length that occurs."""
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), {window}) AS n FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
f AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, win)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM f)) GROUP BY r),
k AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM f) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN k USING (r)"""


def op9_url_filter() -> str:
    """The same counts and smoothing, an order at a time, joined to each distinct window."""
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, said) for said, h, p in sorted(RULES, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r), reverse=True)]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{name}'" for c, name, _ in fits) + " END"
    said = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + " END"
    length = ORDER + 1
    tables, joins, select = [], [], []
    before = {"a": "1.0::DOUBLE / letters", "r": "1.0::DOUBLE / letters"}
    for k in range(ORDER + 1):
        for kind, size in (("n", k + 1), ("t", k)):
            gram = f"substr(win, {length - k}, {size})"
            tables.append(f"{kind}{k} AS (SELECT {gram} AS g, sum(a)::DOUBLE AS a, sum(r)::DOUBLE AS r FROM seen WHERE a + r > 0 GROUP BY 1)")
            joins.append(f"LEFT JOIN {kind}{k} ON {kind}{k}.g = {gram}")
        select += [f"(coalesce(n{k}.{c}, 0) + {SMOOTH}::DOUBLE * {before[c]}) / (coalesce(t{k}.{c}, 0) + {SMOOTH}::DOUBLE) AS p{c}{k}" for c in "ar"]
        before = {c: f"p{c}{k}" for c in "ar"}
    apart = ", ".join(f"'{x}'" for x in APART)
    return f"""
WITH after AS (SELECT row_number() OVER () AS row, page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT row, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM after),
ruled AS (SELECT *, {rule} AS rule, {said} AS said, host || path AS spelling, left(md5(host || path), 1) IN ({apart}) AS apart FROM parts),
windows AS (SELECT *, substr(repeat(chr(2), {ORDER}) || spelling || chr(3), i, {length}) AS win FROM (SELECT *, unnest(range(1, length(spelling) + 2)) AS i FROM ruled)),
seen AS (SELECT win, count(*) FILTER (NOT apart AND said = 'allow') AS a, count(*) FILTER (NOT apart AND said = 'block') AS r FROM windows GROUP BY win),
{", ".join(tables)},
l AS (SELECT count(*) + 1 AS letters FROM n0),
p AS (SELECT seen.win, {", ".join(select)} FROM seen CROSS JOIN l {" ".join(joins)}),
ratios AS (SELECT win, floor((ln({before["a"]}) - ln({before["r"]})) * 1e6::DOUBLE + 0.5::DOUBLE)::BIGINT AS llr FROM p),
scored AS (SELECT row, page_id, host, path, rule, said, apart, sum(llr)::DOUBLE / count(*)::DOUBLE / 1e6::DOUBLE AS score FROM windows JOIN ratios USING (win) GROUP BY ALL),
bins AS (SELECT floor(score * 100)::BIGINT AS b, count(*) FILTER (said = 'allow') AS a, count(*) FILTER (said = 'block') AS r FROM scored WHERE apart AND said IS NOT NULL GROUP BY 1),
total AS (SELECT coalesce(sum(a), 0) AS a, coalesce(sum(r), 0) AS r FROM bins),
cuts AS (SELECT min(b) AS t, (SELECT a * r FROM total) AS right_ FROM bins UNION ALL
  SELECT b + 1, (total.a - sum(bins.a) OVER u) * total.r + sum(bins.r) OVER u * total.a FROM bins, total WINDOW u AS (ORDER BY b)),
best AS (SELECT CASE WHEN (SELECT a = 0 OR r = 0 FROM total) THEN 0.0::DOUBLE ELSE (min(t) + max(t))::DOUBLE / 200::DOUBLE END AS t FROM cuts WHERE right_ = (SELECT max(right_) FROM cuts)),
both_ AS (SELECT coalesce(sum(a), 0) > 0 AND coalesce(sum(r), 0) > 0 AS known FROM seen)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN NOT known OR score >= t THEN 'allow' ELSE 'block' END) AS verdict, score FROM scored, best, both_"""


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": op4_decontamination(), "op9_url_filter": op9_url_filter()}

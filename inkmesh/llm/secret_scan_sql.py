"""DuckDB SQL of the secret scan, the same tests written with rows instead of arrays."""

from __future__ import annotations

import re

from inkmesh.llm.secret_scan import LETTER_RATES, MIN_TOKEN, PATTERNS

_TEMPLATE = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
cut AS (
  SELECT rid, 0 AS kind_rank, 'assign' AS kind, regexp_extract_all(t, '@ASSIGN@') AS toks, string_split_regex(t, '@ASSIGN@') AS gaps FROM d
  UNION ALL SELECT rid, 1, 'access', regexp_extract_all(t, '@ACCESS@'), string_split_regex(t, '@ACCESS@') FROM d
  UNION ALL SELECT rid, 2, 'hex', regexp_extract_all(t, '@HEX@'), string_split_regex(t, '@HEX@') FROM d
  UNION ALL SELECT rid, 3, 'random', regexp_extract_all(t, '@TOKEN@'), string_split_regex(t, '@TOKEN@') FROM d),
rows_of AS (SELECT rid, kind_rank, kind, unnest(toks) AS tok, unnest(gaps[1:len(toks)]) AS gap, unnest(range(len(toks))) AS i FROM cut WHERE len(toks) > 0),
placed AS (SELECT rid, kind_rank, kind, tok, CAST(sum(length(gap) + length(tok)) OVER (PARTITION BY rid, kind_rank ORDER BY i) AS BIGINT) AS e FROM rows_of),
spans AS (SELECT rid, kind_rank, kind, tok, e - length(tok) AS s, e FROM placed),
base AS (SELECT * FROM spans WHERE kind_rank IN (1, 2) OR kind_rank = 0 AND length(regexp_extract(tok, '@VALUE@', 1)) >= 6),
free AS (SELECT row_number() OVER () AS tid, rid, s, e, translate(regexp_replace(tok, '=+$', ''), '-_=', '+//') AS b FROM spans x WHERE kind_rank = 3 AND NOT EXISTS (SELECT 1 FROM base y WHERE y.rid = x.rid AND x.s < y.e AND x.e > y.s)),
typed AS (
  SELECT *, CAST(length(b) AS DOUBLE) AS n, CASE WHEN regexp_full_match(b, '[0-9a-f]+|[0-9A-F]+') THEN 1 WHEN regexp_full_match(b, '[A-Z2-7]+') THEN 2 WHEN regexp_full_match(b, '[0-9a-z]+|[0-9A-Z]+') THEN 3 WHEN regexp_full_match(b, '[0-9A-Za-z]+') THEN 4 ELSE 5 END AS enc
  FROM free WHERE length(b) >= 2 AND NOT regexp_full_match(b, '[0-9]+')),
coded AS (
  SELECT *, enc >= 4 AS cased, ['0123456789abcdef', 'abcdefghijklmnopqrstuvwxyz234567', '0123456789abcdefghijklmnopqrstuvwxyz', '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/'][enc] AS alphabet,
         CAST([16, 32, 36, 62, 64][enc] AS DOUBLE) AS k FROM typed),
chars AS (SELECT tid, k, cased, alphabet, unnest(string_split(b, '')) AS c, unnest(range(CAST(n AS BIGINT))) AS i FROM coded),
indexed AS (SELECT tid, k, c, i, CAST(instr(alphabet, CASE WHEN cased THEN c ELSE lower(c) END) - 1 AS DOUBLE) AS x FROM chars),
paired AS (SELECT *, lag(x) OVER w AS px, lag(c) OVER w AS pc FROM indexed WINDOW w AS (PARTITION BY tid ORDER BY i)),
rate AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz', '')) AS c, unnest([@RATES@]) AS r),
summed AS (
  SELECT tid, sum(CASE WHEN x >= k / 2 THEN 1.0::DOUBLE ELSE 0 END) AS high, 1 + sum(CASE WHEN px IS NOT NULL AND (px >= k / 2) <> (x >= k / 2) THEN 1.0::DOUBLE ELSE 0 END) AS runs,
         sum(x) AS sx, sum(x * x) AS xx, sum(coalesce(px * x, 0)) AS xy, arg_min(x, i) + arg_max(x, i) AS ends,
         sum(CASE WHEN r IS NOT NULL THEN ln(0.96::DOUBLE * r / 1000) WHEN paired.c BETWEEN '0' AND '9' THEN ln(0.002::DOUBLE) ELSE ln(0.005::DOUBLE) END) AS log_text,
         sum(CASE WHEN r IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS letters,
         sum(CASE WHEN regexp_full_match(coalesce(pc, '') || paired.c, '[A-Z][a-z]|[a-z][A-Z]') THEN 1.0::DOUBLE ELSE 0 END) AS changes,
         sum(CASE WHEN regexp_full_match(coalesce(pc, '') || paired.c, '[A-Za-z][A-Za-z]') THEN 1.0::DOUBLE ELSE 0 END) AS chances
  FROM paired LEFT JOIN rate ON rate.c = lower(paired.c) GROUP BY tid),
squares AS (SELECT tid, sum(m * m) AS sq FROM (SELECT tid, x, CAST(count(*) AS DOUBLE) AS m FROM indexed GROUP BY tid, x) GROUP BY tid),
zs AS (
  SELECT tid, rid, s, e, n, k, cased, letters, changes, chances, log_text, high, n - high AS low, (k / n * sq - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) AS z_chi,
         2 * high * (n - high) / n + 1 AS mu, runs, xx - n * (sx / n) * (sx / n) AS spread, xy - (sx / n) * (2 * n * (sx / n) - ends) + (n - 1) * (sx / n) * (sx / n) AS along
  FROM coded JOIN summed USING (tid) JOIN squares USING (tid)),
zz AS (SELECT *, (mu - 1) * (mu - 2) / (n - 1) AS variance, CASE WHEN spread > 1e-9 THEN (along / spread + 1 / n) * sqrt(n) END AS z_serial FROM zs),
zr AS (SELECT *, CASE WHEN high > 0 AND low > 0 AND variance > 0 THEN (runs - mu) / sqrt(variance) END AS z_runs FROM zz),
ps AS (
  SELECT *, CASE WHEN z_chi >= 0 THEN TAIL(z_chi) ELSE 1 - TAIL(z_chi) END AS p_chi,
         CASE WHEN high = 0 OR low = 0 THEN pow(2.0::DOUBLE, 1 - n) WHEN variance <= 0 THEN 1.0 ELSE least(1.0, 2 * TAIL(z_runs)) END AS p_runs,
         CASE WHEN z_serial IS NULL THEN 0.0 ELSE least(1.0, 2 * TAIL(z_serial)) END AS p_serial,
         exp(-greatest(0.0, least(700.0, -n * ln(k) - log_text + CASE WHEN cased THEN letters * ln(2.0::DOUBLE) - letters * ln(2.0::DOUBLE) - changes * ln(0.05::DOUBLE) - (chances - changes) * ln(0.95::DOUBLE) ELSE 0 END))) AS p_text
  FROM zr),
family AS (SELECT *, count(*) OVER (PARTITION BY rid) AS m, p_text * avg(n) OVER (PARTITION BY rid) / n AS w FROM ps),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY w) AS j FROM family),
limits AS (SELECT rid, max(w) AS top FROM ranked WHERE w <= 1e-4::DOUBLE * j / m GROUP BY rid),
found AS (SELECT r.rid, 3 AS kind_rank, 'random' AS kind, r.s, r.e FROM ranked r JOIN limits l ON l.rid = r.rid WHERE r.w <= top AND least(1.0, 3 * least(p_chi, p_runs, p_serial)) >= 0.001),
every_span AS (SELECT rid, kind_rank, kind, s, e FROM base UNION ALL SELECT * FROM found),
joined AS (
  SELECT rid, count(*) FILTER (kind_rank = 0) AS n_assign, count(*) FILTER (kind_rank = 1) AS n_access, count(*) FILTER (kind_rank = 2) AS n_hex, count(*) FILTER (kind_rank = 3) AS n_random,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_rank) FILTER (kind_rank < 3) AS base_spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_rank) AS all_spans
  FROM every_span GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(all_spans, '') AS spans, coalesce(n_random, 0) AS n_random
FROM d LEFT JOIN joined USING (rid)
"""


def _tail(z: str) -> str:
    """1 - Phi(|z|)."""
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({z})))"
    poly = f"{t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE))))"
    return f"(exp(-{z} * {z} / 2) * 0.3989422804014327::DOUBLE * {poly})"


def secret_scan_sql() -> str:
    value = PATTERNS["assign"].replace("'", "''")
    fill = {
        "VALUE": value,
        "ASSIGN": value.replace("([A-Za-z0-9+/_.=-]+)", "[A-Za-z0-9+/_.=-]+"),
        "ACCESS": PATTERNS["access"],
        "HEX": PATTERNS["hex"],
        "TOKEN": "[A-Za-z0-9+/_=-]{%d,}" % MIN_TOKEN,
        "RATES": ", ".join(map(str, LETTER_RATES)),
    }
    sql = _TEMPLATE
    for name, by in fill.items():
        sql = sql.replace(f"@{name}@", by)
    return re.sub(r"TAIL\((\w+)\)", lambda m: _tail(m[1]), sql)

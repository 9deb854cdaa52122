"""DuckDB SQL for the queries that SQL can express, written another way."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3 = rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 9)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + d) AS n_repeat_words FROM rep, (SELECT unnest(range(0, 8)) AS d) GROUP BY r),
m AS (
  SELECT t.r, doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS n_upper
  FROM t LEFT JOIN cov ON t.r = cov.r),
b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         n_symbols / nullif(word_chars, 0)::DOUBLE AS x1, n_dup_lines / nullif(n_lines, 0)::DOUBLE AS x2,
         n_upper / nullif(word_chars, 0)::DOUBLE AS x3, word_chars / nullif(n_words, 0)::DOUBLE AS x4 FROM m),
own AS (
  SELECT lang, source, count(*) AS n, quantile_disc(x1, [0.25, 0.5, 0.75]) AS q1, quantile_disc(x2, [0.25, 0.5, 0.75]) AS q2,
         quantile_disc(x3, [0.25, 0.5, 0.75]) AS q3, quantile_disc(x4, [0.25, 0.5, 0.75]) AS q4
  FROM b WHERE NOT base_failed GROUP BY GROUPING SETS ((lang, source), (lang), ()) HAVING grouping(lang, source) = 0),
lg AS (
  SELECT lang, count(*) AS n, quantile_disc(x1, [0.25, 0.5, 0.75]) AS q1, quantile_disc(x2, [0.25, 0.5, 0.75]) AS q2,
         quantile_disc(x3, [0.25, 0.5, 0.75]) AS q3, quantile_disc(x4, [0.25, 0.5, 0.75]) AS q4
  FROM b WHERE NOT base_failed GROUP BY lang),
ev AS (
  SELECT count(*) AS n, quantile_disc(x1, [0.25, 0.5, 0.75]) AS q1, quantile_disc(x2, [0.25, 0.5, 0.75]) AS q2,
         quantile_disc(x3, [0.25, 0.5, 0.75]) AS q3, quantile_disc(x4, [0.25, 0.5, 0.75]) AS q4
  FROM b WHERE NOT base_failed),
f AS (
  SELECT own.lang, own.source,
         CASE WHEN own.n >= 200 THEN own.q1 WHEN lg.n >= 200 THEN lg.q1 ELSE ev.q1 END AS q1,
         CASE WHEN own.n >= 200 THEN own.q2 WHEN lg.n >= 200 THEN lg.q2 ELSE ev.q2 END AS q2,
         CASE WHEN own.n >= 200 THEN own.q3 WHEN lg.n >= 200 THEN lg.q3 ELSE ev.q3 END AS q3,
         CASE WHEN own.n >= 200 THEN own.q4 WHEN lg.n >= 200 THEN lg.q4 ELSE ev.q4 END AS q4
  FROM own JOIN lg ON own.lang IS NOT DISTINCT FROM lg.lang CROSS JOIN ev)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, n_lines::BIGINT AS n_lines,
       n_upper::BIGINT AS n_upper, base_failed,
       NOT base_failed AND coalesce(x1 <= q1[2] + (4 * (q1[3] - q1[1]) + 0.03::DOUBLE) AND x2 <= q2[2] + (4 * (q2[3] - q2[1]) + 0.35::DOUBLE)
         AND x3 <= q3[2] + (4 * (q3[3] - q3[1]) + 0.25::DOUBLE) AND x4 <= q4[2] + (4 * (q4[3] - q4[1]) + 2.0::DOUBLE)
         AND x4 >= q4[2] - (4 * (q4[3] - q4[1]) + 2.0::DOUBLE), false) AS kept
FROM b LEFT JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
"""


def _rounds() -> str:
    """The passes of the mix, each over all rows of a source that are not taken."""
    out, gap = "", "rest"
    src = "d"
    for k in range(3):
        fits = "true" if k == 0 else f"NOT taken AND size <= {gap}"
        was = "false" if k == 0 else "taken"
        out += f"""
e{k} AS (SELECT *, sum(CASE WHEN {fits} THEN size END) OVER (PARTITION BY source ORDER BY q, doc_id, size) AS run{k} FROM {src}),
f{k} AS (SELECT * EXCLUDE (taken), {was} OR (({fits}) AND run{k} <= {gap}) AS taken,
          coalesce(max(CASE WHEN ({fits}) AND run{k} <= {gap} THEN run{k} END) OVER (PARTITION BY source), 0) AS got{k} FROM e{k}),
g{k} AS (SELECT *, {gap} - got{k} AS gap{k} FROM f{k}),"""
        src, gap = f"g{k}", f"gap{k}"
    return out


OP4 = rf"""
WITH t AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size,
         (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE)
           / 4503599627370496::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM t GROUP BY source),
o AS (
  SELECT *, row_number() OVER (ORDER BY 3 * s / w::DOUBLE, source NULLS LAST) AS k,
         sum(s) OVER () - coalesce(sum(3 * s) OVER (ORDER BY 3 * s / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 3 * s / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wl
  FROM s),
free AS (SELECT min(k) AS k, arg_min(l, k) AS l, arg_min(wl, k) AS wl FROM o WHERE 3 * s * wl > l * w),
p AS (
  SELECT source, s, CASE WHEN free.k IS NULL OR o.k < free.k THEN (3 * s)::DOUBLE ELSE (w * free.l)::DOUBLE / free.wl::DOUBLE END AS target FROM o, free),
r AS (SELECT *, CASE WHEN s > 0 THEN target / s::DOUBLE ELSE 0::DOUBLE END AS ratio FROM p),
d AS (
  SELECT t.doc_id, t.source, t.size, r.s, r.target, floor(ratio)::BIGINT AS sure, ratio - floor(ratio) AS p, false AS taken,
         target - floor(ratio)::BIGINT * r.s AS rest,
         CASE WHEN ratio - floor(ratio) > 0 THEN (u / (1 - u)) / ((ratio - floor(ratio)) / (1 - (ratio - floor(ratio)))) END AS q
  FROM t JOIN r ON t.source IS NOT DISTINCT FROM r.source),
{_rounds()}
h AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN NOT taken AND q IS NOT NULL AND abs(gap2 - size) < gap2
                                                             THEN abs(gap2 - size) END NULLS LAST, q, doc_id) AS n,
         NOT taken AND q IS NOT NULL AND abs(gap2 - size) < gap2 AS helps FROM g2)
SELECT doc_id, size, s AS source_size, target, ((sure + CASE WHEN q IS NOT NULL AND (taken OR (n = 1 AND helps)) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM h
"""

ORACLES = {"op3_quality_rules": OP3, "op4_pareto_mix": OP4}

"""Independent DuckDB SQL for the registered queries (correctness oracle).

DuckDB's RE2 has no look-around, so the rules are restated in SQL terms:

* texts are cut into maximal runs of word / non-word characters;
* a rule whose matches always start and end on word-run boundaries (``name``,
  ``proper_noun``, ``id``, ``username``) becomes a predicate over runs; the
  Title-Case rules become islands of word runs joined by whitespace runs, cut
  greedily into chunks of at most four words (the leftmost-first scan);
* ``email`` uses RE2 with the boundary characters consumed as context groups;
* priority resolution is one ``NOT EXISTS`` level per rule, numbering a
  ``row_number`` over the first position, templates ``printf``/``lpad``.
"""

from __future__ import annotations

W = r"\p{L}\p{N}_"
WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def _ids(ids):
    return ", ".join(ids)


def _on(ids, a, b):
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in ids)


def runs(src: str, ids: list[str]) -> str:
    """Relation: ids, i (1-based run index), tok, s (code-point offset)."""
    i = _ids(ids)
    return f"""(SELECT {i}, i, tok,
      CAST(sum(length(tok)) OVER (PARTITION BY {i} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           - length(tok) AS INTEGER) AS s
    FROM (SELECT {i}, unnest(r) AS tok, unnest(generate_series(1, len(r))) AS i
          FROM (SELECT {i}, regexp_extract_all(text, '[{W}]+|[^{W}]+') AS r FROM {src} WHERE text IS NOT NULL)))"""


def title_spans(src: str, ids: list[str], word: str, max_words: int, min_words: int,
                exclusions=(), sep: str = f"[{WS}]+") -> str:
    """Leftmost-first matches of ``\\b W(\\s+W){min-1,max-1}\\b`` for a word
    shape ``W`` made of word characters only: ids, s, e, v."""
    i = _ids(ids)
    excl = f"AND NOT list_has_any(words, {str_list(exclusions)})" if exclusions else ""
    return f"""(SELECT g.{i.replace(', ', ', g.')}, g.s, g.e, substring(t.text, g.s + 1, g.e - g.s) AS v FROM (
      SELECT {i}, min(s) AS s, CAST(max(s + length(tok)) AS INTEGER) AS e, count(*) AS nw, list(tok ORDER BY i) AS words FROM (
        SELECT *, row_number() OVER (PARTITION BY {i}, island ORDER BY i) AS w FROM (
          SELECT *, sum(CASE WHEN isn AND NOT cont THEN 1 ELSE 0 END)
                      OVER (PARTITION BY {i} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
          FROM (SELECT *, isn AND coalesce(lag(iss, 1) OVER (PARTITION BY {i} ORDER BY i), false)
                             AND coalesce(lag(isn, 2) OVER (PARTITION BY {i} ORDER BY i), false) AS cont
                FROM (SELECT *, regexp_full_match(tok, {q(word)}) AS isn, regexp_full_match(tok, {q(sep)}) AS iss
                      FROM {runs(src, ids)})))
        WHERE isn)
      GROUP BY {i}, island, (w - 1) // {max_words}
      HAVING count(*) >= {min_words} {excl}) g JOIN {src} t ON {_on(ids, 'g', 't')})"""


def run_spans(src: str, ids: list[str], full: str, extra: str = "") -> str:
    """Matches that are exactly one word run: ids, s, e, v."""
    i = _ids(ids)
    return f"""(SELECT {i}, s, CAST(s + length(tok) AS INTEGER) AS e, tok AS v FROM {runs(src, ids)}
      WHERE regexp_full_match(tok, {q(full)}) {extra})"""


def context_spans(src: str, ids: list[str], body: str, flags: str = "", like: str | None = None) -> str:
    """Matches of ``\b BODY \b`` (BODY starting and ending with word
    characters) with RE2: the boundary characters are consumed as context
    groups and offsets rebuilt from the split gaps: ids, s, e, v."""
    i = _ids(ids)
    p = q(f"{flags}(^|[^{W}])({body})([^{W}]|$)")
    cond = f"AND text LIKE {q(like)}" if like else ""
    return f"""(SELECT {i}, CAST(s AS INTEGER) AS s, CAST(s + length(m[j]) AS INTEGER) AS e, m[j] AS v FROM (
      SELECT {i}, m, j,
        coalesce(list_sum([length(x) for x in g[1:j]]), 0)
        + coalesce(list_sum([length(x) for x in f[1:j - 1]]), 0) + length(pre[j]) AS s
      FROM (SELECT {i}, f, pre, m, g, unnest(generate_series(1, len(f))) AS j FROM (
        SELECT {i}, regexp_extract_all(text, {p}, 0) AS f, regexp_extract_all(text, {p}, 1) AS pre,
               regexp_extract_all(text, {p}, 2) AS m, string_split_regex(text, {p}) AS g
        FROM {src} WHERE text IS NOT NULL {cond}))))"""


def email_spans(src: str, ids: list[str]) -> str:
    return context_spans(src, ids, r"[a-zA-Z0-9_][a-zA-Z0-9._%+\-]*@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", like="%@%")


def rule_spans(rule, src: str, ids: list[str]) -> str:
    """SQL emulation of one default rule's candidates (exclusions applied)."""
    if rule.name == "email":
        return email_spans(src, ids)
    if rule.name == "name":
        return title_spans(src, ids, "[A-Z][a-z]{1,25}", 4, 2, rule.exclusions)
    if rule.name == "proper_noun":
        return title_spans(src, ids, "[A-Z][a-z]{1,30}", 4, 1, rule.exclusions)
    if rule.name == "id":
        return run_spans(src, ids, r"\p{Nd}{7,8}")
    if rule.name == "username":
        return run_spans(src, ids, "[a-zA-Z0-9]{8}",
                         "AND regexp_matches(tok, '[a-zA-Z]') AND regexp_matches(tok, '[0-9]')")
    if rule.name == "ni_number":
        return context_spans(src, ids, r"[A-CEGHJ-PR-TW-Z]{2}\p{Nd}{6}[A-D]", "(?i)")
    if rule.name == "phone_uk":
        return context_spans(src, ids, rf"0[{WS}]*\p{{Nd}}[\p{{Nd}}{WS}]{{8,12}}\p{{Nd}}")
    if rule.name == "postcode":
        return context_spans(src, ids, rf"[A-Z]{{1,2}}\p{{Nd}}[A-Z\p{{Nd}}]?[{WS}]*\p{{Nd}}[A-Z]{{2}}", "(?i)")
    raise KeyError(rule.name)


def candidates(rules, src: str, ids: list[str]) -> str:
    parts = [f"SELECT {_ids(ids)}, {k} AS k, {q(r.name)} AS rule, s, e, v FROM {rule_spans(r, src, ids)}"
             for k, r in enumerate(rules)]
    return "(" + "\nUNION ALL\n".join(parts) + ")"


def kept(rules, src: str, ids: list[str]) -> str:
    """WITH-clause body defining cand, lvl0..lvlN; returns (ctes, final name)."""
    ctes = [f"cand AS {candidates(rules, src, ids)}", "lvl0 AS (SELECT * FROM cand WHERE k = 0)"]
    for k in range(1, len(rules)):
        ctes.append(f"""lvl{k} AS (SELECT * FROM lvl{k - 1} UNION ALL SELECT c.* FROM cand c WHERE c.k = {k}
          AND NOT EXISTS (SELECT 1 FROM lvl{k - 1} x WHERE {_on(ids, 'x', 'c')} AND x.s < c.e AND x.e > c.s))""")
    return ctes, f"lvl{len(rules) - 1}"


def strip_sql(col: str) -> str:
    return f"regexp_replace({col}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def template_sql(template: str, n: str, orig: str) -> str:
    """Template as SQL; DuckDB's ``format`` takes Python-style specs."""
    if template == "preserve_length":
        return f"lpad(CAST({n} AS VARCHAR), CAST(greatest(length({orig}), length(CAST({n} AS VARCHAR))) AS INTEGER), '0')"
    import string as _s

    out = []
    for literal, name, spec, _ in _s.Formatter().parse(template):
        if literal:
            out.append(q(literal.replace("{", "{{").replace("}", "}}")))
        if name is not None:
            arg = {"n": n, "orig": orig, "orig_len": f"length({orig})"}[name]
            out.append(f"format({q('{:' + (spec or '') + '}')}, {arg})")
    return "(" + " || ".join(out) + ")" if out else "''"


def registry_sql(rules, kept_name: str, scope: list[str], pos: str) -> str:
    """Registry CTE body over kept spans: scope, rule, key, first_v, first_k, n, pseudonym."""
    sc = ", ".join(scope) + ", " if scope else ""
    part = f"PARTITION BY {sc}rule"
    cases = " ".join(f"WHEN {k} THEN {template_sql(r.template, 'n', 'first_v')}" for k, r in enumerate(rules))
    return f"""(SELECT *, CASE first_k {cases} END AS pseudonym FROM (
      SELECT *, row_number() OVER ({part} ORDER BY fpos) AS n FROM (
        SELECT {sc}rule, {strip_sql('v')} AS key, min({pos}) AS fpos, arg_min(v, {pos}) AS first_v,
               arg_min(k, {pos}) AS first_k, count(*) AS occurrences
        FROM {kept_name} GROUP BY {sc}rule, {strip_sql('v')})))"""


def splice_sql(src: str, ids: list[str], spans: str) -> str:
    """Replace spans (ids, s, e, pseudonym) in src.text: ids, text."""
    i = _ids(ids)
    return f"""(SELECT t.{i.replace(', ', ', t.')}, CASE WHEN p.body IS NULL THEN t.text
                  ELSE p.body || substring(t.text, p.last_e + 1) END AS text
      FROM {src} t LEFT JOIN (
        SELECT {i}, string_agg(substring(text, prev_e + 1, s - prev_e) || pseudonym, '' ORDER BY s) AS body,
               max(e) AS last_e
        FROM (SELECT x.*, t2.text, coalesce(lag(x.e) OVER (PARTITION BY {', '.join('x.' + c for c in ids)}
                                                          ORDER BY x.s), 0) AS prev_e
              FROM {spans} x JOIN {src} t2 ON {_on(ids, 'x', 't2')})
        GROUP BY {i}) p ON {_on(ids, 't', 'p')})"""

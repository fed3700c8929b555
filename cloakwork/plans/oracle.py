"""SQL for checking query results on another engine.

``detect_sql`` repeats detection relationally: lines are unnested, every rule is matched on its own,
offsets are summed up and overlapping spans are merged with window functions.  Its texts hold no key
blocks, so plain lines are enough.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..operators.catalogue import BUILTIN_RULES, INLINE_PREFIX, MASK_PREFIX, VAULT_PREFIX, Rule
from ..operators.score import CONTEXT_WORDS, PATH_LIKE
from .planted import PLANTS, Plant


def quote(text: str) -> str:
    parts = text.split("\n")
    return "||chr(10)||".join("'" + p.replace("'", "''") + "'" for p in parts)


def hash_sql(key: str) -> str:
    text = f"CAST({key} AS VARCHAR)"
    return "(" + "||".join([f"md5({text})"] + [f"md5('{p}'||{text})" for p in "abc"]) + ")"


def value_sql(plant: Plant, key: str) -> str:
    pieces = []
    for part in plant.value:
        digits = f"substr({hash_sql(key)}, {part.start}, {part.size})"
        if part.size == 0:
            pieces.append(quote(part.text))
        elif part.kind == "upper":
            pieces.append(f"upper({digits})")
        elif part.kind == "digit":
            pieces.append(f"translate({digits}, 'abcdef', '012345')")
        else:
            pieces.append(digits)
    return "(" + "||".join(pieces) + ")"


def line_sql(plant: Plant, key: str) -> str:
    return f"({quote(plant.before)}||{value_sql(plant, key)}||{quote(plant.after)})"


def pick_sql(key: str, expression) -> str:
    """A CASE over the plant chosen by the key."""
    cases = " ".join(f"WHEN {i} THEN {expression(p)}" for i, p in enumerate(PLANTS))
    return f"(CASE {key} % {len(PLANTS)} {cases} END)"


def wrapped_sql(text: str, key: str) -> str:
    return f"({text}||chr(10)||{pick_sql(key, lambda p: line_sql(p, key))}||chr(10)||'thanks')"


WRAPPED_DOCUMENTS = f"SELECT doc_id, {wrapped_sql('text', 'doc_id')} AS text FROM documents"


def entropy_sql(value: str) -> str:
    shares = (
        f"list_transform(list_distinct(string_split({value}, '')), "
        f"lambda c: (length({value}) - length(replace({value}, c, '')))::DOUBLE / length({value}))"
    )
    return f"list_sum(list_transform({shares}, lambda p: -p * log2(p)))"


def detect_sql(source: str, rules: Sequence[Rule] = BUILTIN_RULES) -> str:
    """``WITH`` clause whose last table, ``found``, has one row per finding of ``source(doc_id, text)``."""
    branches = []
    for prio, rule in enumerate(rules):
        p = quote(rule.pattern)
        branches.append(
            f"SELECT doc_id, line_no, line, {prio} AS prio, regexp_extract_all(line, {p}, 0) AS whole, "
            f"regexp_extract_all(line, {p}, {rule.group}) AS val, string_split_regex(line, {p}) AS gaps "
            f"FROM lines WHERE regexp_matches(line, {p})"
        )
    rows = ", ".join(
        f"({i}, '{r.name}', '{r.category}', {r.base}::DOUBLE, {r.severity}::DOUBLE, {r.min_entropy}::DOUBLE)"
        for i, r in enumerate(rules)
    )
    masked = " AND ".join(f"NOT starts_with(v, '{p}')" for p in (MASK_PREFIX, INLINE_PREFIX, VAULT_PREFIX))
    order = "PARTITION BY doc_id, line_no ORDER BY s, e, m, prio"
    window = "substr(line, greatest(m - 40, 0) + 1, s - greatest(m - 40, 0))"
    return f"""
WITH src AS ({source}),
rule_table(prio, rule_id, category, base, severity, bits) AS (VALUES {rows}),
lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no
  FROM (SELECT doc_id, string_split(replace(text, chr(13)||chr(10), chr(10)), chr(10)) AS l FROM src)),
raw AS ({" UNION ALL ".join(branches)}),
hits AS (SELECT *, unnest(generate_series(1, len(whole))) AS k FROM raw),
placed AS (
  SELECT doc_id, line_no, line, prio, val[k] AS v, whole[k] AS w,
    (list_sum(list_transform(gaps[1:k], lambda g: length(g)))
     + coalesce(list_sum(list_transform(whole[1:k-1], lambda f: length(f))), 0))::BIGINT AS m
  FROM hits),
spans AS (
  SELECT doc_id, line_no, line, prio, m, m + length(w) - length(v) AS s, m + length(w) AS e
  FROM placed JOIN rule_table USING (prio)
  WHERE v <> '' AND {masked} AND (bits = 0 OR {entropy_sql("v")} >= bits)),
marked AS (
  SELECT *, CASE WHEN s < max(e) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    THEN 0 ELSE 1 END AS fresh FROM spans),
grouped AS (SELECT *, sum(fresh) OVER ({order} ROWS UNBOUNDED PRECEDING) AS grp FROM marked),
merged AS (
  SELECT doc_id, line_no, any_value(line) AS line, min(s) AS s, max(e) AS e, min(m) AS m, min(prio) AS prio
  FROM grouped GROUP BY doc_id, line_no, grp),
valued AS (
  SELECT *, substr(line, s + 1, e - s) AS value,
    CASE WHEN regexp_matches({window}, '{CONTEXT_WORDS}') THEN 1.0 ELSE 0.0 END::DOUBLE AS context_score
  FROM merged JOIN rule_table USING (prio)),
weighed AS (SELECT *, least(1.0, {entropy_sql("value")} / 5)::DOUBLE AS entropy_score FROM valued),
rated AS (
  SELECT *, CASE WHEN category = 'custom' AND regexp_matches(value, '{PATH_LIKE}') THEN 0.2
    ELSE least(1.0, base + 0.1 * entropy_score + 0.1 * context_score) END::DOUBLE AS confidence FROM weighed),
found AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, s)::INTEGER AS ordinal,
    line_no::INTEGER AS line, line AS line_text, (s + 1)::INTEGER AS col, rule_id, category, value,
    entropy_score, context_score, confidence, round(severity * confidence, 2) AS risk FROM rated)
"""


def masked_sql(source: str, token: str = "'[REDACTED_'||category||']'") -> str:
    """``WITH`` clause up to ``masked(doc_id, masked_text, n_findings, secret_lines)``.

    Within a line the values are replaced one after the other, the longest first.
    """
    return (
        detect_sql(source)
        + f""", fills AS (
  SELECT doc_id, line, any_value(line_text) AS line_text,
    list({{'v': value, 't': {token}}} ORDER BY length(value) DESC, ordinal) AS fill
  FROM found GROUP BY doc_id, line),
new_lines AS (
  SELECT doc_id, line,
    list_reduce(list_concat([{{'v': '', 't': line_text}}], fill),
      lambda a, x: {{'v': '', 't': replace(a.t, x.v, x.t)}}).t AS new_line
  FROM fills),
rebuilt AS (
  SELECT l.doc_id, string_agg(coalesce(new_line, l.line), chr(10) ORDER BY line_no) AS new_text
  FROM lines l LEFT JOIN new_lines n ON (l.doc_id = n.doc_id AND l.line_no = n.line)
  GROUP BY l.doc_id),
counts AS (
  SELECT doc_id, count(*)::INTEGER AS n, count(DISTINCT line)::INTEGER AS n_lines FROM found GROUP BY doc_id),
masked AS (
  SELECT s.doc_id, CASE WHEN n IS NULL THEN text ELSE new_text END AS masked_text,
    coalesce(n, 0)::INTEGER AS n_findings, coalesce(n_lines, 0)::INTEGER AS secret_lines
  FROM src s LEFT JOIN counts c ON s.doc_id = c.doc_id LEFT JOIN rebuilt r ON s.doc_id = r.doc_id)
"""
    )

"""Shared parts of the check queries: the same jobs written in plain SQL for another engine.

`SIGNALS` finds signals with joins and windows over exploded lines and matches; the Spark jobs do
the same work inside array columns. Only the fixed rule values are shared.
"""

from __future__ import annotations

import re

from ..functions import fixed
from ..sources.forms import FIRST_FORM_ID, FORM_TEXT


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(words) -> str:
    return "(" + ", ".join(quote(w) for w in words) + ")"


def typed(sql: str, columns: str) -> str:
    """Give the result columns exact types: 'a bigint, b varchar'."""
    pairs = [c.strip().rsplit(" ", 1) for c in columns.split(",")]
    picked = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in pairs)
    head, _, body = sql.rpartition("\n-- result\n")
    return f"{head}\nSELECT {picked} FROM ({body}) q" if head else f"SELECT {picked} FROM ({sql}) q"


CORPUS = f"""corpus AS (
  SELECT doc_id, source, text FROM documents
  UNION ALL
  SELECT {FIRST_FORM_ID} + k, source, {FORM_TEXT} FROM (
    SELECT c_custkey AS k, c_name, n_name AS source
    FROM customer JOIN nation ON c_nationkey = n_nationkey))"""

LINES = """ln AS (
  SELECT doc_id, line_number, line,
    coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_number
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_start
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
          unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_number FROM corpus) t)"""


def spans(source: str, keys: str, text: str, pattern: str, extra: str = "") -> str:
    """All matches of a pattern with positions."""
    p = quote(pattern)
    return f"""(SELECT {keys}{extra}, v, n,
      (list_sum(list_transform(gaps[1:n], lambda s: length(s)))
        + coalesce(list_sum(list_transform(hits[1:n-1], lambda s: length(s))), 0))::BIGINT AS s
    FROM (SELECT {keys}{extra}, hits, gaps, unnest(hits) AS v, unnest(range(1, len(hits) + 1)) AS n
      FROM (SELECT {keys}{extra}, regexp_extract_all({text}, {p}) AS hits,
              string_split_regex({text}, {p}) AS gaps
            FROM {source} WHERE regexp_matches({text}, {p})) h) u)"""


# Patterns as RE2 can run them; what look-around says is tested on the neighbour characters below.
_RE2 = {
    "uk_nino": r"(?i)\b[A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b",
    "handle": r"@[A-Za-z0-9_]{3,30}\b",
}


def pattern_sql(rule: fixed.PatternRule) -> str:
    return _RE2.get(rule.name) or ("(?i)" if rule.ignore_case else "") + rule.pattern


def _luhn(d: str) -> str:
    return (
        f"(list_sum(list_transform(range(1, length({d}) + 1), lambda i: "
        f"CASE WHEN i % 2 = 1 THEN ascii({d}[length({d}) + 1 - i]) - 48 "
        f"ELSE ((ascii({d}[length({d}) + 1 - i]) - 48) * 2) // 10 "
        f"+ ((ascii({d}[length({d}) + 1 - i]) - 48) * 2) % 10 END)) % 10 = 0)"
    )


def card(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    return (
        f"(length({d}) BETWEEN 13 AND 19 AND len(list_distinct(string_split({d}, ''))) > 1 "
        f"AND {_luhn(d)})"
    )


def _near(chars: int) -> str:
    return f"lower(substring(text, greatest(s - {chars}, 0) + 1, s + length(v) + {chars} - greatest(s - {chars}, 0)))"


def _any_of(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {quote(w)})" for w in words) + ")"


def checks(name: str) -> str:
    before = "regexp_extract(substring(text, 1, s), '[0-9 ().+-]*$')"
    after = "regexp_extract(substring(text, s + length(v) + 1), '^[0-9 ().+-]*')"
    run = f"concat({before}, v, {after})"
    plain_digits = "regexp_replace({}, '[^0-9]', '', 'g')"
    return {
        "phone": (
            f"length({plain_digits.format('v')}) BETWEEN 7 AND 15"
            f" AND NOT regexp_full_match(trim(v), {quote(fixed.DATE_LIKE)})"
            r" AND NOT regexp_full_match(trim(v), '\d{3}-\d{2}-\d{4}')"
            f" AND NOT {card('v')} AND length({plain_digits.format(run)}) <= 15 AND NOT {card(run)}"
            f" AND (regexp_matches(v, '[+ ().-]') OR {_any_of(_near(32), fixed.PHONE_WORDS)})"
        ),
        "amount": _any_of(_near(48), fixed.AMOUNT_WORDS),
        "ipv4": "len(list_filter(string_split(v, '.'), lambda x: CAST(x AS INT) > 255)) = 0",
        "payment_card": card("v"),
        "url": _any_of("lower(v)", fixed.URL_HINTS),
        "uk_nino": "upper(v[1:2]) NOT IN ('BG','GB','KN','NK','NT','TN','ZZ')",
        "handle": "NOT regexp_matches(substring(text, s, 1), '[A-Za-z0-9._%+-]')",
    }.get(name, "true")


def _boundary() -> str:
    """RE2 knows ASCII word characters only; a neighbour letter of another script is no boundary."""
    other = r"[^\x00-\x7F]"
    return (
        f"NOT (regexp_matches(substring(text, s, 1), {quote(other)}) AND "
        r"regexp_matches(substring(text, s, 1), '[\p{L}\p{N}]') AND regexp_matches(v, '^[A-Za-z0-9_]') AND s > 0)"
        r" AND NOT (regexp_matches(substring(text, s + length(v) + 1, 1), '[\p{L}\p{N}]') AND "
        r"regexp_matches(v, '[A-Za-z0-9_]$'))"
    )


def rule_hits(names, source: str = "corpus") -> str:
    """All checked matches of some pattern rules: doc_id, rule, rule_order, s, e, v."""
    parts = []
    for order, rule in enumerate(fixed.PATTERN_RULES, start=1):
        if rule.name in names:
            found = spans(source, "doc_id, text", "text", pattern_sql(rule))
            parts.append(
                f"SELECT doc_id, {quote(rule.name)} AS rule, {order} AS rule_order, s, s + length(v) AS e, v, text"
                f" FROM {found} m WHERE {_boundary()} AND {checks(rule.name)}"
            )
    return " UNION ALL ".join(parts)


def _clean(label: str) -> str:
    return f"trim(regexp_replace(translate({label}, '_-', '  '), '\\s+', ' ', 'g'))"


def filled(v: str) -> str:
    return (
        f"(length({v}) >= 2 AND NOT regexp_full_match({v}, '[\\s._/\\\\|()\\[\\]{{}}-]+')"
        f" AND lower(trim({v}, ' _.-/')) NOT IN {values(fixed.PLACEHOLDER_VALUES)}"
        f" AND regexp_matches({v}, '[\\p{{L}}\\p{{N}}]'))"
    )


def _case(folded: str, plain: str, v: str) -> str:
    lines = []
    for i, rule in enumerate(fixed.MULTILINGUAL_RULES + fixed.ENGLISH_RULES, start=1):
        out = str(i)
        if rule in fixed.MULTILINGUAL_RULES:
            test = "(" + " OR ".join(
                f"contains({folded}, strip_accents({quote(w.lower().replace('-', ' '))}))" for w in rule.words) + ")"
        elif rule.test in ("equals", "handle"):
            test = f"{plain} IN {values(rule.words)}"
        else:
            test = _any_of(plain, rule.words)
        if rule.test == "passport":
            out = f"CASE WHEN regexp_matches({v}, '(?i)\\b[A-Z]{{1,3}}[A-Z0-9]{{5,12}}\\b') AND regexp_matches({v}, '[0-9]') THEN {i} END"
        if rule.test == "employee":
            test = f"({test} OR regexp_matches({v}, '(?i)\\b(EMP|EE|E)-\\d{{3,8}}\\b'))"
        if rule.test == "handle":
            test = f"({test} AND regexp_full_match({v}, '[A-Za-z][A-Za-z0-9._-]{{2,63}}'))"
        if rule.test == "person":
            test = (f"({test} AND NOT {_any_of(plain, fixed.NOT_A_PERSON_LABEL)}"
                    f" AND NOT {_any_of(f'lower({v})', fixed.NOT_A_PERSON_VALUE)})")
        lines.append(f"WHEN {test} THEN {out}")
    return "CASE " + "\n".join(lines) + " END"


RULES = "rules(rule, type, detector, marker, confidence) AS (VALUES " + ", ".join(
    f"({i}, {quote(r.signal_type)}, {quote(r.detector)}, {quote(r.marker)}, {r.confidence}::DOUBLE)"
    for i, r in enumerate(fixed.MULTILINGUAL_RULES + fixed.ENGLISH_RULES, start=1)
) + ")"

_ALIASES = sorted(set(fixed.INLINE_LABELS + fixed.MULTILINGUAL_WORDS), key=len, reverse=True)
_ALT = "|".join(re.escape(a).replace("\\ ", " ").replace("\\-", "-") for a in _ALIASES)
_SCRIPT = "[一-鿿぀-ヿ가-힯؀-ۿ]"
_BLANK_ALT = "|".join(a for a in _ALIASES if a in fixed.WHITESPACE_LABELS or re.search(_SCRIPT, a))
_SEP = "[:：#=]|[-–—]"
_P1 = f"(?i)(?:{_ALT})\\s*(?:{_SEP})\\s*"
_P2 = f"(?i)(?:{_BLANK_ALT})"

_STRONGER = " OR ".join(
    f"(w.type = {quote(kind)} AND a.type IN {values(stronger)})" for kind, stronger in fixed.STRONGER_TYPES.items()
)
_BLOCKS = (
    "a.doc_id = w.doc_id AND ((a.type = w.type AND a.snippet = w.snippet) OR (a.s < w.e AND w.s < a.e "
    f"AND (a.type = w.type OR {_STRONGER})))"
)

INLINE = f"""p1 AS (
  SELECT doc_id, line_number, line_start, line, s AS ms, s + length(v) AS me,
    {_clean(f"regexp_extract(v, {quote(f'(?i)^(?:{_ALT})')})")} AS label,
    regexp_extract(regexp_replace(v, {quote(f'(?i)^(?:{_ALT})')}, ''), {quote(_SEP)}) AS sep
  FROM {spans('ln', 'doc_id, line_number, line_start, line', 'line', _P1)} m
  WHERE NOT (regexp_matches(substring(line, s, 1), '[A-Za-z0-9_]') AND s > 0 AND regexp_matches(v, '^[A-Za-z0-9_]'))),
p1ok AS (SELECT * FROM p1 WHERE sep <> '=' OR lower(label) IN {values(fixed.EQUALS_LABELS)}),
p2raw AS (
  SELECT doc_id, line_number, line_start, line, s,
    CASE WHEN regexp_matches(substring(line, s + length(v) + 1), '^\\s+\\S') THEN v
         WHEN lower(v) = 'passport number' THEN substring(v, 1, 8) END AS v
  FROM {spans('ln', 'doc_id, line_number, line_start, line', 'line', _P2)} m),
p2 AS (
  SELECT doc_id, line_number, line_start, line, s AS ms, s + length(v) AS me, {_clean('v')} AS label, '' AS sep
  FROM p2raw m WHERE v IS NOT NULL
    AND NOT (regexp_matches(substring(line, s, 1), '[A-Za-z0-9_]') AND s > 0 AND regexp_matches(v, '^[A-Za-z0-9_]'))),
labels_in AS (
  SELECT * FROM p1ok UNION ALL
  SELECT * FROM p2 WHERE NOT EXISTS (SELECT 1 FROM p1ok a WHERE a.doc_id = p2.doc_id
    AND a.line_number = p2.line_number AND a.ms < p2.me AND p2.ms < a.me)),
inline_raw AS (
  SELECT *, substring(line, me + 1, lead(ms, 1, length(line)) OVER (PARTITION BY doc_id, line_number ORDER BY ms) - me) AS raw
  FROM labels_in),
inline_cut AS (
  SELECT *, me + length(raw) - length(ltrim(raw, ' ' || chr(9))) AS vs,
    CASE WHEN sep = '=' AND regexp_matches(ltrim(raw), '^(''[^'']*''|"[^"]*")') THEN regexp_extract(ltrim(raw), '^(''[^'']*''|"[^"]*")')
         WHEN sep = '=' THEN regexp_extract(ltrim(raw), '^[^\\s;,|]*')
         ELSE trim(raw, ' ' || chr(9)) END AS v0 FROM inline_raw),
inline_values AS (
  SELECT doc_id, line_number, line_start, line, ms, label, vs, trim(regexp_replace(v0, '[ \\t;,|]+$', '')) AS v
  FROM inline_cut WHERE length(trim(regexp_replace(v0, '[ \\t;,|]+$', ''))) > 0)"""

_FOLDED = "strip_accents(lower(label))"
SIGNALS = f"""{CORPUS},
{LINES},
{RULES},
{INLINE},
inline_ruled AS (SELECT doc_id, line_number, line_start, ms, label, vs, v,
    {_case(_FOLDED, 'lower(label)', 'v')} AS rule FROM inline_values WHERE {filled('v')}),
inline_sig AS (SELECT * FROM inline_ruled WHERE rule IS NOT NULL),
whole AS (
  SELECT doc_id, line_number, line_start, 0 AS ms, {_clean("regexp_extract(line, '^\\s*([^:：]{1,72})\\s*[:：]', 1)")} AS label,
    length(regexp_extract(line, '^\\s*[^:：]{{1,72}}\\s*[:：]\\s*')) AS vs,
    regexp_extract(line, '^\\s*[^:：]{{1,72}}\\s*[:：]\\s*(.+?)\\s*$', 1) AS v
  FROM ln WHERE regexp_matches(line, '^\\s*[^:：]{{1,72}}\\s*[:：]\\s*.+')
    AND NOT EXISTS (SELECT 1 FROM inline_sig i WHERE i.doc_id = ln.doc_id AND i.line_number = ln.line_number)),
label_sig AS (
  SELECT * FROM inline_sig UNION ALL
  SELECT * FROM (SELECT doc_id, line_number, line_start, ms, label, vs, v, {_case(_FOLDED, 'lower(label)', 'v')} AS rule
    FROM whole WHERE {filled('v')}) w WHERE rule IS NOT NULL),
label_all AS (
  SELECT doc_id, type, detector, confidence, substring(label || ': ' || marker, 1, 180) AS snippet,
    line_start + vs AS s, line_start + vs + length(v) AS e, line_number, line_number AS o1, ms AS o2
  FROM label_sig JOIN rules USING (rule)),
label_acc AS (SELECT * FROM label_all QUALIFY row_number() OVER (PARTITION BY doc_id, type, snippet ORDER BY o1, o2) = 1),
stack_label AS (SELECT doc_id, line_number, {_clean("regexp_replace(trim(line), '[:：#=–—-]+$', '')")} AS label FROM ln
  WHERE NOT regexp_matches(line, '[0-9/\\\\|{{}}\\[\\]()]') AND lower({_clean("regexp_replace(trim(line), '[:：#=–—-]+$', '')")})
    IN {values(sorted({w.lower() for w in fixed.STACKED_LABELS + fixed.MULTILINGUAL_WORDS}))}),
stack_value AS (
  SELECT l.doc_id, l.line_number AS label_line, l.label, v.line_number, v.line_start, v.line, trim(v.line) AS v,
    row_number() OVER (PARTITION BY l.doc_id, l.line_number ORDER BY v.line_number) AS k
  FROM stack_label l JOIN ln v ON v.doc_id = l.doc_id AND v.line_number BETWEEN l.line_number + 1 AND l.line_number + 3
  WHERE trim(v.line) <> ''),
stack_ruled AS (SELECT *, {_case(_FOLDED, 'lower(label)', 'v')} AS rule FROM stack_value x WHERE k = 1 AND {filled('v')}
  AND NOT EXISTS (SELECT 1 FROM stack_label o WHERE o.doc_id = x.doc_id AND o.line_number = x.line_number)),
stack_all AS (
  SELECT doc_id, type, detector || '_stacked' AS detector, greatest(0, confidence - 0.02::DOUBLE) AS confidence,
    substring(label || ': ' || marker, 1, 180) AS snippet, line_start + length(line) - length(ltrim(line)) AS s,
    line_start + length(line) - length(ltrim(line)) + length(v) AS e, line_number, label_line AS o1, 0 AS o2
  FROM stack_ruled JOIN rules USING (rule) WHERE type IN {values(fixed.STACKED_TYPES)}),
stack_acc AS (SELECT * FROM stack_all w WHERE NOT EXISTS (SELECT 1 FROM label_acc a WHERE {_BLOCKS})
  QUALIFY row_number() OVER (PARTITION BY doc_id, type, snippet ORDER BY o1) = 1),
early AS (SELECT 1 AS stage, * FROM label_acc UNION ALL SELECT 2, * FROM stack_acc),
prules(rule, type, detector, confidence, snippet) AS (VALUES {", ".join(
    f"({quote(r.name)}, {quote(r.signal_type)}, {quote(r.detector)}, {r.confidence}::DOUBLE, "
    f"{quote(r.signal_type.replace('_', ' ').title() + ': ' + r.marker)})" for r in fixed.PATTERN_RULES)}),
pat_all AS (
  SELECT doc_id, type, detector, confidence, snippet, s, e,
    1 + length(substring(text, 1, s)) - length(replace(substring(text, 1, s), chr(10), '')) AS line_number,
    rule_order AS o1, s AS o2
  FROM ({rule_hits([r.name for r in fixed.PATTERN_RULES])}) h JOIN prules USING (rule)),
pat_acc AS (SELECT * FROM pat_all w WHERE NOT EXISTS (SELECT 1 FROM early a WHERE {_BLOCKS})
  QUALIFY row_number() OVER (PARTITION BY doc_id, type, snippet ORDER BY o1, o2) = 1),
sig AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY stage, o1, o2) AS seq,
    type, detector, confidence, snippet, s, e, line_number, stage
  FROM (SELECT * FROM early UNION ALL SELECT 3, * FROM pat_acc) t)"""

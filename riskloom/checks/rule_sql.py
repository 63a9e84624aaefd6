"""The detection rules again, in SQL: the independent twin the Spark rules are compared with."""

from __future__ import annotations

from riskloom.checks.views import quoted, sql_list
from riskloom.functions.regexes import SPACE_CHARS, for_duckdb
from riskloom.functions.text import BASE64_RUN, TOKEN_SEPARATORS, ZERO_WIDTH
from riskloom.operators import patterns as P

# DuckDB has no look-ahead: (wider pattern, condition on the match).
_NO_LOOKAHEAD = {
    r"opacity\s*:\s*0(?![.])": (r"opacity\s*:\s*0\.?", "m NOT LIKE '%.'"),
    r"\bpip\s+install\s+(?:--user\s+)?(?!-r\b)\S+": (
        r"\bpip\s+install\s+(?:--user\s+)?\S+",
        r"NOT regexp_matches(m, '(?i)^pip\s+install\s+(?:--user\s+)?-r(?:$|[^A-Za-z0-9_])')"),
    r"\bnpm\s+install\s+(?!-[dD])\S+": (
        r"\bnpm\s+install\s+\S+", r"NOT regexp_matches(m, '(?i)^npm\s+install\s+-d')"),
}
SPACE_SET = quoted(SPACE_CHARS)
_SCORES = "tier, rule_no, k, i, rule_id, rule_name, severity, matched, start_at, n_chars, confidence"


def rx(pattern: str, ignore_case: bool = False) -> str:
    return quoted(for_duckdb(pattern, ignore_case))


# Places in the text of the characters that stay outside fences, one by one; null without a fence.
PREP = """v_prep AS MATERIALIZED (
 SELECT * EXCLUDE (f, g), CASE WHEN len(f) > 0 THEN flatten(list_transform(range(1, len(g) + 1), lambda i: range(
   (coalesce(list_sum(list_transform(g[1:i - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::BIGINT,
   (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::BIGINT))) END AS places
 FROM (SELECT *, lower(text) AS low, regexp_replace(text, '(?s)```.*?```', '', 'g') AS bare,
  regexp_extract_all(text, '(?s)```.*?```') AS f, string_split_regex(text, '(?s)```.*?```') AS g FROM v_src))"""


def _span_rows(inner: str) -> str:
    """Unnest (found, gaps) of ``inner`` to one row per match with its offset."""
    return f"""SELECT * EXCLUDE (found, gaps), found[i] AS m,
  CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start_at
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM ({inner}))"""


def _pattern_rule(rule: P.PatternRule, number: int) -> str:
    source = "bare" if rule.outside_fences else "text"
    parts, keep = [], []
    for k, pat in enumerate(rule.patterns):
        regex, condition = _NO_LOOKAHEAD.get(pat.regex, (pat.regex, None))
        r = rx(regex, pat.ignore_case)
        if condition:
            keep.append(f"(k <> {k} OR {condition})")
        parts.append(
            f"SELECT item_id, {'places' if rule.outside_fences else 'NULL::BIGINT[]'} AS places, {k} AS k, {quoted(pat.name)} AS rule_name, {pat.severity} AS severity, "
            f"{pat.confidence} AS confidence, {pat.content_chars or 2**31 - 1} AS chars, "
            f"regexp_extract_all({source}, {r}) AS found, string_split_regex({source}, {r}) AS gaps "
            f"FROM v_prep WHERE regexp_matches({source}, {r})"
        )
    rows = _span_rows(" UNION ALL ".join(parts))
    where = f" WHERE {' AND '.join(keep)}" if keep else ""
    return (
        f"SELECT item_id, '{rule.tier}' AS tier, {number} AS rule_no, k, i, '{rule.rule_id}' AS rule_id, rule_name, "
        "severity, m[1:chars] AS matched, CASE WHEN places IS NULL THEN start_at ELSE places[start_at + 1] END AS start_at, "
        "CASE WHEN places IS NULL THEN length(m) ELSE places[start_at + length(m)] + 1 - places[start_at + 1] END AS n_chars, "
        f"confidence FROM ({rows}){where}"
    )


def _count_rule(number, k, rule_id, name, count, least, severity, matched, confidence, source="v_prep") -> str:
    return (
        f"SELECT item_id, 'structural' AS tier, {number} AS rule_no, {k} AS k, 1 AS i, '{rule_id}' AS rule_id, "
        f"'{name}' AS rule_name, {severity} AS severity, n || '{matched}' AS matched, 0 AS start_at, 0 AS n_chars, "
        f"{confidence} AS confidence FROM (SELECT item_id, {count} AS n FROM {source}) WHERE n >= {least}"
    )


def _base64_rule() -> str:
    r = quoted(BASE64_RUN)
    rows = _span_rows(
        f"SELECT item_id, regexp_extract_all(text, {r}) AS found, string_split_regex(text, {r}) AS gaps FROM v_prep "
        f"WHERE regexp_matches(text, {r})"
    )
    bare = "rtrim(m, '=')"
    usable = f"CASE WHEN length({bare}) % 4 = 1 THEN {bare}[1:-2] ELSE {bare} END"
    padded = f"rpad(u, CAST(4 * ceil(length(u) / 4.0) AS INTEGER), '=')"
    plain = f"decode(from_base64({padded}))"
    hits = " OR ".join(f"regexp_matches(p, {rx(s, True)})" for s in P.SUSPICIOUS_DECODED)
    return (
        "SELECT item_id, 'structural' AS tier, 2 AS rule_no, 0 AS k, i, 'STRUCT-002' AS rule_id, 'Base64 Payload' AS rule_name, "
        "0.8 AS severity, m[1:60] || CASE WHEN length(m) > 60 THEN '...' ELSE '' END AS matched, start_at, length(m) AS n_chars, "
        f"0.85 AS confidence FROM (SELECT *, TRY({plain}) AS p FROM (SELECT *, {usable} AS u FROM ({rows}))) WHERE {hits}"
    )


def _link_rule() -> str:
    r = quoted(P.MARKDOWN_LINK)
    rows = _span_rows(
        f"SELECT item_id, regexp_extract_all(text, {r}) AS found, string_split_regex(text, {r}) AS gaps FROM v_prep "
        f"WHERE regexp_matches(text, {r})"
    )
    return (
        "SELECT item_id, 'structural' AS tier, 5 AS rule_no, 0 AS k, i, 'STRUCT-005' AS rule_id, "
        "'Markdown Link Obfuscation' AS rule_name, "
        f"CASE WHEN regexp_matches(url, {rx(P.SCRIPT_OR_DATA_URL, True)}) THEN 0.85 ELSE 0.6 END AS severity, "
        "m[1:100] AS matched, start_at, length(m) AS n_chars, 0.8 AS confidence "
        f"FROM (SELECT *, regexp_extract(m, {r}, 2) AS url FROM ({rows})) "
        f"WHERE regexp_matches(url, {rx(P.SUSPICIOUS_URL, True)})"
    )


def _override_rule() -> str:
    w = P.OVERRIDE_WINDOW
    raised = f"len(list_filter({sql_list(P.OVERRIDE_MODIFIERS)}, lambda x: contains(win, x))) > 0"
    return (
        "SELECT item_id, 'contextual' AS tier, 11 AS rule_no, k, i, 'CTX-001' AS rule_id, 'Instruction Override' AS rule_name, "
        f"CASE WHEN {raised} THEN 0.80 ELSE 0.65 END AS severity, snip[1:100] AS matched, pos - 1 AS start_at, "
        f"least(length(snip), 100) AS n_chars, CASE WHEN {raised} THEN 0.90 ELSE 0.75 END AS confidence FROM ("
        f"SELECT item_id, k, i, pos, low[pos:pos + length(verb) + {w - 1}] AS win, "
        f"trim(text[pos:pos + length(verb) + {w - 1}], {SPACE_SET}) AS snip FROM ("
        "SELECT item_id, text, low, verb, k, i, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + (i - 1) * length(verb) + 1 AS BIGINT) AS pos "
        "FROM (SELECT *, unnest(range(1, len(gaps))) AS i FROM (SELECT item_id, text, low, verb, k, string_split(low, verb) AS gaps FROM v_prep, "
        f"(SELECT unnest({sql_list(P.OVERRIDE_VERBS)}) AS verb, unnest(range({len(P.OVERRIDE_VERBS)})) AS k) WHERE contains(low, verb))))) "
        f"WHERE len(list_filter({sql_list(P.OVERRIDE_NOUNS)}, lambda x: contains(win, x))) > 0"
    )


def _imperative_rule() -> str:
    return (
        "SELECT item_id, 'contextual' AS tier, 12 AS rule_no, i AS k, 1 AS i, 'CTX-002' AS rule_id, 'Imperative + System' AS rule_name, "
        "0.55 AS severity, snip[1:80] AS matched, instr(low, verb) - 1 AS start_at, length(snip) AS n_chars, 0.70 AS confidence FROM ("
        "SELECT item_id, low, i, toks[i] AS verb, array_to_string(toks[i:i + 5], ' ') AS snip, toks[i + 1:i + 5] AS win FROM ("
        "SELECT item_id, low, toks, unnest(range(1, len(toks) + 1)) AS i FROM ("
        f"SELECT item_id, low, list_filter(string_split_regex(low, {rx('[' + TOKEN_SEPARATORS + ']+')}), lambda x: x <> '') AS toks FROM v_prep)) "
        f"WHERE list_contains({sql_list(P.IMPERATIVE_VERBS)}, toks[i])) WHERE list_has_any(win, {sql_list(P.SYSTEM_NOUNS)})"
    )


def _mixed_count() -> str:
    word_mixed = (
        f"regexp_matches(w, '{P.LATIN}') AND regexp_matches(w, '{P.CYRILLIC_OR_GREEK}')"
    )
    return f"len(list_filter(string_split_regex(text, {rx(chr(92) + 's+')}), lambda w: {word_mixed}))"


_PATTERN_RULES = {
    3: P.HTML_INJECTION, 4: P.SCRIPT_URIS, 8: P.DATA_URIS, 9: P.HIDDEN_TEXT, 13: P.SHELL_COMMANDS, 14: P.TOOL_CALLS,
    15: P.ROLE_ASSUMPTION, 16: P.OUTPUT_MANIPULATION, 17: P.URGENCY, 18: P.payload_delivery(), 19: P.SENSITIVE_PATHS,
}
_ENT = f"len(regexp_extract_all(text, {quoted(P.HTML_ENTITY)}))"
_DBL = f"len(regexp_extract_all(text, {quoted(P.DOUBLE_ENCODED)}))"
RULE_SQL: dict[str, str] = {
    "STRUCT-001": _count_rule(1, 0, "STRUCT-001", "Zero-Width Characters", f"len(regexp_extract_all(text, '{ZERO_WIDTH}'))", 1,
                              "CASE WHEN n >= 5 THEN 0.8 ELSE 0.7 END", " zero-width character(s) found", 0.9),
    "STRUCT-002": _base64_rule(),
    "STRUCT-005": _link_rule(),
    "STRUCT-006": _count_rule(6, 0, "STRUCT-006", "Unicode Homoglyphs", _mixed_count(), 1,
                              "CASE WHEN n >= 5 THEN 0.85 WHEN n >= 3 THEN 0.75 ELSE 0.5 END",
                              " word(s) with mixed Unicode scripts", 0.75),
    "STRUCT-007": _count_rule(7, 0, "STRUCT-007", "Double URL Encoding", _DBL, 3, "0.80", " double-encoded sequences", 0.8)
    + " UNION ALL " + _count_rule(7, 1, "STRUCT-007", "Excessive HTML Entities", _ENT, 10, "0.80", " HTML entities", 0.7),
    "CTX-001": _override_rule(),
    "CTX-002": _imperative_rule(),
}
RULE_SQL.update({rule.rule_id: _pattern_rule(rule, n) for n, rule in _PATTERN_RULES.items()})

WEIGHT = (
    "(CASE WHEN s.is_external THEN 1.4 ELSE 1.0 END * CASE s.field_type WHEN 'description' THEN 1.2 "
    "WHEN 'attendee_name' THEN 1.3 ELSE 1.0 END)::DOUBLE"
)

# Detections of all rules over v_src, weighted; ``ord`` is the list position in a tier.
DETECTIONS = PREP + ",\nv_raw AS MATERIALIZED (" + "\n UNION ALL ".join(
    f"SELECT item_id, {_SCORES} FROM ({sql})" for _, sql in sorted(RULE_SQL.items())
) + f"""),
v_det AS MATERIALIZED (
 SELECT * FROM (SELECT r.* EXCLUDE (severity),
   CASE WHEN tier = 'contextual' THEN least(r.severity::DOUBLE * {WEIGHT}, 1.0) ELSE r.severity::DOUBLE END AS severity,
   row_number() OVER (PARTITION BY r.item_id, tier ORDER BY rule_no, k, i) AS ord
  FROM v_raw r JOIN v_src s USING (item_id)))"""

# Field scores, and the detection list (structural first; ``pos`` is its position).
SCORES = DETECTIONS + """,
v_tier AS (SELECT item_id, tier, least(max(severity) + least((count(*) - 1) * 0.05::DOUBLE, 0.15::DOUBLE), 1.0::DOUBLE) AS tier_score
 FROM v_det GROUP BY item_id, tier),
v_score AS MATERIALIZED (SELECT *, CASE risk_level WHEN 'critical' THEN 'block' WHEN 'dangerous' THEN 'redact' WHEN 'suspicious' THEN 'flag' ELSE 'pass' END AS action
 FROM (SELECT *, CASE WHEN risk_score >= 0.85 THEN 'critical' WHEN risk_score >= 0.6 THEN 'dangerous' WHEN risk_score >= 0.3 THEN 'suspicious' ELSE 'safe' END AS risk_level
 FROM (SELECT s.item_id, st, ct,
   CASE WHEN st > 0 AND ct > 0 THEN least((st * 0.40::DOUBLE + ct * 0.45::DOUBLE) * 1.15::DOUBLE, 1.0::DOUBLE) ELSE st * 0.40::DOUBLE + ct * 0.45::DOUBLE END AS risk_score
  FROM (SELECT s.item_id, coalesce(max(tier_score) FILTER (WHERE tier = 'structural'), 0::DOUBLE) AS st,
     coalesce(max(tier_score) FILTER (WHERE tier = 'contextual'), 0::DOUBLE) AS ct
    FROM v_src s LEFT JOIN v_tier t USING (item_id) GROUP BY s.item_id) s))),
v_kept AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE tier WHEN 'structural' THEN 0 ELSE 1 END, ord) AS pos
 FROM v_det))"""

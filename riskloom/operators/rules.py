"""Detection rules as native columns: text in, ``array<detection>`` out.

A rule reads the prepared columns of :class:`Prepared`. Nothing here shuffles
and nothing leaves the JVM; cheap guards keep the costly expressions off texts
that cannot match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.config import ScanConfig
from riskloom.functions import text as tx
from riskloom.functions.regexes import for_spark
from riskloom.operators import patterns as P
from riskloom.schemas import DETECTION, ddl


@dataclass(frozen=True)
class Prepared:
    """Columns a rule may read: the text, its lower-cased form, both without fences, and the anchor words of each."""

    text: Column
    low: Column
    bare: Column
    bare_low: Column
    words: Column
    bare_words: Column


PREPARED_NAMES = ("__text", "__low", "__bare", "__bare_low", "__words", "__bare_words")
CUTS = "__cuts"


def prepare(df: DataFrame, content: str, config: ScanConfig) -> DataFrame:
    """Add the columns rules read. Computed once here, referenced many times later."""
    text = tx.truncated(F.col(content), config.max_chars)
    df = df.withColumns({"__text": text, "__low": F.lower(text)})
    fenced = F.contains("__text", F.lit(tx.FENCE))
    bare = tx.without_fences(F.col("__text"))
    df = df.withColumns({
        "__bare": bare,
        "__bare_low": F.when(fenced, F.lower(bare)).otherwise(F.col("__low")),
        "__words": anchor_words(F.col("__text"), F.col("__low")),
        CUTS: tx.fence_cuts("__text"),
    })
    return df.withColumn("__bare_words", F.when(fenced, anchor_words(F.col("__bare"), F.col("__bare_low"))).otherwise(F.col("__words")))


#: Characters whose lower case holds ASCII letters though they are none.
ODD_LETTERS = "\u0130\u212a"


def anchor_words(text: Column, low: Column) -> Column:
    """The anchor words of all rules that stand in a text, distinct and in lower case: one pass for all of them.

    Letter case is folded in ASCII alone, as the patterns fold it: the few texts
    whose lower-cased form has other word edges are folded word by word.
    """
    anchors = F.array(*map(F.lit, ANCHOR_WORDS))
    odd = reduce(lambda a, b: a | b, (F.contains(text, F.lit(c)) for c in ODD_LETTERS))
    one_by_one = F.transform(F.split(text, NO_WORD), F.lower)
    return F.when(odd, F.array_intersect(one_by_one, anchors)).otherwise(F.array_intersect(F.split(low, NO_WORD), anchors))


def prepared_columns() -> Prepared:
    return Prepared(*(F.col(name) for name in PREPARED_NAMES))


def no_detections() -> Column:
    return F.array().cast(f"array<{ddl(DETECTION)}>")


def detection(tier, rule_id, rule_name, severity, matched, offset, length, confidence, metadata=None) -> Column:
    def as_col(value):
        return value if isinstance(value, Column) else F.lit(value)

    return F.struct(
        as_col(tier).alias("tier"), as_col(rule_id).alias("rule_id"), as_col(rule_name).alias("rule_name"),
        as_col(severity).cast("double").alias("severity"), as_col(matched).alias("matched"),
        as_col(offset).cast("int").alias("offset"), as_col(length).cast("int").alias("length"),
        as_col(confidence).cast("double").alias("confidence"),
        (metadata if metadata is not None else F.lit(None).cast("map<string,string>")).alias("metadata"),
    )


def _anchored(low: str, words: str, anchors: tuple[tuple[str, ...], ...]) -> str:
    def stands(lit: str) -> str:
        return f"array_contains({words}, '{lit}')" if isinstance(lit, P.Word) else f"contains({low}, {tx.literal(lit)})"

    # Words are looked up first: that reads a short list and not the text.
    by_cost = sorted(anchors, key=lambda group: not all(isinstance(lit, P.Word) for lit in group))
    return " and ".join(f"({' or '.join(map(stands, group))})" for group in by_cost)


def pattern_rule(rule: P.PatternRule) -> Column:
    """One detection per match, in pattern order and then match order.

    Each pattern only yields its matches and gap lengths; one shared expression
    turns the hits of all patterns into detections with offsets. Where fenced code
    is ignored, offsets and lengths are those in the whole text: a match that was
    put together across a fence covers the fence too.
    """
    text, low, words = ("__bare", "__bare_low", "__bare_words") if rule.outside_fences else ("__text", "__low", "__words")
    facts = ", ".join(
        f"named_struct('name', {tx.literal(pat.name)}, 'severity', {pat.severity}D, "
        f"'confidence', {pat.confidence}D, 'chars', {pat.content_chars or 2**31 - 1})"
        for pat in rule.patterns
    )
    def exact(pat: P.Pattern) -> str:
        """Which of the runs found are matches; null when all are."""
        if pat.scan is None:
            return "'ok', cast(null as array<boolean>)"
        # The run ends where the match does; what a closing word edge asks of the text behind it was checked there.
        whole = tx.literal(for_spark(f"^(?:{pat.regex.removesuffix(chr(92) + 'b')})$", pat.ignore_case))
        return f"'ok', transform(regexp_extract_all({text}, {tx.literal(for_spark(pat.scan, pat.ignore_case))}, 0), f -> rlike(f, {whole}))"

    def hit(k: int, pat: P.Pattern) -> str:
        # Most texts with the anchors hold no match: one search tells, where matches and gaps take two.
        regex = for_spark(pat.scan or pat.regex, pat.ignore_case)
        tried = f"{_anchored(low, words, pat.anchors)} and rlike({text}, {tx.literal(regex)})"
        return f"if({tried}, named_struct('k', {k}, {tx.found_and_gaps(text, regex)}, {exact(pat)}), null)"

    hits = ", ".join(hit(k, pat) for k, pat in enumerate(rule.patterns))
    first, length = "m.offset", "m.length"
    if rule.outside_fences:
        first = tx.place_before_cuts("m.offset", CUTS)
        length = f"if(size({CUTS}) = 0, m.length, {tx.place_before_cuts('m.offset + m.length - 1', CUTS)} + 1 - {first})"
    return F.expr(f"""flatten(transform(
        filter(array({hits}), h -> h is not null and size(h.found) > 0),
        h -> transform(filter({tx.located("h.found", "h.gaps")}, (m, i) -> coalesce(get(h.ok, i), true)), m -> named_struct(
            'tier', '{rule.tier}', 'rule_id', '{rule.rule_id}', 'rule_name', get(array({facts}), h.k).name,
            'severity', get(array({facts}), h.k).severity,
            'matched', substr(m.matched, 1, get(array({facts}), h.k).chars), 'offset', {first}, 'length', {length},
            'confidence', get(array({facts}), h.k).confidence, 'metadata', cast(null as map<string, string>)))))""")


def _single(condition: Column, found: Column) -> Column:
    """An aggregate rule: at most one detection."""
    return F.when(condition, F.array(found)).otherwise(no_detections())


def zero_width(p: Prepared) -> Column:
    count = F.size(F.regexp_extract_all(p.text, F.lit(tx.ZERO_WIDTH), F.lit(0)))
    made = tx.let(count, lambda n: _single(n > 0, detection(
        P.STRUCTURAL, "STRUCT-001", "Zero-Width Characters", F.when(n >= 5, 0.8).otherwise(0.7),
        F.concat(n.cast("string"), F.lit(" zero-width character(s) found")), 0, 0, 0.9,
        F.create_map(F.lit("count"), n.cast("string")),
    )))
    stands = reduce(lambda a, b: a | b, (F.contains(p.text, F.lit(c)) for c in tx.ZERO_WIDTH_CHARS))
    return F.when(stands, made).otherwise(no_detections())


def base64_payloads(p: Prepared) -> Column:
    decoded = F.transform(
        tx.spans("__text", tx.BASE64_RUN),
        lambda m: F.struct(m.alias("m"), tx.base64_text(m["matched"]).alias("plain")),
    )
    suspicious = for_spark("|".join(f"(?:{rx})" for rx in P.SUSPICIOUS_DECODED), ignore_case=True)
    return F.when(tx.may_hold_base64(p.text), F.transform(
        F.filter(decoded, lambda d: F.rlike(d["plain"], F.lit(suspicious))),
        lambda d: detection(
            P.STRUCTURAL, "STRUCT-002", "Base64 Payload", 0.8, tx.preview(d["m"]["matched"], 60, suffix=True),
            d["m"]["offset"], d["m"]["length"], 0.85,
            F.create_map(F.lit("decodedPreview"), tx.preview(d["plain"], 100)),
        ),
    )).otherwise(no_detections())


def markdown_links(p: Prepared) -> Column:
    links = F.transform(
        F.filter(tx.spans("__text", P.MARKDOWN_LINK_SCAN), lambda m: F.rlike(m["matched"], F.lit(f"^{P.MARKDOWN_LINK}$"))),
        lambda m: F.struct(m.alias("m"), F.regexp_extract(m["matched"], P.MARKDOWN_LINK, 2).alias("url")),
    )
    return F.when(F.contains(p.text, F.lit("](")), F.transform(
        F.filter(links, lambda k: F.rlike(k["url"], F.lit(for_spark(P.SUSPICIOUS_URL, ignore_case=True)))),
        lambda k: detection(
            P.STRUCTURAL, "STRUCT-005", "Markdown Link Obfuscation",
            F.when(F.rlike(k["url"], F.lit(for_spark(P.SCRIPT_OR_DATA_URL, ignore_case=True))), 0.85).otherwise(0.6),
            tx.preview(k["m"]["matched"], 100), k["m"]["offset"], k["m"]["length"], 0.8,
        ),
    )).otherwise(no_detections())


def mixed_scripts(p: Prepared) -> Column:
    mixed = F.size(F.filter(
        tx.words(p.text),
        lambda w: tx.has_non_ascii(w) & F.rlike(w, F.lit(P.LATIN)) & F.rlike(w, F.lit(P.CYRILLIC_OR_GREEK)),
    ))
    made = tx.let(mixed, lambda n: _single(n > 0, detection(
        P.STRUCTURAL, "STRUCT-006", "Unicode Homoglyphs",
        F.when(n >= 5, 0.85).when(n >= 3, 0.75).otherwise(0.5),
        F.concat(n.cast("string"), F.lit(" word(s) with mixed Unicode scripts")), 0, 0, 0.75,
        F.create_map(F.lit("mixedWords"), n.cast("string")),
    )))
    guard = tx.has_non_ascii(p.text) & F.rlike(p.text, F.lit(P.CYRILLIC_OR_GREEK))
    return F.when(guard, made).otherwise(no_detections())


def excessive_encoding(p: Prepared) -> Column:
    def counted(regex: str, least: int, name: str, tail: str, confidence: float, anchor: str) -> Column:
        count = F.size(F.regexp_extract_all(p.text, F.lit(regex), F.lit(0)))
        made = tx.let(count, lambda n: _single(n >= least, detection(
            P.STRUCTURAL, "STRUCT-007", name, 0.80, F.concat(n.cast("string"), F.lit(tail)), 0, 0, confidence,
            F.create_map(F.lit("count"), n.cast("string")),
        )))
        return F.when(F.contains(p.text, F.lit(anchor)), made).otherwise(no_detections())

    return F.concat(
        counted(P.DOUBLE_ENCODED, P.DOUBLE_ENCODED_MIN, "Double URL Encoding", " double-encoded sequences", 0.8, "%25"),
        counted(P.HTML_ENTITY, P.HTML_ENTITY_MIN, "Excessive HTML Entities", " HTML entities", 0.7, "&"),
    )


def instruction_override(p: Prepared, first_only: bool = False) -> Column:
    """Every occurrence of each verb (or its first), with a noun close behind it."""
    nouns, modifiers = (F.array(*map(F.lit, words)) for words in (P.OVERRIDE_NOUNS, P.OVERRIDE_MODIFIERS))

    def at_verb(verb: str) -> Column:
        reach = F.lit(len(verb) + P.OVERRIDE_WINDOW)
        places = tx.spans("__low", verb)
        found = F.transform(F.slice(places, 1, 1) if first_only else places, lambda m: tx.let(m["offset"] + 1, lambda at: F.struct(
            at.alias("at"), p.low.substr(at, reach).alias("window"), tx.strip(p.text.substr(at, reach)).alias("snippet"),
        )))
        none = F.array().cast("array<struct<at:int,window:string,snippet:string>>")
        return F.when(F.contains(p.low, F.lit(verb)), found).when(p.low.isNotNull(), none)

    def found(s: Column) -> Column:
        raised = F.exists(modifiers, lambda m: F.contains(s["window"], m))
        return detection(
            P.CONTEXTUAL, "CTX-001", "Instruction Override", F.when(raised, 0.80).otherwise(0.65),
            tx.preview(s["snippet"], 100), s["at"] - 1, F.least(F.length(s["snippet"]), F.lit(100)),
            F.when(raised, 0.90).otherwise(0.75),
        )

    windows = F.filter(
        F.concat(*map(at_verb, P.OVERRIDE_VERBS)), lambda s: F.exists(nouns, lambda n: F.contains(s["window"], n)))
    return F.transform(windows, found)


def imperative_system(p: Prepared) -> Column:
    """A verb token with a system noun among the next five tokens."""
    verbs, nouns = (F.array(*map(F.lit, words)) for words in (P.IMPERATIVE_VERBS, P.SYSTEM_NOUNS))
    sep, verb_set, noun_set = tx.TOKEN_SEPARATORS, "|".join(P.IMPERATIVE_VERBS), "|".join(P.SYSTEM_NOUNS)
    # Separators are no word characters, so Java's cheap \\b admits every verb token.
    guard = r"\b" + for_spark(
        f"(?:{verb_set})(?=(?:[{sep}]+[^{sep}]+){{0,{P.IMPERATIVE_REACH - 1}}}?[{sep}]+(?:{noun_set})(?![^{sep}]))"
    )

    def hits(toks: Column) -> Column:
        def at_token(token: Column, i: Column) -> Column:
            window = F.slice(toks, i + 2, F.lit(P.IMPERATIVE_REACH))
            return F.when(F.array_contains(verbs, token), F.struct(
                token.alias("verb"),
                F.get(F.filter(window, lambda w: F.array_contains(nouns, w)), F.lit(0)).alias("noun"),
                F.array_join(F.slice(toks, i + 1, F.lit(P.IMPERATIVE_REACH + 1)), " ").alias("snippet"),
            ))

        return F.filter(F.transform(toks, at_token), lambda h: h.isNotNull() & h["noun"].isNotNull())

    made = F.transform(tx.let(tx.tokens(p.low), hits), lambda h: detection(
        P.CONTEXTUAL, "CTX-002", "Imperative + System", 0.55, tx.preview(h["snippet"], 80),
        F.position(h["verb"], p.low) - 1, F.length(h["snippet"]), 0.70,
        F.create_map(F.lit("verb"), h["verb"], F.lit("noun"), h["noun"]),
    ))
    # The rule reads the lower-cased text, in which a Kelvin sign is a k; the words were found without that.
    stand = (F.arrays_overlap(p.words, verbs) & F.arrays_overlap(p.words, nouns)) | F.contains(p.text, F.lit("\u212a"))
    return F.when(stand & F.rlike(p.low, F.lit(guard)), made).otherwise(no_detections())


#: Every anchor word; packages exempt from a rule do not change its anchors.
NO_WORD = r"\W+"
ANCHOR_WORDS = sorted({
    lit for rule in (P.HTML_INJECTION, P.SCRIPT_URIS, P.DATA_URIS, P.HIDDEN_TEXT, P.SHELL_COMMANDS, P.TOOL_CALLS, P.ROLE_ASSUMPTION,
                     P.OUTPUT_MANIPULATION, P.URGENCY, P.payload_delivery(), P.SENSITIVE_PATHS)
    for pat in rule.patterns for group in pat.anchors for lit in group if isinstance(lit, P.Word)
} | {*P.IMPERATIVE_VERBS, *P.SYSTEM_NOUNS})

Rule = Callable[[Prepared], Column]


def _from(rule: P.PatternRule) -> Rule:
    return lambda _: pattern_rule(rule)


def tier_rules(config: ScanConfig) -> dict[str, dict[str, Rule]]:
    """Rules per tier, in the order their detections are listed."""
    return {
        P.STRUCTURAL: {
            "STRUCT-001": zero_width,
            "STRUCT-002": base64_payloads,
            "STRUCT-003": _from(P.HTML_INJECTION),
            "STRUCT-004": _from(P.SCRIPT_URIS),
            "STRUCT-005": markdown_links,
            "STRUCT-006": mixed_scripts,
            "STRUCT-007": excessive_encoding,
            "STRUCT-008": _from(P.DATA_URIS),
            "STRUCT-009": _from(P.HIDDEN_TEXT),
        },
        P.CONTEXTUAL: {
            "CTX-001": lambda p: instruction_override(p, config.first_override_only),
            "CTX-002": imperative_system,
            "CTX-003": _from(P.SHELL_COMMANDS),
            "CTX-004": _from(P.TOOL_CALLS),
            "CTX-005": _from(P.ROLE_ASSUMPTION),
            "CTX-006": _from(P.OUTPUT_MANIPULATION),
            "CTX-007": _from(P.URGENCY),
            "CTX-008": _from(P.payload_delivery(config.trusted_npx_packages)),
            "CTX-009": _from(P.SENSITIVE_PATHS),
        },
    }


def weighted(detections: Column, field_type: Column, external: Column) -> Column:
    """Contextual weighting by organizer and field, each severity capped at 1."""
    factor = F.when(external, P.EXTERNAL_WEIGHT).otherwise(1.0)
    by_field = reduce(
        lambda acc, item: acc.when(field_type == item[0], item[1]),
        list(P.FIELD_WEIGHTS.items())[1:],
        F.when(field_type == next(iter(P.FIELD_WEIGHTS)), next(iter(P.FIELD_WEIGHTS.values()))),
    ).otherwise(1.0)
    return F.transform(
        detections,
        lambda d: d.withField("severity", F.least(d["severity"] * (factor * by_field), F.lit(1.0))),
    )


def capped(detections: Column, limit: int | None) -> Column:
    return detections if limit is None else F.slice(detections, 1, limit)

"""Scalar text functions, all built from native Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.regexes import SPACE_CHARS, for_spark

# Token separators, zero-width characters, fenced code.
TOKEN_SEPARATORS = r"""\s,.;:!?()\[\]{}"'"""
ZERO_WIDTH = r"[\x{200B}\x{200C}\x{200D}\x{FEFF}\x{2060}\x{180E}]"
ZERO_WIDTH_CHARS = "\u200b\u200c\u200d\ufeff\u2060\u180e"
FENCE = "```"
FENCED = "(?s)```.*?```"
BASE64_RUN = "[A-Za-z0-9+/]{32,}={0,2}"
# A run starts where the character before is no run character: scanning stays linear.
BASE64_GUARD = "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32}"
# No run crosses a space; this is far cheaper to look for in prose. The text gets a space in front, so words are tried at their start only.
LONG_WORD = " [^ ]{32}"
_PREFIX_BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda acc, n: acc + n)


def strip(col: Column) -> Column:
    """Trim the wide white-space set on both sides."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def is_blank(col: Column) -> Column:
    return F.coalesce(strip(col) == "", F.lit(True))


def email_domain(email: Column) -> Column:
    """Lower-cased domain, only when there is exactly one ``@``."""
    parts = F.split(email, "@", -1)
    return F.when(F.size(parts) == 2, F.lower(F.get(parts, F.lit(1))))


def is_external(organizer_domain: Column, owner_domain: Column) -> Column:
    known = (F.coalesce(organizer_domain, F.lit("")) != "") & (F.coalesce(owner_domain, F.lit("")) != "")
    return F.coalesce(known & (organizer_domain != owner_domain), F.lit(False))


def truncated(col: Column, max_chars: int | None) -> Column:
    return col if max_chars is None else F.substring(col, 1, max_chars)


def without_fences(col: Column) -> Column:
    """Drop fenced code blocks; texts without a fence are passed through untouched."""
    return F.when(F.contains(col, F.lit(FENCE)), F.regexp_replace(col, FENCED, "")).otherwise(col)


def normalized(col: Column) -> Column:
    return strip(F.regexp_replace(F.lower(col), for_spark(r"\s+"), " "))


def tokens(lowered: Column) -> Column:
    return F.filter(F.split(lowered, for_spark(f"[{TOKEN_SEPARATORS}]+"), -1), lambda t: t != "")


def words(col: Column) -> Column:
    return F.split(col, for_spark(r"\s+"), -1)


def base64_text(run: Column) -> Column:
    """Lenient base64 to text: padding optional, bad bytes become U+FFFD."""
    bare = F.rtrim(F.translate(run, "=", " "))
    usable = F.when(F.length(bare) % 4 == 1, bare.substr(F.lit(1), F.length(bare) - 1)).otherwise(bare)
    return F.make_valid_utf8(F.unbase64(usable).cast("string"))


def preview(col: Column, width: int, suffix: bool = False) -> Column:
    cut = F.substring(col, 1, width)
    return F.concat(cut, F.when(F.length(col) > width, "...").otherwise("")) if suffix else cut


def may_hold_base64(col: Column) -> Column:
    return F.rlike(F.concat(F.lit(" "), col), F.lit(LONG_WORD)) & F.rlike(col, F.lit(BASE64_GUARD))


def has_non_ascii(col: Column) -> Column:
    return F.octet_length(col) > F.length(col)


def literal(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def found_and_gaps(text: str, pattern: str) -> str:
    """SQL: all matches of a pattern, and the lengths of the pieces of text around them."""
    regex = literal(pattern)
    return (
        f"'found', regexp_extract_all({text}, {regex}, 0), "
        f"'gaps', transform(split({text}, {regex}, -1), piece -> length(piece))"
    )


def located(found: str, gaps: str) -> str:
    """SQL: matches and gap lengths to ``array<struct<matched, offset, length>>``.

    Offsets are prefix sums. They are taken per block and then over the blocks,
    so a text with very many matches stays far from quadratic. (SQL text and not
    column calls: a rule set holds thousands of nodes, and one string is one
    round trip to the JVM.)
    """
    block = _PREFIX_BLOCK
    step_sum = "(acc, x) -> acc + x.gap + x.size"
    place = f"""transform({found}, (m, i) -> named_struct(
        'matched', m,
        'offset', get(bases, cast(floor(i / {block}) as int)) + get(steps, i).gap
            + aggregate(slice(steps, cast(floor(i / {block}) as int) * {block} + 1, i % {block}), 0, {step_sum}),
        'length', length(m)))"""
    bases = "transform(sums, (s, b) -> aggregate(slice(sums, 1, b), 0, (acc, x) -> acc + x))"
    sums = f"""transform(sequence(0, cast(floor((size(steps) - 1) / {block}) as int)),
        b -> aggregate(slice(steps, b * {block} + 1, {block}), 0, {step_sum}))"""
    steps = f"""zip_with(transform({found}, f -> length(f)), {gaps},
        (f, g) -> named_struct('gap', coalesce(g, 0), 'size', coalesce(f, 0)))"""
    return (
        f"get(transform(array({steps}), steps -> get(transform(array({sums}), sums -> "
        f"get(transform(array({bases}), bases -> {place}), 0)), 0)), 0)"
    )


def spans(text: str, pattern: str) -> Column:
    """Every match of ``pattern`` in column ``text`` with its code-point offset."""
    return F.expr(
        f"get(transform(array(named_struct({found_and_gaps(text, pattern)})), h -> {located('h.found', 'h.gaps')}), 0)"
    )


CUTS = "array<struct<at:int,removed:int>>"


def fence_cuts(text: str) -> Column:
    """Where :func:`without_fences` cut a text: offsets in what is left, ascending, with all that was removed up to there."""
    nothing = "transform(h.found, f -> '')"
    cuts = F.expr(
        f"get(transform(array(named_struct({found_and_gaps(text, FENCED)})), h -> zip_with("
        f"{located('h.found', 'h.gaps')}, {located(nothing, 'h.gaps')}, (o, c) -> named_struct("
        f"'at', cast(c.offset as int), 'removed', cast(o.offset + o.length - c.offset as int)))), 0)")
    return F.when(F.contains(text, F.lit(FENCE)), cuts.cast(CUTS)).otherwise(F.array().cast(CUTS))


def place_before_cuts(offset: str, cuts: str) -> str:
    """SQL: the offset in the whole text of an offset in the text without fences, by bisection of the cuts."""
    step = (
        f"(s, i) -> if(s.lo >= s.hi, s, if(get({cuts}, cast(floor((s.lo + s.hi) / 2) as int)).at <= {offset}, "
        "named_struct('lo', cast(floor((s.lo + s.hi) / 2) as int) + 1, 'hi', s.hi), "
        "named_struct('lo', s.lo, 'hi', cast(floor((s.lo + s.hi) / 2) as int))))")
    rounds = f"sequence(0, cast(ceil(log2(size({cuts}) + 1)) as int))"
    found = f"aggregate({rounds}, named_struct('lo', 0, 'hi', size({cuts})), {step}, s -> s.lo)"
    return f"if(size({cuts}) = 0, {offset}, {offset} + coalesce(get({cuts}, {found} - 1).removed, 0))"

"""Quality rules whose cutoffs are certified on labelled documents (DataFrame functions only).

A rule rejects a document when a feature exceeds a cutoff. For each stratum and
rule the cutoffs are tried from loose to strict. With k of the n good labelled
documents rejected, the exact binomial tail P(X <= k), X ~ Bin(n, a), is the
p-value of "this cutoff rejects more than a share a of the good documents". A
cutoff counts as certified while the p-value stays at or below the level, and the
strictest one of the unbroken run is used. A fixed sequence needs no correction
inside itself; over strata and rules the level is divided (Bonferroni), and the
share of false rejections allowed is split over the rules. So with probability
``1 - delta`` no stratum loses more than ``alpha`` of its good documents.

That split asks for many labels of every stratum. With ``joint`` the loss is
controlled as a whole: one sequence of combinations of cutoffs is tested against
``alpha`` on the good documents that any rule rejects, and the level is divided
over the strata alone. The sequence is fixed without a look at the good documents:
first the steps that reject labelled bad documents, those that spare most
unlabelled ones before others, then the remaining cutoffs. The last combination before the first failure holds.

Defined results: a null text is an empty text (no words, fails the base); labels
that are null, or that name no document, are ignored; a document labelled twice
counts once, as good only if every label says so; a null stratum is its own; with no certified cutoff a
rule rejects nothing; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType
from pyspark.sql.window import Window

from riskloom.llm.shared import kept

SPACES = r"[\x20\x09-\x0D]+"
SIGNS = r"[^#*$%&|<>]+"
WINDOW = 5


def _cutoffs() -> dict[str, tuple[float, ...]]:
    return {
        "sign_rate": (3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05),
        "dup_line_rate": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
        "repeat_rate": (0.19, 0.16, 0.13, 0.1, 0.07, 0.05),
        "long_word_rate": (60.0, 40.0, 25.0, 20.0, 16.0, 13.0, 11.0, 9.5, 8.5),
        "capital_rate": (0.95, 0.8, 0.6, 0.45, 0.35, 0.25, 0.2),
    }


@dataclass(frozen=True)
class RiskControl:
    """``alpha``: good documents a stratum may lose; ``delta``: chance that some stratum loses more."""

    alpha: float = 0.02
    delta: float = 0.05
    cutoffs: dict[str, tuple[float, ...]] = field(default_factory=_cutoffs)

    @property
    def rule_alpha(self) -> float:
        return self.alpha / len(self.cutoffs)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def _covered(words: Column) -> Column:
    """Words that lie in a window of five words found at least twice in the text."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))

    def spread(grams: Column) -> Column:
        pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        alike = lambda s, k, d: F.coalesce(F.get(s, k + d)["g"] == F.get(s, k)["g"], F.lit(False))
        places = _let(pairs, lambda s: F.array_sort(F.filter(
            F.transform(s, lambda p, k: F.when(alike(s, k, -1) | alike(s, k, 1), p["i"])), lambda x: x.isNotNull())))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            places, start,
            lambda a, p: F.struct((a["n"] + (p + WINDOW - F.greatest(a["end"], p))).cast("long").alias("n"), (p + WINDOW).alias("end")),
            lambda a: a["n"])

    repeats = _let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(spread(g)))
    return F.when(F.size(words) > WINDOW, repeats).otherwise(F.lit(0).cast("long"))


def _measures(text: Column) -> Column:
    """All measures of a text in one struct; its words and lines are split once."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    of_words = _let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _covered(w).alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(of_words.alias("w"), of_lines.alias("l"))


def measured(docs: DataFrame, stratum: str = "lang", whole: bool = False) -> DataFrame:
    """``doc_id, stratum`` and the measures of every row, with the ``whole`` row as the struct ``doc``. One narrow stage."""
    doc = [F.struct(*docs.columns).alias("doc")] if whole else []
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", F.col(stratum).alias("stratum"), _measures(text).alias("m"),
        F.length(F.regexp_replace(text, SIGNS, "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("n_capitals"), *doc)
    return rows.select(
        "doc_id", "stratum", "m.w.n_words", "m.w.word_chars", "n_symbols", "m.l.n_dup_lines", "m.w.n_repeat_words",
        "m.l.n_lines", "n_capitals", *(["doc"] if whole else []))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def features() -> dict[str, Column]:
    words, lines, chars = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines", "word_chars"))
    return {
        "sign_rate": F.col("n_symbols") / words, "dup_line_rate": F.col("n_dup_lines") / lines,
        "repeat_rate": F.col("n_repeat_words") / words, "long_word_rate": F.col("word_chars") / words,
        "capital_rate": F.col("n_capitals") / chars,
    }


def binomial_tail(n: Column, k: Column, share: float) -> Column:
    """P(X <= k) of X ~ Bin(n, share): the terms are summed exactly, each from the one before, in logs."""
    odds = math.log(share) - math.log1p(-share)
    first = n.cast("double") * math.log1p(-share)
    start = F.struct(first.alias("t"), F.exp(first).alias("p"))

    def step(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1).cast("double") / i) + odds
        return F.struct(t.alias("t"), (a["p"] + F.exp(t)).alias("p"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(terms, start, step, lambda a: a["p"])


def certified(rows: DataFrame, labels: DataFrame, control: RiskControl) -> DataFrame:
    """``stratum`` and a map from rule to its certified cutoff, for strata with a good labelled document."""
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    held = rows.where(~base_failed()).join(good, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    values = features()
    counts = [
        F.sum((values[rule] > F.lit(c)).cast("long")).alias(f"{rule}_{i}")
        for rule, cuts in control.cutoffs.items() for i, c in enumerate(cuts)]
    sums = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *counts)
    tries = F.explode(F.array(*(
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff"), F.col(f"{rule}_{i}").alias("k"))
        for rule, cuts in control.cutoffs.items() for i, c in enumerate(cuts))))
    long = sums.select("stratum", "n", tries.alias("t")).select("stratum", "n", "t.*")
    strata = sums.agg(F.count(F.lit(1))).scalar()
    level = F.lit(control.delta) / (strata * len(control.cutoffs))
    run = Window.partitionBy("stratum", "rule").orderBy("step")
    passed = long.withColumn("ok", (F.col("k") <= F.col("n") * control.rule_alpha) & (
        F.when(F.col("k") <= F.col("n") * control.rule_alpha, binomial_tail(F.col("n"), F.col("k"), control.rule_alpha)) <= level))
    unbroken = passed.withColumn("ok", F.min("ok").over(run)).where("ok")
    best = unbroken.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


Counted = list[tuple[tuple[int, ...], int]]


def sequence(bad: Counted, other: Counted, sizes: list[int]) -> Iterator[tuple[int, ...]]:
    """Combinations from loose to strict: per rule the place of its cutoff, -1 for none.

    ``bad`` and ``other`` count bad and unlabelled documents by the place of the
    first cutoff of each rule that rejects them (the number of cutoffs where none
    does). The rule is tightened that can reject most bad documents, against the
    share of the unlabelled ones; then the rest, those that reject fewest unlabelled first.
    """
    at = [-1] * len(sizes)
    n_bad, n_other = sum(n for _, n in bad), max(1, sum(n for _, n in other))

    def hit(counted: Counted, r: int, place: int) -> int:
        return sum(n for f, n in counted if f[r] <= place)

    while any(k < size - 1 for k, size in zip(at, sizes, strict=True)):
        steps = []
        for r, size in enumerate(sizes):
            places = {f[r] for f, _ in bad if f[r] < size}
            if places:
                gain = max(hit(bad, r, p) / (1 + n_bad * hit(other, r, p) / n_other) for p in places)
                steps.append((-gain, r, min(places)))
        if steps:
            _, r, at[r] = min(steps)
        else:
            _, _, r = min((hit(other, r, at[r] + 1), (at[r] + 1) / size, r) for r, size in enumerate(sizes) if at[r] < size - 1)
            at[r] += 1
        bad, other = ([(f, n) for f, n in rows if f[r] > at[r]] for rows in (bad, other))
        yield tuple(at)


def tail(n: int, k: int, share: float) -> float:
    """P(X <= k) of X ~ Bin(n, share), like :func:`binomial_tail`."""
    odds, t = math.log(share) - math.log1p(-share), n * math.log1p(-share)
    terms = [t]
    for i in range(1, k + 1):
        t += math.log((n - i + 1) / i) + odds
        terms.append(t)
    return math.fsum(map(math.exp, terms))


def jointly_certified(rows: DataFrame, labels: DataFrame, control: RiskControl) -> DataFrame:
    """Like :func:`certified`, with the loss of all rules together held to ``alpha``.

    Documents are counted by the cutoffs they meet; the driver gets those
    counts, whose number is bounded by strata and cutoffs.
    """
    told = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    passed = rows.where(~base_failed())
    held = passed.join(told, "doc_id").dropDuplicates(["doc_id"]).select(*rows.columns, "good").unionByName(
        passed.join(told, "doc_id", "left_anti").withColumn("good", F.lit(None).cast("boolean")))
    values, rules = features(), list(control.cutoffs)
    first = [sum(((values[r] <= F.lit(c)).cast("int") for c in control.cutoffs[r]), F.lit(0)).alias(f"first_{r}") for r in rules]
    counts: dict = {}
    for row in held.select("stratum", "good", *first).groupBy("stratum", "good", *(f"first_{r}" for r in rules)).count().collect():
        counts.setdefault(row["stratum"], {True: [], False: [], None: []})[row["good"]].append((tuple(row[f"first_{r}"] for r in rules), row["count"]))
    strata = sum(bool(c[True]) for c in counts.values())
    made = []
    for name, c in counts.items():
        n, best = sum(m for _, m in c[True]), None
        for combination in sequence(c[False], c[None], [len(control.cutoffs[r]) for r in rules]) if n else ():
            k = sum(m for f, m in c[True] if any(a <= b for a, b in zip(f, combination, strict=True)))
            if k > n * control.alpha or tail(n, k, control.alpha) > control.delta / strata:
                break
            best = combination
        if best:
            made.append((name, {r: float(control.cutoffs[r][k]) for r, k in zip(rules, best, strict=True) if k >= 0}))
    schema = StructType([rows.schema["stratum"], StructField("cutoffs", MapType(StringType(), DoubleType()))])
    return rows.sparkSession.createDataFrame(made, schema)


def judged(
    docs: DataFrame, labels: DataFrame, control: RiskControl = RiskControl(), stratum: str = "lang", joint: bool = False,
    whole: bool = False,
) -> DataFrame:
    """Measures of every row with ``base_failed``, ``rejected_by`` (rules) and ``kept``; ``whole`` rows are kept beside them as ``doc``.

    Measures are kept once as a table; texts are read once and never shuffled.
    """
    rows = kept(measured(docs, stratum, whole), "measures")
    narrow = rows.drop("doc")
    cutoffs = kept((jointly_certified if joint else certified)(narrow, labels, control), "cutoffs").withColumnRenamed("stratum", "__stratum")
    found = rows.join(cutoffs, F.col("stratum").eqNullSafe(F.col("__stratum")), "left").drop("__stratum")
    values = features()
    hits = F.array_compact(F.array(*(
        F.when(values[rule] > F.element_at(F.col("cutoffs"), rule), F.lit(rule)) for rule in control.cutoffs)))
    return found.withColumn("base_failed", base_failed()).withColumn(
        "rejected_by", F.when(F.col("cutoffs").isNull(), F.array().cast("array<string>")).otherwise(hits)).withColumn(
        "kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("cutoffs")


def filtered(
    docs: DataFrame, labels: DataFrame, control: RiskControl = RiskControl(), stratum: str = "lang", joint: bool = False,
) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns; every row is judged by its own stratum."""
    return judged(docs, labels, control, stratum, joint, whole=True).where("kept").select("doc.*")

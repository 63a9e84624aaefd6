"""Registered queries of the operators here, with SQL where it can say the same."""

from __future__ import annotations

import math
import string
import uuid
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return keep


def _rules_sql() -> str:
    """The same measures, exact tails (by log-gamma) and verdicts."""
    from riskloom.llm.quality_rules import RiskControl

    control = RiskControl()
    share, delta, rules = control.rule_alpha, control.delta, len(control.cutoffs)
    tries = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for r, cuts in control.cutoffs.items() for i, c in enumerate(cuts))
    names = list(control.cutoffs)
    hits = " || ".join(f"CASE WHEN {r} > c_{r} THEN ',{r}' ELSE '' END" for r in names)
    tail = (f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)"
            f" + i * {math.log(share)!r} + (n - i) * {math.log1p(-share)!r})))")
    return rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS c FROM g),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(5)) AS k) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
         len(l) AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals
  FROM d LEFT JOIN p ON p.doc_id = d.doc_id),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_symbols / greatest(n_words, 1) AS sign_rate, n_dup_lines / greatest(n_lines, 1) AS dup_line_rate,
         n_repeat_words / greatest(n_words, 1) AS repeat_rate, word_chars / greatest(n_words, 1) AS long_word_rate,
         n_capitals / greatest(word_chars, 1) AS capital_rate FROM m),
u AS (UNPIVOT (SELECT doc_id, lang, {", ".join(names)} FROM f WHERE NOT base_failed AND doc_id IN (
        SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1))
      ON {", ".join(names)} INTO NAME rule VALUE v),
t AS (SELECT * FROM (VALUES {tries}) AS t(rule, step, cutoff)),
k AS (SELECT coalesce(lang, '') AS lang, t.rule, step, cutoff, count(*) AS n, count(*) FILTER (v > cutoff) AS k
      FROM u JOIN t ON t.rule = u.rule GROUP BY ALL),
c AS (SELECT *, (k <= n * {share!r} AND {tail} <= {delta!r} / ((SELECT count(DISTINCT lang) FROM k) * {rules})) AS ok FROM k),
b AS (SELECT lang, rule, min(cutoff) AS cutoff FROM (
        SELECT *, bool_and(ok) OVER (PARTITION BY lang, rule ORDER BY step) AS run FROM c) WHERE run GROUP BY ALL),
v AS (SELECT f.*, {", ".join(f"(SELECT cutoff FROM b WHERE b.lang = coalesce(f.lang, '') AND rule = '{r}') AS c_{r}" for r in names)} FROM f),
h AS (SELECT *, substr({hits}, 2) AS rejected_by FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rejected_by = '' AS kept, rejected_by FROM h"""


@query("op2_quality_rules", _rules_sql())
def op2(spark, sf):
    from riskloom.llm import quality_rules

    rows = quality_rules.judged(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("rejected_by", ",").alias("rejected_by"))


@query("op3_candidate_boosting")
def op3(spark, sf):
    from riskloom.llm import pii_boost

    rows = pii_boost.found(table(spark, sf, "documents"))
    of_base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in pii_boost.KINDS[: pii_boost.BASE_KINDS]]
    return rows.select("doc_id", *counts, F.sha2(joined(of_base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op4_importance")
def op4(spark, sf):
    from riskloom.llm import importance

    return importance.resampled(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op5_recurrent_lm")
def op5(spark, sf):
    from riskloom.llm import recurrent_lm

    return recurrent_lm.scored(table(spark, sf, "documents"))


@query("op6_nnls_packing")
def op6(spark, sf):
    from riskloom.llm import packing_nnls

    return packing_nnls.filled(table(spark, sf, "documents")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op7_chosen_path")
def op7(spark, sf):
    from riskloom.llm import chosen_path

    return chosen_path.classes(table(spark, sf, "documents"))


@query("op8_virtual_slots")
def op8(spark, sf):
    from riskloom.llm import slots
    from riskloom.llm.shared import work_root

    rows = slots.shard_table(table(spark, sf, "documents"), map_path=f"{work_root(spark)}/slot_map-{uuid.uuid4().hex[:12]}")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        F.col("slot_no").alias("virtual_slot"))


@query("op9_curriculum")
def op9(spark, sf):
    from riskloom.llm import curriculum

    rows = curriculum.scheduled(table(spark, sf, "documents"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "times", "positions")


@query("op10_multi_index")
def op10(spark, sf):
    from riskloom.llm import multi_index

    vectors = table(spark, sf, "embeddings")
    return multi_index.nearest(vectors, F.col("vec_id") % 20 == 0)


@query("op1_best_fit_packing")
def op1(spark, sf):
    from riskloom.llm import packing_bfd

    return packing_bfd.packed(table(spark, sf, "documents"))


def _audit_sql() -> str:
    """Failures of every document, sums per mask, and all orders by hand."""
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))
    bit = "(1 << (ascii(substr(filter_order, {}, 1)) - 65))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
e AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic,
         (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
         + 4 * (100 * length(regexp_replace(w.t, '[^A-Z]+', '', 'g')) > 2 * length(w.t))::INT
         + 8 * regexp_matches(w.t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first_id, false)::INT AS mask
  FROM w JOIN e ON e.t = w.t LEFT JOIN l ON l.doc_id = w.doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
o AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM (VALUES {orders}) AS v(filter_order)),
s AS (SELECT *, {bit.format("step")} AS bit,
             coalesce(list_sum(list_transform(range(1, step), lambda i: {bit.format("i::INT")})), 0)::INT AS before FROM o)
SELECT part, filter_order, step,
       coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * 120 // nullif(bit_count(mask), 0)) FILTER (mask & bit <> 0), 0)::BIGINT AS shapley
FROM m, s GROUP BY ALL"""


@query("op12_bloom_audit", _audit_sql())
def op12(spark, sf):
    from riskloom.llm import filter_audit

    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op13_block_whitening")
def op13(spark, sf):
    from riskloom.llm import whitening

    return whitening.whitened(table(spark, sf, "embeddings"))


def _urls_sql() -> str:
    """Rules, counts of symbols (hex pairs) after contexts, Witten-Bell odds order by order, and the calibrated cutoff."""
    from riskloom.llm.url_models import RULES, SYMBOLS, UrlPlan

    plan = UrlPlan()
    values = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
    folds = ", ".join(f"'{c}'" for c in plan.held_out)
    odds = f"1.0 / {SYMBOLS}"
    joins = ""
    for k in range(plan.order + 1):
        context = f"substr(s, 2 * (i - {k}) + 1, {2 * k})" if k else "''"
        fits = "" if k == 0 else f" AND i >= {k}"
        joins += (f" LEFT JOIN c c{k} ON c{k}.verdict = y.verdict AND c{k}.context = {context}{fits}"
                  f" LEFT JOIN n n{k} ON n{k}.verdict = y.verdict AND n{k}.context = {context} AND n{k}.symbol = y.symbol{fits}")
        odds = (f"CASE WHEN c{k}.total IS NULL THEN {odds} ELSE (coalesce(n{k}.n, 0) + c{k}.kinds * ({odds})) / (c{k}.total + c{k}.kinds) END")
    return rf"""
WITH a AS (SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS k FROM pages),
b AS (SELECT *, CASE WHEN k > 0 THEN substr(u, k + 3) ELSE '' END AS t FROM a),
p AS (SELECT row_number() OVER () AS id, page_id, translate(regexp_extract(t, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path,
             translate(CASE WHEN k > 0 THEN t ELSE u END, '{_UPPER}', '{_LOWER}') AS text FROM b),
r AS (SELECT * FROM (VALUES {values}) AS v(verdict, rule, host, prefix)),
f AS (SELECT id, arg_max(rule, len(rule)) AS rule, arg_max(verdict, len(rule)) AS verdict
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(path, prefix) GROUP BY id),
u AS (SELECT p.*, f.rule, f.verdict, left(md5(text), 1) IN ({folds}) AS held, '^^' || hex(encode(text)) || '$$' AS s
      FROM p LEFT JOIN f ON f.id = p.id),
x AS (SELECT id, s, verdict, held, unnest(range(1, len(s) // 2)) AS i FROM u),
g AS (SELECT verdict, substr(s, 2 * i + 1, 2) AS symbol, unnest(list_transform(
        range(0, least(i, {plan.order}) + 1), lambda k: substr(s, 2 * (i - k)::INT + 1, 2 * k::INT))) AS context
      FROM x WHERE verdict IS NOT NULL AND NOT held),
n AS (SELECT verdict, context, symbol, count(*)::DOUBLE AS n FROM g GROUP BY ALL),
c AS (SELECT * FROM (SELECT verdict, context, sum(n) AS total, count(*) AS kinds FROM n GROUP BY ALL) AS q
      WHERE context = '' OR (total >= {plan.least_count} AND total >= {plan.least_share!r} * (
        SELECT sum(n) FROM n WHERE n.verdict = q.verdict AND context = ''))),
y AS (SELECT x.id, s, i, substr(s, 2 * i + 1, 2) AS symbol, v.verdict FROM x, (VALUES ('allow'), ('block')) AS v(verdict)),
z AS (SELECT y.id, y.verdict, log10({odds}) AS gain FROM y{joins}),
e AS (SELECT id, sum(CASE WHEN verdict = 'allow' THEN gain ELSE -gain END) / (count(*) / 2) AS score FROM z GROUP BY id),
h AS (SELECT floor(score * {plan.steps}) AS step, count(*) FILTER (verdict = 'allow') AS good, count(*) FILTER (verdict = 'block') AS bad
      FROM u JOIN e ON e.id = u.id WHERE held AND verdict IS NOT NULL GROUP BY 1),
k AS (SELECT step, floor((coalesce(lag(step) OVER (ORDER BY step) + 1, step) + step) / 2) AS middle, coalesce(sum(good) OVER w, 0) / (SELECT sum(good) FROM h) AS lost,
             1 - coalesce(sum(bad) OVER w, 0) / (SELECT sum(bad) FROM h) AS passed
      FROM (FROM h UNION ALL SELECT max(step) + 1, 0, 0 FROM h) WINDOW w AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT coalesce(arg_min(middle, (round(lost + passed, 9), step)) FILTER (lost + passed IS NOT NULL AND isfinite(lost + passed)), 0) AS least FROM k)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN floor(score * {plan.steps}) >= least THEN 'allow' ELSE 'block' END) AS verdict,
       round(score, 6) AS score
FROM u JOIN e ON e.id = u.id, o"""


@query("op11_url_models", _urls_sql())
def op11(spark, sf):
    from riskloom.llm import url_models

    return url_models.judged(table(spark, sf, "pages"))

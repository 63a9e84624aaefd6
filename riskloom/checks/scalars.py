"""Registered queries of the scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.checks import check
from riskloom.checks.rule_sql import PREP, SPACE_SET, rx
from riskloom.checks.views import OWNER_DOMAIN, V_EVENTS, V_TEXT, v_events, v_text, with_views
from riskloom.config import FIELD_CHAR_LIMIT
from riskloom.functions import text as tx
from riskloom.functions.text import BASE64_RUN, TOKEN_SEPARATORS
from riskloom.operators import rules
from riskloom.sources.fields import with_organizer

SQL_NORMALIZED = f"trim(regexp_replace(lower(text), {rx(chr(92) + 's+')}, ' ', 'g'), {SPACE_SET})"


@check("fn_1_email_domain", with_views("SELECT id, organizer_domain FROM v_events", V_EVENTS))
def fn_1(spark, sf):
    return with_organizer(v_events(spark, sf), OWNER_DOMAIN).select("id", "organizer_domain")


@check("fn_2_external", with_views(
    f"SELECT id, coalesce(organizer_domain <> '{OWNER_DOMAIN}', false) AS is_external FROM v_events", V_EVENTS))
def fn_2(spark, sf):
    return with_organizer(v_events(spark, sf), OWNER_DOMAIN).select("id", "is_external")


@check("fn_3_bounded_text", with_views(
    f"SELECT item_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(text[1:{FIELD_CHAR_LIMIT}]) AS bounded_hash FROM v_src", V_TEXT))
def fn_3(spark, sf):
    return v_text(spark, sf).select(
        "item_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2(tx.truncated(F.col("text"), FIELD_CHAR_LIMIT), 256).alias("bounded_hash"),
    )


@check("fn_4_without_fences", with_views(
    "SELECT item_id, sha256(bare) AS bare_hash, CAST(length(bare) AS BIGINT) AS n_chars FROM v_prep", V_TEXT, PREP))
def fn_4(spark, sf):
    bare = tx.without_fences(F.col("text"))
    return v_text(spark, sf).select(
        "item_id", F.sha2(bare, 256).alias("bare_hash"), F.length(bare).cast("long").alias("n_chars"))


@check("fn_5_normalized", with_views(
    f"SELECT item_id, sha256(n) AS text_hash, CAST(length(n) AS BIGINT) AS n_chars FROM (SELECT item_id, {SQL_NORMALIZED} AS n FROM v_src)", V_TEXT))
def fn_5(spark, sf):
    n = tx.normalized(F.col("text"))
    return v_text(spark, sf).select("item_id", F.sha2(n, 256).alias("text_hash"), F.length(n).cast("long").alias("n_chars"))


@check("fn_6_tokens", with_views(f"""
 SELECT item_id, CAST(len(t) AS BIGINT) AS n_tokens, sha256(array_to_string(t, ' ')) AS token_hash FROM (SELECT item_id,
 list_filter(string_split_regex(lower(text), {rx('[' + TOKEN_SEPARATORS + ']+')}), lambda x: x <> '') AS t FROM v_src)""", V_TEXT))
def fn_6(spark, sf):
    tokens = v_text(spark, sf).select("item_id", tx.tokens(F.lower("text")).alias("t"))
    return tokens.select("item_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("token_hash"))


@check("fn_7_base64_text", with_views(f"""
 SELECT item_id, m, TRY(decode(from_base64(rpad(u, CAST(4 * ceil(length(u) / 4.0) AS INTEGER), '=')))) AS plain FROM (
 SELECT item_id, m, CASE WHEN length(b) % 4 = 1 THEN b[1:-2] ELSE b END AS u FROM (
 SELECT item_id, m, rtrim(m, '=') AS b FROM (SELECT item_id, unnest(regexp_extract_all(text, '{BASE64_RUN}')) AS m FROM v_src)))""", V_TEXT))
def fn_7(spark, sf):
    guarded = v_text(spark, sf).where(F.rlike("text", F.lit(tx.BASE64_GUARD)))
    runs = guarded.select("item_id", F.explode_outer(F.regexp_extract_all("text", F.lit(BASE64_RUN), F.lit(0))).alias("m"))
    plain = tx.base64_text(F.col("m"))
    # SQL gives no text at all for bytes that are no UTF-8; here they show as U+FFFD.
    return runs.where("m is not null").select(
        "item_id", "m", F.when(~F.contains(plain, F.lit("\ufffd")), plain).alias("plain"))


@check("fn_8_previews", with_views("""
 SELECT item_id, text[1:60] || CASE WHEN length(text) > 60 THEN '...' ELSE '' END AS p60, text[1:80] AS p80, text[1:100] AS p100 FROM v_src""", V_TEXT))
def fn_8(spark, sf):
    t = F.col("text")
    return v_text(spark, sf).select(
        "item_id", tx.preview(t, 60, suffix=True).alias("p60"), tx.preview(t, 80).alias("p80"), tx.preview(t, 100).alias("p100"))


@check("ex_1_extra_tier", with_views(
    "SELECT item_id, CAST(CASE WHEN contains(low, 'agenda') THEN 1 ELSE 0 END AS BIGINT) AS n FROM v_prep", V_TEXT, PREP))
def ex_1(spark, sf):
    """A tier added by the user: one detection where a text names an agenda."""
    from riskloom.plans.scan import detect

    def agenda(p):
        found = rules.detection("custom", "CUSTOM-001", "Agenda", 0.2, "agenda", 0, 0, 0.5)
        return F.when(F.contains(p.low, F.lit("agenda")), F.array(found)).otherwise(rules.no_detections())

    found = detect(v_text(spark, sf), content="text", extra_tiers={"custom": agenda})
    return found.select("item_id", F.size("custom").cast("long").alias("n"))

"""Registered queries of the detection rules over all texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.checks import check
from riskloom.checks.rule_sql import DETECTIONS, PREP, RULE_SQL
from riskloom.checks.views import V_TEXT, v_text, with_views
from riskloom.config import DETECTION_LIMIT, ScanConfig
from riskloom.operators import rules
from riskloom.plans.scan import detect

_NAMES = {
    "STRUCT-001": "r_s001_zero_width", "STRUCT-002": "r_s002_base64", "STRUCT-003": "r_s003_html",
    "STRUCT-004": "r_s004_script_uri", "STRUCT-005": "r_s005_markdown", "STRUCT-006": "r_s006_homoglyphs",
    "STRUCT-007": "r_s007_encoding", "STRUCT-008": "r_s008_data_uri", "STRUCT-009": "r_s009_hidden_text",
    "CTX-001": "r_c001_override", "CTX-002": "r_c002_imperative", "CTX-003": "r_c003_shell",
    "CTX-004": "r_c004_tool_call", "CTX-005": "r_c005_role", "CTX-006": "r_c006_output", "CTX-007": "r_c007_urgency",
    "CTX-008": "r_c008_delivery", "CTX-009": "r_c009_paths",
}
UNCAPPED = ScanConfig(max_detections=None)
_BY_ID = {rule_id: rule for by in rules.tier_rules(UNCAPPED).values() for rule_id, rule in by.items()}


def unfolded(df: DataFrame, array: str = "d") -> DataFrame:
    # Outer, so that no filter on the array size is derived that would evaluate the rules twice.
    return df.select("item_id", F.posexplode_outer(array).alias("p", "x")).where("p is not null").select(
        "item_id", (F.col("p") + 1).cast("long").alias("ord"), "x.rule_id", "x.rule_name",
        F.round("x.severity", 6).alias("severity"), "x.matched", F.col("x.offset").cast("long").alias("start_at"),
        F.col("x.length").cast("long").alias("n_chars"), F.round("x.confidence", 6).alias("confidence"),
    )


_COLUMNS = """item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY k, i) AS BIGINT) AS ord, rule_id, rule_name,
 round(severity::DOUBLE, 6) AS severity, matched, CAST(start_at AS BIGINT) AS start_at, CAST(n_chars AS BIGINT) AS n_chars,
 round(confidence::DOUBLE, 6) AS confidence"""


def _rule_query(rule_id: str):
    def query(spark, sf):
        df = rules.prepare(v_text(spark, sf), "text", UNCAPPED)
        return unfolded(df.select("item_id", _BY_ID[rule_id](rules.prepared_columns()).alias("d")))

    return query


for _rule_id, _name in _NAMES.items():
    check(_name, with_views(f"SELECT {_COLUMNS} FROM ({RULE_SQL[_rule_id]})", V_TEXT, PREP))(_rule_query(_rule_id))


@check("r_w_weighting", with_views(
    "SELECT item_id, CAST(ord AS BIGINT) AS ord, rule_id, round(severity, 6) AS severity FROM v_det WHERE tier = 'contextual'",
    V_TEXT, DETECTIONS))
def r_w(spark, sf):
    return unfolded(detect(v_text(spark, sf), content="text"), "contextual").select("item_id", "ord", "rule_id", "severity")


@check("r_off_offsets", with_views(
    """SELECT rule_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(start_at) AS BIGINT) AS sum_start, CAST(sum(n_chars) AS BIGINT) AS sum_chars,
 CAST(max(start_at + n_chars) AS BIGINT) AS last_end FROM v_det WHERE n_chars > 0 GROUP BY rule_id""", V_TEXT, DETECTIONS))
def r_off(spark, sf):
    found = detect(v_text(spark, sf), content="text")
    rows = unfolded(found.withColumn("d", F.concat("structural", "contextual")))
    return rows.where("n_chars > 0").groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("start_at").alias("sum_start"), F.sum("n_chars").alias("sum_chars"),
        F.max(F.col("start_at") + F.col("n_chars")).alias("last_end"),
    )


@check("r_cap_per_tier", with_views(
    "SELECT item_id, tier, least(CAST(count(*) AS BIGINT), 50) AS n FROM v_det GROUP BY item_id, tier", V_TEXT, DETECTIONS))
def r_cap(spark, sf):
    found = detect(v_text(spark, sf), ScanConfig(max_detections=DETECTION_LIMIT), content="text")
    sizes = F.array(*(F.struct(F.lit(t).alias("tier"), F.size(t).cast("long").alias("n")) for t in ("structural", "contextual")))
    return found.select("item_id", F.explode(sizes).alias("s")).select("item_id", "s.*").where("n > 0")

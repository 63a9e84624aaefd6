"""Threat reports to threats and feed, with counts, expiry and admission.

A hash may hold a third of all reports. Reports are therefore first folded per
(hash, UTC day), which a map-side combine does before any shuffle. Those facts merge
in any order; sessions are unions of time intervals over the day rows and over the
sessions of an earlier state, so late reports and such that bridge two sessions
count as if they had come in time.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.lookup import is_hash
from riskloom.operators.skew import salted_lookup

# Fixed values of the threat store.
IDLE_DAYS = 30
COUNT_STEP, COUNT_MAX, RISK_SHARE = 0.1, 0.5, 0.5
FEED_MIN_REPORTS, FEED_MIN_CONFIDENCE = 2, 0.60
CATEGORY_RULES = (
    (("CTX-001", "CTX-005"), "prompt-injection"),
    (("CTX-003", "CTX-008"), "code-execution"),
    (("CTX-004",), "tool-call-injection"),
    (("CTX-009",), "data-exfiltration"),
    (("STRUCT-003", "STRUCT-004"), "xss-injection"),
)
LOOKUP_TTL_HOURS = 24
# From this many reports on, confidence depends on the risk of the report alone.
_COUNT_SATURATES = 5
_EPSILON = 1e-9


def reject_reason(reports: DataFrame) -> Column:
    """First failed check in order; null for an accepted report."""
    def empty(name):
        return F.coalesce(F.col(name), F.lit("")) == ""

    risk = F.col("risk_score")
    return (
        F.when(empty("client_id"), "Missing or invalid clientId")
        .when(empty("content_hash") | empty("structural_hash"), "Missing fingerprint hashes")
        .when(F.coalesce(~risk.between(0.0, 1.0) | F.isnan(risk), F.lit(True)), "Invalid riskScore (must be 0.0 - 1.0)")
        .when(~is_hash(F.col("content_hash")) | ~is_hash(F.col("structural_hash")),
              "Invalid hash format (expected SHA-256 hex)")
    )


def accepted(reports: DataFrame) -> DataFrame:
    return reports.where(reject_reason(reports).isNull())


def fan_out(reports: DataFrame) -> DataFrame:
    """Each report updates its content hash and its structural hash."""
    return reports.select(
        "report_id", F.explode(F.array("content_hash", "structural_hash")).alias("hash"),
        F.coalesce("pattern_ids", F.array().cast("array<string>")).alias("pattern_ids"),
        "risk_score", "organizer_domain", "reported_at",
    )


def confidence(report_count: Column, risk_score: Column) -> Column:
    return F.least(
        F.least(report_count * F.lit(COUNT_STEP), F.lit(COUNT_MAX)) + risk_score * F.lit(RISK_SHARE), F.lit(1.0)
    )


def category(pattern_ids: Column) -> Column:
    def any_prefix(prefix):
        return F.exists(pattern_ids, lambda p: F.startswith(p, F.lit(prefix)))

    expr = F
    for ids, name in CATEGORY_RULES:
        expr = expr.when(F.arrays_overlap(pattern_ids, F.array(*map(F.lit, ids))), name)
    structural, contextual = any_prefix("STRUCT"), any_prefix("CTX")
    return (
        expr.when(structural & contextual, "multi-vector").when(structural, "structural-attack")
        .when(contextual, "semantic-attack").otherwise("unknown")
    )


def _order() -> Column:
    return F.struct("reported_at", "report_id")


def _of_both(a: Column, b: Column) -> Column:
    return F.struct(
        (a["report_count"] + b["report_count"]).alias("report_count"),
        F.least(a["first_seen"], b["first_seen"]).alias("first_seen"),
        F.greatest(a["last_seen"], b["last_seen"]).alias("last_seen"),
        F.greatest(a["last"], b["last"]).alias("last"), F.greatest(a["domain"], b["domain"]).alias("domain"),
        F.array_sort(F.array_union(a["pattern_ids"], b["pattern_ids"])).alias("pattern_ids"),
    )


def _joined(*facts: Column) -> Column:
    """Facts of several sets of reports as those of all together, in whatever order; any of them may be null."""
    return _merged(F.array(*facts))


def _merged(facts: Column) -> Column:
    """Facts of an array of facts; null for an empty one."""
    given = F.filter(facts, lambda x: x.isNotNull())
    return F.transform(F.array(given), lambda g: F.aggregate(
        F.slice(g, 2, F.greatest(F.size(g), F.lit(1))), F.get(g, 0), _of_both))[0]


def _day() -> Column:
    return F.to_date("reported_at").alias("day")


def cells(updates: DataFrame) -> DataFrame:
    """Per (hash, UTC day) the mergeable facts and the last report that admits by its risk alone. One pass.

    Equal pattern lists are kept once before they are shuffled.
    """
    strong = confidence(F.lit(_COUNT_SATURATES), F.col("risk_score")) >= FEED_MIN_CONFIDENCE - _EPSILON
    lists = F.collect_set(F.array_sort(F.array_distinct("pattern_ids")))
    folded = updates.groupBy("hash", _day()).agg(
        F.count(F.lit(1)).alias("report_count"), F.min("reported_at").alias("first_seen"), F.max("reported_at").alias("last_seen"),
        F.max(F.struct("reported_at", "report_id", "risk_score")).alias("last"),
        F.max(F.when(F.col("organizer_domain").isNotNull(), F.struct("reported_at", "report_id", "organizer_domain"))).alias("domain"),
        F.array_sort(F.array_distinct(F.flatten(lists))).alias("pattern_ids"), F.max(F.when(strong, _order())).alias("strong"),
    )
    return folded.select("hash", "day", F.struct(*FACTS).alias("facts"), "strong")


def early_reports(updates: DataFrame) -> DataFrame:
    """Per (hash, UTC day) its first four reports. Spark cuts such a ranking in every task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy("hash", "day").orderBy("reported_at", "report_id"))
    first = updates.select("hash", _day(), "reported_at", "report_id", "risk_score").withColumn("nth", rank)
    return first.where(F.col("nth") < _COUNT_SATURATES).groupBy("hash", "day").agg(
        F.collect_list(F.struct("reported_at", "report_id", "risk_score")).alias("early"))


#: Facts of a set of reports; ``last`` and ``domain`` carry the report they come from, so they merge in any order.
FACTS = ("report_count", "first_seen", "last_seen", "last", "domain", "pattern_ids")


def _worked_out(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row: the optimizer copies nothing through a generator."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _numbered(rows: DataFrame) -> DataFrame:
    """Add the session of each interval of a hash: a gap of more than 30 days behind all before it opens a new one.

    The rows are days of new reports and sessions of an earlier state. A gap cannot
    lie within a day, and a day that lies in a session, or between two, joins them.
    """
    in_order = Window.partitionBy("hash").orderBy("facts.first_seen", "facts.last_seen")
    reach = F.max("facts.last_seen").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col("facts.first_seen") > reach + F.expr(f"interval {IDLE_DAYS} days")
    return rows.withColumn("opens", F.coalesce(opens.cast("int"), F.lit(0))).withColumn(
        "session", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))


def _admitted_at() -> Column:
    """The last new report at which the session entered the feed; null for none.

    Only the first four new reports need their exact number; any later one is the
    fifth or beyond and is admitted by its risk alone.
    """
    order = lambda r: F.struct(r["reported_at"].alias("reported_at"), r["report_id"].alias("report_id"))
    number = lambda k: F.col("base_count") + k + 1
    fits = lambda r, k: (number(k) >= FEED_MIN_REPORTS) & (
        confidence(number(k), r["risk_score"]) >= FEED_MIN_CONFIDENCE - _EPSILON)
    early_at = F.array_max(F.transform("early", lambda r, k: F.when(fits(r, k), order(r))))
    edge = order(F.get("early", _COUNT_SATURATES - 2))
    strong_at = F.array_max(F.transform("new", lambda d: d["strong"]))
    return F.greatest(early_at, F.when(F.size("early") >= _COUNT_SATURATES - 1, F.when(strong_at > edge, strong_at)))


def advance(
    updates: DataFrame, prior: DataFrame | None = None, salt: int = 8, with_feed: bool = True, idle_before: datetime | None = None,
    last_only: bool = False,
) -> DataFrame:
    """State after ``updates``: a row per hash and session, with its facts and those at its last admission.

    ``prior`` is an earlier result of this function; reports may come in any order,
    also into or between its sessions. Facts then equal those of all reports at
    once. A report is admitted, as in the running store, by the number it has on
    arrival. ``with_feed=False`` leaves admissions out and reads ``updates`` once;
    sessions idle since before ``idle_before`` leave the state. ``last_only`` keeps the
    last session of each hash, which is enough where no report can come later.
    """
    none = F.lit(None)
    facts_type = cells(updates).schema["facts"].dataType
    days = cells(updates)
    if with_feed:
        days = days.join(early_reports(updates), ["hash", "day"], "left")
    else:
        days = days.withColumn("early", F.array().cast("array<struct<reported_at:timestamp,report_id:long,risk_score:double>>"))
    rows = days.select(
        "hash", F.struct("day", "facts", "strong", "early").alias("new"), none.cast(facts_type).alias("admitted"), "facts")
    if prior is not None:
        rows = rows.unionByName(prior.select("hash", "facts", "admitted"), allowMissingColumns=True)
    old = F.when(F.col("new").isNull(), F.struct("facts", "admitted"))
    rows = _numbered(rows)
    if last_only:
        rows = rows.withColumn("top", F.max("session").over(Window.partitionBy("hash"))).where(F.col("session") == F.col("top"))
    sessions = rows.groupBy("hash", "session").agg(
        F.collect_list("new").alias("new"), F.collect_list(old).alias("old"))
    merged = _worked_out(sessions, base=_merged(F.transform("old", lambda s: s["facts"])))
    merged = _worked_out(merged, facts=_merged(F.concat(F.array("base"), F.transform("new", lambda d: d["facts"]))))
    if idle_before is not None:
        merged = merged.where(F.col("facts.last_seen") + F.expr(f"interval {IDLE_DAYS} days") >= F.lit(idle_before).cast("timestamp"))
    if not with_feed:
        return merged.select("hash", "facts", none.cast(facts_type).alias("admitted"))

    early = F.slice(F.array_sort(F.flatten(F.transform("new", lambda d: d["early"]))), 1, _COUNT_SATURATES - 1)
    found = _worked_out(merged, base_count=F.coalesce("base.report_count", F.lit(0)), early=early)
    found = _worked_out(found, at=_admitted_at())
    found = _worked_out(found, at_day=F.to_date("at.reported_at"))
    found = _worked_out(found, of_day=F.get(F.filter("new", lambda d: d["day"] == F.col("at_day")), 0)["facts"])
    cell = lambda h, d: F.concat_ws("/", h, d)
    inside = F.struct("of_day.last.reported_at", "of_day.last.report_id") > F.col("at")
    cuts = found.where(F.col("at").isNotNull() & inside).select(cell("hash", "at_day").alias("cell"), "at")
    keyed = updates.withColumn("cell", cell(F.col("hash"), F.to_date("reported_at")))
    heads = cells(salted_lookup(keyed, cuts, "cell", F.col("report_id"), salt, how="inner").where(_order() <= F.col("at"))).select(
        "hash", F.col("day").alias("at_day"), F.col("facts").alias("head"))
    whole_days = F.transform(F.filter("new", lambda d: d["day"] < F.col("at_day")), lambda d: d["facts"])
    entered = _merged(F.concat(whole_days, F.array(F.col("base"), F.coalesce("head", "of_day"))))
    stays = F.array_max(F.transform("old", lambda s: F.when(
        s["admitted"].isNotNull(), F.struct(s["admitted"]["last_seen"].alias("t"), s["admitted"].alias("a")))))["a"]
    return found.join(heads, ["hash", "at_day"], "left").select(
        "hash", "facts", F.when(F.col("at").isNotNull(), entered).otherwise(stays).alias("admitted"))


def current(state: DataFrame) -> DataFrame:
    """The last session of every hash."""
    latest = F.max(F.struct("facts.last_seen", "facts", "admitted"))
    return state.groupBy("hash").agg(latest.alias("s")).select("hash", "s.facts", "s.admitted")


def _finished(entries: DataFrame) -> DataFrame:
    return entries.select(
        "hash", F.lit("content").alias("hash_type"), "report_count",
        confidence(F.col("report_count"), F.col("last.risk_score")).alias("confidence"),
        "first_seen", "last_seen", "pattern_ids", F.col("domain.organizer_domain").alias("organizer_domain"),
        category(F.col("pattern_ids")).alias("category"),
        (F.col("last_seen") + F.expr(f"interval {IDLE_DAYS} days")).alias("expires_at"),
    )


def threats_of(state: DataFrame) -> DataFrame:
    """The entry of every hash: its last session."""
    return _finished(current(state).select("hash", "facts.*"))


def feed_of(state: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Feed rows of a state; an admitted entry leaves the feed after 30 idle days."""
    feed = _finished(current(state).where(F.col("admitted").isNotNull()).select("hash", "admitted.*"))
    return feed if as_of is None else feed.where(F.col("expires_at") >= F.lit(as_of).cast("timestamp"))


def threat_table(reports: DataFrame, salt: int = 8) -> DataFrame:
    """One row per hash: the state of its last session."""
    return threats_of(advance(fan_out(reports), salt=salt, with_feed=False, last_only=True))


def threat_feed(reports: DataFrame, as_of: datetime | None = None, salt: int = 8) -> DataFrame:
    """The feed: per hash the entry as it stood when it was last admitted."""
    return feed_of(advance(fan_out(reports), salt=salt, last_only=True), as_of)


def feed_since(feed: DataFrame, since: datetime | None = None) -> DataFrame:
    """Feed rows seen strictly after ``since``; all of them without it."""
    rows = feed if since is None else feed.where(F.col("last_seen") > F.lit(since).cast("timestamp"))
    return rows.select(
        "hash", "hash_type", "confidence", "report_count", F.col("last_seen").alias("updated_at"), "category"
    )


def import_feed(feed_rows: DataFrame, now: datetime) -> DataFrame:
    """Lookup table from feed rows: the last row per hash, valid for 24 hours."""
    latest = feed_rows.groupBy("hash").agg(F.max_by(
        F.struct("confidence", "report_count", "updated_at", "category"),
        F.struct("updated_at", "report_count", "confidence"),
    ).alias("r"))
    return latest.select(
        "hash", F.lit(True).alias("known"), "r.confidence", "r.report_count",
        F.col("r.updated_at").alias("last_seen"), "r.category",
        (F.lit(now).cast("timestamp") + F.expr(f"interval {LOOKUP_TTL_HOURS} hours")).alias("expires_at"),
    )


def sync_feed(
    feed: DataFrame, now: datetime, last_sync: datetime | None, interval_minutes: int = 15
) -> tuple[DataFrame, datetime] | None:
    """One incremental sync: lookup rows and the new sync time, or None when too soon."""
    from datetime import timedelta

    if last_sync is not None and now - last_sync < timedelta(minutes=interval_minutes):
        return None
    since = last_sync if last_sync is not None else now - timedelta(hours=24)
    return import_feed(feed_since(feed, since), now), now

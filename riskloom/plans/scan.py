"""The full scan: fields, rules, scores and actions as one plan."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.config import ScanConfig
from riskloom.operators import actions, lookup, patterns, rules, scoring
from riskloom.operators.fingerprints import content_hash, structural_hash
from riskloom.sources.fields import explode_fields

Tier = Callable[[rules.Prepared], Column]


def detect(
    fields: DataFrame, config: ScanConfig = ScanConfig(), content: str = "content",
    extra_tiers: dict[str, Tier] | None = None,
) -> DataFrame:
    """Add one detection array per tier. Needs ``field_type`` and ``is_external``.

    ``extra_tiers`` maps a tier name to a function from the prepared columns to
    a detection array; a pandas UDF column is as good as a native one.
    """
    df = rules.prepare(fields, content, config)
    p = rules.prepared_columns()
    # Weighting never changes order or count, so capping first gives the same list.
    tiers = {tier: rules.capped(found, config.max_detections) for tier, found in _built_in_tiers(config).items()}
    tiers[patterns.CONTEXTUAL] = rules.weighted(tiers[patterns.CONTEXTUAL], F.col("field_type"), F.col("is_external"))
    for name, tier in (extra_tiers or {}).items():
        tiers[name] = rules.capped(tier(p), config.max_detections)
    return evaluated(df, tiers).drop(*rules.PREPARED_NAMES, rules.CUTS)


def _built_in_tiers(config: ScanConfig) -> dict[str, Column]:
    """The two rule tiers as columns. They are large, so a session builds them once per rule set."""
    key = (SparkContext._active_spark_context.applicationId, config.trusted_npx_packages, config.first_override_only)
    if key not in _TIERS:
        p = rules.prepared_columns()
        _TIERS[key] = {
            tier: F.concat(*(rule(p) for rule in by_id.values())) for tier, by_id in rules.tier_rules(config).items()
        }
    return _TIERS[key]


_TIERS: dict[tuple, dict[str, Column]] = {}


def evaluated(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly columns as the one row of a generator.

    The optimizer moves filters below a projection by copying its expressions,
    and a filter on the action would copy the whole scan many times over. It
    does not move filters on generated columns, so each value is computed once.
    """
    row = F.struct(*(value.alias(name) for name, value in columns.items()))
    return df.select("*", F.inline_outer(F.array(row)))


def score_fields(
    detected: DataFrame, config: ScanConfig = ScanConfig(), content: str = "content",
    extra_tiers: tuple[str, ...] = (),
) -> DataFrame:
    """Score, level, action, kept detections and replacement text per field."""
    columns = {patterns.STRUCTURAL: "structural", patterns.CONTEXTUAL: "contextual"}
    if "threat_intel" in detected.columns:
        columns[patterns.THREAT_INTEL] = "threat_intel"
    columns.update({name: name for name in extra_tiers})
    tier_scores = {tier: F.col(f"__{name}_score") for tier, name in columns.items()}
    df = detected.withColumns(
        {f"__{name}_score": scoring.tier_score_of(F.col(name)) for name in columns.values()}
    )
    df = evaluated(df, {
        "risk_score": scoring.composite(tier_scores, config),
        "detections": rules.capped(F.concat(*(F.col(n) for n in columns.values())), config.max_detections),
    })
    df = df.withColumn("risk_level", scoring.level(F.col("risk_score"), config))
    df = df.withColumn("action", scoring.action(F.col("risk_level")))
    df = df.withColumn("sanitized", actions.sanitized(F.col(content), F.col("action"), F.col("detections")))
    return df.drop(*(f"__{name}_score" for name in columns.values()))


def scan_fields(
    fields: DataFrame, config: ScanConfig = ScanConfig(), content: str = "content",
    threats: DataFrame | None = None, as_of: datetime | None = None, salt: int = 8,
    extra_tiers: dict[str, Tier] | None = None,
) -> DataFrame:
    """Scan one text per row. Without threats the plan is a single narrow stage."""
    df = fields.withColumn("original_length", F.length(content))
    if threats is not None:
        df = df.withColumns({
            "content_hash": content_hash(F.col(content)), "structural_hash": structural_hash(F.col(content)),
        })
    df = detect(df, config, content, extra_tiers)
    if threats is not None:
        # Spread by a number of the row itself: copies of one text must not share a slice.
        spread = F.monotonically_increasing_id()
        df = lookup.with_threat_detections(df, threats, as_of, spread, salt)
    return score_fields(df, config, content, tuple(extra_tiers or ()))


def scan_texts(
    df: DataFrame, text: str = "text", config: ScanConfig = ScanConfig(), field_type: str = "description",
    external: Column | None = None, **options,
) -> DataFrame:
    """Scan a table of plain texts, one field per row; no shuffle is needed."""
    prepared = df.withColumns({
        "field_type": F.lit(field_type), "is_external": F.lit(False) if external is None else external,
    })
    return scan_fields(prepared, config, content=text, **options)


def scan_events(
    events: DataFrame, owner_domain: str | None = None, config: ScanConfig = ScanConfig(),
    threats: DataFrame | None = None, as_of: datetime | None = None,
    extra_tiers: dict[str, Tier] | None = None,
) -> DataFrame:
    """Scan nested events: one result row per event, with its fields as an array.

    Events are exploded to fields and scanned narrowly; one shuffle by event
    gathers detections and replacement texts, never the event texts. Rows stay
    apart by a number of their own, so an event delivered twice gives two results.
    """
    numbered = events.withColumn("__event_no", F.monotonically_increasing_id())
    fields = explode_fields(numbered, owner_domain, keep_empty=True, extra=("__event_no",))
    scanned = scan_fields(fields, config, threats=threats, as_of=as_of, extra_tiers=extra_tiers)
    return gather_events(scanned, config)


def gather_events(scanned: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Fold scanned fields into one row per event."""
    entry = F.when(F.col("field_no").isNotNull(), F.struct(
        F.col("field_no").alias("no"),
        F.struct(
            "field_name", "original_length", "risk_score", "risk_level", "action", "detections", "sanitized",
        ).alias("field"),
    ))
    keys = ["calendar_id", "id", "organizer_email", "organizer_domain", "is_external"]
    keys += [c for c in ("__event_no", "event_hash") if c in scanned.columns]
    folded = scanned.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("field_no").isNotNull(), F.col("risk_score"))), F.lit(0.0)).alias("risk_score"),
        F.count("field_no").alias("field_count"),
        F.collect_list(entry).alias("__entries"),
    )
    places = F.transform(F.col("__entries"), lambda e, i: F.struct(e["no"].alias("no"), i.alias("i")))
    in_order = F.transform(F.array_sort(places), lambda p: F.get(F.col("__entries"), p["i"])["field"])
    folded = folded.withColumns({
        "fields": in_order, "risk_level": scoring.level(F.col("risk_score"), config),
    }).drop("__entries", "__event_no")
    return folded.withColumns({
        "action": scoring.action(F.col("risk_level")), "detections": actions.all_detections(F.col("fields")),
    })

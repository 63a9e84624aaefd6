"""Batch application of changes to an event table: a new table version per batch."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import times as tm
from riskloom.operators.conflicts import BLOCK_SIMILARITY
from riskloom.operators.overlap_counts import check_counts
from riskloom.operators.recurrence import event_kind

PATCHABLE = ("summary", "description", "location", "status", "transparency", "visibility", "recurrence", "attendees")
# Ids and event-type defaults.
EVENT_ID = "^[a-v0-9]+$"
EVENT_ID_MIN, EVENT_ID_MAX, GENERATED_ID_CHARS = 5, 1024, 26
WORKING_SUMMARY = {"homeOffice": "Working from home", "officeLocation": "Working from office",
                   "customLocation": "Working from custom location"}
WORKING_DEFAULT = "Working location"
DECLINE_DEFAULT = "declineAllConflictingInvitations"
SCOPES = ("thisEventOnly", "all", "thisAndFollowing")


def gate_inserts(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New events with ``accepted``, counts and warnings.

    A near-certain duplicate (similarity of 0.95 or more) rejects the insert
    unless ``allow_duplicates`` is set on the row.
    """
    hits = check_counts(new, existing)
    joined = new.join(hits, "event_id", "left")
    blocked = F.coalesce(F.col("max_similarity") >= BLOCK_SIMILARITY, F.lit(False))
    return joined.withColumns({
        "accepted": ~blocked | F.coalesce("allow_duplicates", F.lit(False)),
        "n_conflicts": F.coalesce("n_conflicts", F.lit(0)), "n_duplicates": F.coalesce("n_duplicates", F.lit(0)),
        "warnings": F.coalesce("warnings", F.lit("")),
    }).drop("max_similarity")


def with_type_defaults(new: DataFrame) -> DataFrame:
    """Defaults by event type. Reads event_type, place_type and place_label."""
    kind = F.col("event_type")
    working = kind == "workingLocation"
    place = F
    for name, text in WORKING_SUMMARY.items():
        labelled = F.when(
            (F.coalesce("place_label", F.lit("")) != "") & F.lit(name != "homeOffice"),
            F.concat(F.lit("Working from "), F.col("place_label")),
        ).otherwise(text)
        place = place.when(F.col("place_type") == name, labelled)
    return new.withColumns({
        "transparency": F.coalesce(
            "transparency",
            F.when(kind.isin("focusTime", "outOfOffice"), "opaque").when(working, "transparent"),
        ),
        "visibility": F.coalesce("visibility", F.when(working, "public")),
        "summary": F.when(working & (F.coalesce("summary", F.lit("")) == ""), place.otherwise(WORKING_DEFAULT))
        .otherwise(F.col("summary")),
        "auto_decline": F.when(kind == "outOfOffice", DECLINE_DEFAULT),
    })


def insert_reject_reason(new: DataFrame) -> Column:
    kind = F.col("event_type")
    timed_only = kind.isin("focusTime", "outOfOffice")
    dated = tm.matches(F.col("start_text"), tm.DATE_ONLY) | tm.matches(F.col("end_text"), tm.DATE_ONLY)
    primary_only = kind.isin("outOfOffice", "workingLocation")
    on_primary = (F.col("calendar_id") == "primary") | F.contains("calendar_id", F.lit("@"))
    return (
        F.when(timed_only & dated, "all_day_not_allowed")
        .when(primary_only & ~on_primary, "primary_calendar_required")
        .when((kind == "workingLocation") & F.col("place_type").isNull(), "working_location_required")
    )


def merged_attendees(existing: Column, wanted: Column) -> Column:
    """The wanted list; entries already known (any case of the address) keep all their fields.

    ``existing`` holds attendee structs, ``wanted`` addresses. When an address
    is listed twice in the existing list, its last entry counts.
    """
    def entry(address: Column) -> Column:
        known = F.filter(existing, lambda a: F.lower(a["email"]) == F.lower(address))
        return F.when(F.size(known) > 0, F.element_at(known, -1))

    def fresh(address: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(
            address.alias("email"), none.alias("displayName"), none.alias("responseStatus"), none.alias("comment"),
            F.lit(None).cast("boolean").alias("self"), F.lit(None).cast("boolean").alias("organizer"),
        )

    return F.transform(wanted, lambda address: F.coalesce(entry(address), fresh(address)))


def patched(events: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply the last patch per event. Null patch values leave a column alone.

    ``start_text`` / ``end_text`` (with ``zone``) replace a time; switching between
    timed and all-day clears the other form.
    """
    keys = ["calendar_id", "event_id"]
    names = [c for c in patches.columns if c not in (*keys, "change_no")]
    last = patches.groupBy(*keys).agg(
        F.max_by(F.struct(*names), "change_no").alias("__patch")
    )
    joined = events.join(last, keys, "left")
    patch = F.col("__patch")
    new_values = {c: F.coalesce(patch[c], F.col(c)) for c in PATCHABLE if c in names and c in events.columns}
    for side in ("start", "end"):
        if f"{side}_text" not in names:
            continue
        text = patch[f"{side}_text"]
        zone = patch["zone"] if "zone" in names else F.lit(None).cast("string")
        made = tm.time_object(text, zone, F.lit(None).cast("string"))
        at = F.coalesce(
            F.when(tm.has_offset(text) | ~F.contains(text, F.lit("T")), tm.instant(text)),
            F.to_utc_timestamp(tm.instant(text), F.coalesce(zone, F.lit("UTC"))),
        )
        new_values[side] = F.when(text.isNotNull(), made).otherwise(F.col(side))
        new_values[f"{side}_ts"] = F.when(text.isNotNull(), at).otherwise(F.col(f"{side}_ts"))
        if side == "start":
            new_values["is_all_day"] = F.when(text.isNotNull(), made["date"].isNotNull()).otherwise(F.col("is_all_day"))
    return joined.withColumns(new_values).drop("__patch")


def scope_reject_reason(changes: DataFrame, now: datetime) -> Column:
    """Why a scoped change is refused; null when it is fine. Needs the target's recurrence columns."""
    scope = F.coalesce("scope", F.lit("all"))
    kind = event_kind(F.col("recurrence"), F.col("recurring_event_id"))
    return (
        F.when(~scope.isin(*SCOPES), "INVALID_MODIFICATION_SCOPE")
        .when((scope == "thisEventOnly") & F.col("original_start").isNull(), "MISSING_ORIGINAL_START_TIME")
        .when((scope == "thisAndFollowing") & F.col("future_start").isNull(), "MISSING_FUTURE_START_DATE")
        .when(F.coalesce(F.col("future_start") <= F.lit(now).cast("timestamp"), F.lit(False)), "FUTURE_DATE_IN_PAST")
        .when((scope != "all") & (kind != "recurring"), "SCOPE_NOT_APPLICABLE_TO_SINGLE_EVENT")
    )


def responded(events: DataFrame, responses: DataFrame) -> DataFrame:
    """Set the answer of the ``self`` attendee; ``reject_reason`` tells why not."""
    joined = events.join(
        responses.select("calendar_id", "event_id", "response", "response_comment"), ["calendar_id", "event_id"]
    )
    first_self = F.array_position(
        F.transform("attendees", lambda a: F.coalesce(a["self"], F.lit(False))), True
    )
    mine = F.get(F.col("attendees"), (first_self - 1).cast("int"))
    reason = (
        F.when(F.coalesce(first_self, F.lit(0)) == 0, "not_an_attendee")
        .when(F.coalesce(mine["organizer"], F.lit(False)), "is_organizer")
    )
    answered = F.transform("attendees", lambda a, i: F.when(
        i + 1 == first_self,
        a.withField("responseStatus", F.col("response")).withField(
            "comment", F.coalesce(F.col("response_comment"), a["comment"])),
    ).otherwise(a))
    return joined.withColumn("reject_reason", reason).withColumn(
        "attendees", F.when(F.col("reject_reason").isNull(), answered).otherwise(F.col("attendees"))
    )


def deleted(events: DataFrame, deletes: DataFrame) -> DataFrame:
    return events.join(
        deletes.select("calendar_id", "event_id").distinct(), ["calendar_id", "event_id"], "left_anti"
    )


def valid_event_id(event_id: Column) -> Column:
    return F.length(event_id).between(EVENT_ID_MIN, EVENT_ID_MAX) & tm.matches(event_id, EVENT_ID)


def event_id_problem(event_id: Column) -> Column:
    """All violated id rules as one text; null for a valid id."""
    text = F.concat_ws(
        ", ",
        F.when(F.length(event_id) < EVENT_ID_MIN, "must be at least 5 characters long"),
        F.when(F.length(event_id) > EVENT_ID_MAX, "must not exceed 1024 characters"),
        F.when(~tm.matches(event_id, EVENT_ID),
               "can only contain lowercase letters a-v and digits 0-9 (base32hex encoding)"),
    )
    return F.when(text != "", text)


def sanitized_event_id(raw: Column) -> Column:
    """A valid id from any text: lower case, w-z become a-d, the rest is dropped.

    Short results get a suffix hashed from the input, so a rerun gives the same id.
    """
    kept = F.regexp_replace(F.translate(F.lower(raw), "wxyz", "abcd"), "[^a-v0-9]", "")
    suffix = F.lower(F.hex(F.xxhash64(raw)))
    stem = F.when(kept == "", "event").otherwise(kept)
    filled = F.when(F.length(kept) < EVENT_ID_MIN, F.substring(F.concat(stem, suffix), 1, GENERATED_ID_CHARS))
    return F.substring(F.coalesce(filled, kept), 1, EVENT_ID_MAX)


def apply_changes(events: DataFrame, inserts: DataFrame, patches: DataFrame, deletes: DataFrame) -> DataFrame:
    """Next version of the table: gated inserts, then patches, then deletes."""
    gated = gate_inserts(inserts, events)
    fresh = gated.where("accepted").select(*(c for c in events.columns if c in gated.columns))
    return deleted(patched(events.unionByName(fresh, allowMissingColumns=True), patches), deletes)

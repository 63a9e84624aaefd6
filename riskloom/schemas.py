"""Declared schemas. Nothing in the library infers a schema from data."""

from pyspark.sql import types as T

STR, LONG, INT, DBL, BOOL, TS = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SCAN_EVENT = _struct(
    id=STR, calendarId=STR, summary=STR, description=STR, location=STR,
    organizer=_struct(email=STR),
    attendees=T.ArrayType(_struct(displayName=STR, email=STR)),
    attachments=T.ArrayType(_struct(title=STR)),
)

DETECTION = _struct(
    tier=STR, rule_id=STR, rule_name=STR, severity=DBL, matched=STR,
    offset=INT, length=INT, confidence=DBL, metadata=T.MapType(STR, STR),
)

EVENT_TIME = _struct(dateTime=STR, date=STR, timeZone=STR)

ATTENDEE = _struct(
    email=STR, displayName=STR, responseStatus=STR, comment=STR, self=BOOL, organizer=BOOL,
)

CALENDAR_EVENT = _struct(
    event_id=STR, calendar_id=STR, summary=STR, description=STR, location=STR,
    start=EVENT_TIME, end=EVENT_TIME, start_ts=TS, end_ts=TS, is_all_day=BOOL,
    status=STR, transparency=STR, visibility=STR, event_type=STR,
    recurrence=T.ArrayType(STR), recurring_event_id=STR,
    attendees=T.ArrayType(ATTENDEE),
    ext_private=T.MapType(STR, STR), ext_shared=T.MapType(STR, STR),
)

REPORT = _struct(
    report_id=LONG, client_id=STR, content_hash=STR, structural_hash=STR,
    pattern_ids=T.ArrayType(STR), risk_score=DBL, organizer_domain=STR, reported_at=TS,
)

THREAT = _struct(
    hash=STR, hash_type=STR, report_count=LONG, confidence=DBL, first_seen=TS, last_seen=TS,
    pattern_ids=T.ArrayType(STR), organizer_domain=STR, category=STR, expires_at=TS,
)


def ddl(schema: T.StructType) -> str:
    """The type as a DDL string, for casts of empty arrays and for from_json."""
    return schema.simpleString()

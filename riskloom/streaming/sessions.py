"""Threat sessions as keyed stream state with timers.

State per hash is a set of sessions, each a time interval with mergeable facts.
Reports that arrive late extend the session they fall into, and join two sessions
when they lie between them. A session leaves the state once the watermark is 30
days past its last report: nothing that may still arrive can belong to it.

Reports are folded into intervals in each task before they are grouped by hash, so
a hash that holds a third of all reports sends a few rows per task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskloom.operators.threats import IDLE_DAYS

_IDLE = IDLE_DAYS * 86_400_000_000
FACTS_SCHEMA = (
    "report_count long, first_seen timestamp, last_seen timestamp, "
    "last struct<reported_at:timestamp,report_id:long,risk_score:double>, "
    "domain struct<reported_at:timestamp,report_id:long,organizer_domain:string>, pattern_ids array<string>")
#: What a session is in state: the facts in flat columns, times in microseconds.
_STATE = (
    "report_count long, first_seen long, last_seen long, last_id long, last_risk double, "
    "domain_at long, domain_id long, domain string, pattern_ids array<string>")
_NAMES = [c.strip().split(" ")[0] for c in _STATE.split(", ")]
OUTPUT = f"hash string, {_STATE}, gone boolean"

Interval = dict[str, Any]


def _both(a: Interval, b: Interval) -> Interval:
    late = max(a, b, key=lambda s: (s["last_seen"], s["last_id"]))
    named = [s for s in (a, b) if s["domain_at"] is not None]
    domain = max(named, key=lambda s: (s["domain_at"], s["domain_id"])) if named else a
    return {
        "report_count": a["report_count"] + b["report_count"], "first_seen": min(a["first_seen"], b["first_seen"]),
        "last_seen": late["last_seen"], "last_id": late["last_id"], "last_risk": late["last_risk"],
        "domain_at": domain["domain_at"], "domain_id": domain["domain_id"], "domain": domain["domain"],
        "pattern_ids": sorted({*a["pattern_ids"], *b["pattern_ids"]}),
    }


def merged(intervals: Iterable[Interval]) -> list[Interval]:
    """Sessions of some intervals: those at most 30 days apart become one."""
    out: list[Interval] = []
    for one in sorted(intervals, key=lambda s: s["first_seen"]):
        if out and one["first_seen"] <= out[-1]["last_seen"] + _IDLE:
            out[-1] = _both(out[-1], one)
        else:
            out.append(one)
    return out


def _of_report(r: Any) -> Interval:
    named = r.organizer_domain is not None
    return {
        "report_count": 1, "first_seen": int(r.at), "last_seen": int(r.at), "last_id": int(r.report_id),
        "last_risk": float(r.risk_score), "domain_at": int(r.at) if named else None,
        "domain_id": int(r.report_id) if named else None, "domain": r.organizer_domain if named else None,
        "pattern_ids": sorted(set(r.pattern_ids)),
    }


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, reports in batch.groupby("hash", sort=False):
            rows += [(key, *(s[n] for n in _NAMES)) for s in merged(_of_report(r) for r in reports.itertuples(index=False))]
        yield pd.DataFrame(rows, columns=["hash", *_NAMES], dtype=object)


class Sessions(StatefulProcessor):
    """Merges arriving intervals into the sessions of a hash and gives the last one after each change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getListState("sessions", _STATE)

    def _stored(self) -> list[Interval]:
        return [dict(zip(_NAMES, row, strict=True)) for row in self.sessions.get()]

    def _keep(self, sessions: list[Interval]) -> None:
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if not sessions:
            self.sessions.clear()
            return
        self.sessions.put([tuple(s[n] for n in _NAMES) for s in sessions])
        self.handle.registerTimer(_due(min(s["last_seen"] for s in sessions)))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        sessions = merged([*self._stored(), *({n: r[n] for n in _NAMES} for r in rows)])
        self._keep(sessions)
        yield Row(hash=key[0], **sessions[-1], gone=False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        left = [s for s in self._stored() if _due(s["last_seen"]) > now]
        self._keep(left)
        if not left:
            yield Row(hash=key[0], **dict.fromkeys(_NAMES), gone=True)

    def close(self) -> None:
        pass


def _due(last_seen: int) -> int:
    """The millisecond from which nothing can belong to a session any more."""
    return -(-(last_seen + _IDLE + 1) // 1000)


def sessions_of(updates: DataFrame, lateness: str) -> DataFrame:
    """Streaming rows ``hash, facts, gone``: the last session of a hash after each change, or that it left the state."""
    folded = updates.select(
        "hash", "report_id", "pattern_ids", "risk_score", "organizer_domain", F.unix_micros("reported_at").alias("at")).mapInPandas(
        _folded, f"hash string, {_STATE}")
    timed = folded.withColumn("seen_at", F.timestamp_micros("last_seen")).withWatermark("seen_at", lateness)
    found = timed.groupBy("hash").transformWithState(
        statefulProcessor=Sessions(), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")
    at = F.timestamp_micros
    domain = F.struct(at("domain_at").alias("reported_at"), F.col("domain_id").alias("report_id"), F.col("domain").alias("organizer_domain"))
    facts = F.struct(
        "report_count", at("first_seen").alias("first_seen"), at("last_seen").alias("last_seen"),
        F.struct(at("last_seen").alias("reported_at"), F.col("last_id").alias("report_id"), F.col("last_risk").alias("risk_score")).alias("last"),
        F.when(F.col("domain_at").isNotNull(), domain).alias("domain"), "pattern_ids")
    return found.select("hash", F.when(~F.col("gone"), facts).alias("facts"), "gone")

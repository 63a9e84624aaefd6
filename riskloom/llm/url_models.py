"""URL filter: rules first, then the ratio of two character models.

Rules of a host and a path prefix judge the addresses they fit; the longest rule
wins. Their verdicts also label addresses: a variable-order Markov model of bytes
is counted from the accepted ones, another from the rejected ones. A context of up
to ``order`` symbols is used where it makes up at least ``least_share`` of its
model's symbols and occurs twice; each order is smoothed with the next shorter one
(Witten-Bell), the shortest with even odds. So a model has at most
``order / least_share`` contexts however many addresses there are, and is small
enough to be sent to every task; all counts cover all labelled addresses.

An address without a rule is judged by the difference of the log10 likelihoods per
symbol. The cutoff is calibrated on labelled addresses that were held out of the
models (by a hash of the address, so copies stay together): the one that makes the
shares of wrongly rejected and wrongly accepted addresses smallest together (the
lower one at a tie), in the middle of the gap it lies in.

Defined results: a null address, or one without ``://``, has an empty host and
path, no rule, and is judged as it stands (a null one as the empty text); with no
labelled or no held-out addresses a model gives even odds and the cutoff is 0;
repeated rows are judged alike and counted as often as they occur; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import in_arrow, kept
from riskloom.llm.words import PIECE_BYTES, in_pieces, sums, text_bytes

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the registered query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Bytes are 1 to 256; an address is closed by END and opened by START (a context only).
END, START, SYMBOLS = 257, 258, 257
_BITS = 9


@dataclass(frozen=True)
class UrlPlan:
    """Longest context, least share of a context, steps of the cutoff per log10 unit, held-out sixteenths."""

    order: int = 5
    least_share: float = 1 / 4096
    least_count: int = 2
    steps: int = 50
    held_out: str = "012"


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and the text that the models read: everything after the scheme, in lower case."""
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    after = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise(F.lit(""))
    host = _lower(F.regexp_extract(after, r"^[^/?#]*", 0))
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return host, path, _lower(F.when(at > 0, after).otherwise(whole))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as an array of at most one ``struct<verdict, rule>``."""
    if not rules:
        return F.array().cast("array<struct<verdict:string,rule:string>>")
    known = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, prefix = rule.partition("/")
        known.append(F.struct(*(F.lit(v).alias(n) for n, v in (
            ("verdict", verdict), ("rule", rule), ("host", name), ("inside", f".{name}"), ("prefix", slash + prefix)))))
    fitting = F.filter(F.array(*known), lambda r: (
        (host == r["host"]) | F.endswith(host, r["inside"])) & F.startswith(path, r["prefix"]))
    return F.transform(F.slice(fitting, 1, 1), lambda r: F.struct(r["verdict"].alias("verdict"), r["rule"].alias("rule")))


def _symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """START, bytes and END of every text, flat; the place of each symbol in its text; bounds of the texts."""
    data, bounds = text_bytes(texts)
    n = len(bounds) - 1
    wide = bounds + 2 * np.arange(n + 1)
    flat = np.empty(len(data) + 2 * n, np.int64)
    inner = np.ones(len(flat), bool)
    inner[wide[:-1]] = inner[wide[1:] - 1] = False
    flat[inner] = data.astype(np.int64) + 1
    flat[wide[:-1]], flat[wide[1:] - 1] = START, END
    return flat, np.arange(len(flat)) - np.repeat(wide[:-1], np.diff(wide)), wide


def _grams(flat: np.ndarray, place: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per order: the symbols that have a context so long, and their keys ``order | context | symbol``."""
    context = np.zeros(len(flat), np.int64)
    for k in range(order + 1):
        if k:
            earlier = np.zeros(len(flat), np.int64)
            earlier[k:] = flat[:-k] if k < len(flat) else earlier[k:]
            context = context | (earlier << (_BITS * (k - 1)))
        at = np.flatnonzero(place >= max(k, 1))
        yield k, at, (k << (_BITS * 6)) | (context[at] << _BITS) | flat[at]


def _count(order: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            labels = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for label in (False, True):
                texts = batch.column(0).filter(pa.array(labels == label))
                if len(texts) == 0:
                    continue
                flat, place, _ = _symbols(texts)
                for _, _, keys in _grams(flat, place, order):
                    found, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), label)), pa.array(found), pa.array(n)],
                                                     ["accepted", "key", "n"])

    return work


@dataclass(frozen=True)
class UrlModel:
    """Contexts with their counts and numbers of different followers, and the counts of followers; keys sorted."""

    contexts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray
    keys: np.ndarray
    counts: np.ndarray

    def log10(self, flat: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
        """log10 of the probability of every symbol but START, which gets 0."""
        p = np.full(len(flat), 1.0 / SYMBOLS)
        for _, at, keys in _grams(flat, place, order):
            total, kinds = _looked_up(self.contexts, keys >> _BITS, self.totals, self.kinds)
            (count,) = _looked_up(self.keys, keys, self.counts)
            known = total > 0
            p[at] = np.where(known, (count + kinds * p[at]) / np.where(known, total + kinds, 1), p[at])
        return np.where(place == 0, 0.0, np.log10(p))


def _looked_up(table: np.ndarray, keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    if len(table) == 0:
        return [np.zeros(len(keys)) for _ in values]
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return [np.where(table[at] == keys, v[at], 0).astype(np.float64) for v in values]


def models(labelled: DataFrame, plan: UrlPlan) -> dict[bool, UrlModel]:
    """The model of accepted and of rejected addresses, from ``text, accepted`` of all labelled rows."""
    parts_ = in_arrow(labelled.select("text", "accepted"), _count(plan.order), "accepted boolean, key long, n long")
    counts = kept(parts_.groupBy("accepted", "key").agg(F.sum("n").alias("n")), "url_counts")
    per = counts.groupBy("accepted", F.shiftright("key", _BITS).alias("context")).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    whole = per.where("context = 0").select("accepted", F.col("total").alias("whole"))
    frequent = per.join(F.broadcast(whole), "accepted").where(
        (F.col("context") == 0) | ((F.col("total") >= plan.least_count) & (F.col("total") >= F.col("whole") * plan.least_share)))
    frequent = kept(frequent.select("accepted", "context", "total", "kinds"), "url_contexts")
    used = counts.withColumn("context", F.shiftright("key", _BITS)).join(
        F.broadcast(frequent.select("accepted", "context")), ["accepted", "context"])
    out = {}
    for accepted in (True, False):
        c = frequent.where(F.col("accepted") == accepted).select("context", "total", "kinds").toArrow().sort_by("context")
        k = used.where(F.col("accepted") == accepted).select("key", "n").toArrow().sort_by("key")
        out[accepted] = UrlModel(*(t.column(i).to_numpy() for t in (c, k) for i in range(t.num_columns)))
    return out


def _score(accepted: UrlModel, rejected: UrlModel, order: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, limit=PIECE_BYTES // 4):
            flat, place, bounds = _symbols(batch.column(batch.schema.get_field_index("text")))
            gain = accepted.log10(flat, place, order) - rejected.log10(flat, place, order)
            scores = sums(gain, bounds) / (np.diff(bounds) - 1)
            yield batch.append_column("score", pa.array(scores)).drop_columns(["text"])

    return work


def cutoff(held: DataFrame) -> int:
    """The step from which addresses are accepted, from ``accepted, step`` of the held-out rows."""
    found = held.groupBy("step").agg(
        F.count(F.when(F.col("accepted"), 1)).alias("good"), F.count(F.when(~F.col("accepted"), 1)).alias("bad")).orderBy("step").collect()
    good, bad = (np.array([r[c] for r in found], np.float64) for c in ("good", "bad"))
    if not len(found) or not good.sum() or not bad.sum():
        return 0
    steps = [r["step"] for r in found] + [found[-1]["step"] + 1]
    lost = np.concatenate(([0], np.cumsum(good))) / good.sum()
    passed = 1 - np.concatenate(([0], np.cumsum(bad))) / bad.sum()
    at = int(np.argmin(np.round(lost + passed, 9)))
    return int(steps[at]) if at == 0 else (int(steps[at - 1]) + int(steps[at]) + 1) // 2


def judged(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, plan: UrlPlan = UrlPlan(), page_id: str = "page_id", url: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row."""
    host, path, text = parts(F.col(url))
    split = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), text.alias("text"))
    ruled = split.withColumn("found", F.get(rule_of(F.col("host"), F.col("path"), rules), 0)).withColumn(
        "held", F.substring(F.md5("text"), 1, 1).isin(*plan.held_out))
    labelled = ruled.where("found is not null and not held").select("text", (F.col("found.verdict") == "allow").alias("accepted"))
    of_class = models(labelled, plan)
    kind = dict(pages.dtypes)[page_id]
    schema = (f"page_id {kind}, host string, path string, found struct<verdict:string,rule:string>, held boolean, score double")
    scored = kept(in_arrow(ruled, _score(of_class[True], of_class[False], plan.order), schema), "url_scores")
    step = F.floor(F.col("score") * plan.steps)
    least = cutoff(scored.where("held and found is not null").select(step.alias("step"), (F.col("found.verdict") == "allow").alias("accepted")))
    return scored.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.when(step >= least, "allow").otherwise("block")).alias("verdict"),
        F.round("score", 6).alias("score"))

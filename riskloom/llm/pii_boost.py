"""Personal data: exact finders, and boosted trees over high-recall candidates.

Four kinds are found by fixed patterns and always stay. Beyond them, generators
propose overlapping spans (number groups and their parts, account numbers,
spelled-out addresses). Gradient-boosted trees score each by its format and its
context, thresholds calibrated on held-out examples select, and of overlapping
selected spans the likeliest wins.

The trees are fitted on examples rendered into the words of a bounded sample of
documents (``sample_rows`` documents, ``sample_words`` words of each); the result
is of fixed size and goes to every task. Everything else is one narrow stage.

Defined results: a null text is empty and has no spans; positions count code
points and ends are exclusive; very long texts are searched whole, in linear
time; repeated rows are treated alike; an empty table gives no rows; extra
columns are ignored by :func:`found` and kept by :func:`redacted`.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import in_arrow, smallest_hashed
from riskloom.llm.words import as_large, in_pieces

# Kinds in their order; the first four are found by pattern.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
BASE_KINDS = 4

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_GROUPS = re.compile(r"(?<![0-9A-Za-z])\(?[0-9]++\)?(?:[ ./-]{1,2}\(?[0-9]++\)?)*+")
_NUMBER = re.compile(r"[0-9]+")
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?=(?: ?[A-Z0-9]){11})")
_ACCOUNT_GROUP = re.compile(r" ?[A-Z0-9]++(?![a-z])")
_SPELLED = re.compile(r"( at |\(at\)| ?\[at\] ?)([A-Za-z0-9-]+)((?: dot | ?\(dot\) ?| ?\[dot\] ?)[A-Za-z]+)+")
#: Digits of a proposed number, and letters and digits of a proposed account.
_NUMBER_SIZES, _ACCOUNT_SIZES = (7, 15), (15, 34)
#: Candidates of one text whose features are held at once.
_SCORED = 1 << 14

_CUES = (
    re.compile(r"(?:tel|phone|call|mobile|cell|fax|ring|dial)\W*\Z", re.I),
    re.compile(r"(?:ssn|social security|taxpayer)\W*(?:no|number)?\W*\Z", re.I),
    re.compile(r"(?:iban|account|konto|compte|cuenta)\W*\Z", re.I),
    re.compile(r"(?:version|page|chapter|isbn|order|invoice|article|section|no|nr|item|total|price|usd|eur|\$|€|#)\W*\Z", re.I),
    re.compile(r"(?:on|since|until|date|from|born|in|between)\W*\Z", re.I),
)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses around each at sign; the part before it starts as far left as it can."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        host = _DOMAIN.match(text, at + 1) if begin < at else None
        if host:
            yield begin, host.end()
            done = host.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four fixed kinds, per kind leftmost and non-overlapping."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return sorted(out)


def _mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of everything that might be one of the kinds; spans may overlap."""
    out = set()
    for m in _GROUPS.finditer(text):
        parts = [(p.start(), p.end()) for p in _NUMBER.finditer(text, m.start(), m.end())]
        for i in range(len(parts)):
            digits = 0
            for j in range(i, len(parts)):
                digits += parts[j][1] - parts[j][0]
                if digits > _NUMBER_SIZES[1]:
                    break
                if digits < _NUMBER_SIZES[0]:
                    continue
                begin, end = parts[i][0], parts[j][1]
                if begin > 0 and text[begin - 1] == "(" and text.find(")", begin, end) >= 0:
                    begin -= 1
                shape = [b - a for a, b in parts[i: j + 1]]
                out.add((begin, 4 if shape == [3, 2, 4] else 3, end))
    for m in _ACCOUNT.finditer(text):
        # Every end at which no letter or digit follows: the word after an account may look like a group of it.
        size, group = 4, _ACCOUNT_GROUP.match(text, m.end())
        while group:
            size += len(group[0].lstrip(" "))
            if size > _ACCOUNT_SIZES[1]:
                break
            if size >= _ACCOUNT_SIZES[0]:
                out.add((m.start(), 5, group.end()))
            group = _ACCOUNT_GROUP.match(text, group.end())
    if "dot" in text:
        for m in _SPELLED.finditer(text):
            local = _LOCAL.search(text, max(0, m.start() - 64), m.start())
            if local:
                out.add((local.start(), 0, m.end()))
    return sorted(out)


FEATURES = (
    "kind", "digits", "letters", "groups", "first", "second", "third", "last", "dashes", "dots", "blanks", "slashes", "parens",
    "left", "right", "luhn", "mod97", "octets", "year_first", "year_last", "day_month", "ssn_range", "same_digit", "zero_first",
    "bracketed", "distinct", *(f"cue{k}" for k in range(len(_CUES))),
)


def _side(text: str, at: int) -> int:
    if not 0 <= at < len(text):
        return 0
    c = text[at]
    return 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4 if c in ",;:!?)(\"'" else 5 if c == "." else 6


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    begin, kind, end = span
    value, ahead = text[begin:end], text[max(0, begin - 24): begin]
    groups = _NUMBER.findall(value)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    numbers = [int(g[:9]) for g in groups] or [0]
    compact = value.replace(" ", "")
    day_month = len(numbers) >= 3 and (
        (1 <= numbers[0] <= 31 and 1 <= numbers[1] <= 12) or (1 <= numbers[1] <= 12 and 1 <= numbers[2] <= 31) or (
            1 <= numbers[0] <= 12 and 1 <= numbers[1] <= 31))
    return [
        kind, len(digits), sum(c.isalpha() for c in value), len(groups), sizes[0], sizes[1] if len(sizes) > 1 else 0,
        sizes[2] if len(sizes) > 2 else 0, sizes[-1], value.count("-"), value.count("."), value.count(" "), value.count("/"),
        value.count("(") + value.count(")"), _side(text, begin - 1), _side(text, end), len(digits) > 11 and _luhn(digits),
        kind == 5 and compact.isalnum() and compact.isascii() and _mod97(compact), len(groups) == 4 and max(numbers) <= 255,
        sizes[0] == 4 and 1000 <= numbers[0] <= 2100, sizes[-1] == 4 and 1000 <= numbers[-1] <= 2100, day_month,
        kind == 4 and numbers[0] not in (0, 666) and numbers[0] < 900 and numbers[1] > 0 and numbers[2] > 0,
        len(set(digits)) <= 1, digits[:1] == "0", "[" in value or "(at" in value, len(set(digits)),
        *(cue.search(ahead) is not None for cue in _CUES)]


@dataclass(frozen=True)
class Boosting:
    sample_rows: int = 2_000
    sample_words: int = 60
    examples: int = 12_000
    trees: int = 60
    depth: int = 4
    rate: float = 0.2
    precision: float = 0.99
    seed: int = 3
    bins: int = 32


@dataclass
class Model:
    """Trees as (feature, cut, value) arrays in heap order, and a threshold per kind."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0
    thresholds: np.ndarray = field(default_factory=lambda: np.full(len(KINDS), 1.1))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for tree in self.trees:
            total += _leaf(tree, x)
        return 1 / (1 + np.exp(-total))


def _tree(codes: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, plan: Boosting):
    """One regression tree on gradients: the best split of each node by histogram."""
    size = 2 ** (plan.depth + 1) - 1
    feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
    node = np.zeros(len(g), np.int64)
    for k in range(size):
        mine = np.flatnonzero(node == k)
        if not len(mine):
            continue
        sum_g, sum_h = g[mine].sum(), h[mine].sum()
        value[k] = -plan.rate * sum_g / (sum_h + 1.0)
        if 2 * k + 2 >= size or len(mine) < 20:
            continue
        best, kept = 1e-6, None
        for f, edge in enumerate(edges):
            if not len(edge):
                continue
            gl = np.cumsum(np.bincount(codes[mine, f], weights=g[mine], minlength=len(edge) + 1))[:-1]
            hl = np.cumsum(np.bincount(codes[mine, f], weights=h[mine], minlength=len(edge) + 1))[:-1]
            gain = gl ** 2 / (hl + 1) + (sum_g - gl) ** 2 / (sum_h - hl + 1) - sum_g ** 2 / (sum_h + 1)
            b = int(np.argmax(gain))
            if gain[b] > best:
                best, kept = gain[b], (f, b)
        if kept:
            feature[k], cut[k] = kept[0], edges[kept[0]][kept[1]]
            node[mine] = 2 * k + 1 + (codes[mine, kept[0]] > kept[1])
    return feature, cut, value


def boosted(x: np.ndarray, y: np.ndarray, plan: Boosting) -> Model:
    """Gradient boosting with logistic loss."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Model(start=float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, plan.bins + 1)[1:-1], method="lower")) for c in x.T]
    edges = [e[e < c.max()] for e, c in zip(edges, x.T, strict=True)]
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    raw = np.full(len(y), model.start)
    for _ in range(plan.trees):
        p = 1 / (1 + np.exp(-raw))
        tree = _tree(codes, edges, p - y, p * (1 - p), plan)
        model.trees.append(tree)
        raw += _leaf(tree, x)
    return model


def _leaf(tree, x: np.ndarray) -> np.ndarray:
    feature, cut, value = tree
    node = np.zeros(len(x), np.int64)
    while (inner := feature[node] >= 0).any():
        right = x[np.arange(len(x)), np.maximum(feature[node], 0)] > cut[node]
        node = np.where(inner, 2 * node + 1 + right, node)
    return value[node]


def _render(rng: np.random.Generator) -> tuple[str, str, bool]:
    """A cue to put before (may be empty), a value, and whether it is personal data."""
    d = lambda n, low=0: "".join(str(rng.integers(low if k == 0 else 0, 10)) for k in range(n))
    pick = lambda *xs: xs[rng.integers(len(xs))]
    number = lambda n: str(rng.integers(1, n))
    kind = rng.integers(10)
    if kind < 2:
        cue = pick("tel", "Tel:", "phone", "call", "mobile", "fax:", "", "")
        return cue, pick(
            f"({d(3, 2)}) {d(3, 2)}-{d(4)}", f"{d(3, 2)}-{d(3, 2)}-{d(4)}", f"{d(3, 2)}.{d(3, 2)}.{d(4)}", f"({d(3, 2)}) {d(3, 2)} {d(4)}",
            f"0{d(2, 1)} {d(4)} {d(4)}", f"0{d(4, 1)} {d(6)}", f"0{d(1, 1)} {d(2)} {d(2)} {d(2)} {d(2)}",
            f"00 {d(2, 1)} {d(1, 1)} {d(2)} {d(2)} {d(2)} {d(2)}"), True
    if kind == 2:
        return pick("ssn", "SSN:", "social security number", "", ""), f"{rng.integers(1, 665):03d}-{rng.integers(1, 99):02d}-{rng.integers(1, 9999):04d}", True
    if kind == 3:
        body = pick("DE", "FR", "ES", "GB", "NL"), d(pick(14, 18, 20))
        check = 98 - int("".join(str(int(c, 36)) for c in body[1] + body[0] + "00")) % 97
        account = f"{body[0]}{check:02d}{body[1]}"
        if pick(0, 1):
            account = " ".join(account[k: k + 4] for k in range(0, len(account), 4))
        return pick("iban", "IBAN:", "account", "", ""), account, True
    if kind == 4:
        name, host = ("".join(chr(97 + rng.integers(26)) for _ in range(rng.integers(3, 9))) for _ in range(2))
        at, dot = pick((" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "))
        return pick("mail", "write to", ""), f"{name}{at}{host}{dot}{pick('com', 'org', 'net', 'de')}", True
    year = str(rng.integers(1900, 2100))
    two = lambda n: f"{rng.integers(1, n):02d}"
    return pick("on", "since", "version", "page", "order", "total", "no", "isbn", "price", "", "", ""), pick(
        f"{year}-{two(13)}-{two(29)}", f"{two(29)}.{two(13)}.{year}", f"{two(13)}/{two(29)}/{year}", f"{year}-{rng.integers(1900, 2100)}",
        f"{number(99)} {d(3)} {d(3)}", f"{number(9)}.{number(99)}.{number(9999)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(7, 1)}", f"{d(10, 1)}",
        f"{d(12, 1)}", " ".join(number(99) for _ in range(rng.integers(4, 9))), f"{d(3)} {d(3)} {d(3)} {d(3)}", f"{number(99)}-{number(99)}-{number(9999)}", f"{year} {year} {year}", f"999-{d(2)}-{d(4)}",
        f"000-{d(2)}-{d(4)}", f"{d(3)}.{d(3)}.{d(3)}.{d(3)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", f"{number(999)} / {number(999)} / {number(999)} / {number(999)}",
        f"XX{d(20)}", f"AB{d(16)}", f"{year}{two(13)}{two(29)}", f"{year}-{two(13)}-{two(29)} {two(24)}.{two(60)}.{two(60)}"), False


def fitted(contexts: list[list[str]], plan: Boosting = Boosting()) -> Model:
    """Trees and thresholds from examples rendered into the given words."""
    rng = np.random.default_rng(plan.seed)
    contexts = [c for c in contexts if c] or [["and"]]
    xs, ys, kinds = [], [], []
    for _ in range(plan.examples):
        words = contexts[rng.integers(len(contexts))]
        at = int(rng.integers(len(words) + 1))
        cue, value, personal = _render(rng)
        head = " ".join([*words[max(0, at - 12): at], *([cue] if cue else [])])
        head += " " if head else ""
        text = head + value + ("", "", ".", ",")[rng.integers(4)] + " " + " ".join(words[at: at + 12])
        want = (len(head), len(head) + len(value))
        for span in candidates(text):
            if span[0] < want[1] and span[2] > want[0]:
                xs.append(features(text, span))
                ys.append(personal and (span[0], span[2]) == want)
                kinds.append(span[1])
    x, y, kind = np.array(xs, np.float64), np.array(ys, np.float64), np.array(kinds)
    test = rng.random(len(y)) < 0.3
    model = boosted(x[~test], y[~test], plan)
    score = model.score(x[test])
    for k in range(len(KINDS)):
        mine = kind[test] == k
        order = np.argsort(-score[mine], kind="stable")
        right = np.cumsum(y[test][mine][order])
        good = np.flatnonzero(right >= plan.precision * np.arange(1, len(order) + 1)) if len(order) else []
        if len(good) and right[good[-1]] > 0:
            model.thresholds[k] = max(0.5, score[mine][order][good[-1]])
    return model


def all_spans(text: str, model: Model) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, by pattern) of one text, by start and kind."""
    base = base_spans(text)
    spans = [(a, k, b, True) for a, k, b in base]
    offered = candidates(text)
    if offered and base:
        starts = np.array([a for a, _, _ in base])
        reach = np.maximum.accumulate([b for _, _, b in base])
        last = np.searchsorted(starts, [c[2] for c in offered], side="left") - 1
        offered = [c for c, k in zip(offered, last, strict=True) if k < 0 or reach[k] <= c[0]]
    if offered:
        score = np.concatenate([
            model.score(np.array([features(text, c) for c in offered[k: k + _SCORED]], np.float64))
            for k in range(0, len(offered), _SCORED)])
        chosen: list[tuple[int, int, int, bool]] = []
        end, held = -1, []

        def settle() -> None:
            starts: list[int] = []
            ends: list[int] = []
            for _, c in sorted(held, key=lambda x: (-x[0], x[1])):
                k = bisect_left(starts, c[2])
                if k == 0 or ends[k - 1] <= c[0]:
                    starts.insert(k, c[0])
                    ends.insert(k, c[2])
                    chosen.append((*c, False))

        for s, c in zip(score, offered, strict=True):
            if s < model.thresholds[c[1]]:
                continue
            if c[0] >= end:
                settle()
                held = []
            held.append((float(s), c))
            end = max(end, c[2])
        settle()
        spans += chosen
    return sorted(spans)


def _maybe(texts: list[str]) -> list[bool]:
    """Texts with a digit, an at sign or a spelled-out dot: no other can hold a span."""
    any_sign = re.compile("[0-9@]")
    return [any_sign.search(t) is not None or "dot" in t for t in texts]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _find(model: Model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            texts = as_large(batch.column(1)).to_pylist()
            spans = [
                [{"kind": KINDS[k], "start": a, "end": b, "base": s} for a, k, b, s in all_spans(t, model)] if some else []
                for t, some in zip(texts, _maybe(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], names=["doc_id", "spans"])

    return work


def redact(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with each stretch of touching spans replaced by the name of its first kind."""
    out, done, k = [], 0, 0
    while k < len(spans):
        start, kind, end, _ = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = end
    return "".join([*out, text[done:]])


def _replace(model: Model, at: int, length_at: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            texts = batch.column(at).to_pylist()
            lengths = batch.column(length_at).to_pylist() if length_at >= 0 else None
            for k, some in enumerate(_maybe([t or "" for t in texts])):
                if some and (spans := all_spans(texts[k], model)):
                    texts[k] = redact(texts[k], spans)
                    if lengths is not None:
                        lengths[k] = len(texts[k])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.types[at])
            if lengths is not None:
                columns[length_at] = pa.array(lengths, batch.schema.types[length_at])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return work


def fit(docs: DataFrame, plan: Boosting = Boosting()) -> Model:
    """The model for a table, from a bounded sample of its words (documents with the smallest hashed ids)."""
    words = F.slice(F.split(F.substring("text", 1, 40 * plan.sample_words), " "), 1, plan.sample_words)
    rows = smallest_hashed(docs.select("doc_id", "text"), plan.sample_rows, "doc_id", plan.seed)
    return fitted([r["words"] or [] for r in rows.select(words.alias("words")).collect()], plan)


def found(docs: DataFrame, plan: Boosting = Boosting()) -> DataFrame:
    """``doc_id, spans`` of every row: kind, start, end and whether a fixed pattern found it."""
    model = fit(docs, plan)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_arrow(rows, _find(model), "doc_id long, spans array<struct<kind string, start long, end long, base boolean>>")


def redacted(docs: DataFrame, plan: Boosting = Boosting(), length: str = "n_chars") -> DataFrame:
    """The rows with personal data replaced by its kind, in ``text`` and, where it exists, the ``length`` column."""
    model = fit(docs, plan)
    schema = ", ".join(f"`{n}` {k}" for n, k in docs.dtypes)
    at = docs.columns.index("text")
    return in_arrow(docs, _replace(model, at, docs.columns.index(length) if length in docs.columns else -1), schema)

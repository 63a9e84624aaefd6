"""Gated recurrent language model over words, with a class-factored output.

P(word | history) = P(class | state) * P(word | class). The state is that of a
gated recurrent unit fed with the classes of the words so far; it is carried over
all windows of a document, so a document's score is the log-likelihood of the
whole text. Words are classed by the company they keep: frequent words by k-means
over the mean signature of the documents they occur in, less frequent ones, rare
ones and the end of a text have classes of their own. Word counts, signatures and
the network all come from every training document.

Training is truncated backpropagation in numpy inside Spark tasks: each round,
every task goes once over its share of the training documents from the round's
common weights, and the weights are averaged by tokens. Only the weights and the
``frequent`` commonest words (both of fixed size) reach the driver. Counts of
other words stay a table and are joined by the word's hash.

Defined results: a null or empty text is its end token alone; ``held_out`` is
false for a null id; repeated rows are scored (and learned from) each; a word not
seen in training shares one unseen slot's probability; with no training document
the class part is uniform; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import in_arrow, kept
from riskloom.llm.words import Words, hashes, in_pieces, ranges, sums

#: The end of a text as a token: it holds a space, so it is no word.
END = b" end"
PIECE = 8 << 20


@dataclass(frozen=True)
class RecurrentModel:
    frequent: int = 1 << 18  # at most
    classed: int = 1 << 16
    clusters: int = 40
    guides: int = 256
    signature: int = 8
    hidden: int = 16
    lanes: int = 512
    window: int = 16
    rounds: int = 2
    rate: float = 0.01
    block_tokens: int = 8 << 20
    seed: int = 5

    @property
    def classes(self) -> int:
        """The clusters, then less frequent words, rare words, the end."""
        return self.clusters + 3


@dataclass(frozen=True)
class Lexicon:
    """The frequent words (sorted hashes) with counts and classes, and totals of all words."""

    words: np.ndarray
    counts: np.ndarray
    class_of: np.ndarray
    inside: np.ndarray
    tokens: int
    distinct: int
    rare_tokens: int
    rare_distinct: int
    classes: int

    def look_up(self, words: np.ndarray) -> np.ndarray:
        """Place of each hash among the frequent words, or -1."""
        if not len(self.words):
            return np.full(len(words), -1, np.int64)
        k = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[k] == words, k, -1)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id) == 1, F.lit(False))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, codes of all tokens with an end after each text, and bounds."""
    words = Words(texts, lower=True)
    distinct = np.concatenate((hashes(words.distinct), hashes([END])))
    n = len(words.bounds) - 1
    bounds = words.bounds + np.arange(n + 1)
    codes = np.empty(bounds[-1], np.int64)
    last = np.zeros(len(codes), bool)
    last[bounds[1:] - 1] = True
    codes[last], codes[~last] = len(distinct) - 1, words.codes
    return distinct, codes, bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_pieces(batches, limit=PIECE):
        distinct, codes, _ = _tokens(batch.column(0))
        n = np.bincount(codes, minlength=len(distinct))
        yield pa.RecordBatch.from_arrays([pa.array(distinct.astype(np.int64)), pa.array(n, pa.int64())], names=["word", "n"])


def word_counts(training: DataFrame) -> DataFrame:
    """``word`` (hash) and ``n`` of every distinct token of the training documents."""
    counted = in_arrow(training.select("text"), _count, "word long, n long")
    return kept(counted.groupBy("word").agg(F.sum("n").alias("n")), "word_counts")


def _signatures(words: np.ndarray, guide: np.ndarray, classed: np.ndarray, plan: RecurrentModel):
    """Sums over documents of the document's signature, for the words to be classed.

    ``guide[k]`` numbers the guide words and ``classed[k]`` the classed ones, else -1.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = int(classed.max(initial=-1)) + 1
        acc = np.zeros((plan.signature + 1, total))
        project = np.random.default_rng(plan.seed).standard_normal((plan.guides, plan.signature))
        look = Lexicon(words, words, words, words, 0, 0, 0, 0, 0)
        for batch in in_pieces(batches, limit=PIECE):
            distinct, codes, bounds = _tokens(batch.column(0))
            place = look.look_up(distinct)
            known = np.where(place >= 0, place, 0)
            of_word = np.where(place >= 0, classed[known], -1)[codes]
            of_guide = np.where(place >= 0, guide[known], -1)[codes]
            doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            hit = of_guide >= 0
            bag = np.bincount(doc[hit] * plan.guides + of_guide[hit], minlength=(len(bounds) - 1) * plan.guides)
            bag = np.sqrt(bag.reshape(-1, plan.guides))
            bag /= np.maximum(np.linalg.norm(bag, axis=1, keepdims=True), 1e-9)
            sign = bag @ project
            mine = of_word >= 0
            word, doc = of_word[mine], doc[mine]
            for d in range(plan.signature):
                acc[d] += np.bincount(word, weights=sign[doc, d], minlength=total)
            acc[-1] += np.bincount(word, minlength=total)
        seen = np.flatnonzero(acc[-1]) if total else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int64()), *(pa.array(acc[d, seen]) for d in range(plan.signature + 1))],
            names=["word", *(f"s{d}" for d in range(plan.signature)), "n"])

    return work


def _clusters(x: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means; every word's cluster."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centers = x[rng.choice(len(x), k, replace=False, p=weight / weight.sum())].copy()
    near = np.zeros(len(x), np.int64)
    for _ in range(20):
        near = np.argmin((centers * centers).sum(axis=1) - 2 * (x @ centers.T), axis=1)
        mass = np.bincount(near, weights=weight, minlength=k)
        for d in range(x.shape[1]):
            mean = np.bincount(near, weights=weight * x[:, d], minlength=k)
            centers[:, d] = np.where(mass > 0, mean / np.maximum(mass, 1e-300), centers[:, d])
    return near


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The commonest words, at most ``most``: all above a count, which a histogram of counts (eighths of octaves) gives.

    Only the histogram and these words reach the driver, however many partitions there are.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    least, held = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r["step"]):
        held += r["k"]
        if held > most:
            break
        least = r["step"]
    return counts.where("false") if least is None else counts.where(step >= least)


def lexicon(training: DataFrame, counts: DataFrame, plan: RecurrentModel) -> Lexicon:
    total = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    tokens, distinct = int(total[0] or 0), int(total[1])
    top = _frequent(counts, plan.frequent).toPandas().sort_values(["n", "word"], ascending=[False, True])
    order = np.argsort(top["word"].to_numpy().astype(np.uint64), kind="stable")
    words, n = top["word"].to_numpy().astype(np.uint64)[order], top["n"].to_numpy().astype(np.int64)[order]
    rank = np.empty(len(order), np.int64)
    rank[np.arange(len(order))] = order
    end = words == hashes([END])[0]
    class_of = np.full(len(words), plan.clusters, np.int64)
    classed = np.where((rank < plan.classed) & ~end, np.cumsum((rank < plan.classed) & ~end) - 1, -1)
    if (classed >= 0).any():
        guide = np.where(rank < plan.guides, rank, -1)
        schema = "word long, " + ", ".join(f"s{d} double" for d in range(plan.signature)) + ", n double"
        sums_of = in_arrow(training.select("text"), _signatures(words, guide, classed, plan), schema).groupBy("word").agg(
            *(F.sum(c).alias(c) for c in (*(f"s{d}" for d in range(plan.signature)), "n"))).orderBy("word").toPandas()
        x = sums_of[[f"s{d}" for d in range(plan.signature)]].to_numpy() / sums_of[["n"]].to_numpy()
        near = _clusters(x, sums_of["n"].to_numpy(), plan.clusters, plan.seed)
        by_number = np.full(int(classed.max()) + 1, plan.clusters, np.int64)
        by_number[sums_of["word"].to_numpy()] = near
        class_of[classed >= 0] = by_number[classed[classed >= 0]]
    class_of[end] = plan.clusters + 2
    mass = np.bincount(class_of, weights=n, minlength=plan.classes)
    size = np.bincount(class_of, minlength=plan.classes)
    inside = np.log10((n + 0.5) / (mass[class_of] + 0.5 * size[class_of])) if len(n) else np.empty(0)
    return Lexicon(words, n, class_of, inside, tokens, distinct, tokens - int(n.sum()), distinct - len(n), plan.classes)


class Network:
    """The recurrent unit and its class output; all weights in one flat vector."""

    def __init__(self, classes: int, hidden: int, flat: np.ndarray | None = None, seed: int = 0) -> None:
        self.c, self.h = classes, hidden
        shapes = ((classes + 1, 3 * hidden), (hidden, 3 * hidden), (hidden, classes), (1, classes))
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = np.concatenate([(rng.standard_normal(a * b) * (0.3 if k < 3 else 0.0)) for k, (a, b) in enumerate(shapes)])
        self.flat = np.array(flat, np.float32)
        self.parts, at = [], 0
        for a, b in shapes:
            self.parts.append(self.flat[at: at + a * b].reshape(a, b))
            at += a * b

    def states(self, before: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
        """States after each step of a window; ``before`` holds the class ahead of each token."""
        table, u, _, _ = self.parts
        k = self.h
        out = np.empty((len(before), len(h), k), np.float32)
        held = []
        for t in range(len(before)):
            h = h * ~fresh[t][:, None]
            x, y = table[before[t]], h @ u
            gates = 1 / (1 + np.exp(-(x[:, : 2 * k] + y[:, : 2 * k])))
            z, r = gates[:, :k], gates[:, k:]
            n = np.tanh(x[:, 2 * k:] + r * y[:, 2 * k:])
            new = n + z * (h - n)
            if keep:
                held.append((h, z, r, n, y[:, 2 * k:]))
            h = out[t] = new
        return out, h, held

    def log_classes(self, states: np.ndarray) -> np.ndarray:
        _, _, v, bias = self.parts
        a = states.reshape(-1, self.h) @ v + bias
        a -= a.max(axis=1, keepdims=True)
        return a - np.log(np.exp(a).sum(axis=1, keepdims=True))

    def gradient(self, before, fresh, target, h) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the mean loss of a window, truncated at its start, and the state after it."""
        _, u, v, _ = self.parts
        k, (steps, lanes) = self.h, before.shape
        states, last, held = self.states(before, fresh, h, keep=True)
        d = np.exp(self.log_classes(states))
        d[np.arange(len(d)), target.ravel()] -= 1
        d /= len(d)
        flat_states = states.reshape(-1, k)
        grad_v, grad_bias = flat_states.T @ d, d.sum(axis=0)
        d_states = (d @ v.T).reshape(steps, lanes, k)
        grad_u, d_in = np.zeros_like(u), np.empty((steps, lanes, 3 * k), np.float32)
        dh = np.zeros((lanes, k), np.float32)
        for t in range(steps - 1, -1, -1):
            h0, z, r, n, y = held[t]
            dh = dh + d_states[t]
            dn = dh * (1 - z) * (1 - n * n)
            d_in[t, :, :k] = dh * (h0 - n) * z * (1 - z)
            d_in[t, :, k: 2 * k] = dn * y * r * (1 - r)
            d_in[t, :, 2 * k:] = dn
            d_y = d_in[t].copy()
            d_y[:, 2 * k:] *= r
            grad_u += h0.T @ d_y
            dh = (dh * z + d_y @ u.T) * ~fresh[t][:, None]
        one = np.zeros((steps * lanes, self.c + 1), np.float32)
        one[np.arange(len(one)), before.ravel()] = 1
        grad_table = one.T @ d_in.reshape(-1, 3 * k)
        return np.concatenate([g.ravel() for g in (grad_table, grad_u, grad_v, grad_bias)]), last


def _classes_of(distinct: np.ndarray, codes: np.ndarray, lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Place among the frequent words (or -1) of every distinct word, and the class of every token."""
    place = lex.look_up(distinct)
    known = np.where(place >= 0, place, 0)
    kinds = np.where(place >= 0, lex.class_of[known] if len(lex.class_of) else 0, lex.classes - 2)
    return place, kinds.astype(np.int16)[codes]


def _ahead(kinds: np.ndarray, bounds: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Class ahead of every token (``start`` at the beginning of a document) and where documents begin."""
    fresh = np.zeros(len(kinds), bool)
    fresh[bounds[:-1]] = True
    before = np.empty_like(kinds)
    before[1:] = kinds[:-1]
    before[fresh] = start
    return before, fresh


def _train(lex: Lexicon, flat: np.ndarray, plan: RecurrentModel):
    """One pass over the partition from the given weights: the weights after it, weighted by tokens."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(lex.classes, plan.hidden, flat)
        first, second, updates, seen = np.zeros_like(net.flat), np.zeros_like(net.flat), 0, 0
        held, size = [], 0

        def learn() -> None:
            nonlocal updates, seen, held, size
            kinds, before, fresh = (np.concatenate([h[k] for h in held]) for k in range(3))
            held, size = [], 0
            lanes = max(1, min(plan.lanes, len(kinds) // plan.window))
            steps = len(kinds) // lanes
            # All tokens lie in equal lanes, one stretch of the stream each; what is over makes a shorter last block.
            for low, wide, n in ((0, lanes, steps), (lanes * steps, 1, len(kinds) - lanes * steps)):
                if n == 0:
                    continue
                part = slice(low, low + wide * n)
                x, y, s = (a[part].reshape(wide, n).T for a in (before, kinds, fresh))
                h = np.zeros((wide, plan.hidden), np.float32)
                for t in range(0, n, plan.window):
                    w = slice(t, t + plan.window)
                    grad, h = net.gradient(x[w], s[w], y[w].astype(np.int64), h)
                    updates += 1
                    first[:] = 0.9 * first + 0.1 * grad
                    second[:] = 0.99 * second + 0.01 * grad * grad
                    step = plan.rate / (1 + updates / 2000) ** 0.5 * np.sqrt(1 - 0.99 ** updates) / (1 - 0.9 ** updates)
                    net.flat -= (step * first / (np.sqrt(second) + 1e-8)).astype(np.float32)
            seen += len(kinds)

        for batch in in_pieces(batches, limit=PIECE):
            distinct, codes, bounds = _tokens(batch.column(0))
            _, kinds = _classes_of(distinct, codes, lex)
            held.append((kinds, *_ahead(kinds, bounds, lex.classes)))
            size += len(kinds)
            if size >= plan.block_tokens // 4:
                learn()
        if held:
            learn()
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([seen], pa.int64()), pa.array([net.flat.astype(np.float64).tolist()], pa.list_(pa.float64()))],
                names=["tokens", "weights"])

    return work


def trained(training: DataFrame, lex: Lexicon, plan: RecurrentModel) -> np.ndarray:
    """Weights after all rounds; each training document is in exactly one round."""
    flat = Network(lex.classes, plan.hidden, seed=plan.seed).flat
    # Start from the classes' overall shares, which every task would learn first.
    mass = np.bincount(lex.class_of, weights=lex.counts, minlength=lex.classes) if len(lex.counts) else np.zeros(lex.classes)
    mass[lex.classes - 2] += lex.rare_tokens
    flat[-lex.classes:] = np.log((mass + 1) / (mass.sum() + lex.classes))
    for k in range(plan.rounds):
        share = training.where(F.pmod(F.xxhash64(F.lit(plan.seed), "doc_id"), F.lit(plan.rounds)) == k).select("text")
        each = in_arrow(share, _train(lex, flat, plan), "tokens long, weights array<double>")
        mean = each.select("tokens", F.posexplode("weights").alias("at", "w")).groupBy("at").agg(
            (F.sum(F.col("w") * F.col("tokens")) / F.sum("tokens")).alias("w")).orderBy("at").toPandas()
        if len(mean):
            flat = mean["w"].to_numpy().astype(np.float32)
    return flat


def _lanes(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents dealt to lanes, longest first, each to the shortest lane; longest lane first."""
    heap = [(0, k) for k in range(max(1, min(lanes, len(lengths))))]
    out: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-lengths, kind="stable").tolist():
        total, k = heapq.heappop(heap)
        out[k].append(d)
        heapq.heappush(heap, (total + int(lengths[d]), k))
    return sorted(out, key=lambda docs: -int(lengths[docs].sum()))


def class_scores(net: Network, kinds: np.ndarray, bounds: np.ndarray, lanes: int, window: int) -> np.ndarray:
    """log10 probability of the classes of every document; states run through each document whole."""
    lengths = np.diff(bounds)
    dealt = _lanes(lengths, lanes)
    before, fresh = _ahead(kinds, bounds, net.c)
    per_lane = np.array([int(lengths[docs].sum()) for docs in dealt])
    order = np.array([d for docs in dealt for d in docs], np.int64)
    stream = ranges(bounds[:-1][order], lengths[order])
    base = np.concatenate(([0], np.cumsum(per_lane)))[:-1]
    got = np.zeros(len(stream), np.float64)
    h = np.zeros((len(dealt), net.h), np.float32)
    for t in range(0, int(per_lane.max(initial=0)), window):
        open_lanes = int(np.searchsorted(-per_lane, -t, side="left"))
        steps = np.arange(t, min(t + window, int(per_lane[0])))
        at = base[None, :open_lanes] + steps[:, None]
        inside = steps[:, None] < per_lane[None, :open_lanes]
        token = stream[np.where(inside, at, base[None, :open_lanes])]
        states, h, _ = net.states(before[token], fresh[token] & inside, h[:open_lanes])
        logs = net.log_classes(states)
        value = logs[np.arange(len(logs)), kinds[token].ravel()].reshape(inside.shape)
        got[at[inside]] = value[inside]
    of_doc = np.zeros(len(lengths))
    of_doc[order] = sums(got, np.concatenate(([0], np.cumsum(lengths[order]))))
    return of_doc / np.log(10)


def _score(lex: Lexicon, flat: np.ndarray, plan: RecurrentModel):
    """Per document: counts, scores of its frequent words and classes, and its rare words for the join."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        net, held, size = Network(lex.classes, plan.hidden, flat), [], 0
        row = TaskContext.get().partitionId() << 40
        base_of = np.log10((lex.counts + 0.5) / (lex.tokens + 0.5 * (lex.distinct + 1))) if len(lex.counts) else np.zeros(1)
        inside_of = lex.inside if len(lex.inside) else np.zeros(1)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, row
            kinds = np.concatenate([h[1] for h in held])
            ends = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(h[2]) for h in held]))))
            by_class = class_scores(net, kinds, ends, plan.lanes, plan.window)
            done = 0
            for ids, _, bounds, facts in held:
                n = len(bounds) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(n), pa.int64()), ids, pa.array(np.diff(bounds)), *facts[:2],
                     pa.array(facts[2] + by_class[done: done + n]), *facts[3:]],
                    names=["row", "doc_id", "n_tokens", "n_frequent", "base", "model", "rare", "times"])
                done, row = done + n, row + n
            held, size = [], 0

        for batch in in_pieces(batches, limit=PIECE):
            distinct, codes, bounds = _tokens(batch.column(1))
            place, kinds = _classes_of(distinct, codes, lex)
            of_token = place[codes]
            hit = of_token >= 0
            known = np.where(hit, of_token, 0)
            n_frequent = sums(hit.astype(np.int64), bounds)
            base = sums(np.where(hit, base_of[known], 0.0), bounds)
            inside = sums(np.where(hit, inside_of[known], 0.0), bounds)
            doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[~hit]
            pair, times = np.unique(doc * len(distinct) + codes[~hit], return_counts=True)
            ends = np.searchsorted(pair, np.arange(len(bounds)) * len(distinct)).astype(np.int32)
            rare = distinct[pair % len(distinct)].astype(np.int64)
            facts = (pa.array(n_frequent), pa.array(base), inside, pa.ListArray.from_arrays(pa.array(ends), pa.array(rare)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int64))))
            held.append((batch.column(0), kinds, bounds, facts))
            size += len(codes)
            if size >= plan.block_tokens:
                yield from flush()
        if held:
            yield from flush()

    return work


def scored(docs: DataFrame, plan: RecurrentModel = RecurrentModel()) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    training = source.where(~is_held_out(F.col("doc_id")))
    counts = word_counts(training)
    lex = lexicon(training, counts, plan)
    flat = trained(training, lex, plan)
    schema = (
        "row long, doc_id long, n_tokens long, n_frequent long, base double, model double, rare array<long>, times array<long>")
    rows = kept(in_arrow(source, _score(lex, flat, plan), schema), "scored")
    # Words outside the frequent ones: their counts come from the table, by the word's hash.
    each = rows.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("e")).select(
        "row", F.col("e.rare").alias("word"), F.col("e.times").alias("times"))
    n = F.coalesce(F.col("n"), F.lit(0))
    base = F.log10((n + 0.5) / (lex.tokens + 0.5 * (lex.distinct + 1)))
    model = F.log10((n + 0.5) / (lex.rare_tokens + 0.5 * (lex.rare_distinct + 1)))
    late = each.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("n_rare"), F.sum(base * F.col("times")).alias("base_rare"),
        F.sum(model * F.col("times")).alias("model_rare"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.drop("rare", "times").join(late, "row", "left").select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("n_frequent") + zero("n_rare")).cast("long").alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base_rare")).alias("base_score"), (F.col("model") + zero("model_rare")).alias("score"))

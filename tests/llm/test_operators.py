"""Operators of the llm subpackage against brute force, on small and awkward tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import (
    chosen_path, curriculum, importance, multi_index, packing_bfd, packing_nnls, pii_boost, quality_rules, recurrent_lm, shared, slots)
from riskloom.llm.tokens import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, row_key string, size string, slot int"


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words_of(text: str | None, low: bool = False) -> list[str]:
    return WORD.findall(lower(text) if low else text) if text else []


def sentence(rng: np.random.Generator, n: int, alphabet: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(list(alphabet), rng.integers(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts() -> list[tuple[int | None, str | None, str | None, str | None]]:
    """Nulls, empties, a very long text, exact and near copies, repeated rows and ties."""
    rng = np.random.default_rng(1)
    base = [sentence(rng, int(n)) for n in rng.integers(20, 120, 30)]
    rows = [(k, t, ("en", "de")[k % 2], f"s{k % 4}") for k, t in enumerate(base)]
    for k in range(30, 60):
        near = base[0].split(" ")
        near[int(rng.integers(len(near)))] = f"x{k}"
        rows.append((k, " ".join(near), "en", "s0"))
    rows += [(k, base[3], "en", "s0") for k in range(60, 75)]
    rows += [
        (80, None, "en", "s1"), (81, "", "en", None), (82, " \n\t ", None, "s1"), (83, "one", "en", "s1"), (84, "ONE", "en", "s1"),
        (85, sentence(rng, 9000), "en", "s2"), (86, "a b c d", "en", "s2"), (87, "a b c d e a b c d e", "en", "s2"),
        (88, "line one two\nline one two\n\nline one two", "en", "s3"), (89, "é ß <|endoftext|> Σας ﬁ 12.5 it's", "de", "s3"),
        (None, "no id at all here", "en", "s0"), (5, base[5], "de", "s1")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, lang, src, len(t) if t else 0, 1, "k", "z", 7) for i, t, lang, src in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(k, int(k % 5 != 0), 0) for k in range(60)] + [(None, 1, 0), (7, None, None), (999, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- packing ----------------------------------------------------------------------------------------------------------


def encoded(text: str | None, end: int) -> list[int]:
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    return [*whole.encode(text or "", add_special_tokens=False).ids, end]


def test_best_fit_packing_loses_nothing(docs, texts):
    found: dict = {}
    for r in packing_bfd.packed(docs, window=64, block_tokens=3000).collect():
        parts = packing_bfd.unpacked(bytes(r["ids"]), r["cu_seqlens"])
        places = np.frombuffer(bytes(r["position_ids"]), "<u2")
        assert r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= 64 and len(bytes(r["ids"])) == 128
        for d, s, part, at in zip(r["doc_ids"], r["starts"], parts, r["cu_seqlens"], strict=False):
            assert list(places[at: at + len(part)]) == list(range(len(part)))
            found.setdefault(d, []).append((s, part))
    for d, t, *_ in texts:
        want = encoded(t, packing_bfd.END_ID)
        got = sorted(found[-1 if d is None else d])
        copies = 2 if d == 5 else 1
        assert [x for s, p in got[::copies] for x in p] == want, d


def test_best_fit_uses_the_fullest_open_row():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 65, 400)
    row, offset, rows = packing_bfd.best_fit_decreasing(lengths, 64)
    free: list[int] = []
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [k for k, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda k: free[k])] -= n
        else:
            free.append(64 - n)
    used = np.bincount(row, weights=lengths)
    assert rows == len(free) and sorted(64 - used) == sorted(free)
    assert all(offset[k] + lengths[k] <= 64 for k in range(400))


def test_nnls_packing_covers_every_id_once(docs, texts):
    rows = packing_nnls.packed(docs, window=64, unit=8, with_ids=True).collect()
    by_sequence: dict = {}
    pieces: dict = {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], list(r["ids"])))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for d, t, *_ in texts:
        got = sorted(pieces[d])[:: 2 if d == 5 else 1]
        assert [x for _, p in got for x in p] == encoded(t, 1)
    assert sum(r["length"] for r in rows) / (64 * len(by_sequence)) > 0.85


def test_nnls_matches_brute_force_and_plan_uses_all():
    rng = np.random.default_rng(0)
    for _ in range(5):
        a, b = rng.random((4, 6)), rng.standard_normal(4)
        x = packing_nnls.nnls(a, b)
        best = np.inf
        for mask in range(64):
            on = [k for k in range(6) if mask >> k & 1]
            if len(on) <= 4:
                s = np.linalg.lstsq(a[:, on], b, rcond=None)[0] if on else np.empty(0)
                if (s >= -1e-12).all():
                    best = min(best, float(((a[:, on] @ s if on else 0) - b) @ ((a[:, on] @ s if on else 0) - b)))
        assert (x >= 0).all() and abs(float((a @ x - b) @ (a @ x - b)) - best) < 1e-6
    histogram = {int(k): int(v) for k, v in enumerate(rng.integers(0, 30, 17)) if k and v}
    made = packing_nnls.plan(histogram, 16)
    used: Counter = Counter()
    for combo, times in made:
        assert sum(combo) <= 16
        for n in combo:
            used[n] += times
    assert used == histogram


def test_nnls_sequences_pad(docs):
    rows = packing_nnls.sequences(packing_nnls.packed(docs, window=64, unit=8, with_ids=True), 64).collect()
    assert all(len(r["ids"]) == 64 or math.log2(len(r["ids"])).is_integer() for r in rows)


# ---- quality rules ----------------------------------------------------------------------------------------------------


def measures(text: str | None) -> tuple:
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    grams = [tuple(w[k: k + 5]) for k in range(len(w) - 4)]
    many = Counter(grams)
    cover = {k + j for k, g in enumerate(grams) if many[g] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_quality_measures(docs, labels, texts):
    rows = quality_rules.judged(docs, labels).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
    assert got == Counter((d, *measures(t)) for d, t, *_ in texts)
    for r in rows:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and not r["rejected_by"])


def test_binomial_tail(spark):
    rows = spark.createDataFrame([(n, k) for n in (1, 5, 40, 3000) for k in (0, 1, 3, 30) if k <= n], "n long, k long")
    for r in rows.withColumn("p", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.02)).collect():
        want = sum(math.comb(r["n"], i) * 0.02 ** i * 0.98 ** (r["n"] - i) for i in range(r["k"] + 1))
        assert abs(r["p"] - want) < 1e-9


def test_certified_cutoffs_reject_junk_and_spare_the_good(spark):
    rng = np.random.default_rng(2)
    rows = [(k, sentence(rng, 40) if k % 10 else " ".join(w + "%%%" for w in sentence(rng, 40).split()), "en") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 10 > 0), 0) for k in range(2000)], "doc_id long, quality int, toxic int")
    control = quality_rules.RiskControl(alpha=0.05)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs, labels, control).collect()}
    assert not any(kept[k] for k in range(0, 2000, 10))
    assert sum(not kept[k] for k in range(2000) if k % 10) <= 0.05 * 1800
    assert quality_rules.filtered(docs, labels, control).count() == sum(kept.values())


# ---- personal data ----------------------------------------------------------------------------------------------------


def luhn(d: str) -> bool:
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(t: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(4)
    fixed = ["a@b.c@d.e", "@x.y", "a@@b.c", "x@y", "u@a-b.co.uk.", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "0255.001.1.1", "+1 (988) 555-2485",
             "++12345678901", "4111 1111 1111 1111", "+4111111111111111", "1-2 3--4", "é a.b@c.de ñ 10.0.0.1"]
    alphabet = list("ab1234567890.@+-() %_é\n") + ["4111111111111111", "@a.b", "10.0.0.1", "+1 555 "]
    for text in fixed + ["".join(rng.choice(alphabet, rng.integers(1, 60))) for _ in range(3000)]:
        assert pii_boost.base_spans(text) == plain_spans(text), text


@pytest.fixture(scope="module")
def model():
    return pii_boost.fitted([["the", "house", "and", "a", "tree", "in", "the", "garden", "of", "time"]])


def test_boosting_adds_spans_and_leaves_clean_text(model):
    def kinds(text):
        return [(pii_boost.KINDS[k], text[a:b]) for a, k, b, _ in pii_boost.all_spans(text, model)]

    assert kinds("please call tel (988) 555-2485 today") == [("phone", "(988) 555-2485")]
    assert kinds("his ssn 512-44-9321 is here") == [("ssn", "512-44-9321")]
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00 thanks") == [("iban", "DE89 3704 0044 0532 0130 00")]
    for clean in ("on 2024-01-15 we met", "version 1.2.3 of 1999", "the years 1990-2000", "page 12, 345 items", "in the garden"):
        assert kinds(clean) == []


def test_long_hostile_texts_take_linear_time(model):
    for text in ("a" * 200_000, "1" * 200_000, "1 " * 100_000, "@" * 100_000, "a@" * 100_000, "1." * 100_000, "+1(" * 60_000, "(1" * 60_000):
        pii_boost.all_spans(text, model)


def test_found_and_redacted(spark, model):
    rows = [(1, "mail a.b@c.de now", 17, "x"), (2, None, 0, None), (3, "", 0, "x"), (4, "plain", 5, "x"), (4, "plain", 5, "x"),
            (5, "+1 (988) 555-2485 and 42.144.35.254", 35, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = {r["doc_id"]: r["spans"] for r in pii_boost.found(docs).collect()}
    for d, t, *_ in rows:
        assert [(s["start"], pii_boost.KINDS.index(s["kind"]), s["end"]) for s in got[d] if s["base"]] == plain_spans(t or "")
    clean = {r["doc_id"]: r for r in pii_boost.redacted(docs).collect()}
    assert clean[1]["text"] == "mail <EMAIL> now" and clean[1]["n_chars"] == 16 and clean[2]["text"] is None
    assert clean[5]["text"] == "<PHONE> and <IP>" and clean[4]["text"] == "plain" and clean[1]["spans"] == "x"


def test_personal_data_query_digest(spark):
    from riskloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in shared.table(spark, sf, "documents").collect()}
    for r in QUERIES["op3_candidate_boosting"](spark, sf).collect():
        spans = plain_spans(texts[r["doc_id"]])
        told = ",".join(f"{pii_boost.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii_boost.KINDS[:4]] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert set(told.split(",")) - {""} <= set(r["spans"].split(","))


# ---- importance resampling --------------------------------------------------------------------------------------------


def test_resampling_prefers_target_text(spark):
    rng = np.random.default_rng(5)
    rows = [(k, sentence(rng, 60, "abcd" if k % 4 else "wxyz")) for k in range(400)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(200)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in importance.resampled(docs, labels, importance.Resampling(share=0.7)).collect()}
    assert sum(r["kept"] for r in got.values()) == math.ceil(0.7 * 402)
    assert not any(got[k]["kept"] for k in range(0, 400, 4))
    assert got[900]["log_weight"] == 0 and got[901]["n_grams"] == 0
    for k in (1, 8):
        w = words_of(rows[k][1])
        assert got[k]["n_grams"] == 2 * len(w) - 1
    assert sorted(r["place"] for r in got.values()) == list(range(402))


# ---- language model ---------------------------------------------------------------------------------------------------

SMALL = recurrent_lm.RecurrentModel(frequent=30, classed=24, clusters=4, guides=16, lanes=8, window=4, block_tokens=4000)


def test_base_score_and_counts(docs, texts):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    counts: Counter = Counter()
    for d, t, *_ in texts:
        if not held(d):
            counts.update([*words_of(t, True), " end"])
    n, v = sum(counts.values()), len(counts)
    got = Counter()
    for r in recurrent_lm.scored(docs, SMALL).collect():
        assert r["train_tokens"] == n and np.isfinite(r["score"]) and r["score"] < 0
        got[(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6))] += 1
    want = Counter()
    for d, t, *_ in texts:
        w = [*words_of(t, True), " end"]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want[(d, held(d), len(w), sum(counts[x] > 0 for x in w), round(base, 6))] += 1
    assert got == want


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    net = recurrent_lm.Network(3, 4, seed=1)
    before, target = rng.integers(0, 4, (5, 2)), rng.integers(0, 3, (5, 2))
    fresh = np.array([[1, 1], [0, 0], [0, 1], [0, 0], [0, 0]], bool)
    h = np.zeros((2, 4), np.float32)

    def loss(flat):
        states, _, _ = recurrent_lm.Network(3, 4, flat).states(before, fresh, h)
        logs = recurrent_lm.Network(3, 4, flat).log_classes(states)
        return -logs[np.arange(10), target.ravel()].mean()

    grad, _ = net.gradient(before, fresh, target, h)
    for k in rng.choice(len(net.flat), 25, replace=False):
        up, down = net.flat.copy(), net.flat.copy()
        up[k] += 1e-2
        down[k] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - grad[k]) < 2e-3


def test_state_runs_through_the_whole_document():
    rng = np.random.default_rng(1)
    net = recurrent_lm.Network(5, 4, seed=2)
    lengths = np.array([1, 40, 3, 17, 2, 90])
    kinds, bounds = rng.integers(0, 5, lengths.sum()).astype(np.int16), np.concatenate(([0], np.cumsum(lengths)))
    got = recurrent_lm.class_scores(net, kinds, bounds, lanes=3, window=4)
    for d, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        h, last, total = np.zeros((1, 4), np.float32), 5, 0.0
        for k in kinds[a:b]:
            states, h, _ = net.states(np.array([[last]]), np.zeros((1, 1), bool), h)
            total += float(net.log_classes(states)[0, k])
            last = int(k)
        assert abs(got[d] - total / math.log(10)) < 1e-3


def test_the_model_learns_what_counts_cannot(spark):
    rng = np.random.default_rng(6)
    rows = [(k, sentence(rng, 80, ("abc", "xyz")[k % 2])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = recurrent_lm.RecurrentModel(frequent=400, classed=400, clusters=6, guides=32, lanes=16, window=8)
    held = recurrent_lm.scored(docs, plan).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (held[0] - held[1]) / held[2] > 0.15


# ---- near-duplicates --------------------------------------------------------------------------------------------------


def brute_classes(rows):
    sets = []
    for d, t in rows:
        w = words_of(t, True)
        sets.append({tuple(w[k: k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("plan", [chosen_path.ChosenPath(), chosen_path.ChosenPath(leaf=4, block=8, depth=2, pivots=1, turns=2, met=1)])
def test_classes_equal_brute_force(spark, texts, plan):
    rng = np.random.default_rng(8)
    rows = [(d, t) for d, t, *_ in texts if d is not None and d != 85]
    shared_part = sentence(rng, 60)
    rows += [(1000 + k, f"{shared_part} {sentence(rng, 90)}") for k in range(40)]
    far = [sentence(rng, 200).split() for _ in range(6)]
    for k in range(120):
        copy = list(far[k % 6])
        for at in rng.choice(200, int(rng.integers(1, 14)), replace=False):
            copy[at] = f"n{k}x{at}"
        rows.append((2000 + k, " ".join(copy)))
    docs = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], "doc_id long, text string, n long, root long, node string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in chosen_path.classes(docs, plan).collect())
    assert got == Counter(brute_classes(rows))
    assert chosen_path.deduplicated(docs, plan).count() == len({d for d, _, _, keep in brute_classes(rows) if keep})


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 300)] + [(500, 400), (7, 7)], "a long, b long")
    got = {r["id"]: r["root"] for r in shared.components(edges).collect()}
    assert all(got[k] == 0 for k in range(301)) and got[500] == got[400] == 400


# ---- sharding ---------------------------------------------------------------------------------------------------------


def test_shards(docs, texts, tmp_path):
    rows = slots.shard_table(docs, shards=5, slots=64, map_path=str(tmp_path / "map")).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in texts)
    for s in range(5):
        mine = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert mine == list(range(len(mine)))
    assert len({(r["slot_no"], r["shard"]) for r in rows}) == len({r["slot_no"] for r in rows})


def test_null_and_repeated_ids_spread(spark):
    rows = [(None if k % 2 else 7, f"text {k}") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    load = Counter()
    for r in slots.shard_table(docs, shards=4, slots=512).collect():
        load[r["shard"]] += r["size"]
    assert len(load) == 4 and max(load.values()) - min(load.values()) < 0.02 * sum(load.values())


def test_versions_of_the_map_and_written_shards(spark, tmp_path):
    where, out = str(tmp_path / "map"), str(tmp_path / "out")
    rows = [(None if k % 50 == 0 else k, f"text {k}", "mine") for k in range(800)]
    clash = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    before = {r["slot_no"]: r["shard"] for r in slots.shard_table(clash, 4, 64, where).select("slot_no", "shard").collect()}
    after = {r["slot_no"]: r["shard"] for r in slots.rebalanced(clash, where, 0, 5, 64).collect()}
    assert len(after) == 64 and max(after.values()) == 4
    assert {r["slot_no"]: r["shard"] for r in slots.read_map(spark, where, 0).collect()}.items() >= before.items()
    assert sum(after[k] != v for k, v in before.items()) < len(before) / 2
    for version, held in ((0, before), (1, after)):
        slots.write_shards(clash, out, where, version, 64)
        written = spark.read.parquet(f"{out}/version={version}")
        want = Counter((r["doc_id"], held[r["slot_no"]]) for r in slots.sized(clash, 64).collect())
        assert Counter((r["doc_id"], r["_shard"]) for r in written.collect()) == want
        assert set(written.columns) == {*clash.columns, "_shard"}


def test_editing_the_map_moves_little():
    rng = np.random.default_rng(3)
    sizes = rng.integers(100, 1000, 4096).tolist()
    old = slots.first_map(sizes, 16)
    load = np.bincount(old, weights=sizes)
    assert load.max() - load.min() <= 1000
    new = slots.edited_map(old, sizes, 17)
    load = np.bincount(new, weights=sizes)
    assert load.max() <= 1.03 * load.mean() and all(a == b or b == 16 for a, b in zip(old, new, strict=True))
    gone = slots.edited_map(old, sizes, 15)
    assert max(gone) == 14 and sum(a != b for a, b in zip(old, gone, strict=True)) < 4096 / 12


# ---- mixing -----------------------------------------------------------------------------------------------------------


def brute_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        rate = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * rate > 2 * sizes[s]]
        if not over:
            return out | {s: weight[s] * rate for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_allocation(docs, texts):
    sizes: dict = {}
    for _, t, _, s in texts:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    goal = brute_targets(sizes)
    rows = curriculum.allocation(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d, len(words_of(t))) for d, t, *_ in texts)
    for s in sizes:
        mine = [r for r in rows if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - goal[s]) < 1e-6 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - goal[s]) <= max(r["size"] for r in mine) / 2 + 1e-6
    assert all(r["taken"] <= 2 * r["size"] and len(r["times"]) * r["size"] == r["taken"] for r in rows)
    again = curriculum.allocation(docs.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixed_repeats_rows_in_order(docs):
    times = Counter()
    for r in curriculum.allocation(docs).collect():
        times[r["doc_id"]] += len(r["times"])
    out = curriculum.mixed(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == +times


def test_mixed_keeps_rows_that_differ_in_one_column(spark):
    rows = [(1, "a", "one two", k, None) for k in range(6)] + [(None, None, "x", None, 3), (None, None, "x", 3, None)]
    rows += [(2, "a", "one two", 9, 9)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, row_key int, time int")
    plan = curriculum.Curriculum(share=2.0)
    got = Counter(tuple(r) for r in curriculum.mixed(docs, plan).collect())
    assert got == Counter({r: 2 * n for r, n in Counter(rows).items()})


def test_positions_follow_times(docs):
    rows = curriculum.scheduled(docs).collect()
    copies = sorted((t, p) for r in rows for t, p in zip(r["times"], r["positions"], strict=True))
    assert [p for _, p in copies] != [] and sorted(p for _, p in copies) == list(range(len(copies)))
    at = {p: t for t, p in copies}
    assert all(at[k] <= at[k + 1] for k in range(len(at) - 1))
    assert len(rows) == docs.count()


def test_demand_is_inverted():
    for knots in curriculum.Curriculum().schedules:
        share = np.linspace(0, 1, 41)
        t = curriculum.inverse_demand(knots, share)
        fine = np.linspace(0, 1, 200_001)
        w = np.interp(fine, [k[0] for k in knots], [k[1] for k in knots])
        area = np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2))) / ((w[1:] + w[:-1]) / 2).sum()
        assert np.abs(np.interp(t, fine, area) - share).max() < 1e-6 and (np.diff(t) >= 0).all()


# ---- nearest neighbours -----------------------------------------------------------------------------------------------


def test_neighbours_and_recall(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [
        (5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [1.0] * 5), (5020, [None] * 16), (None, [1.0] * 16)]
    vectors = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<float>, cell string, rank int").repartition(3)
    plan = multi_index.MultiIndex(centroids=4, entry_block=200, query_block=20)
    got: dict = {}
    for r in multi_index.nearest(vectors, F.col("vec_id") % 20 == 0, 20, plan).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 1500, 20))
    hits, wide = 0, x.astype(np.float64)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        score = wide @ wide[q]
        assert all(abs(score[v] - s) < 1e-9 and v != q for _, v, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        want = sorted((k for k in range(1500) if k != q), key=lambda k: (-score[k], k))[:20]
        hits += len({v for _, v, _ in found} & set(want))
    assert hits / (20 * len(got)) >= 0.9


def test_index_takes_repeated_ids_and_a_common_vector_as_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6)).astype(np.float32)
    ids = [k // 2 if k < 80 else k for k in range(400)]
    x[150:300] = x[150]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    plan = multi_index.MultiIndex(centroids=3, entry_block=40, query_block=7, recall=1.0)
    got: dict = {}
    for r in multi_index.nearest(vectors, F.col("vec_id") % 20 == 0, 20, plan).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows, hits, asked = {}, 0, 0
    for k, i in enumerate(ids):
        if i % 20 == 0:
            rows.setdefault(i, []).append(k)
    assert sorted(got) == sorted(rows)
    wide = x.astype(np.float64)
    for i, own in rows.items():
        assert sorted(r for r, _, _ in got[i]) == sorted(list(range(1, 21)) * len(own))
        want = []
        for k in own:
            near = sorted((j for j in range(400) if j != k), key=lambda j: (-sum(wide[k] * wide[j]), ids[j]))[:20]
            want += [(r + 1, ids[j]) for r, j in enumerate(near)]
        found = [(r, v) for r, v, _ in got[i]]
        asked += len(want)
        hits += sum(min(found.count(f), want.count(f)) for f in set(found))
    assert hits >= 0.9 * asked


def test_centroids_follow_the_table():
    plan = multi_index.MultiIndex()
    assert [plan.centroids_for(n) for n in (0, 10_256, 256_000, 10**6, 10**9, 10**12)] == [8, 8, 8, 15, 500, 1024]


# ---- empty tables -----------------------------------------------------------------------------------------------------


def test_empty_tables(spark, none, labels):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for made in (
        packing_bfd.packed(none), packing_nnls.packed(none), quality_rules.judged(none, labels), quality_rules.filtered(none, labels),
        pii_boost.found(none), pii_boost.redacted(none), importance.resampled(none, labels), recurrent_lm.scored(none, SMALL),
        chosen_path.classes(none), chosen_path.deduplicated(none), slots.shard_table(none), curriculum.allocation(none),
        curriculum.mixed(none), multi_index.nearest(vectors, F.col("vec_id") % 20 == 0)):
        assert made.count() == 0


def test_no_labels(docs, labels):
    few = labels.where("false")
    assert quality_rules.judged(docs, few).where("size(rejected_by) > 0").count() == 0
    assert importance.resampled(docs, few).where("log_weight <> 0").count() == 0

"""URL models, filter audit and whitening against brute force, on small and awkward tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from dataclasses import replace
from itertools import permutations

import numpy as np
import pytest

from riskloom.llm import filter_audit, url_models, whitening

# ---- URL filter -------------------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme at all", "://", "http://", "HTTPS://Www.Example.NET/en/page?x=1", "https://example.net/EN/x", "https://net/en/",
    "http://fooexample.net/en/1", "https://a.b.example.com/de/1#t", "https://example.com/denmark", "https://example.com/de",
    "ftp://x.org/fr/1", "ftp://x.org?/fr/", "https://organ/fr/1", "https://xn--é.org/fr/ü", "a://b://c.net/x", "https://foo.com/" + "y" * 3000,
    "https://casino-win.example.com/en/1", "https://net", "https://u@example.com:80/de/#?", "http://x.net/\ud7ff€😀",
]


def brute_parts(url):
    url = url or ""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    if "://" not in url:
        return "", "", low(url)
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return low(host), re.match(r"[^?#]*", rest[len(host):]).group(), low(rest)


def brute_rule(host, path):
    best = None
    for verdict, rule in url_models.RULES:
        name, prefix = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return best


def brute_urls(rows, plan):
    """(page_id, host, path, rule, verdict, score) by dictionaries of tuples."""
    full = [(i, *brute_parts(u), brute_rule(*brute_parts(u)[:2])) for i, u in rows]
    held = lambda t: hashlib.md5(t.encode()).hexdigest()[0] in plan.held_out
    symbols = lambda t: ["^", *t.encode(), "$"]
    counts = {"allow": defaultdict(Counter), "block": defaultdict(Counter)}
    for _, _, _, t, rule in full:
        if rule and not held(t):
            s = symbols(t)
            for i in range(1, len(s)):
                for k in range(min(i, plan.order) + 1):
                    counts[rule[0]][tuple(s[i - k:i])][s[i]] += 1

    def log10(which, s):
        c, whole, out = counts[which], sum(counts[which][()].values()), 0.0
        for i in range(1, len(s)):
            p = 1 / url_models.SYMBOLS
            for k in range(min(i, plan.order) + 1):
                n = c.get(tuple(s[i - k:i]))
                total = sum(n.values()) if n else 0
                if total and (k == 0 or (total >= plan.least_count and total >= plan.least_share * whole)):
                    p = (n[s[i]] + len(n) * p) / (total + len(n))
            out += math.log10(p)
        return out

    score = [(log10("allow", symbols(t)) - log10("block", symbols(t))) / (len(t.encode()) + 1) for _, _, _, t, _ in full]
    tried = [(math.floor(x * plan.steps), rule[0]) for (_, _, _, t, rule), x in zip(full, score, strict=True) if rule and held(t)]
    good, bad = [s for s, v in tried if v == "allow"], [s for s, v in tried if v == "block"]
    least = 0
    if good and bad:
        edges = sorted({s for s, _ in tried}) + [max(s for s, _ in tried) + 1]
        least = min(edges, key=lambda e: (round(sum(s < e for s in good) / len(good) + sum(s >= e for s in bad) / len(bad), 9), e))
        below = [e for e in edges if e < least]
        least = (max(below) + least + 1) // 2 if below else least
    return [
        (i, h, p, rule and rule[1], rule[0] if rule else ("allow" if math.floor(x * plan.steps) >= least else "block"), round(x, 6))
        for (i, h, p, _, rule), x in zip(full, score, strict=True)]


def same_rows(got, want):
    key = lambda r: tuple(str(x) for x in r[:4])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=2e-6)


@pytest.mark.parametrize("plan", [url_models.UrlPlan(), url_models.UrlPlan(order=2, least_share=0.02)])
def test_urls_against_brute_force(spark, plan):
    rng = np.random.default_rng(3)
    hosts = ["a.example.net", "www.example.org", "shop.example.com", "casino.example.net", "x.net", "example.com"]
    rows = list(enumerate(URLS))
    rows += [(100 + k, f"https://{hosts[rng.integers(6)]}/{['en', 'de', 'fr', 'es'][rng.integers(4)]}/{rng.integers(50)}") for k in range(400)]
    rows += [(600, URLS[5])] * 3 + [(None, "https://example.com/x"), (None, "https://x.net/q")]
    table = spark.createDataFrame([(i, u, "r", "h", 1.0) for i, u in rows], "page_id long, url string, rule string, host string, score double")
    got = [tuple(r) for r in url_models.judged(table.repartition(3), plan=plan).collect()]
    same_rows(got, brute_urls(rows, plan))


def test_urls_without_labels_or_rows(spark):
    schema = "page_id long, url string"
    assert url_models.judged(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "https://example.com/x"), (2, None), (3, "")]
    got = {r.page_id: (r.verdict, r.score) for r in url_models.judged(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("allow", 0.0), 2: ("allow", 0.0), 3: ("allow", 0.0)}


def test_urls_of_unknown_hosts_are_told_apart(spark):
    """Held-out accuracy: addresses of two styles, most of them with a rule, the others without."""
    rng = np.random.default_rng(5)
    good = [f"https://news{rng.integers(99)}.{{}}/articles/{rng.integers(9999)}" for _ in range(300)]
    bad = [f"http://win-casino{rng.integers(99)}.{{}}/bonus?id={rng.integers(9999)}" for _ in range(300)]
    rows = [u.format("test") if k < 200 else u.format("else") for us in (good, bad) for k, u in enumerate(us)]
    rules = [("allow", f"news{k}.test/") for k in range(99)] + [("block", f"win-casino{k}.test/") for k in range(99)]
    table = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id: r for r in url_models.judged(table, rules).collect()}
    judged = [k for k in got if got[k].rule is None]
    assert len(judged) >= 200 and all(got[k].verdict == ("allow" if k < 300 else "block") for k in judged)


# ---- filter audit -----------------------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    failed = []
    for d, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
        failed.append((s or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = []
    for part in {f[0] for f in failed}:
        mine = [f for f in failed if f[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            for _, fails, *_ in mine:
                hit = next((x for x in order if x in fails), None)
                shapley[hit] += 1
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[:step - 1])
                here = [f for f in mine if letter in f[1] and not f[1] & before]
                out.append((
                    part, "".join(order), step, sum(not f[1] & {*before, letter} for f in mine), len(here),
                    sum(letter in f[1] and bool(f[1] & before) for f in mine), sum(f[1] == {letter} for f in mine),
                    sum(f[2] for f in here), sum(f[3] for f in here), shapley[letter]))
    return out


def test_audit_against_brute_force(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(1, 5)))
    texts = [" ".join(word() for _ in range(n)) for n in (5, 150, 250, 300, 5000)] + ["", None, " \n", "A B C # x", "x " * 300, "é" * 9]
    rows = [(int(k), texts[int(rng.integers(len(texts)))], ["a", "b", None, ""][k % 4]) for k in range(300)]
    rows += [(1000 + k, f"only {k} " + " ".join(word() for _ in range(210)), "a") for k in range(100)]
    rows += [(None, texts[2], "a"), (None, "null id", "b"), (None, "null id", "b"), (7, texts[3], "c"), (7, texts[3], "c"), (7, "other text", "c")]
    labels = [(k, int(k % 3 > 0), int(k % 7 == 0)) for k in range(0, 250)] + [(5, 1, 1), (5, 0, None), (None, 1, 1), (9, None, None), (4000, 1, 1)]
    docs = spark.createDataFrame(
        [(d, t, s, 1, "x", 9) for d, t, s in rows], "doc_id long, text string, source string, part int, mask string, n int").repartition(4)
    known = spark.createDataFrame([(*r, 3) for r in labels], "doc_id long, quality int, toxic int, n int")
    got = [tuple(r) for r in filter_audit.audit(docs, known).collect()]
    assert sorted(got) == sorted(brute_audit(rows, labels))


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []
    one = filter_audit.audit(spark.createDataFrame([(1, None, None)], docs.schema), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""}


def test_sketch_never_clears_a_repeat_and_clears_most_others(spark):
    rows = [(k, f"text {k // 2 if k < 2000 else k}", "a") for k in range(10_000)]
    known = filter_audit.facts(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for blocks in (1, 8, 40):
        marked = filter_audit.possible_repeats(known, filter_audit.sketch(known, blocks), blocks)
        found = {r.doc_id for r in marked.where("repeat").collect()}
        assert marked.count() == 10_000 and found >= set(range(2000))
        assert blocks < 40 or len(found) < 2100


def test_audit_with_a_full_sketch(spark, monkeypatch):
    rows = [(k, f"text {k % 700}", "a") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(filter_audit, "CELLS_PER_ROW", 1)
    got = {r["mask"]: r["n"] for r in filter_audit.mask_counts(docs, labels).collect()}
    assert got == {1: 700, 17: 800}


# ---- whitening --------------------------------------------------------------------------------------------------------


def brute_whitening(rows, used):
    fine = [(i, [float(c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    width = min(Counter(len(v) for _, v in fine).items(), key=lambda x: (-x[1], x[0]))[0]
    fine = [(i, v) for i, v in fine if len(v) == width]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in fine]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return [i for i, _ in fine], deviation, centred @ vectors[:, :used], values


@pytest.mark.parametrize("plan", [
    whitening.Whitening(components=5), whitening.Whitening(components=5, block_rows=16, panel_rows=100, task_bytes=4000)])
def test_whitening_against_brute_force(spark, plan):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(240, 7)) * [3, 2.5, 2, 1.5, 1, 0.5, 0.3]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(base)] + [(7, [float(c) for c in base[7]])] * 2
    rows += [(900, None), (901, []), (902, [1.0] * 6), (903, [1.0] * 6 + [None]), (904, [float("nan")] * 7), (905, [float("inf")] * 7),
             (None, [0.0] * 7)]
    schema = "vec_id long, embedding array<double>, row int, panel string, x int, index int"
    table = spark.createDataFrame([(*r, 1, "p", 2, 3) for r in rows], schema).repartition(5)
    got = whitening.whitened(table, plan).collect()
    ids, deviation, places, values = brute_whitening(rows, 5)
    assert len(got) == len(ids) * 5 and {r.n for r in got} == {len(ids)}
    assert Counter((r.vec_id, r.deviation) for r in got) == Counter({k: 5 * v for k, v in Counter(zip(ids, deviation, strict=True)).items()})
    for c in range(5):
        mine = sorted((r.vec_id is None, r.vec_id or 0, r.whitened) for r in got if r.component == c + 1)
        want = places[:, c] / np.sqrt(values[c])
        one = max((abs(w), w, i) for w, i in zip(want, ids, strict=True) if i is not None and i > 10)
        sign = 1 if next(w for _, i, w in mine if i == one[2]) * one[1] > 0 else -1
        wanted = sorted((i is None, i or 0, sign * w) for i, w in zip(ids, want, strict=True))
        assert np.allclose([w for *_, w in mine], [w for *_, w in wanted], atol=1e-9)
        share = {r.explained for r in got if r.component == c + 1}
        assert share.pop() == pytest.approx(values[c] / values.sum(), rel=1e-9) and not share
    assert {r.identity_error for r in got}.pop() < 1e-9


def test_whitening_without_variance_and_without_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    got = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 2, schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(got, key=lambda r: r.component)] == [
        (c, 2, 0, 0.0, 0.0, 0.0) for c in (1, 1, 2, 2)]
    flat = whitening.whitened(spark.createDataFrame([(k, [float(k), 5.0]) for k in range(4)], schema)).collect()
    assert {r.whitened for r in flat if r.component == 2} == {0.0} and {r.identity_error for r in flat}.pop() < 1e-12


def test_whitening_of_huge_entries(spark):
    rows = [(k, [float(10 ** 14 * k), float(k % 2)]) for k in range(50)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), replace(whitening.Whitening(), components=1))
    assert {r.deviation for r in got.collect()} == {None} and got.count() == 50


def test_words_hashed_together_have_the_hashes_of_single_words():
    """Stretches of every length, beside the end of the bytes too, folded to lower case."""
    import numpy as np
    import pyarrow as pa

    from riskloom.llm.words import Words, hashed, hashes

    given = ["".join(chr(33 + (7 * k + j) % 90) for j in range(k)) for k in range(1, 80)]
    texts = pa.array([None, "", "  ", " ".join(given), "Grüße\tAUS  wien ", *given])
    for lower in (False, True):
        words = Words(texts, lower=lower)
        found, bounds = hashed(texts, lower=lower)
        assert (found == hashes(words.distinct)[words.codes]).all() and (bounds == words.bounds).all()
    assert len(hashed(pa.array([], pa.string()))[0]) == 0 and found.dtype == np.uint64


def test_groups_are_worked_on_many_at_a_time(spark, monkeypatch):
    """Whatever the cut into batches, groups stay whole, and small and large groups give the bunches of all pairs."""
    import numpy as np
    import pyarrow as pa

    from riskloom.llm import chosen_path as cp

    rng, plan, rows = np.random.default_rng(4), cp.ChosenPath(), []
    for node in range(60):
        size = int(rng.choice([2, 3, 5, 30, 130]))
        bases = rng.integers(0, 2**32, (4, cp.TOKENS), dtype=np.uint32)
        for _ in range(size):
            tokens = bases[rng.integers(4)].copy()
            tokens[: rng.integers(0, 40)] = 7
            side = 0 if node % 3 else 1 + int(rng.integers(2))
            rows.append((node // 2, node % 2, side, len(rows), int(rng.integers(size)), int(rng.integers(90, 111)), tokens))
    want = set()
    for node in {r[:2] for r in rows}:
        mine = [r for r in rows if r[:2] == node]
        group = cp._Groups(np.arange(len(mine)))
        pairs = [(i, j) for i, a in enumerate(mine) for j, b in enumerate(mine) if i < j and a[4] != b[4] and (
            a[2] == 0 or a[2] != b[2]) and 100 * min(a[5], b[5]) >= plan.percent * max(a[5], b[5]) and (a[6] == b[6]).sum() >= plan.least_match]
        for i, j in pairs:
            group.join(i, j)
        hit = {k for pair in pairs for k in pair}
        want |= {tuple(sorted(mine[k][3] for k in hit if group.find(k) == top)) for top in {group.find(k) for k in hit}}
    names = ("node", "block", "side", "rep", "root", "n")
    table = pa.table({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(names)} | {
        "tokens": pa.array([r[6].tobytes() for r in rows], pa.binary())})
    for cut in (1, 7, 100, len(rows)):
        found = [tuple(m) for b in cp._suspects(plan)(iter(table.to_batches(cut))) for m in b.column(0).to_pylist()]
        assert len(want) > 20 and len(found) == len(want) and set(found) == want

"""Cases where an operator once did less than its whole job."""

from __future__ import annotations

import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import chosen_path, curriculum, packing_nnls, pii_boost, quality_rules, tokens
from riskloom.llm.shared import work_root
from riskloom.llm.words import PIECE_BYTES


# ---- near-duplicates --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_one_short_text_alone_in_a_partition(spark, n):
    docs = spark.createDataFrame([(1, " ".join("abcd"[:n]))], "doc_id long, text string").coalesce(1)
    assert [tuple(r) for r in chosen_path.classes(docs).collect()] == [(1, 1, 1, True)]


def test_a_short_text_before_one_above_a_piece():
    long = "word " * (PIECE_BYTES // 5 + 1)
    for short in ("a", "a b", "a b c", "a b c d"):
        batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [short, long]})
        for work in (chosen_path._draw(3), chosen_path._full):
            assert [n for b in work(iter([batch])) for n in b.column(0).to_pylist()] == [1, 2]


def _most_memory(work) -> int:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_drawing_holds_arrays_of_a_small_piece_only():
    text = " ".join(f"w{k % 5000}" for k in range(400))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(3000)), "text": [f"{k} {text}" for k in range(3000)]})
    for work in (chosen_path._draw(13), chosen_path._full):
        assert _most_memory(lambda work=work: [None for _ in work(iter([batch]))]) < 40 << 20


def test_tables_made_on_the_way_to_the_classes_do_not_stay(spark):
    base = [" ".join(f"w{(k * 7 + j) % 997}" for j in range(30)) for k in range(40)]
    texts = [*base, *base[:20], *(f"{t} tail" for t in base[:20])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = Path(work_root(spark).removeprefix("file:"))
    before = set(folder.glob("*"))
    out = chosen_path.classes(docs)
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before}
    assert left <= {"ids", "names", "labels"}
    assert [r["component_id"] for r in out.orderBy("doc_id").collect()] == [*range(40), *range(20), *range(20)]


def test_words_remembered_by_a_tokenizer_do_not_stay_beside_the_sets(monkeypatch):
    for work in (chosen_path._draw(3), chosen_path._full):
        monkeypatch.setattr(tokens, "_ENCODERS", {"one": object()})
        assert list(work(iter([]))) == [] and not tokens._ENCODERS


def test_sets_of_a_bunch_are_not_copied_number_by_number():
    sets = [np.arange(k, k + 2000) for k in range(0, 300_000, 1000)]
    rows = {"rep": list(range(300)), "root": list(range(300)), "n": [2000] * 300, "tokens": [bytes(256)] * 300, "shingles": sets}
    types = {"rep": pa.int64(), "root": pa.int64(), "n": pa.int64(), "tokens": pa.binary(), "shingles": pa.list_(pa.int64())}
    table = pa.table({name: pa.array(values, types[name]) for name, values in rows.items()})
    table = pa.concat_tables([table.slice(0, 120), table.slice(120)])
    assert [x.tolist() for x in chosen_path._sets(table.column("shingles"))] == [x.tolist() for x in sets]
    assert chosen_path._sets(table.slice(0, 0).column("shingles")) == []
    plan = chosen_path.ChosenPath(percent=30)
    out = []
    assert _most_memory(lambda: out.append(chosen_path._links(plan)(table))) < 4 << 20
    assert out[0].num_rows == 299


# ---- personal data ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pii_boost.fitted([["the", "house", "and", "a", "tree", "in", "the", "garden", "of", "time"]])


@pytest.mark.parametrize("account", ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"])
@pytest.mark.parametrize("after", [" The bank", " Bank of it", " 2024 was good", " A", ". Then", " thanks", ""])
def test_accounts_before_capitals_and_digits(model, account, after):
    text = f"IBAN: {account}{after}"
    assert (6, 5, 6 + len(account)) in pii_boost.candidates(text)
    assert [(pii_boost.KINDS[k], text[a:b]) for a, k, b, _ in pii_boost.all_spans(text, model)] == [("iban", account)]


def test_accounts_end_where_no_letter_or_digit_follows():
    text = "XX12 DE89 3704 0044 0532 0130 00 Bank"
    for a, k, b in pii_boost.candidates(text):
        assert k != 5 or (not text[b:b + 1].isalnum() and 15 <= len(text[a:b].replace(" ", "")) <= 34)
    assert (5, 5, 32) in pii_boost.candidates(text)


def test_numbers_of_many_groups_are_offered_whole(model):
    number = "00 33 1 23 45 67 89"
    text = f"please call tel {number} today"
    assert (16, 3, 16 + len(number)) in pii_boost.candidates(text)
    assert [text[a:b] for a, _, b, _ in pii_boost.all_spans(text, model)] == [number]


# ---- packing ----------------------------------------------------------------------------------------------------------


def test_the_last_stage_holds_padded_sequences(spark):
    from tests.llm.test_operators import encoded

    rows = [(k, f"word{k} " * (7 * k)) for k in range(40)] + [(50, None), (51, "long text " * 3000), (3, "word3 " * 21)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = corpus_pipeline.packing(spark, docs, "").collect()
    whole = {r["sequence_id"]: list(r["sequence"]) for r in out if r["sequence"] is not None}
    assert sorted(whole) == sorted({r["sequence_id"] for r in out}) and len(whole) == sum(r["sequence"] is not None for r in out)
    texts, got = dict(rows), {}
    for r in out:
        ids = whole[r["sequence_id"]][r["offset"]: r["offset"] + r["length"]]
        assert ids == encoded(texts[r["doc_id"]], 1)[r["start"]: r["start"] + r["length"]] and len(ids) == r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {d: len(encoded(t, 1)) * (2 if d == 3 else 1) for d, t in texts.items()}
    for k, ids in whole.items():
        used = sum(r["length"] for r in out if r["sequence_id"] == k)
        assert len(ids) == (used if used & (used - 1) == 0 else packing_nnls.WINDOW) and not any(ids[used:])


# ---- quality rules ----------------------------------------------------------------------------------------------------


def test_strata_with_few_labels_lose_their_junk(spark, tmp_path):
    from tests.llm.test_operators import sentence

    rng, rows = np.random.default_rng(2), []
    for k in range(4 * 360):
        text = sentence(rng, 40)
        rows.append((k, text.replace(" ", " % ", 8) if k % 9 == 0 else text, ("en", "de", "fr", "es")[k % 4]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 9 > 0), 0) for k in range(len(rows))], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()}
    assert not any(k in kept for k in range(0, len(rows), 9))
    for lang in range(4):
        good = [k for k in range(len(rows)) if k % 9 and k % 4 == lang]
        assert sum(k not in kept for k in good) <= 0.02 * len(good)


def test_the_filter_leaves_texts_where_they_are(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, " ".join("abcdefghijkl"), None), (None, " ".join("mnopqrstuvwx"), "x"), (2, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("doc", F.lit(7))
    out = quality_rules.filtered(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), joint=True)
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.where("length(text) > 20").collect()))


def test_the_joint_level():
    sizes = [2, 2]
    assert list(quality_rules.sequence([((2, 1), 5)], [], sizes)) == [(-1, 1), (0, 1), (1, 1)]
    # The step that also takes most of the unlabelled documents comes last, however many bad ones it rejects.
    assert next(quality_rules.sequence([((0, 2), 6), ((2, 0), 4)], [((0, 2), 90), ((2, 2), 10)], sizes)) == (-1, 0)
    assert list(quality_rules.sequence([], [], sizes)) == [(0, -1), (0, 0), (1, 0), (1, 1)]
    assert quality_rules.tail(217, 0, 0.02) <= 0.05 / 4 < quality_rules.tail(216, 0, 0.02)
    assert abs(quality_rules.tail(10, 10, 0.3) - 1) < 1e-12


def test_mixing_deals_texts_by_key_once(spark):
    """Duplicates and the join share one exchange of the texts; the other one orders the copies."""
    rows = [(None, "a", "x y", 1), (None, "a", "x y", 1), (None, "a", None, 1), (1, "a", "x y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, own_id int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = curriculum.mixed(docs, curriculum.Curriculum(share=2.0))
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = Counter(tuple(r) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # one for the texts, one for the times, one for the order
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Exchange rangepartitioning") == 1
    assert 1 <= got.pop((None, "a", None, 1)) <= 2
    assert got == {(None, "a", "x y", 1): 4, (1, "a", "x y", 1): 2}

"""The pipeline stage by stage on a small table, each judged on its own input."""

from collections import Counter

import corpus_pipeline
from riskloom.llm import curriculum, packing_nnls, pii_boost, quality_rules
from riskloom.llm.shared import kept, table
from tests.llm.test_operators import brute_classes, encoded, plain_spans

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = kept(stage(spark, docs, SF), f"test_{name}")
        out[name] = (before, docs.collect())
        assert name == "packing" or docs.columns == columns
    assert list(out) == ["quality_rules", "near_duplicates", "personal_data", "mixture", "packing"]

    before, after = out["quality_rules"]
    judged = {r["doc_id"]: r["kept"] for r in quality_rules.judged(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if judged[r["doc_id"]]}

    before, after = out["near_duplicates"]
    assert {r["doc_id"] for r in after} == {d for d, _, _, keep in brute_classes([(r["doc_id"], r["text"]) for r in before]) if keep}
    assert len(after) == len({r["doc_id"] for r in after})

    before, after = out["personal_data"]
    assert len(after) == len(before)
    clean = {r["doc_id"]: r for r in after}
    for r in before:
        assert clean[r["doc_id"]]["n_chars"] == len(clean[r["doc_id"]]["text"]) and not plain_spans(clean[r["doc_id"]]["text"])
        if not any(c.isdigit() or c == "@" for c in r["text"]):
            assert clean[r["doc_id"]] == r

    before, after = out["mixture"]
    texts = {r["doc_id"]: r["text"] for r in before}
    source = spark.createDataFrame(before)
    want = Counter({r["doc_id"]: len(r["times"]) for r in curriculum.allocation(source).collect()})
    assert Counter(r["doc_id"] for r in after) == +want and all(texts[r["doc_id"]] == r["text"] for r in after)

    before, after = out["packing"]
    ids = Counter()
    for r in after:
        ids[r["doc_id"]] += r["length"]
    assert ids == Counter({d: n * len(encoded(texts[d], packing_nnls.END_ID)) for d, n in Counter(r["doc_id"] for r in before).items()})


def test_registered(spark):
    from __spark_entry__ import queries

    names = queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and names["pipeline"] is corpus_pipeline.run
    assert pii_boost.KINDS[:4] == ("email", "ip", "card", "phone")

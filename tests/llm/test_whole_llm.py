"""What the training-data queries once left out."""

import random

import pyarrow.parquet as pq
from conftest import SMALL

from ferrule.llm import p4_lookalikes, p5_pairs


def test_p4_accented_lookalikes():
    c = p4_lookalikes.canonical
    for accented, foreign in (("\u00f6", "\u043e\u0308"), ("\u00f6", "\u04e7"), ("\u00eb", "\u0451"), ("\u00ef", "\u0457"), ("\u00e1", "\u03b1\u0301"), ("\u00e1", "\u03ac"), ("\u00f6", "\u043e\u200b\u0308")):
        assert c(f"bj{foreign}rk8825") == f"bj{accented}rk8825" == c(f"bj{accented}rk8825"), foreign
    assert c("\u0439\u0457") == "\u0439\u00ef" and c("\uac00\u0301") == "\uac00\u0301"


def test_p4_accented_lookalikes_are_found(spark):
    df = spark.createDataFrame([(1591, "bj\u00f6rk8825"), (4551, "bj\u043e\u0308rk8825"), (3, "bjork8825")], "id long, value string")
    got = p4_lookalikes.equal_readings(p4_lookalikes.lookalike_forms(df, "id", "value", "f")).collect()
    assert [(r.id_a, r.id_b) for r in got] == [(1591, 4551)]


def test_p5_frequent_refusal_is_not_sound():
    """A refusal that recurs in 5 % of the answers; where it is in another language than the question either label is right."""
    r = random.Random(3)
    rows = [tuple(x.values()) for x in pq.read_table("/root/testdata/sf0.1/golden_set.parquet", columns=["question", "reference_answer", "answerable"]).to_pylist()]
    text = "Sorry, that is confidential."
    pairs = [(q, text if can is not False and r.random() < 0.05 else a, can) for q, a, can in r.sample(rows, 1000)]
    hit = [p for p in pairs if p[1] == text and p[2] is not False]
    assert len(hit) > 40 and all(p5_pairs.fit_pairs(pairs).decide(hit))


def test_p4_forms_give_the_texts_too(spark):
    got = {r.field: r["count"] for r in p4_lookalikes.p4_forms(spark, SMALL).groupBy("field").count().collect()}
    assert got["text"] == spark.read.parquet(f"{SMALL}/parsed_segments.parquet").count() and set(got) == {"username", "phone", "text"}

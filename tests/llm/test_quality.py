"""Embeddings learn what labels mark; whole texts count; odd rows are defined."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprof.llm import quality


def rows_of(n=120):
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(200)]
    good = [" ".join(rng.choice(words, 40)) for _ in range(n)]
    bad = [" ".join(w + "%%%" for w in rng.choice(words, 40)) for _ in range(n // 3)]
    return [(i, t, int(i < n), "x") for i, t in enumerate(good + bad)]


@pytest.fixture(scope="module")
def model(spark):
    rows = rows_of()
    documents = spark.createDataFrame([(i, t, x) for i, t, _, x in rows] + [(0, "zzz", "x"), (None, "q", "x")],
                                      "doc_id bigint, text string, label string")
    labels = spark.createDataFrame([(i, q, 5) for i, _, q, _ in rows] + [(7, None, 1), (8, 3, 1), (None, 1, 1), (900, 1, 1)],
                                   "doc_id bigint, quality int, label int")
    return quality.fit(documents, labels, rows_per_class=60)


def test_scores(spark, model):
    long = "word1 word2 " * 200_000
    texts = ["word5 word9 word100", "word5%%% word9%%% word100%%%", None, "", " \n", long, long + "%%% " * 400_000, "x" * 3_000_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    scores = [r[0] for r in df.orderBy("doc_id").select(model.score(df["text"]).alias("s")).collect()]
    assert all(0 <= s <= 1 for s in scores)
    assert scores[0] > 0.7 > scores[1]
    assert scores[2] == scores[3] == scores[4]
    assert scores[5] > scores[6]  # the end of a long text counts


def test_the_model_does_not_depend_on_partitions(spark, model):
    rows = rows_of()
    documents = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(0, "zzz")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q, _ in rows], "doc_id bigint, quality int")
    again = quality.fit(documents.repartition(5), labels.repartition(3), rows_per_class=60)
    assert np.array_equal(again.vectors, model.vectors) and np.array_equal(again.output, model.output)


def test_nothing_to_learn(spark):
    documents = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    untrained = quality.fit(documents, labels)
    assert not untrained.trained
    assert documents.select(untrained.score(documents["text"])).first()[0] == 0.5
    assert documents.limit(0).select(untrained.score(documents["text"])).collect() == []


def test_pieces_and_batches_do_not_change_a_score(monkeypatch):
    table = np.random.default_rng(2).normal(size=1 << quality.BITS).astype(np.float32)
    texts = ["one two two three", None, "", "four " * 50, "é漢字 x"]
    whole = quality.document_sums(texts, table)
    alone = [quality.document_sums([t], table)[0] for t in texts]
    assert np.allclose(whole, alone)
    assert whole[1] == whole[2] == 0
    at, weight = quality.document_weights(texts[3])
    assert abs(weight.sum() - 1) < 1e-9 and np.isclose((weight * table[at]).sum(), whole[3])
    monkeypatch.setattr(quality, "PIECE", 40)
    assert np.isclose(quality.document_sums(texts, table)[0], whole[0])


def test_repeats_share_a_bucket():
    a, b = (quality._buckets([t])[1][0] for t in ("x x", "longer longer"))
    assert a.tolist() == b.tolist()


def plain_logit(text, table):
    """The mean of each family's bucket values over one text, an n-gram at a time, with Python's integers."""
    low = (1 << 32) - 1

    def value(hash, family):
        mixed = (hash + (family * 0x85EBCA6B & low)) * 0x9E3779B1 & low
        return float(table[((mixed ^ mixed >> 15) * 0x9E3779B1 & low) >> (32 - quality.BITS)])

    words = (text or "").split()
    named = []
    for word in words:
        whole = sum(ord(c) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(word)) % (1 << 64)
        named.append((whole * 0x9E3779B97F4A7C15 >> 32) & low)
    families = [[value(h, 1) for h in named], [value(a ^ b, 2) for a, b in zip(named, named[1:])]]
    line = f" {' '.join(words)} " if words else ""
    for size in quality.CHARACTERS:
        found = []
        for i in range(len(line) - size + 1):
            hash = 0
            for c in line[i : i + size]:
                hash = (hash * 0x01000193 + ord(c)) & low
            found.append(value(hash, 2 + size))
        families.append(found)
    return sum(sum(f) / max(len(f), 1) for f in families) / quality.FAMILIES


def test_scores_agree_with_a_plain_scorer(spark, small):
    """Every document of the small table, and odd texts, scored one n-gram at a time from the same model."""
    documents = spark.read.parquet(f"{small}/documents.parquet")
    model = quality.fit(documents, spark.read.parquet(f"{small}/labels.parquet"))
    table = (model.vectors @ (model.output[:, 1] - model.output[:, 0])).astype(np.float32)
    odd = [(-1, None), (-2, ""), (-3, " \n "), (-4, "a"), (-5, "é 你好 \U0001f600 x"), (-6, "w " * 700)]
    rows = documents.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    for r in rows.select("text", model.score(F.col("text")).alias("score")).collect():
        plain = 1 / (1 + np.exp(-(plain_logit(r["text"], table) + model.offset)))
        assert abs(r["score"] - plain) < 1e-6

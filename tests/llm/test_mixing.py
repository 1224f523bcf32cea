"""Targets, draws and shards of the mix."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sparkprof.llm import mixing


def sources(spark, sizes):
    rows, n = [], 0
    rng = np.random.default_rng(4)
    for name, count in sizes.items():
        for _ in range(count):
            rows.append((n, "w " * int(rng.integers(1, 60)), name, 5, "p"))
            n += 1
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, source string, mix_s int, key string")


def plain_targets(sizes, weights=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), list(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * unit > 3 * sizes[s]]
        if not over:
            out |= {s: weight[s] * unit for s in open_}
            break
        out |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def test_taken_words_come_near_the_targets(spark):
    rows, df = sources(spark, {"big": 900, "b": 200, "small": 12, "é": 40, None: 90, "tiny": 1})
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    whole = Counter()
    for _, text, source, *_ in rows:
        whole[source] += size(text)
    want = plain_targets(whole)
    taken = Counter()
    drawn = mixing.draws(df).collect()
    assert len(drawn) == len(rows)
    for r in drawn:
        assert r["mix_size"] == size(r["text"]) and r["mix_source_size"] == whole[r["source"]]
        assert abs(r["mix_target"] - want[r["source"]]) < 1e-6
        assert len(r["mix_draws"]) <= 3
        assert len({d["mix_copy"] for d in r["mix_draws"]}) == len(r["mix_draws"])
        taken[r["source"]] += r["mix_size"] * len(r["mix_draws"])
    for source, target in want.items():
        assert target - 60 <= taken[source] <= target + 1e-6, source
    again = mixing.draws(df.repartition(7)).collect()
    pick = lambda rows: sorted((r["doc_id"], str(r["mix_draws"])) for r in rows)
    assert pick(drawn) == pick(again)


def test_shards_hold_every_draw_once(spark):
    _, df = sources(spark, {"a": 300, "b": 300, "c": 100})
    drawn = mixing.draws(df, shards=8)
    dealt = mixing.mix(df, shards=8)
    assert dealt.columns == ["doc_id", "text", "source", "key", "mix_copy", "mix_shard", "mix_place"]
    rows = dealt.withColumn("part", F.spark_partition_id()).collect()
    assert len(rows) == sum(len(r["mix_draws"]) for r in drawn.collect())
    assert len({(r["doc_id"], r["mix_copy"]) for r in rows}) == len(rows)
    shards = {}
    for r in rows:
        shards.setdefault(r["mix_shard"], []).append(r)
    assert set(shards) == set(range(8))
    for held in shards.values():
        assert len({r["part"] for r in held}) == 1
        assert [r["mix_place"] for r in held] == sorted(r["mix_place"] for r in held)


def test_shards_are_found_in_groups(spark, monkeypatch):
    _, df = sources(spark, {"a": 300, "b": 100})
    pick = lambda: sorted((r["doc_id"], str(r["mix_draws"])) for r in mixing.draws(df, shards=11).collect())
    plain = pick()
    monkeypatch.setattr(mixing, "GROUP", 3)
    assert pick() == plain
    monkeypatch.setattr(mixing, "SHARD_WORDS", 100)
    found = {d["mix_shard"] for r in mixing.draws(df).collect() for d in r["mix_draws"]}
    assert max(found) > 64  # more shards than there are at least


def test_the_tree_deals_all_blocks():
    quotas = np.array([100, 7, 0, 33])
    dealt = mixing.split(quotas, 5, seed=1)
    assert (dealt.sum(axis=0) == quotas).all() and (dealt >= 0).all()
    assert dealt.sum(axis=1).max() - dealt.sum(axis=1).min() <= 2
    assert (mixing.split(quotas, 5, seed=1) == dealt).all()


def test_the_end_is_searched_in_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEVEL_BITS", 2)
    monkeypatch.setattr(mixing, "FINE_BITS", 8)
    monkeypatch.setattr(mixing, "LEAF_ROWS", 10)
    _, df = sources(spark, {"a": 800, "b": 700})
    rows = mixing.draws(df).groupBy("source").agg(
        F.max("mix_target").alias("target"), F.sum(F.col("mix_size") * F.size("mix_draws")).alias("taken"))
    for r in rows.collect():
        assert r["target"] - 60 <= r["taken"] <= r["target"]


def test_odd_rows(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, "x y", None), (2, "", "a"), (3, "x " * 100_000, "b"), (3, "x " * 100_000, "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixing.draws(df).collect()
    assert len(found) == 6
    assert {r["mix_target"] for r in found if r["source"] == "a"} == {0.0}
    assert mixing.draws(df.limit(0)).collect() == [] and mixing.mix(df.limit(0)).collect() == []
    empty = spark.createDataFrame([(1, None, "a"), (2, "", "b")], df.schema)
    assert {r["mix_target"] for r in mixing.draws(empty).collect()} == {0.0}

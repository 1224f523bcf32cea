"""Scores against plain counting."""

import math
from collections import Counter

import numpy as np
import pytest

from sparkprof.llm import backoff

SCHEMA = "doc_id bigint, text string, block string, part int, score double"


def plain(texts):
    split = [(t or "").encode().lower().split() for t in texts]
    one = Counter(w for s in split for w in s)
    two = Counter(p for s in split for p in zip(s, s[1:]))
    others = max(sum(one.values()) - 1, 1)
    out = []
    for s in split:
        total = 0.0
        for i, w in enumerate(s):
            alone = max(one[w] - 1, 1) / others
            if i == 0:
                total += math.log10(alone)
            elif two[s[i - 1], w] > 1:
                total += math.log10((two[s[i - 1], w] - 1) / (one[s[i - 1]] - 1))
            else:
                total += math.log10(backoff.BACKOFF * alone)
        out.append((len(s), total))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_scores_agree_with_plain_counts(spark, monkeypatch, small):
    if small:  # many blocks and tables
        monkeypatch.setattr(backoff, "BLOCK_WORDS", 50)
        monkeypatch.setattr(backoff, "TABLE_GRAMS", 40)
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["a", "b", "c", "The", "the", "é", "rare%d" % i], int(rng.integers(0, 30)))) for i in range(60)]
    texts += [None, "", " ", "alone", "the " * 5_000, texts[0], texts[0]]
    rows = [(i if i != 3 else None, t, "x", 1, 0.5) for i, t in enumerate(texts)]
    found = backoff.score(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(found) == len(texts)
    want = sorted((-1 if r[0] is None else r[0], n, s) for r, (n, s) in zip(rows, plain(texts)))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["score"]) for r in found)
    for a, b in zip(want, got):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-4


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, None, "x", 1, 0.5)], SCHEMA)
    assert [tuple(r) for r in backoff.score(df).collect()] == [(1, 0, 0.0)]
    assert backoff.score(df.limit(0)).collect() == []


def test_packing_is_reversible():
    for values in ([], [0], [5, 300, 70_000], [2**63 + 5]):
        values = np.array(values, dtype=np.uint64)
        assert (backoff._thick(backoff._thin(values)) == values).all()
        assert (backoff._whole(backoff._steps(np.sort(values))) == np.sort(values)).all()

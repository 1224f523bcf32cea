"""Fingerprints, the trie self-join and components against all pairs."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkprof.llm import graph, shingles, simhash

DOCUMENTS = "doc_id bigint, text string, fp string, id string, root int"


def plain_fingerprint(text, words=4):
    parts = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").split()]
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes_of(prints, distance):
    """Component numbers by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def expected(rows, words=4, distance=4):
    prints = [plain_fingerprint(t, words) for _, t in rows]
    classes = classes_of(prints, distance)
    out = []
    for (id, _), p, c in zip(rows, prints, classes):
        ids = [i for (i, _), k in zip(rows, classes) if k == c and i is not None]
        out.append((id, f"{p:016x}", min(ids) if ids else None))
    return out


def near_texts():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    base = list(rng.choice(words, 400))
    rows = []
    for n in range(60):  # a chain of small changes
        base = list(base)
        base[int(rng.integers(len(base)))] = f"x{n}"
        rows.append(" ".join(base))
    rows += [" ".join(rng.choice(words, int(rng.integers(1, 60)))) for _ in range(60)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "f", "i", 1) for i, t in rows], DOCUMENTS)


def found(df):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in df.collect()), key=key)


def test_groups_agree_with_all_pairs(spark):
    texts = [None, "", " \t\n", "One", "ONE", "é È", "a b c", "a  b\x0bc"]
    texts += near_texts() + ["word " * 30_000]
    rows = list(enumerate(texts, 10)) + [(None, "a b c"), (None, "only without id"), (70, texts[60])]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert found(simhash.near_duplicates(frame(spark, rows))) == sorted(expected(rows), key=key)


def test_hot_units_are_split_without_losing_links(spark, monkeypatch):
    """Hundreds of fingerprints with one prefix meet in parts."""
    monkeypatch.setattr(simhash, "UNIT_ROWS", 16)
    rng = np.random.default_rng(5)
    prints = {int(x) for x in rng.integers(0, 1 << 62, 40)}
    center = 0x0123456789ABCDEF
    for _ in range(300):
        bits = rng.choice(64, int(rng.integers(1, 7)), replace=False)
        prints.add(center ^ sum(1 << int(b) for b in bits))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    pairs = simhash.links(table, 4)
    roots = {r["node"]: r["root"] for r in graph.components(pairs).collect()}
    classes = classes_of(prints, 4)
    for i in range(len(prints)):
        for j in range(i):
            same = roots.get(signed[i], signed[i]) == roots.get(signed[j], signed[j])
            assert same == (classes[i] == classes[j])


@pytest.mark.parametrize("distance", [0, 1, 4, 6])
def test_close_pairs_agree_with_all_pairs(distance):
    rng = np.random.default_rng(distance)
    near = rng.integers(0, 1 << 8, 60, dtype=np.uint64) << np.uint64(20)
    bits = np.unique(np.concatenate((near, rng.integers(0, 1 << 63, 20, dtype=np.uint64))))
    left, right = simhash.close_pairs(bits, np.array([0]), np.zeros(len(bits), bool), distance)
    got = {(min(a, b), max(a, b)) for a, b in zip(left.tolist(), right.tolist())}
    want = {(i, j) for j in range(len(bits)) for i in range(j) if int(bits[i] ^ bits[j]).bit_count() <= distance}
    assert got == want
    # Two sides: only pairs across are wanted.
    side = np.arange(len(bits)) % 2 == 1
    order = np.lexsort((bits, side))
    left, right = simhash.close_pairs(bits[order], np.array([0]), side[order], distance)
    got = {tuple(sorted((int(order[a]), int(order[b])))) for a, b in zip(left, right)}
    assert got == {(i, j) for i, j in want if side[i] != side[j]}


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    table = spark.createDataFrame(chain, "a bigint, b bigint")
    roots = {r["node"]: r["root"] for r in graph.components(table).collect()}
    assert roots == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert graph.components(table.limit(0)).count() == 0


def test_small_graphs_need_no_rounds(spark, monkeypatch):
    """A chain and random links: one task gives the roots that rounds give, in two written tables."""
    random = np.random.default_rng(5)
    ends = [(n, n + 1) for n in range(1000, 1200)] + random.integers(-500, 500, (300, 2)).tolist() + [(None, 7)]
    table = spark.createDataFrame([tuple(e) for e in ends], "a long, b long")
    written = []
    write = graph.write_once
    monkeypatch.setattr(graph, "write_once", lambda df, kind: written.append(kind) or write(df, kind))
    at_once = {tuple(r) for r in graph.components(table).collect()}
    assert written == ["links", "roots"]
    monkeypatch.setattr(graph, "AT_ONCE", 0)
    assert {tuple(r) for r in graph.components(table).collect()} == at_once
    # Rounds shrink no graph below its nodes, but copies of links go first.
    monkeypatch.setattr(graph, "AT_ONCE", 210)
    assert {tuple(r) for r in graph.components(table.unionAll(table)).collect()} == at_once
    assert len(written) > 6


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(5, text), (3, text), (9, text + " more"), (4, "other words here"), (None, text), (None, "alone"),
            (8, None), (6, "")]
    kept = simhash.deduplicated(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "fp", "id", "root"]
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {
        (3, text), (4, "other words here"), (None, "alone"), (6, "")}


def test_empty_table(spark):
    none = frame(spark, [(1, "a")]).limit(0)
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.deduplicated(none).collect() == []


def test_bits_are_only_moved(spark):
    blocks = simhash._blocks(6)
    assert sum(w for _, w in blocks) == 64
    moves = simhash._order(blocks, (1, 4))
    row = spark.createDataFrame([(-12345678901234,)], "fp bigint").select(
        simhash._moved("fp", moves).alias("m"), F.bit_count("fp").alias("n")).first()
    assert (row["m"] & (1 << 64) - 1).bit_count() == row["n"]


def shingle_sets(text, words=5):
    parts = (text or "").lower().split()
    return {tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def test_similar_texts_of_distant_fingerprints_are_one(spark, monkeypatch):
    """All pairs of similarity 0.8 or more are linked whatever their fingerprints, and no others."""
    monkeypatch.setattr(shingles, "UNIT_ROWS", 8)  # groups are split into parts
    rng = np.random.default_rng(11)
    rows, pool = [], [f"w{i}" for i in range(5000)]
    for g in range(25):
        base = list(rng.choice(pool, int(rng.integers(20, 70))))
        for _ in range(4):
            changed = list(base)
            for _ in range(int(rng.integers(0, 3))):
                changed[int(rng.integers(len(changed)))] = str(rng.choice(pool))
            rows.append((len(rows), " ".join(changed)))
    base = list(rng.choice(pool, 200))
    for g in range(60):  # a dense group
        changed = list(base)
        changed[g] = "other"
        rows.append((len(rows), " ".join(changed)))
    sets, root = [shingle_sets(t) for _, t in rows], list(range(len(rows)))
    prints = [plain_fingerprint(t, 5) for _, t in rows]
    lost = close = 0
    for i in range(len(rows)):
        for j in range(i):
            alike = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            bits = (prints[i] ^ prints[j]).bit_count()
            lost, close = lost + (alike and bits > 6), close + (not alike and bits <= 6)
            if alike:
                root = [root[j] if r == root[i] else r for r in root]
    assert lost  # the fingerprints alone do not find all
    first = {}
    for (i, _), r in zip(rows, root):
        first.setdefault(r, i)
    kept = simhash.deduplicated(frame(spark, rows))
    assert {r["doc_id"] for r in kept.collect()} == set(first.values())

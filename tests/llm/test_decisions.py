"""Statistics against plain Python, learned lists against a plain version of the learner."""

import math
import re
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparkprof.llm import decisions
from sparkprof.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    triples = list(zip(words, words[1:], words[2:]))
    times = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if times[t] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


def failed(b):
    return b[0] < 50 or 100 * b[4] > 50 * b[0]


def test_whole_table(spark, small):
    result = QUERIES["op11_rules"][0](spark, small)
    assert result.columns[:8] == ["doc_id", *decisions.BASE, "base_failed", "kept"]
    rows = {r["doc_id"]: r for r in result.collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert rows.keys() == texts.keys()
    for id, text in texts.items():
        r, b = rows[id], base(text)
        assert tuple(r[c] for c in decisions.BASE) == b and r["base_failed"] == failed(b)
        assert not (r["base_failed"] and r["kept"])
        assert r["kept"] == (not r["base_failed"] and r["rule"] is None)
    judged = [(rows[i]["kept"], q) for i, q in labels.items() if i in rows and not rows[i]["base_failed"]]
    assert sum(k == bool(q) for k, q in judged) >= 0.95 * len(judged)


ODD = [
    None, "", " \n\t\x0b\x0c\r ", "a", "a b", "a b c", "a b c a b c", "x x x x x", "a a", "one\none\n\n \none two\n one",
    "é 你好 \x1c \x85  z", "#*$%&|<> ##", "a b c d a b c e a b c\n" * 3, "w " * 5000, "A.B!C? 12 3", "\n\n\n", "a\r\na\r\nb",
]


def test_odd_texts(spark):
    """Nulls, blanks, repeats, long texts, clashing names; every row gives one."""
    labels = spark.createDataFrame([(0, 1), (None, 0), (2, None), (3, 7)], "doc_id long, quality int")
    rows = list(enumerate(ODD)) + [(None, "a b c a b c"), (3, "other")]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n_words int, words_ string, rule int")
    got = [(r["doc_id"], *(r[c] for c in decisions.BASE), r["base_failed"]) for r in decisions.apply(frame, labels).collect()]
    assert sorted(got, key=repr) == sorted(((i, *base(t), failed(base(t))) for i, t in rows), key=repr)
    assert decisions.apply(frame.limit(0), labels).collect() == []
    assert all(r["kept"] != r["base_failed"] for r in decisions.apply(frame, labels.limit(0)).collect())


def plain_learn(rows, features, prunes, precision, covered):
    """The same covering over rows in memory, counting every threshold anew."""
    bins = lambda r: [min(400, math.ceil(math.log1p(r[n] / u) * 16)) for n, u in features.items()]
    rows = [(r, bins(r), r["label"] == 0, prunes(r["id"])) for r in rows]
    passes = lambda r, c: r[c[0]] > c[2] if c[1] else r[c[0]] <= c[2]
    found = []
    hit = lambda r: any(all(passes(r, c) for c in rule) for rule in found)
    while True:
        left = [x for x in rows if not hit(x[0])]
        grow, rule = [x for x in left if not x[3]], []
        while len(rule) < 4:
            now = [x for x in grow if all(passes(x[0], c) for c in rule)]
            p, n = sum(x[2] for x in now), sum(not x[2] for x in now)
            best = None
            for k, (name, unit) in enumerate(features.items()):
                values = sorted({x[1][k] for x in now})
                for low, high in zip(values, values[1:]):
                    for above in (True, False):
                        inside = [x for x in now if (x[1][k] > low) == above]
                        a, b = sum(x[2] for x in inside), sum(not x[2] for x in inside)
                        if a and b < n and (gain := a * (math.log2(a / (a + b)) - math.log2(p / (p + n)))) > 1e-9:
                            if best is None or gain > best[0]:
                                edge = lambda i: unit * math.expm1(i / 16)  # noqa: E731,B023
                                best = (gain, (name, above, float(f"{(edge(low) + edge(high - 1)) / 2:.5g}")), b)
            if best is None or best[1] in rule:
                break
            rule.append(best[1])
            if best[2] == 0:
                break
        if not rule:
            break
        scores = []
        for k in range(1, len(rule) + 1):
            inside = [x for x in left if x[3] and all(passes(x[0], c) for c in rule[:k])]
            p, n = sum(x[2] for x in inside), sum(not x[2] for x in inside)
            scores.append(((p - n) / max(p + n, 1), -k, p, n))
        _, k, p, n = max(scores)
        total = sum(x[2] for x in left if all(passes(x[0], c) for c in rule[: -k]))
        if p == 0 or p < precision * (p + n) or total < covered:
            break
        found.append(rule[: -k])
    return found


@pytest.mark.parametrize("seed", range(3))
def test_learner_agrees_with_plain_version(spark, seed):
    import random

    draw = random.Random(seed)
    rows = []
    for i in range(600):
        r = {"id": i, "a": draw.random(), "b": float(draw.randrange(200)), "c": draw.random() * 5}
        bad = r["a"] > 0.7 and r["b"] <= 90 or r["c"] > 4.4
        rows.append(r | {"label": 0 if bad != (draw.random() < 0.01) else 1})
    frame = spark.createDataFrame(rows, "id long, a double, b double, c double, label int")
    features = {"a": 0.001, "b": 1.0, "c": 0.01}
    held = {r["id"] for r in frame.selectExpr("id", "pmod(xxhash64(id), 3) = 0 AS p").filter("p").collect()}
    learned = decisions.learn(frame, features, precision=0.8)
    plain = plain_learn(rows, features, held.__contains__, 0.8, decisions.COVERED)
    assert 2 <= len(learned.rules) <= len(plain)
    assert [[(c.name, c.above, c.threshold) for c in rule] for rule in learned.rules] == plain[: len(learned.rules)]
    # The expression is the list.
    for r in frame.select("*", learned.kept().alias("kept"), learned.rule().alias("rule")).collect():
        first = next((k for k, rule in enumerate(learned.rules, 1) if all(
            r[c.name] > c.threshold if c.above else r[c.name] <= c.threshold for c in rule)), None)
        assert r["rule"] == first and r["kept"] == (first is None)
    assert "drop if" in str(learned) and str(learned).endswith("else keep")


def test_noise_and_single_labels_give_no_rules(spark):
    import random

    draw = random.Random(5)
    rows = [(i, draw.random(), draw.randrange(2)) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, a double, label int")
    assert decisions.learn(frame, {"a": 0.01}).rules == []
    for label in (0, 1):
        assert decisions.learn(frame.filter(f"label = {label}"), {"a": 0.01}).rules == []
    assert decisions.learn(frame.limit(0), {"a": 0.01}).rules == []


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 5), st.integers(0, 9), st.integers(0, 9)), max_size=12))
def test_best_split_is_the_best(table):
    table = [t for t in {t[:2]: t for t in table}.values() if t[2] + t[3]]
    found, best = decisions.best_split(table), 0.0
    for f in {t[0] for t in table}:
        rows = [t[1:] for t in table if t[0] == f]
        p, n = sum(r[1] for r in rows), sum(r[2] for r in rows)
        for cut in range(5):
            for side in (True, False):
                inside = [r for r in rows if (r[0] > cut) == side]
                a, b = sum(r[1] for r in inside), sum(r[2] for r in inside)
                if a and b < n:
                    best = max(best, a * (math.log2(a / (a + b)) - math.log2(p / (p + n))))
    assert (found[0] if found else 0) == pytest.approx(best, abs=1e-8)

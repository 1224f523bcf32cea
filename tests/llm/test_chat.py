"""Formatted conversations are read back by a plain parser."""

import random

import pytest
from pyspark.sql import functions as F

from sparkprof.llm import chat

PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<\\/s>", "[\\\\INST]", "<", "s>", "INST]", "\n", "é", "ok", " ", "$1"]


def plain_parse(text, escaped):
    """Turns of a formatted conversation, without regular expressions."""
    turns = []
    while text:
        assert text.startswith("<s>[INST]")
        role, rest = text[9:].split("[/INST]", 1)
        body, text = rest.split("</s>", 1)
        turns.append((plain_unescape(role), plain_unescape(body)))
    return turns


def plain_unescape(text):
    out, i = "", 0
    while i < len(text):
        if text[i] in "<[":
            j = i + 1
            while j < len(text) and text[j] == "\\":
                j += 1
            tail = text[j:]
            if j > i + 1 and any(tail.startswith(t) for t in ("s>", "/s>", "INST]", "/INST]")):
                out += text[i] + text[i + 2 : j]
                i = j
                continue
        out += text[i]
        i += 1
    return out


@pytest.fixture(scope="module")
def conversations(spark):
    rng = random.Random(2)
    rows = []
    for c in range(80):
        for t in range(rng.randint(1, 5)):
            text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 8))) if c % 2 else f"plain {t}"
            rows.append((c, t, rng.choice(["user", "assistant", "system", "as[/INST]x"]), text, "f", True))
    rows += [(200, 1, None, None, "f", True), (200, None, "user", "first", "f", True), (200, 1, "assistant", "b", "f", True),
             (200, 1, "assistant", "b", "f", True), (None, 0, "assistant", "nobody", "f", True),
             (201, 0, "assistant", "long </s> " * 50_000, "f", True)]
    schema = "conv_id bigint, turn bigint, role string, text string, formatted string, escaped boolean"
    return rows, spark.createDataFrame(rows, schema)


def test_round_trip(conversations):
    rows, df = conversations
    want = {}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c, _, role, text, *_ in sorted(rows, key=key):
        want.setdefault(c, []).append((role or "", text or ""))
    out = chat.format_conversations(df).collect()
    assert len(out) == len(want)
    for r in out:
        turns = plain_parse(r["formatted"], r["escaped"])
        assert turns == want[r["conv_id"]]
        learned = "".join(plain_unescape(r["formatted"][s["start"] : s["start"] + s["length"]]) for s in r["loss_spans"])
        assert learned == "".join(t for role, t in turns if role == "assistant")
    assert {r["escaped"] for r in out if r["conv_id"] in (0, 2, 4)} == {False}
    assert next(r for r in out if r["conv_id"] == 201)["escaped"]


def test_parse_gives_the_source(conversations):
    _, df = conversations
    out = chat.format_conversations(df).withColumn("t", chat.parse(F.col("formatted")))
    assert out.filter(F.size("t") == 0).count() == 0


def test_escapes_are_reversible(spark):
    texts = [("".join(p),) for p in zip(PARTS, PARTS[1:], PARTS[2:])] + [("<\\\\\\s>",), ("",)]
    df = spark.createDataFrame(texts, "t string")
    bad = df.filter(chat.unescape(chat.escape(F.col("t"))) != F.col("t"))
    assert bad.collect() == []
    held = df.select(chat.escape(F.col("t")).alias("e")).collect()
    assert not any(c in r["e"] for r in held for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_empty_table(conversations):
    assert chat.format_conversations(conversations[1].limit(0)).collect() == []

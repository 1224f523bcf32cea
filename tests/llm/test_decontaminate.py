"""Passages of the benchmark, also re-parameterised ones, against a plain search."""

import re

from pyspark.sql import functions as F

from sparkprof.llm import decontaminate

ITEM = "Anna walked 12 km with Peter and then 12 miles more because Maria had asked them to buy 3 apples."
SHORT = "two words only here"
DOCUMENTS = "doc_id bigint, text string, item bigint, hash string, slots int"


def frames(spark, texts):
    documents = spark.createDataFrame([(i, t, 1, "h", 2) for i, t in texts], DOCUMENTS)
    items = [(0, ITEM, 1), (1, SHORT, 1), (2, None, 1), (3, "", 1), (None, ITEM, 1), (4, "7 8 9 10 11 12 13 14 15", 1)]
    return documents, spark.createDataFrame(items, "item_id bigint, text string, doc bigint")


def test_copies_and_changed_questions(spark):
    other = "x Anna walked 15 km with Paul and then 15 miles more because Sara had asked them to buy 7 apples. y"
    mixed = "Anna walked 15 km with Paul and then 19 miles more because Sara had asked them to buy 7 apples."
    texts = [(1, "before it. " + ITEM.upper().lower() + " after it"), (2, other), (3, mixed), (4, None), (5, ""),
             (6, "nothing of it at all, but 12 km and 3 apples"), (None, ITEM), (7, "a " * 50_000 + ITEM), (8, "some " + SHORT + " there"),
             (9, "1 2 3 4 5 6 7 8 9 10 11 12"), (7, "again"), (10, ITEM)]
    documents, items = frames(spark, texts)
    rows = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(documents, items).collect()}
    # Lower case hides the names; what is left of the question is not enough of it.
    assert set(rows) - {(1, 0)} == {(2, 0), (3, 0), (7, 0), (8, 1), (10, 0)}
    assert rows[2, 0]["changed"] and not rows[10, 0]["changed"]
    assert rows[10, 0]["matched"] == rows[10, 0]["windows"]
    # 19 miles and 15 km cannot both stand for 12.
    assert rows[3, 0]["matched"] < rows[2, 0]["matched"]
    kept = decontaminate.clean(documents, items)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} >= {4, 5, 6, 9, None}
    assert kept.filter(F.col("doc_id").isin(2, 7, 8, 10)).count() == 0


def test_copied_windows_agree_with_a_plain_search(spark, small):
    documents, benchmark = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(documents, benchmark).collect()}
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    windows = {}
    for item in benchmark.collect():
        own = words(item["text"])
        for i in range(max(1, len(own) - 7)):
            windows.setdefault(tuple(own[i : i + 8]), set()).add(item["item_id"])
    hits, sizes = {}, {i["item_id"]: max(1, len(words(i["text"])) - 7) for i in benchmark.collect()}
    for d in documents.collect():
        own = words(d["text"])
        for i in range(len(own) - 7):
            for item in windows.get(tuple(own[i : i + 8]), ()):
                hits.setdefault((d["doc_id"], item), set()).add(tuple(own[i : i + 8]))
    plain = {pair for pair, held in hits.items() if len(held) >= 0.3 * sizes[pair[1]]}
    assert plain == found and found


def test_empty_tables(spark):
    documents, items = frames(spark, [(1, ITEM)])
    assert decontaminate.contaminated(documents.limit(0), items).collect() == []
    assert decontaminate.contaminated(documents, items.limit(0)).collect() == []
    assert decontaminate.clean(documents, items.limit(0)).count() == 1


def test_verbatim_copies_of_any_case_and_place(spark):
    """Names in lower or upper case, and a first word that looks like a name inside the sentence."""
    question = "Which river flows through the old town?"
    texts = [(1, "so " + ITEM.lower()), (2, ITEM.upper()), (3, "quiz question: " + question), (4, "a river, and Which town?")]
    documents, _ = frames(spark, texts)
    items = spark.createDataFrame([(0, ITEM), (1, question)], "item_id bigint, text string")
    rows = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(documents, items).collect()}
    assert set(rows) == {(1, 0), (2, 0), (3, 1)}
    assert all(r["matched"] == r["windows"] for r in rows.values())
    assert {r["doc_id"] for r in decontaminate.clean(documents, items).collect()} == {4}


def test_excerpts_of_long_items(spark):
    """A run of words counts though it is a small share of the item."""
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)]
    texts = [(1, "x " + " ".join(words[40:53]) + " y"), (2, "x " + " ".join(words[40:52]) + " y"),
             (3, " ".join(w for i in range(0, 100, 10) for w in (*words[i : i + 8], "z"))), (4, " ".join(words))]
    documents, _ = frames(spark, texts)
    items = spark.createDataFrame([(0, " ".join(words))], "item_id bigint, text string")
    rows = {r["doc_id"]: r for r in decontaminate.contaminated(documents, items).collect()}
    assert {i: (r["run"], r["matched"]) for i, r in rows.items()} == {1: (13, 6), 4: (100, 93)}
    assert rows[1]["share"] < decontaminate.SHARE

"""The registered queries on the smallest tables: against their SQL or brute force."""

import re
import zlib

import pytest

import __spark_entry__ as registered
from sparkprof.llm import decontaminate, queries, simhash
from tests.compare import difference, oracle_connection
from tests.llm.test_simhash import expected, found

QUERIES = queries.QUERIES


@pytest.fixture(scope="module")
def connection(small):
    return oracle_connection(small)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_agrees_with_sql(name, spark, small, connection):
    assert difference(QUERIES[name][0](spark, small), connection, QUERIES[name][1]) is None


def test_all_are_registered():
    assert set(QUERIES) <= set(registered.queries()) and "pipeline" in registered.queries()
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]


def documents(spark, small):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]


def test_fingerprints_and_groups(spark, small):
    result = QUERIES["op8_simhash"][0](spark, small)
    assert result.columns == ["doc_id", "fingerprint", "component_id"]
    assert found(result) == sorted(expected(documents(spark, small)))


def test_folds_and_scores(spark, small):
    fold = lambda id, n: zlib.crc32(str(id).encode()) % n
    rows = QUERIES["op3_quality"][0](spark, small).collect()
    assert len(rows) == 200
    for r in rows:
        assert r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.7)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) >= 0.8 * len(held)
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op4_language"][0](spark, small).collect()
    assert len(rows) == 200 and all(r["held_out"] == (fold(r["doc_id"], 3) == 1) for r in rows)
    held = [r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(held) >= 0.95 * len(held)


def test_mix_query(spark, small):
    rows = QUERIES["op1_mixing"][0](spark, small).collect()
    assert len(rows) == 200
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in documents(spark, small)}
    assert all(r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) / sum(sizes.values()) - 1) < 0.05


def similar_groups(rows, least=0.8):
    """The smallest id of each document's group: Jaccard similarity of five-word shingles over all pairs."""
    shingled = []
    for id, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        size = min(5, len(words))
        shingled.append((id, {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if words else {b""}))
    group = {id: id for id, _ in rows}
    for k, (a, left) in enumerate(shingled):
        for b, right in shingled[:k]:
            if group[a] != group[b] and len(left & right) >= least * len(left | right):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return group


def test_pipeline_keeps_what_its_stages_keep(spark, small):
    """Each stage's decisions, taken again from their definitions, give the pipeline's rows."""
    import corpus_pipeline

    good = {r["doc_id"] for r in QUERIES["op3_quality"][0](spark, small).collect() if r["predicted"] == 1}
    out = registered.queries()["pipeline"](spark, small).collect()
    kept = {r["doc_id"] for r in out}
    assert kept <= good and len(kept) > 100
    docs = spark.read.parquet(f"{small}/documents.parquet")
    left = entered = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = left.count()
        left = simhash.write_once(stage(spark, left, small), "stage")
        assert left.columns == docs.columns and left.count() <= before
        if name == "SimHash near-dedup":
            # One document of each group of texts whose shingles are alike, by brute force over all pairs.
            texts = [(r["doc_id"], r["text"]) for r in entered.collect()]
            assert {r["doc_id"] for r in left.collect()} == set(similar_groups(texts).values())
        entered = left
    rows = [(r["doc_id"], r["text"]) for r in left.collect()]
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    assert decontaminate.contaminated(left, benchmark).count() == 0
    assert kept <= {i for i, _ in rows}
    langs = {"en", "fr", "de", "es"}
    assert {r["lang"] for r in out} <= langs
    # Run again, the pipeline gives the same rows.
    again = registered.queries()["pipeline"](spark, small).collect()
    pick = lambda rows: sorted((r["doc_id"], r["mix_copy"], r["mix_shard"]) for r in rows)
    assert pick(out) == pick(again)


def test_pipeline_of_odd_rows(spark, small, tmp_path):
    """Nulls, empty and repeated rows, extra columns; and an empty table."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60).selectExpr("*", "1 AS language", "2 AS fp", "'x' AS mix_s")
    odd = spark.createDataFrame([(None, None, None, None, 1), (1, "", "en", None, 2), (70_000, "12 34", "en", "s", 3)],
                                "doc_id bigint, text string, lang string, source string, n_chars bigint")
    odd = odd.selectExpr("*", "1 AS language", "2 AS fp", "'x' AS mix_s")
    for name, rows in (("odd", docs.unionByName(odd).unionByName(docs.limit(5))), ("none", docs.limit(0))):
        folder = tmp_path / name
        rows.write.parquet(f"{folder}/documents.parquet")
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{small}/{other}.parquet").write.parquet(f"{folder}/{other}.parquet")
        out = corpus_pipeline.run(spark, str(folder)).collect()
        assert (len(out) > 0) == (name == "odd")
        assert not any(r["text"] in (None, "", "12 34") for r in out)

"""Code lengths against a plain walk down the contexts; odd rows are defined."""

import numpy as np
import pandas as pd
import pytest

from sparkprof.llm import language

TEXTS = {
    "en": ["the cat and the dog were in the house", "this is what they said and then they went"],
    "de": ["der hund und die katze sind in dem haus", "das ist was sie sagten und dann gingen sie"],
    "fr": ["le chien et la chatte étaient à la maison", "c'est ce qu'ils ont dit et puis ils sont partis"],
}


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, t, lang, "x") for i, (lang, t) in enumerate((l, t) for l, ts in TEXTS.items() for t in ts * 3)]
    rows += [(None, "the", "en", "x"), (90, None, "en", "x"), (91, "the", None, "x"), (0, "the", "en", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, gram string")


@pytest.fixture(scope="module")
def model(frame):
    return language.fit(frame)


def test_predictions(spark, model):
    asked = ["the house and the cat", "und die katze", "les chiens étaient", None, "", "123 !!", "THE CAT", "漢字",
             "the dog " * 50_000]
    df = spark.createDataFrame(list(enumerate(asked)), "n int, text string").orderBy("n")
    rows = df.select("n", model.predict(df["text"]).alias("p")).select("n", "p.*").collect()
    names = [r["lang_pred"] for r in rows]
    assert names[:7] == ["en", "de", "fr", "und", "und", "und", "en"] and names[8] == "en"
    assert names[7] in TEXTS  # unseen letters: a language, by their escapes
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert [r["score"] for r in rows[3:6]] == [0.0] * 3 and rows[3]["bits_per_byte"] is None


def test_code_lengths_agree_with_a_plain_walk(monkeypatch):
    counts = pd.concat(language._counted([pd.DataFrame(
        [(l, t) for l, ts in TEXTS.items() for t in ts], columns=["lang", "text"])]))
    counts = counts.groupby(["lang", "gram"], as_index=False)["n"].sum()
    model = language.build(counts)
    texts = ["the katze étaient", "zzz 漢字", "", None, "a" * 300]

    def plain(text, lang):
        own = counts[counts["lang"] == lang]
        data = b"\n" * language.ORDER + (text or "").lower().encode()
        total = 0.0
        for i in range(language.ORDER, len(data)):
            for order in range(language.ORDER, -1, -1):
                context = int.from_bytes(data[i - order : i], "big")
                cut = own["gram"].to_numpy() & ((1 << 8 * (order + 1)) - 1)
                here = (cut >> 8) == context
                seen = {}
                for symbol, n in zip(cut[here] & 255, own["n"].to_numpy()[here]):
                    seen[symbol] = seen.get(symbol, 0) + n
                n, d = sum(seen.values()), len(seen)
                if data[i] in seen:
                    total -= np.log2(seen[data[i]] / (n + d))
                    break
                if n:
                    total -= np.log2(d / (n + d))
            else:
                total += 8
        return total

    want = [[plain(t, lang) for lang in model.languages] for t in texts]
    assert np.allclose(model.code_lengths(texts), want, rtol=1e-5)
    monkeypatch.setattr(language, "CELLS", 30)  # chunks of a few bytes
    assert np.allclose(model.code_lengths(texts), want, rtol=1e-5)


def test_statistics_do_not_depend_on_partitions(frame, model):
    again = language.fit(frame.repartition(4))
    texts = ["the cat", "katze"]
    assert again.languages == model.languages
    assert np.array_equal(again.code_lengths(texts), model.code_lengths(texts))


def test_nothing_to_learn(frame):
    empty = language.fit(frame.limit(0))
    assert empty.languages == []
    row = frame.limit(1).select(empty.predict(frame["text"]).alias("p")).first()["p"]
    assert (row["lang_pred"], row["score"]) == ("und", 0.0)
    assert frame.limit(0).select(empty.predict(frame["text"])).collect() == []


def test_hash_tables_find_what_they_hold():
    keys = np.random.default_rng(0).choice(1 << 40, 500, replace=False).astype(np.int64)
    table = language.Table.of(keys, np.zeros((500, 1), dtype=np.float32))
    assert table.find(keys).tolist() == list(range(500))
    assert set(table.find(keys + 1)) <= {-1, *range(500)} and table.find(np.array([1 << 41])).tolist() == [-1]

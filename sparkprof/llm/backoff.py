"""Language-model scores of documents by stupid backoff over counts of the corpus itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Weight of the shorter context.
BACKOFF = 0.4
# Words of a block of documents and n-grams of a count table, on average.
BLOCK_WORDS = 2_000_000
TABLE_GRAMS = 2_000_000
# Decimals of a score.
DIGITS = 4

_PAIR = np.uint64(0x9E3779B97F4A7C15)
_WORD = r"[^\x20\x09-\x0D]+"


def score(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns ``id``, ``n_words`` and ``score``, the base-10 log of the text's probability.

    Words are split at ASCII white space, A-Z in lower case.  Every word is scored by the
    counts of all other occurrences in all documents: after v, a word w has
    (c(v w) - 1) / (c(v) - 1) if the pair occurs elsewhere, else BACKOFF times
    (c(w) - 1) / (N - 1), where a word that occurs nowhere else counts as one.  The first
    word has no context and no backoff weight.  Scores have DIGITS decimals.

    Documents are dealt to blocks by hash.  A block sends each of its distinct n-grams
    once, with its count, to one of the count tables that the hashes are cut into, so an
    n-gram that fills the corpus is a row for each block.  A table adds up and answers
    every block that asked; the answers are joined to the block's documents, word by
    word, and summed.

    Null and empty texts have no words and score 0.  Null ids and repeated rows stay.
    Other columns are not read.  An empty table gives an empty table.
    """
    rows = documents.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    counted = F.sum(F.regexp_count("text", F.lit(_WORD)))
    words = int(rows.agg(F.coalesce(counted, F.lit(0))).first()[0])
    blocks, tables = max(1, -(-words // BLOCK_WORDS)), max(1, -(-2 * words // TABLE_GRAMS))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).alias("block")
    # This shuffle is used twice: for the questions, and where the answers arrive.
    dealt = rows.select(block, "id", "text").repartition(max(blocks, tables), "block").groupBy("block")

    def asked(key, held):
        grams, _, counts = _distinct(held["text"])[:3]
        ends = [0, *np.searchsorted(grams, _bounds(tables)), len(grams)]
        return pd.DataFrame([
            (key[0], part, _steps(grams[a:b]), _thin(counts[a:b]))
            for part, (a, b) in enumerate(zip(ends, ends[1:])) if a < b
        ], columns=["block", "part", "data", "counts"])

    questions = dealt.applyInPandas(asked, "block long, part int, data binary, counts binary")
    answers = questions.groupBy("part").applyInPandas(_answers, "block long, part int, counts binary")

    def scored(key, held, answers):
        return _scores(held, answers, words)

    out = dealt.cogroup(answers.groupBy("block")).applyInPandas(scored, "id long, n_words long, score double")
    return out.select(F.col("id").alias(id), "n_words", "score")


def word_hashes(text: str | None) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    words = (text or "").encode().lower().split()
    return np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words))


def _grams(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of all words, then of all pairs; ``first`` marks where a document begins."""
    pairs = (words[:-1] * _PAIR + words[1:]) ^ (words[:-1] >> np.uint64(29))
    return np.concatenate((words, (pairs * _PAIR)[~first[1:]]))


def _distinct(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct n-grams, the number of each word's and pair's, their counts; the lengths
    of the texts, and which words begin one."""
    hashed = [word_hashes(t) for t in texts]
    lengths = np.array([len(h) for h in hashed], dtype=np.int64)
    words = np.concatenate([np.empty(0, dtype=np.uint64), *hashed])
    first = np.zeros(len(words) + 1, dtype=bool)
    first[np.cumsum(lengths) - lengths] = True
    first = first[: len(words)]
    grams = _grams(words, first) if len(words) else words
    return *np.unique(grams, return_inverse=True, return_counts=True), lengths, first


def _thin(values: np.ndarray) -> bytes:
    """Bytes of non-negative integers, as few for each as the largest needs, and that number."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    whole = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    return bytes([width]) + whole[:, :width].tobytes()


def _thick(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def _steps(sorted_: np.ndarray) -> bytes:
    return _thin(np.diff(sorted_, prepend=np.uint64(0)))


def _whole(data: bytes) -> np.ndarray:
    return np.cumsum(_thick(data), dtype=np.uint64)


def _bounds(tables: int) -> np.ndarray:
    """Where the range of hashes of each table but the first begins."""
    return np.array([(i << 64) // tables for i in range(1, tables)], dtype=np.uint64)


def _answers(rows: pd.DataFrame) -> pd.DataFrame:
    """The counts in all blocks of the n-grams that each block has in one table."""
    grams = [_whole(d) for d in rows["data"]]
    known, place = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.zeros(len(known), dtype=np.int64)
    np.add.at(total, place, np.concatenate([_thick(c) for c in rows["counts"]]).astype(np.int64))
    ends = np.cumsum([len(g) for g in grams])[:-1]
    answers = [_thin(total[p]) for p in np.split(place, ends)]
    return pd.DataFrame({"block": rows["block"], "part": rows["part"], "counts": answers})


def _scores(held: pd.DataFrame, answers: pd.DataFrame, words: int) -> pd.DataFrame:
    _, place, _, lengths, first = _distinct(held["text"])
    total = np.zeros(len(lengths))
    if len(first):
        counts = np.concatenate([_thick(c) for c in answers.sort_values("part")["counts"]])
        others = counts[place].astype(np.int64) - 1
        single, pair = others[: len(first)], others[len(first) :]
        after = np.flatnonzero(~first)
        alone = np.maximum(single, 1) / max(words - 1, 1)
        chance = alone.copy()
        chance[after] = np.where(
            pair > 0, pair / np.maximum(single[after - 1], 1), BACKOFF * alone[after]
        )
        owner = np.repeat(np.arange(len(lengths)), lengths)
        total = np.bincount(owner, weights=np.log10(chance), minlength=len(lengths))
    return pd.DataFrame({
        "id": held["id"].astype("Int64"), "n_words": lengths, "score": np.round(total, DIGITS) + 0.0,
    })

"""Quality classifier: supervised subword embeddings trained by stochastic gradient descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Hashed n-grams: 2**BITS buckets.
BITS = 17
DIMENSION = 8
CHARACTERS = (3, 4)
FAMILIES = 2 + len(CHARACTERS)
# Labelled rows of either class that a model is trained on, at most.
ROWS_PER_CLASS = 1500
EPOCHS = 6
RATE = 1.0
# Characters that are hashed at once; a word of more (262,144) counts as several.
PIECE = 1 << 18

_MIX = np.uint32(0x9E3779B1)
_STEP = np.uint32(0x01000193)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass
class QualityModel:
    """Bucket vectors, output weights and the log odds that training set aside."""

    vectors: np.ndarray
    output: np.ndarray
    offset: float
    trained: bool

    def score(self, text: Column) -> Column:
        """The probability of label 1, over the whole text; null and empty texts included.

        A model that saw no labelled row gives 0.5.
        """
        # Output and mean are linear: a bucket adds the difference of its two logits.
        logits = (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32)
        shared = SparkSession.active().sparkContext.broadcast((logits, self.offset))

        @F.pandas_udf("double")
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            table, offset = shared.value
            for texts in batches:
                odds = document_sums(texts.tolist(), table) + offset
                yield pd.Series(1.0 / (1.0 + np.exp(-odds)))

        return of(text)


def fit(
    documents: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
    label: str = "quality", rows_per_class: int = ROWS_PER_CLASS, seed: int = 7,
) -> QualityModel:
    """Trains on up to ``rows_per_class`` labelled documents of either class.

    They are those whose hashed id is smallest, so the choice does not depend on how
    rows are stored.  Labels other than 0 and 1 are ignored, of several labels of an
    id the largest counts, and of several rows of an id the smallest text.  Executors
    turn the chosen texts into bucket weights; only these reach the driver.  The scores
    are corrected for the share of the classes among all labels.
    """
    marked = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label"))
    marked = marked.filter("id is not null and label in (0, 1)")
    marked = marked.groupBy("id").agg(F.max("label").alias("label"))
    shares = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    chosen = None
    for value in (0, 1):
        one = marked.filter(F.col("label") == value).orderBy(F.xxhash64("id", F.lit(seed)), "id")
        one = one.limit(rows_per_class)
        chosen = one if chosen is None else chosen.unionByName(one)
    # At most 2 * rows_per_class rows of two numbers.
    rows = documents.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text"))
    found = rows.mapInPandas(_training_rows, "id long, label int, bucket binary, weight binary")
    found = found.toPandas().sort_values("id")
    buckets = [np.frombuffer(b, dtype=np.int32) for b in found["bucket"]]
    weights = [np.frombuffer(w, dtype=np.float32) for w in found["weight"]]
    wanted = found["label"].to_numpy()
    vectors, output = train(buckets, weights, wanted, seed)
    seen = np.bincount(wanted, minlength=2) + 1
    offset = np.log((shares.get(1, 0) + 1) / (shares.get(0, 0) + 1)) - np.log(seen[1] / seen[0])
    return QualityModel(vectors, output, float(offset), len(found) > 0)


def _training_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        rows = rows.reset_index(drop=True)
        pairs = [document_weights(t) for t in rows["text"]]
        yield pd.DataFrame({
            "id": rows["id"], "label": rows["label"],
            "bucket": [b.astype(np.int32).tobytes() for b, _ in pairs],
            "weight": [w.astype(np.float32).tobytes() for _, w in pairs],
        })


def train(
    buckets: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray, seed: int,
    epochs: int = EPOCHS, rate: float = RATE,
) -> tuple[np.ndarray, np.ndarray]:
    """One document a step; the rate falls to zero in a straight line.

    A bucket moves by its weight, times the root of the number of buckets: else the
    buckets of long texts would hardly move.
    """
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIMENSION, 1 / DIMENSION, (1 << BITS, DIMENSION)).astype(np.float32)
    output = np.zeros((DIMENSION, 2), dtype=np.float32)
    steps, step = max(1, epochs * len(labels)), 0
    for _ in range(epochs):
        for row in random.permutation(len(labels)):
            pace = rate * (1 - step / steps)
            step += 1
            at, weight = buckets[row], weights[row]
            if not len(at):
                continue
            mean = weight @ vectors[at]
            odds = mean @ output
            error = np.exp(odds - odds.max())
            error /= error.sum()
            error[labels[row]] -= 1
            back = output @ error
            output -= pace * np.outer(mean, error)
            vectors[at] -= (pace * weight * len(at) ** 0.5)[:, None] * back
    return vectors, output


def document_weights(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights: each family of n-grams averages."""
    parts = [found for pieces, _ in _batches([text]) for found in enumerate(b for b, _ in _buckets(pieces))]
    if not parts:
        return np.empty(0, dtype=np.int64), np.empty(0)
    counts = np.zeros(FAMILIES)
    for family, found in parts:
        counts[family] += len(found)
    share = np.concatenate([np.full(len(f), 1 / (max(counts[k], 1) * FAMILIES)) for k, f in parts])
    at, place = np.unique(np.concatenate([f for _, f in parts]), return_inverse=True)
    return at, np.bincount(place, weights=share)


def document_sums(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """For each text the mean of its buckets' values in ``table``."""
    sums = np.zeros((FAMILIES, len(texts)))
    counts = np.zeros((FAMILIES, len(texts)))
    for pieces, owners in _batches(texts):
        for family, (found, piece) in enumerate(_buckets(pieces)):
            sums[family] += _per_document(piece, table[found], owners, len(texts))
            counts[family] += _per_document(piece, None, owners, len(texts))
    return (sums / np.maximum(counts, 1)).sum(axis=0) / FAMILIES


def _per_document(piece: np.ndarray, values, owners: np.ndarray, documents: int) -> np.ndarray:
    of_piece = np.bincount(piece, weights=values, minlength=len(owners))
    return np.bincount(owners, weights=of_piece, minlength=documents)


def _batches(texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Texts in pieces cut at white space, some PIECE characters at a time, with their owners."""
    pieces: list[str] = []
    owners: list[int] = []
    held = 0
    for owner, text in enumerate(texts):
        for piece in _pieces(" ".join((text or "").split())):
            if pieces and held + len(piece) > PIECE:
                yield pieces, np.array(owners)
                pieces, owners, held = [], [], 0
            pieces.append(piece)
            owners.append(owner)
            held += len(piece)
    if pieces:
        yield pieces, np.array(owners)


def _pieces(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > PIECE:
        cut = text.rfind(" ", start + 1, start + PIECE)
        cut = cut if cut > start else start + PIECE
        yield text[start:cut]
        start = cut
    if start < len(text):
        yield text[start:]


def _buckets(pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, piece of each) of every family: words, word pairs, character n-grams."""
    # Every piece stands between spaces of its own, whatever its neighbours are.
    text = "".join(f" {p} " for p in pieces)
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), [len(p) + 2 for p in pieces])
    spaces = np.flatnonzero(codes == 32)
    real = np.diff(spaces) > 1
    start, end = spaces[:-1][real] + 1, spaces[1:][real]
    words, owner = _word_hashes(codes, start, end), piece[start]
    # Symmetric, so that every immediate repeat of a word falls into one bucket.
    same = owner[1:] == owner[:-1]
    pairs = (words[1:] ^ words[:-1])[same]
    out = [(_bucket(words, 1), owner), (_bucket(pairs, 2), owner[1:][same])]
    rolled = codes
    for size in range(2, max(CHARACTERS) + 1):
        rolled = rolled[:-1] * _STEP + codes[size - 1 :]
        if size in CHARACTERS:
            inside = piece[: len(rolled)] == piece[size - 1 :]
            out.append((_bucket(rolled[inside], 2 + size), piece[: len(rolled)][inside]))
    return out


def _word_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of words from running sums, folded to 32 bits."""
    powers = np.cumprod(np.full(len(codes), _BASE))
    back = np.cumprod(np.full(len(codes), _INVERSE))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(codes * powers)))
    whole = (sums[end] - sums[start]) * back[start]
    return ((whole * _BASE) >> np.uint64(32)).astype(np.uint32)


def _bucket(hashes: np.ndarray, family: int) -> np.ndarray:
    mixed = (hashes + np.uint32(family * 0x85EBCA6B & 0xFFFFFFFF)) * _MIX
    return (mixed ^ (mixed >> np.uint32(15))) * _MIX >> np.uint32(32 - BITS)

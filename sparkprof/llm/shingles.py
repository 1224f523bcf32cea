"""Groups of texts with similar sets of shingles: bands and fingerprints propose, the sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprof.llm.graph import components
from sparkprof.scratch import write_once

SEED = 42
# A pair at similarity 0.8 shares none of 20 bands of 6 minima with probability 0.0023, at 0.85 with 0.00002.
BANDS, MINIMA = 20, 6
# Texts and shingles of one side of a unit, on average.
UNIT_ROWS = 1024
UNIT_SHINGLES = 500_000
_AT_ONCE = 4096
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashes(text: str | None, words: int) -> np.ndarray:
    """A hash of each shingle in order; ASCII white space separates words, A-Z are lowered."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, dtype="<u8")
    size = min(words, len(parts))
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())), "<u8", len(starts)
    )


def set_id(shingles: np.ndarray) -> int:
    """A signed hash of a sorted set of shingles; the empty set is 0."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63) if len(shingles) else 0


def bands(shingles: np.ndarray) -> np.ndarray:
    """MinHash keys: two sets have a key in common if all minima of a band agree."""
    if not len(shingles):
        return np.empty(0, dtype="<i8")
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, dtype="<u8")
    for at in range(0, len(shingles), _AT_ONCE):
        mixed = shingles[at : at + _AT_ONCE, None] * _FACTORS
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, mixed.min(axis=0))
    rows = least.reshape(BANDS, MINIMA)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), n) for n, r in enumerate(rows)], dtype="<u8").view("<i8")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def marks(text: Column, words: int, fingerprint) -> Column:
    """``set`` (an id of the set of shingles), its size ``n``, ``fp`` and ``bands`` of a text."""

    @F.pandas_udf("set long, n int, fp long, bands array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                every = hashes(text, words)
                own = np.unique(every)
                rows.append((set_id(own), len(own), fingerprint(every), bands(own)))
            yield pd.DataFrame(rows, columns=["set", "n", "fp", "bands"])

    return of(text)


def sets(text: Column, words: int) -> Column:
    """``set`` as in ``marks`` and the sorted ``shingles`` as bytes."""

    @F.pandas_udf("set long, shingles binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            own = [np.unique(hashes(t, words)) for t in texts]
            yield pd.DataFrame({"set": [set_id(s) for s in own], "shingles": [s.tobytes() for s in own]})

    return of(text)


def alike(
    documents: DataFrame, classes: DataFrame, near: DataFrame, words: int, least: float, distance: int, id: str, text: str
) -> DataFrame:
    """Links ``a, b`` that connect the same sets as all proposed pairs of similarity ``least`` or more do.

    ``classes`` has a row ``set, n, fp, bands, least`` (the smallest id) for each set and
    ``near`` the group ``root`` of fingerprints ``fp`` that are linked.  Sets that share a
    band or have fingerprints within ``distance`` bits are proposed.  What is proposed
    directly or through others comes together in units, large groups in parts that meet
    pairwise; there the similarity of every proposed pair that is not connected yet is computed
    from the sets themselves.
    """
    root = F.xxhash64(F.lit("near"), F.coalesce("root", "fp"))
    keys = classes.select("set", F.explode("bands").alias("key"))
    keys = keys.unionByName(classes.join(near, "fp", "left").select("set", root.alias("key")))
    low = keys.groupBy("key").agg(F.min("set").alias("b"), F.max("set").alias("most")).filter("b < most")
    low = write_once(low.select("key", "b"), "keys")
    groups = components(keys.join(low, "key").select(F.col("set").alias("a"), "b")).withColumnRenamed("node", "set")
    groups = write_once(classes.join(groups, "set"), "proposed")

    count = F.greatest(F.sum("n") / UNIT_SHINGLES, F.count(F.lit(1)) / UNIT_ROWS)
    parts = groups.groupBy("root").agg(F.ceil(count).cast("int").alias("parts"))
    # Small groups share units.
    bins = 1 + groups.count() * 2 // UNIT_ROWS
    large = F.col("parts") > 1
    placed = groups.join(parts, "root").select(
        "set", "n", "fp", "bands", large.alias("large"), "parts",
        F.when(large, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(bins))).alias("unit"),
        F.pmod(F.xxhash64("set"), F.col("parts")).cast("int").alias("part"),
    )
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held = _held(documents.select(F.col(id).alias("id"), F.col(text).alias("text")), groups, words)
    units = placed.join(held, "set").select(
        "large", "unit", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        (F.col("part") > F.col("other")).alias("right"), "set", "n", "fp", "bands", "shingles",
    )

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        return _linked(rows, least, distance)

    return units.groupBy("large", "unit", "i", "j").applyInPandas(join, "a long, b long")


def _held(documents: DataFrame, groups: DataFrame, words: int) -> DataFrame:
    """``set, shingles`` of the groups, made again from one of the texts of each set."""
    wanted = groups.filter(F.col("least").isNotNull()).select(F.col("least").alias("id")).distinct()
    texts = documents.join(wanted, "id", "left_semi")
    if not groups.filter(F.col("least").isNull()).isEmpty():
        texts = texts.unionByName(documents.filter(F.col("id").isNull()))
    made = texts.select(sets(F.col("text"), words).alias("s")).select("s.*")
    # Rows that share an id may have other texts too.
    return made.join(groups.select("set"), "set", "left_semi").dropDuplicates(["set"])


def _linked(rows: pd.DataFrame, least: float, distance: int) -> pd.DataFrame:
    """Links between the left and right rows of a unit, or among all rows of a unit of one part."""
    shingles = [np.frombuffer(s, dtype="<u8") for s in rows["shingles"]]
    size, right = rows["n"].to_numpy(), rows["right"].to_numpy(dtype=bool)
    prints = rows["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    keys = np.stack([np.asarray(b, dtype=np.int64) for b in rows["bands"]])
    every = np.arange(len(rows))
    alone = rows["i"].iloc[0] == rows["j"].iloc[0]
    lefts, rights = (every, every) if alone else (every[~right], every[right])
    root, found = list(range(len(rows))), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for at in range(0, len(lefts), 256):
        these = lefts[at : at + 256]
        proposed = np.bitwise_count(prints[these, None] ^ prints[rights]) <= distance
        for k in range(keys.shape[1]):
            proposed |= keys[these, k, None] == keys[rights, k]
        # Sets of other sizes cannot be as similar.
        small, big = np.minimum(size[these, None], size[rights]), np.maximum(size[these, None], size[rights])
        proposed &= small >= np.floor(least * big)
        if alone:
            proposed &= these[:, None] < rights
        for i, j in np.argwhere(proposed).tolist():
            a, b = int(these[i]), int(rights[j])
            x, y = top(a), top(b)
            if x != y and similarity(shingles[a], shingles[b]) >= least:
                root[x] = y
                found.append((a, b))
    name = rows["set"].to_numpy()
    return pd.DataFrame({"a": [name[a] for a, _ in found], "b": [name[b] for _, b in found]}, dtype="int64")

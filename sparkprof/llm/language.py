"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Longest context in bytes.
ORDER = 4
# Labelled documents of each language that statistics are taken from, on average.
ROWS_PER_LANGUAGE = 300
UNKNOWN = "und"
# Table cells that are looked up at once, over all languages.
CELLS = 1 << 20

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_RANGE = 1 << 31


@dataclass
class Table:
    """Code lengths per language by packed bytes: an open-addressing hash table."""

    slots: np.ndarray
    place: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, bits: np.ndarray) -> Table:
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        slots = np.full(size, -1, dtype=np.int64)
        place = np.zeros(size, dtype=np.int32)
        left, at = np.arange(len(keys)), _slot(keys, size)
        while len(left):
            free = slots[at] < 0
            slots[at[free]] = keys[left[free]]
            # Of several keys that want one slot the last has it.
            won = slots[at] == keys[left]
            place[at[won]] = left[won]
            left, at = left[~won], (at[~won] + 1) & (size - 1)
        return cls(slots, place, bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        at = _slot(keys, len(self.slots))
        held = self.slots[at]
        out = np.where(held == keys, self.place[at], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.slots) - 1)
            held = self.slots[at]
            hit = held == keys[left]
            out[left[hit]] = self.place[at[hit]]
            more = ~hit & (held >= 0)
            left, at = left[more], at[more]
        return out


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    shift = np.uint64(64 - size.bit_length() + 1)
    return ((keys.astype(np.uint64) * _SPREAD) >> shift).astype(np.int64)


@dataclass
class LanguageModel:
    """Frozen context trees of all languages.

    ``grams[k]`` holds, for each context of k bytes and byte after it that some language
    has seen, the code length of that byte in every language, escapes included;
    ``escapes[k]``, for each context, the escape of every language (0 if it has not seen
    the context, which costs nothing then).
    """

    languages: list[str]
    grams: list[Table]
    escapes: list[Table]

    def code_lengths(self, texts: list[str | None]) -> np.ndarray:
        """Bits that each text costs in each language."""
        total = np.zeros((len(texts), len(self.languages)))
        room = max(1, CELLS // max(1, len(self.languages)))
        for owners, data, at, starts in _chunks(texts, room):
            sums = np.add.reduceat(self._bits(data, at), starts, axis=0, dtype=np.float64)
            np.add.at(total, owners, sums)
        return total

    def _bits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code lengths of the bytes at the given places."""
        out = np.zeros((len(at), len(self.languages)), dtype=np.float32)
        wide = data.astype(np.int64)
        left = np.arange(len(at))
        for order in range(ORDER, -1, -1):
            here = at[left]
            context = np.zeros(len(left), dtype=np.int64)
            for back in range(order, 0, -1):
                context = context << 8 | wide[here - back]
            row = self.grams[order].find(context << 8 | wide[here])
            hit = row >= 0
            out[left[hit]] += self.grams[order].bits[row[hit]]
            left, context = left[~hit], context[~hit]
            escape = self.escapes[order].find(context)
            known = escape >= 0
            out[left[known]] += self.escapes[order].bits[escape[known]]
        # A byte no language has seen costs as much in all, besides its escapes.
        out[left] += 8.0
        return out

    def predict(self, text: Column) -> Column:
        """``lang_pred``, ``score`` and ``bits_per_byte`` as a struct, over the whole text.

        The language with the shortest code is predicted, of equals the first by name; the
        score is its probability if all were as likely before.  A null text, a text without
        a letter and every text when nothing was learned give ``und``, 0 and null.
        """
        shared = SparkSession.active().sparkContext.broadcast(self)

        @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = shared.value
            for texts in batches:
                yield model.table(texts.tolist())

        unknown = F.struct(
            F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
            F.lit(None).cast("double").alias("bits_per_byte"),
        )
        if not self.languages:
            return unknown
        return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), of(text)).otherwise(unknown)

    def table(self, texts: list[str | None]) -> pd.DataFrame:
        bits = self.code_lengths(texts)
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(bits)), best]
        score = 1 / np.exp2(np.minimum(least[:, None] - bits, 0)).sum(axis=1)
        size = [max(1, len((t or "").encode())) for t in texts]
        names = np.array(self.languages, dtype=object)
        return pd.DataFrame({"lang_pred": names[best], "score": score, "bits_per_byte": least / size})


def fit(
    documents: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE, seed: int = 11,
) -> LanguageModel:
    """Takes the statistics of about ``rows_per_language`` documents of each language.

    Documents are chosen by the hash of their id: a share of each language that gives so
    many on average, all if it has fewer.  Rows without id, text or language teach
    nothing; of several rows of an id the smallest language and text count.  Executors
    count byte sequences; the driver gets the distinct ones of the chosen documents and
    the number of documents of each language.
    """
    rows = documents.select(F.col(id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.filter("id is not null and lang is not null and text is not null")
    # One row for each language.
    sizes = rows.groupBy("lang").count().collect()
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(_RANGE))
    shares = [
        F.lit(x) for size in sizes
        for x in (size["lang"], min(_RANGE, rows_per_language * _RANGE // size["count"]))
    ]
    share = F.create_map(*shares)[F.col("lang")] if shares else F.lit(0)
    chosen = rows.filter(place < share)
    chosen = chosen.groupBy("id").agg(F.min(F.struct("lang", "text")).alias("row")).select("row.*")
    counts = chosen.mapInPandas(_counted, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return build(counts)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for lang, group in rows.groupby("lang"):
            for _, data, at, _ in _chunks(group["text"].tolist(), CELLS):
                gram = np.zeros(len(at), dtype=np.int64)
                for back in range(ORDER, -1, -1):
                    gram = gram << 8 | data[at - back]
                grams, n = np.unique(gram, return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})


def build(counts: pd.DataFrame) -> LanguageModel:
    """Context trees from counts of sequences of ORDER + 1 bytes.

    After a context seen n times with d different bytes, a byte seen c times has
    probability c / (n + d), and d / (n + d) is the escape to the context without its
    first byte; below the empty context every byte has 1 / 256.
    """
    languages = sorted(counts["lang"].unique())
    grams, escapes = [], []
    below_keys, below_bits = None, None
    for order in range(ORDER + 1):
        keep = (1 << 8 * (order + 1)) - 1
        part = counts.assign(gram=counts["gram"].to_numpy(dtype=np.int64) & keep)
        part = part.groupby(["lang", "gram"], as_index=False)["n"].sum()
        part["context"] = part["gram"].to_numpy() >> 8
        of = part.groupby(["lang", "context"])["n"]
        n, d = of.transform("sum").to_numpy(), of.transform("count").to_numpy()
        column = np.searchsorted(languages, part["lang"])

        contexts, row = np.unique(part["context"], return_inverse=True)
        escape = np.zeros((len(contexts), len(languages)), dtype=np.float32)
        escape[row, column] = -np.log2(d / (n + d))
        escapes.append(Table.of(contexts.astype(np.int64), escape))

        keys, own = np.unique(part["gram"], return_inverse=True)
        bits = escape[np.searchsorted(contexts, keys >> 8)].copy()
        if order == 0:
            bits += 8.0
        else:
            bits += below_bits[np.searchsorted(below_keys, keys & (keep >> 8))]
        bits[own, column] = -np.log2(part["n"].to_numpy() / (n + d))
        grams.append(Table.of(keys.astype(np.int64), bits))
        below_keys, below_bits = keys, bits
    return LanguageModel(list(languages), grams, escapes)


def _chunks(texts: list[str | None], room: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(owners, bytes, places, starts) of some ``room`` bytes each.

    Texts are in lower case, each after ORDER line feeds; a long text goes on in the next
    chunk after its last ORDER bytes.  The places are those of the texts' own bytes, and
    the starts say where each owner's places begin among them.
    """
    owners: list[int] = []
    parts: list[bytes] = []
    held = 0
    for owner, text in enumerate(texts):
        data, at = b"\n" * ORDER + (text or "").lower().encode(), 0
        while len(data) - at > ORDER:
            piece = data[at : at + ORDER + max(1, room - held)]
            owners.append(owner)
            parts.append(piece)
            held += len(piece)
            at += len(piece) - ORDER
            if held >= room:
                yield _chunk(owners, parts)
                owners, parts, held = [], [], 0
    if parts:
        yield _chunk(owners, parts)


def _chunk(owners: list[int], parts: list[bytes]) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(p) for p in parts])
    own = np.ones(sizes.sum(), dtype=bool)
    own[(np.cumsum(sizes) - sizes)[:, None] + np.arange(ORDER)] = False
    starts = np.cumsum(sizes - ORDER) - (sizes - ORDER)
    return np.array(owners), np.frombuffer(b"".join(parts), dtype=np.uint8), np.flatnonzero(own), starts

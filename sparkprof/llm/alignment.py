"""Token alignment of two tokenizers: byte offsets where tokens of both end cut a text into groups."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType,
)

from sparkprof.llm.batches import bounded
from sparkprof.scratch import write_once

FOLDER = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Links between distinct ids that the documents of a block hold together, on average.
BLOCK_LINKS = 1 << 20
# Words and their characters that a task remembers between batches.
WORDS, CHARACTERS = 250_000, 1 << 23
# Characters of new words that are encoded together.
STRETCH = 1 << 14
# A space between two visible characters.
_GAP = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
_VISIBLE = re.compile(r"[!-~\w]")
_NONE = np.empty(0, dtype=np.int64)
_COUNTED = ("a", "b", "group", "link")
_ITEMS = ("a", "b", "cuts_a", "cuts_b", "link")


def align(
    documents: DataFrame, folder: str = FOLDER, byte_level: str = BYTE_LEVEL, pieces: str = PIECES,
    id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The tokens of every text by both tokenizers and the groups they form.

    Returns one row per input row: the id, ``a`` and ``b`` (token ids), ``a_cuts`` and
    ``b_cuts`` (how many tokens of each side the groups up to here hold).  Special tokens
    are neither added nor recognised.  A text that is null, empty or does not come back
    byte by byte from both sides has empty lists.
    """
    spark, names = documents.sparkSession, ["a", "b", "a_cuts", "b_cuts"]
    files = _files(folder, byte_level, pieces)
    key = documents.select(F.col(id)).schema[0].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = TokenizerPair(*files)
        for batch in batches:
            found = [pair.lists(r) for r in pair.rows(batch.column("text").to_pylist())]
            lists = [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in range(4)]
            yield pa.record_batch([batch.column("id"), *lists], ["id", *names])

    schema = StructType([StructField("id", key)])
    for name in names:
        schema = schema.add(name, ArrayType(IntegerType()))
    made = documents.select(F.col(id).alias("id"), F.col(text).alias("text"))
    with bounded(spark):
        return write_once(made.mapInArrow(rows, schema), "aligned").withColumnRenamed("id", id)


def link_counts(
    documents: DataFrame, folder: str = FOLDER, byte_level: str = BYTE_LEVEL, pieces: str = PIECES,
    id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """How the links of every text between the two tokenizers rank among those of all texts.

    A link is a pair of token occurrences whose byte ranges overlap; the count of a pair of
    ids is the number of rows that hold it linked.  Returns one row per input row: the id,
    ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair has the highest
    count of its first id, ties included), ``count_sum`` (of the counts of all links) and
    ``groups_sha256`` (hex digest of the groups ``a1,a2|b1;a3|b2,b3``, '' without tokens).

    Texts that are null, empty or do not come back byte by byte from both tokenizers have no
    tokens: zeros.  Repeated rows and null ids stay, each row counts.  Other columns are not
    read.  An empty table gives an empty table.

    Rows are read once.  A task gathers its documents in blocks; a block names each of its
    pairs once, with the number of its rows that hold it, and its documents refer to them by
    place.  Only distinct pairs of blocks are added up and sent back.
    """
    spark = documents.sparkSession
    key = documents.select(F.col(id)).schema[0].dataType
    counted = ["n_a", "n_b", "n_groups", "n_links"]
    packed = StructType([
        StructField("block", LongType()), StructField("whole", BooleanType()), StructField("id", key),
        *[StructField(c, LongType()) for c in counted], StructField("groups_sha256", StringType()),
        StructField("links", BinaryType()), StructField("times", BinaryType()),
    ])
    rows = documents.select(F.col(id).alias("id"), F.col(text).alias("text"))
    # The vocabularies: two files of fixed size.
    files = spark.sparkContext.broadcast(_files(folder, byte_level, pieces))
    arrow_key, limit = _arrow_type(rows), BLOCK_LINKS
    with bounded(spark):
        made = rows.mapInArrow(lambda batches: _packed(batches, files.value, arrow_key, limit), packed)
        packs = write_once(made, "packs")
    files.unpersist()

    asked = packs.filter("whole").select("block", "links", "times").mapInArrow(
        _unpacked, "block long, pair long, n long"
    )
    counts = asked.groupBy("pair").agg(F.sum("n").alias("n"))
    counts = write_once(counts.withColumn("first", F.shiftright("pair", 32)), "pairs")
    # At most a row per id of the first vocabulary.
    most = counts.groupBy("first").agg(F.max("n").alias("most"))
    ranked = write_once(counts.join(most, "first").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "ranked")
    replies = asked.select("block", "pair").join(ranked, "pair")

    held = packs.filter("not whole").drop("whole")
    result = StructType([
        packed["id"], *[packed[c] for c in counted], StructField("n_best", LongType()),
        StructField("count_sum", LongType()), packed["groups_sha256"],
    ])
    found = held.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_summed, result)
    return found.withColumnRenamed("id", id)


def _files(folder: str, byte_level: str, pieces: str) -> tuple[str, bytes]:
    with open(f"{folder}/{byte_level}", encoding="utf-8") as a, open(f"{folder}/{pieces}", "rb") as b:
        return a.read(), b.read()


def _arrow_type(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["id"].dataType)


def cut_groups(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of either side lie before each offset at which tokens of both end."""
    at_a = dict(zip(ends_a, range(1, len(ends_a) + 1)))
    at_b = dict(zip(ends_b, range(1, len(ends_b) + 1)))
    shared = sorted(at_a.keys() & at_b.keys())
    pick = lambda at: np.fromiter(map(at.__getitem__, shared), np.int64, len(shared))
    return pick(at_a), pick(at_b)


def links_of(ends_a: np.ndarray, ends_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens that overlap, all slices expanded at once.

    A slice with one token on a side links it to all of the other side; in the others
    every end of either side closes one overlap.
    """
    n_a, n_b = np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
    places = []
    for many, single, start, first in ((n_b, n_a == 1, cuts_b - n_b, cuts_a - n_a), (n_a, (n_b == 1) & (n_a > 1), cuts_a - n_a, cuts_b - n_b)):
        n = many[single]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        places.append((np.repeat(first[single], n), np.repeat(start[single], n) + inner))
    left = [places[0][0], places[1][1]]
    right = [places[0][1], places[1][0]]
    crossed = (n_a > 1) & (n_b > 1)
    if crossed.any():
        in_a, in_b = np.repeat(crossed, n_a), np.repeat(crossed, n_b)
        ends = np.union1d(ends_a[in_a], ends_b[in_b])
        left.append(np.searchsorted(ends_a, ends))
        right.append(np.searchsorted(ends_b, ends))
    return np.concatenate(left), np.concatenate(right)


def _runs(offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the items of the given rows, one run after another."""
    n = offsets[rows + 1] - offsets[rows]
    return np.repeat(offsets[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())


class TokenizerPair:
    """Both tokenizers of a task, and the words it has aligned so far.

    Texts are cut into words at gaps, where both tokenizers begin a token whatever stands
    around; a word is aligned once and found again by its number.  Words beyond ``WORDS`` or
    ``CHARACTERS`` in all are forgotten between batches.
    """

    def __init__(self, byte_level: str, pieces: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_str(byte_level)
        self._a.encode_special_tokens = True
        self._b = SentencePieceProcessor(model_proto=pieces)
        vocabulary = _byte_level_tokens(self._a.get_vocab(with_added_tokens=False))
        self._bytes_a = [vocabulary.get(i, b"") for i in range(self._a.get_vocab_size())]
        names = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self._bytes_b = [
            bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)
        ]
        self._sizes_a = np.array([len(t) for t in self._bytes_a])
        self._sizes_b = np.array([len(t) for t in self._bytes_b])
        # Names of ids with what follows them: another of the side, or the end of the side in the group.
        self._names_a = np.array([f"{i}{mark}" for mark in ",|" for i in range(len(self._bytes_a))], dtype=object)
        self._names_b = np.array([f"{i}{mark}" for mark in ",;" for i in range(len(self._bytes_b))], dtype=object)
        # Gaps part words if the first tokenizer splits by its usual pattern and no piece of the second
        # goes on after a space within it; else a text is one word.
        spec = json.loads(byte_level)
        before = spec.get("pre_tokenizer") or {}
        self._separable = (
            spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space") and not any("▁" in p.lstrip("▁") for p in names)
        )
        self._forget()

    def _forget(self) -> None:
        self._known: defaultdict[str, int] = defaultdict()
        # A new word gets the next number.
        self._known.default_factory = self._known.__len__
        self._characters = 0
        self._names = np.empty(0, dtype=object)
        self._good = np.empty(0, dtype=bool)
        self._items = {k: np.empty(0, dtype=np.int64) for k in _ITEMS}
        self._ends = {k: np.zeros(1, dtype=np.int64) for k in _COUNTED}

    def rows(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The numbers of the words of each text; None without tokens: empty, or its bytes do not come back."""
        if len(self._known) > WORDS or self._characters > CHARACTERS:
            self._forget()
        learned, number = len(self._known), self._known.__getitem__
        found = []
        for text in texts:
            parts = (_GAP.split(text) if self._separable else [text]) if text else []
            found.append(np.fromiter(map(number, parts), np.int64, len(parts)))
        self._learn(list(islice(self._known, learned, None)))
        return [row if len(row) and self._good[row].all() else None for row in found]

    def count(self, rows: np.ndarray, kind: str) -> int:
        """How many ``a`` or ``b`` tokens, groups or links the words hold."""
        ends = self._ends[kind]
        return int((ends[rows + 1] - ends[rows]).sum())

    def links(self, rows: np.ndarray) -> np.ndarray:
        return self._items["link"][_runs(self._ends["link"], rows)]

    def groups(self, rows: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
        return ";".join(self._names[rows].tolist())

    def lists(self, rows: np.ndarray | None) -> list[np.ndarray]:
        """Ids of both sides, and how many of them the groups up to each hold."""
        if rows is None:
            return [np.empty(0, dtype=np.int64)] * 4
        groups = self._ends["group"][rows + 1] - self._ends["group"][rows]
        out = [self._items[k][_runs(self._ends[k], rows)] for k in ("a", "b")]
        for side, cuts in (("a", "cuts_a"), ("b", "cuts_b")):
            n = self._ends[side][rows + 1] - self._ends[side][rows]
            out.append(self._items[cuts][_runs(self._ends["group"], rows)] + np.repeat(np.cumsum(n) - n, groups))
        return out

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        self._characters += sum(map(len, words))
        found = [part for stretch in _stretches(words) for part in self._aligned(stretch)]
        for k in _ITEMS:
            self._items[k] = np.concatenate([self._items[k], *[f[k] for f in found]])
        for k in _COUNTED:
            counts = np.concatenate([f["n_" + k] for f in found])
            self._ends[k] = np.concatenate([self._ends[k], self._ends[k][-1] + np.cumsum(counts)])
        names = np.empty(len(words), dtype=object)
        names[:] = [name for f in found for name in f["names"]]
        self._names = np.concatenate([self._names, names])
        self._good = np.concatenate([self._good, *[f["good"] for f in found]])

    def _aligned(self, words: list[str]) -> Iterator[dict]:
        """The words of a stretch, side by side in one text; alone where its bytes do not come back."""
        text = " ".join(words)
        a = self._a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b, whole = self._b.encode(text), b" " + text.encode()
        if any(b"".join(map(side.__getitem__, ids)) != whole for side, ids in ((self._bytes_a, a), (self._bytes_b, b))):
            if len(words) == 1:
                yield {k: np.empty(0, dtype=np.int64) for k in _ITEMS} | {"n_" + k: np.zeros(1, dtype=np.int64) for k in _COUNTED} | {
                    "names": [""], "good": np.array([False])}
                return
            for part in (words[: len(words) // 2], words[len(words) // 2 :]):
                yield from self._aligned(part)
            return
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        ends_a, ends_b = np.cumsum(self._sizes_a[a]), np.cumsum(self._sizes_b[b])
        cuts_a, cuts_b = cut_groups(ends_a.tolist(), ends_b.tolist())
        # Every word ends where tokens of both end.
        stops = np.cumsum([len(w.encode()) + 1 for w in words])
        of_group = np.searchsorted(stops, ends_a[cuts_a - 1])
        last = np.searchsorted(of_group, np.arange(len(words)), side="right") - 1
        stop_a, stop_b = cuts_a[last], cuts_b[last]
        i, j = links_of(ends_a, ends_b, cuts_a, cuts_b)
        word = np.searchsorted(stop_a, i, side="right")
        order = np.argsort(word, kind="stable")
        n_a, n_b, n_groups = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0), np.diff(last, prepend=-1)
        named = self._named(a, b, cuts_a, cuts_b).tolist()
        both = (stop_a + stop_b).tolist()
        yield {
            "a": a, "b": b, "link": (a[i] << 32 | b[j])[order],
            "cuts_a": cuts_a - np.repeat(stop_a - n_a, n_groups), "cuts_b": cuts_b - np.repeat(stop_b - n_b, n_groups),
            "n_a": n_a, "n_b": n_b, "n_group": n_groups, "n_link": np.bincount(word, minlength=len(words)),
            "names": ["".join(named[x:y])[:-1] for x, y in zip([0, *both], both)], "good": np.ones(len(words), dtype=bool),
        }

    def _named(self, a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> np.ndarray:
        """The ids in the order of the groups' names, with the marks between them."""
        n_a, n_b = np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
        names = np.empty(len(a) + len(b), dtype=object)
        last_a, last_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        last_a[cuts_a - 1], last_b[cuts_b - 1] = len(self._bytes_a), len(self._bytes_b)
        names[np.arange(len(a)) + np.repeat(cuts_b - n_b, n_a)] = self._names_a[a + last_a]
        names[np.arange(len(b)) + np.repeat(cuts_a, n_b)] = self._names_b[b + last_b]
        return names


def _stretches(words: list[str]) -> Iterator[list[str]]:
    """Words that may stand side by side with gaps between them, some STRETCH characters at a time."""
    held, size = [], 0
    for word in words:
        if not _VISIBLE.match(word[0]) or not _VISIBLE.match(word[-1]):
            # Beside such an end there is no gap.
            if held:
                yield held
            yield [word]
            held, size = [], 0
            continue
        held.append(word)
        size += len(word)
        if size >= STRETCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def _byte_level_tokens(vocabulary: dict[str, int]) -> dict[int, bytes]:
    """Bytes of each id: visible bytes stand for themselves, the others for characters from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    return {i: bytes(byte[c] for c in token) for token, i in vocabulary.items() if all(c in byte for c in token)}


def _packed(
    batches: Iterator[pa.RecordBatch], files: tuple[str, bytes], key: pa.DataType, limit: int
) -> Iterator[pa.RecordBatch]:
    """Rows of documents and of the blocks they are gathered in."""
    pair = TokenizerPair(*files)
    number, rows, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for id, found in zip(batch.column("id").to_pylist(), pair.rows(batch.column("text").to_pylist())):
            found, sha = (_NONE, "") if found is None else (found, hashlib.sha256(pair.groups(found).encode()).hexdigest())
            links, times = np.unique(pair.links(found), return_counts=True)
            rows.append((id, *(pair.count(found, k) for k in _COUNTED), sha, links, times))
            size += len(links) + 64
            if size >= limit:
                yield _block(number, rows, key)
                number, rows, size = number + 1, [], 0
    if rows:
        yield _block(number, rows, key)


def _block(number: int, rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    every, place, n = np.unique(np.concatenate([r[6] for r in rows]), return_inverse=True, return_counts=True)
    ends = np.cumsum([len(r[6]) for r in rows])
    places = np.split(place.astype("<i4"), ends[:-1])
    more = [[r[k] for r in rows] + [None] for k in range(6)]
    return pa.record_batch([
        pa.array([number] * (len(rows) + 1)), pa.array([False] * len(rows) + [True]), pa.array(more[0], key),
        *[pa.array(m, pa.int64()) for m in more[1:5]], pa.array(more[5], pa.string()),
        pa.array([p.tobytes() for p in places] + [every.tobytes()], pa.binary()),
        pa.array([r[7].astype("<i4").tobytes() for r in rows] + [n.astype("<i8").tobytes()], pa.binary()),
    ], ["block", "whole", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "times"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each pair of a block."""
    for batch in batches:
        for block, links, times in zip(*(batch.column(c) for c in ("block", "links", "times"))):
            pairs = np.frombuffer(links.as_buffer(), dtype=np.int64)
            if len(pairs):
                n = np.frombuffer(times.as_buffer(), dtype="<i8")
                yield pa.record_batch([pa.array(np.full(len(pairs), block.as_py())), pa.array(pairs), pa.array(n)], ["block", "pair", "n"])


def _summed(held: pa.Table, replies: pa.Table) -> pa.Table:
    """Documents of a block with the counts of their links, which they name by place."""
    order = np.argsort(replies.column("pair").to_numpy())
    n, best = replies.column("n").to_numpy()[order], replies.column("best").to_numpy(zero_copy_only=False)[order]
    n_best, total = [], []
    for links, times in zip(held.column("links"), held.column("times")):
        at = np.frombuffer(links.as_buffer(), dtype="<i4")
        times = np.frombuffer(times.as_buffer(), dtype="<i4").astype(np.int64)
        n_best.append(int(times[best[at].astype(bool)].sum()))
        total.append(int((times * n[at]).sum()))
    names = ["id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table(
        [*[held.column(c) for c in names], pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), held.column("groups_sha256")],
        [*names, "n_best", "count_sum", "groups_sha256"],
    )

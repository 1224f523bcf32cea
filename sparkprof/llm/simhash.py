"""Near-duplicates by SimHash: a self-join of binary tries under a Hamming budget."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprof.columns import qcol
from sparkprof.llm import shingles
from sparkprof.llm.batches import bounded
from sparkprof.llm.graph import components, local_roots
from sparkprof.scratch import write_once

# Fingerprints that one unit of the join holds on either side, on average.
UNIT_ROWS = 1024
# Candidate pairs of the units that are traversed together.
PAIRS_AT_ONCE = 1_000_000
_SHINGLES_AT_ONCE = 65_536
# Bytes of texts that a task hands to Python at once.
_BATCH = 1 << 21


def near_duplicates(
    documents: DataFrame, words: int = 4, distance: int = 4, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Groups documents whose fingerprints are linked, directly or through others.

    Two fingerprints are linked if at most ``distance`` of their 64 bits differ.
    Returns one row per input row: the id, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id of the group (null if all its ids are null).

    A text of fewer than ``words`` words is one shingle; null, empty and blank texts
    have fingerprint zero and form one group like any other.  Repeated rows stay.
    Other columns are not read.  An empty table gives an empty table.
    """
    prints = documents.select(
        F.col(id).alias("id"), fingerprint(F.col(text), words).alias("fp")
    )
    prints = write_once(prints, "fingerprints")
    classes = write_once(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = components(links(classes, distance)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        F.col("id").alias(id),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def fingerprint(text: Column, words: int) -> Column:
    """The SimHash of a text as a long; ``words`` words make a shingle."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([text_fingerprint(t, words) for t in texts], dtype="int64")

    return of(text)


def text_fingerprint(text: str | None, words: int) -> int:
    """Signed 64-bit fingerprint; ASCII white space separates words, A-Z are lowered."""
    return hashes_fingerprint(shingles.hashes(text, words))


def hashes_fingerprint(hashes: np.ndarray) -> int:
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _SHINGLES_AT_ONCE):
        piece = hashes[at : at + _SHINGLES_AT_ONCE]
        bits = np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_ = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(set_.view("<i8")[0])


def links(classes: DataFrame, distance: int) -> DataFrame:
    """Links ``a, b`` that connect the same fingerprints ``fp`` as all close pairs do.

    The bits are cut into ``distance + 2`` blocks, of which a close pair must share
    two.  For each choice of two blocks there is a trie whose top levels are these
    blocks; below them a traversal of node pairs counts differing bits.  A unit of work
    is the subtree under one value of the top levels.  Subtrees of many fingerprints
    are split into parts that meet pairwise, so that no unit is large.  What a unit
    finds leaves it as a star for each local component, not as all pairs.
    """
    blocks = _blocks(distance + 2)
    tries = list(combinations(range(len(blocks)), 2))
    top = [blocks[i][1] + blocks[j][1] for i, j in tries]
    shapes = [_order(blocks, pair) for pair in tries]
    rows = classes.select(
        F.inline(F.array(*[
            F.struct(F.lit(t).cast("byte").alias("trie"), _moved("fp", shape).alias("bits"))
            for t, shape in enumerate(shapes)
        ]))
    )
    keep = F.array(*[F.lit(64 - n) for n in top])
    node = F.call_function("shiftrightunsigned", "bits", keep[F.col("trie").cast("int")])
    rows = rows.withColumn("node", node)
    hot = rows.groupBy("trie", "node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > UNIT_ROWS)
    split = rows.join(hot, ["trie", "node"], "left").select(
        "trie", "node", "bits", F.coalesce(F.ceil(F.col("n") / UNIT_ROWS), F.lit(1)).cast("int").alias("parts")
    )
    part = F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int")
    met = split.withColumn("part", part).select(
        "trie", "node", "bits", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    )
    units = met.select(
        "trie", "node", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        (F.col("part") > F.col("other")).alias("right"), "bits",
    )
    unsigned = F.col("bits").bitwiseXOR(F.lit(-(1 << 63)))
    units = units.repartition("trie", "node", "i", "j").sortWithinPartitions(
        "trie", "node", "i", "j", "right", unsigned
    )
    inverse = [[(to, width, at) for at, width, to in shape] for shape in shapes]

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_units(batches):
            yield _stars(rows, inverse, distance)

    return units.mapInPandas(join, "a long, b long")


def _blocks(count: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of nearly equal blocks."""
    cuts = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _order(blocks: list[tuple[int, int]], first: tuple[int, int]) -> list[tuple[int, int, int]]:
    """(from bit, width, to bit) of each block when ``first`` come on top."""
    order = [*first, *[i for i in range(len(blocks)) if i not in first]]
    at, moves = 64, []
    for i in order:
        at -= blocks[i][1]
        moves.append((*blocks[i], at))
    return moves


def _moved(bits: str, moves: list[tuple[int, int, int]]) -> Column:
    pieces = (
        f"shiftleft(shiftrightunsigned({bits}, {at}) & {(1 << width) - 1}L, {to})"
        for at, width, to in moves
    )
    return F.expr(" | ".join(pieces))


def _whole_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows again, cut only between units and by the pairs they may hold."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= 8 * UNIT_ROWS:
            rows = pd.concat(held, ignore_index=True)
            last = int(_unit_starts(rows)[-1])
            yield from _by_pairs(rows[:last].reset_index(drop=True))
            held = [rows[last:]]
    if held:
        yield from _by_pairs(pd.concat(held, ignore_index=True))


def _unit_starts(rows: pd.DataFrame) -> np.ndarray:
    keys = rows[["trie", "node", "i", "j"]].to_numpy(dtype=np.int64)
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    return np.flatnonzero(new)


def _by_pairs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    if rows.empty:
        return
    starts = _unit_starts(rows)
    sizes = np.diff(np.append(starts, len(rows)))
    chunk = np.cumsum(sizes.astype(np.int64) ** 2) // PAIRS_AT_ONCE
    cuts = starts[np.flatnonzero(np.diff(chunk, prepend=-1))]
    for a, b in zip(cuts, np.append(cuts[1:], len(rows))):
        yield rows[a:b].reset_index(drop=True)


def _stars(rows: pd.DataFrame, inverse: list, distance: int) -> pd.DataFrame:
    bits = rows["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    starts = _unit_starts(rows)
    left, right = close_pairs(bits, starts, rows["right"].to_numpy(dtype=bool), distance)
    trie = rows["trie"].to_numpy()
    fps, ends = np.unique(
        np.concatenate([_original(bits[x], trie[x], inverse) for x in (left, right)]).view(np.int64),
        return_inverse=True,
    )
    root = local_roots(len(fps), ends[: len(left)], ends[len(left) :])
    away = root != np.arange(len(fps))
    return pd.DataFrame({"a": fps[away], "b": fps[root[away]]})


def _original(bits: np.ndarray, trie: np.ndarray, inverse: list) -> np.ndarray:
    out = np.zeros(len(bits), dtype=np.uint64)
    for t in np.unique(trie):
        these = trie == t
        for at, width, to in inverse[t]:
            piece = (bits[these] >> np.uint64(at)) & np.uint64((1 << width) - 1)
            out[these] |= piece << np.uint64(to)
    return out


def close_pairs(
    bits: np.ndarray, starts: np.ndarray, right: np.ndarray, distance: int
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints within ``distance`` bits, found by tries.

    ``bits`` is sorted within each unit, and within its left and right side if it
    has two.  A node of a (path-compressed) trie is a range of the sorted order.  All
    units go down together; a node pair carries the bits in which the prefixes that
    its nodes have in common differ, and is dropped once they exceed the budget.
    """
    ends = np.append(starts[1:], len(bits))
    crossing = np.add.reduceat(right.astype(np.int64), starts) > 0
    middle = ends - np.where(crossing, np.add.reduceat(right.astype(np.int64), starts), 0)
    # Units whose rows are all on one side have no pair to give.
    useful = np.where(crossing, middle > starts, ends - starts > 1)
    a_lo, a_hi = starts[useful], np.where(crossing, middle, ends)[useful]
    b_lo, b_hi = np.where(crossing, middle, starts)[useful], ends[useful]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(a_lo):
        same = a_lo == b_lo
        a_depth, b_depth = _depth(bits, a_lo, a_hi), _depth(bits, b_lo, b_hi)
        shared = np.minimum(a_depth, b_depth)
        # Bits below the shared prefix do not count yet.
        differ = np.where(shared > 0, (bits[a_lo] ^ bits[b_lo]) >> (64 - np.maximum(shared, 1)).astype(np.uint64), 0)
        alive = np.bitwise_count(differ) <= distance
        leaf = alive & (shared == 64) & ~same
        found.append((a_lo[leaf], b_lo[leaf]))
        # The node that branches higher up is opened; a node paired with itself opens both.
        alive &= shared < 64
        open_a = alive & ~same & (a_depth <= b_depth)
        open_b = alive & ~same & (a_depth > b_depth)
        both = alive & same
        parts = []
        for which, lo, hi, depth in ((open_a, a_lo, a_hi, a_depth), (open_b, b_lo, b_hi, b_depth)):
            lo, hi = lo[which], hi[which]
            cut = _branch(bits, lo, hi, depth[which])
            o_lo, o_hi = ((b_lo, b_hi) if which is open_a else (a_lo, a_hi))
            o_lo, o_hi = o_lo[which], o_hi[which]
            parts += [(lo, cut, o_lo, o_hi), (cut, hi, o_lo, o_hi)]
        lo, hi = a_lo[both], a_hi[both]
        cut = _branch(bits, lo, hi, a_depth[both])
        parts += [(lo, cut, lo, cut), (cut, hi, cut, hi), (lo, cut, cut, hi)]
        a_lo, a_hi, b_lo, b_hi = (np.concatenate([p[k] for p in parts]) for k in range(4))
        # A single fingerprint has no pair with itself.
        real = (a_lo != b_lo) | (a_hi - a_lo > 1)
        a_lo, a_hi, b_lo, b_hi = a_lo[real], a_hi[real], b_lo[real], b_hi[real]
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return tuple(np.concatenate([f[k] for f in found]) for k in range(2))


def _depth(bits: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Length of the prefix that all fingerprints of a range share."""
    x = bits[lo] ^ bits[hi - 1]
    for shift in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(shift)
    return 64 - np.bitwise_count(x).astype(np.int64)


def _branch(bits: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Where the second child of a node begins, by binary search."""
    shift = (63 - depth).astype(np.uint64)
    lo, hi = lo.copy(), hi.copy() - 1
    while (lo < hi).any():
        mid = (lo + hi) // 2
        one = (bits[mid] >> shift) & np.uint64(1) == 1
        lo, hi = np.where(one, lo, np.minimum(mid + 1, hi)), np.where(one, mid, hi)
    return lo


def deduplicated(
    documents: DataFrame, words: int = 5, distance: int = 6, id: str = "doc_id", text: str = "text",
    similarity: float = 0.8,
) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Two documents are linked if the Jaccard similarity of their sets of shingles is
    ``similarity`` or more.  Pairs whose fingerprints differ in at most ``distance`` bits and
    pairs that share a MinHash band are compared, on the sets themselves; texts without
    words are one group.  Rows that share an id are one document.  A row without an id stays
    only if no other document of its group has one.
    """
    marks = shingles.marks(F.col(text), words, hashes_fingerprint)
    with bounded(documents.sparkSession, _BATCH):
        rows = write_once(documents.select(F.col(id).alias("id"), marks.alias("m")).select("id", "m.*"), "marks")
    classes = rows.groupBy("set").agg(
        F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("bands").alias("bands"), F.min("id").alias("least")
    )
    classes = write_once(classes, "classes")
    near = components(links(classes.filter("n > 0").select("fp").distinct(), distance)).withColumnRenamed("node", "fp")
    pairs = shingles.alike(
        documents, classes.filter("n > 0"), near, words, similarity, distance, id, text
    )
    with bounded(documents.sparkSession, _BATCH):
        roots = components(pairs).withColumnRenamed("node", "set")
    rooted = classes.join(roots, "set", "left").select("set", "least", F.coalesce("root", "set").alias("root"))
    rooted = write_once(rooted, "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    found = write_once(rows.join(named.select("set", "component_id"), "set").select("id", "set", "component_id"), "found")
    # Smaller than what stays, and of a known size: if it is small, texts are not shuffled.
    gone = found.filter(F.col("id") != F.col("component_id")).select(F.col("id").alias(id)).distinct()
    gone = write_once(gone, "copies")
    kept = documents.join(gone, id, "left_anti")
    if documents.filter(F.col(id).isNull()).isEmpty():
        return kept
    set_ = fresh(kept, "set")
    alone = found.filter("id is null and component_id is null").select(F.col("set").alias(set_)).distinct()
    unnamed = kept.filter(F.col(id).isNull()).withColumn(set_, shingles.sets(F.col(text), words)["set"])
    unnamed = unnamed.join(alone, set_, "left_semi").select(*map(qcol, documents.columns))
    return kept.filter(F.col(id).isNotNull()).unionByName(unnamed)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the rows do not have yet."""
    while name in df.columns:
        name += "_"
    return name

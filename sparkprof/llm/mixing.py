"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprof.columns import qcol
from sparkprof.scratch import write_once

# Most often that a document is taken.
REPEATS = 3
# Shards at least, and the words of a shard beyond that.
SHARDS = 64
SHARD_WORDS = 64_000_000
# Shards of a group, in which a block is looked up after the group.
GROUP = 256
# A source has a block for so many documents, but at most 2**LEVEL_BITS blocks.
BLOCK_ROWS = 32
# Bits of the order that each pass over the sizes looks at.
LEVEL_BITS = 10
FINE_BITS = 40
# Documents of a source among which the last ones are chosen one by one.
LEAF_ROWS = 1024
# A plan of up to this many sources is sent to every task.
BROADCAST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Source:
    """What the mix takes of a source: whole passes, then the documents before ``cut``."""

    name: str | None
    weight: float
    rows: int
    size: int
    target: float = 0.0
    passes: int = 0
    rest: float = 0.0
    blocks: int = 1
    cut: int = 0
    width: int = 0
    quota: int = 0


def mix(documents: DataFrame, text: str = "text", source: str = "source", id: str = "doc_id", **options) -> DataFrame:
    """The mixed corpus: a row for each time a document is taken, dealt to shards.

    Adds ``mix_copy`` (0, 1, 2), ``mix_shard`` and ``mix_place``; rows of a shard lie in
    one partition in the order of their place.  See ``draws`` for what is taken.
    """
    drawn = draws(documents, text, source, id, **options)
    return (
        drawn.select(*_kept(documents), F.inline("mix_draws"))
        .repartition("mix_shard")
        .sortWithinPartitions("mix_shard", "mix_place")
    )


def draws(
    documents: DataFrame, text: str = "text", source: str = "source", id: str = "doc_id",
    weights: tuple[float, ...] = (1, 2, 3), shards: int | None = None, seed: int = 17,
) -> DataFrame:
    """Adds ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_draws`` to each document.

    The size is the number of words (null: 0).  Sources in code point order, null last,
    weigh ``weights`` in turn and share the size of the whole corpus; a target stops at
    REPEATS times its source's size, and the excess is shared anew by weight.  A source is
    taken in whole passes over its permuted blocks of documents and a last pass that ends
    when the target is reached; near the end documents that no longer fit are skipped.

    The blocks that each source gives are its quota; a binary tree over the shards splits
    the quotas by multivariate hypergeometric draws, and each shard takes its number of
    the source's next blocks.  Without ``shards`` there are as many as the words fill, SHARDS
    at least.  ``mix_draws`` is an array of ``mix_copy``, ``mix_shard`` and
    ``mix_place`` (a random order within the shard), empty if the document is not taken.

    All choices come from hashes of id and size and from the seed: reruns agree, and equal
    rows are taken alike.  The driver holds a row for each source.  An empty table gives an
    empty table; other columns pass through, but for those named ``mix_...``.
    """
    documents = documents.select(*_kept(documents))
    sized = documents.select(_sizes(text, source, id, seed))
    sized = write_once(sized.select("s.*"), "sizes")
    plan = _plan(sized, weights, shards, seed)
    rows = documents.withColumn("mix_s", _sizes(text, source, id, seed))
    rows = rows.withColumn("mix_k", F.col("mix_s.mix_source"))
    joined = rows.join(plan.withColumnRenamed("mix_source", "mix_k"), "mix_k")
    return joined.select(
        *_kept(documents), F.col("mix_s.size").alias("mix_size"),
        F.col("mix_p.size").alias("mix_source_size"), F.col("mix_p.target").alias("mix_target"),
        _drawn(F.col("mix_s.key"), F.col("mix_p")).alias("mix_draws"),
    )


def _kept(documents: DataFrame) -> list[Column]:
    return [qcol(c) for c in documents.columns if not c.startswith("mix_")]


def _sizes(text: str, source: str, id: str, seed: int) -> Column:
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return F.struct(
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null")).alias("mix_source"),
        size.alias("size"), F.xxhash64(F.col(id), size, F.lit(seed)).alias("key"),
    ).alias("s")


def _drawn(key: Column, plan: Column) -> Column:
    """The draws of a document whose hash is ``key``.

    An odd factor and a shift permute the blocks of a pass, a power of two of them.
    """
    block = key.bitwiseAND(plan["blocks"] - 1)
    fine = F.shiftrightunsigned(key, 64 - FINE_BITS)

    def one(copy: Column) -> Column:
        rank = (block * plan["factors"][copy] + plan["shifts"][copy]).bitwiseAND(plan["blocks"] - 1)
        place = copy * plan["blocks"] + rank
        in_last = F.shiftleft(rank, FINE_BITS).bitwiseOR(fine) < plan["cut"]
        taken = (copy < plan["passes"]) | in_last | F.array_contains(plan["extra"], key)
        passed = lambda ends: F.size(F.filter(ends, lambda end: end <= place))
        before = passed(plan["groups"]) * GROUP
        shard = before + passed(F.slice(plan["ends"], before + 1, F.lit(GROUP)))
        return F.when(taken, F.struct(
            copy.alias("mix_copy"), shard.alias("mix_shard"), F.xxhash64(key, copy).alias("mix_place")
        ))

    copies = F.transform(F.sequence(F.lit(0), F.least(plan["passes"], F.lit(REPEATS - 1))), one)
    return F.filter(copies, lambda d: d.isNotNull())


def targets(sources: list[Source]) -> None:
    """Shares the whole size by weight; nobody gets over REPEATS times its size."""
    left, open_ = float(sum(s.size for s in sources)), list(sources)
    while open_:
        unit = left / sum(s.weight for s in open_)
        over = [s for s in open_ if s.weight * unit > REPEATS * s.size]
        for s in over or open_:
            s.target = float(REPEATS * s.size) if over else s.weight * unit
        left -= sum(s.target for s in over)
        open_ = [s for s in open_ if s not in over] if over else []


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """The blocks of every source (columns) for every shard (rows), all blocks dealt."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def down(first: int, last: int, held: np.ndarray) -> None:
        if last - first == 1:
            out[first] = held
            return
        middle = (first + last) // 2
        random = np.random.default_rng([seed, first, last])
        room = int(held.sum()) * (middle - first) // (last - first)
        left = random.multivariate_hypergeometric(held, room, method="marginals")
        down(first, middle, left)
        down(middle, last, held - left)

    down(0, shards, np.asarray(quotas, dtype=np.int64))
    return out


def _plan(sized: DataFrame, weights: tuple[float, ...], shards: int | None, seed: int) -> DataFrame:
    """A row for each source: ``mix_source`` and a struct ``mix_p``."""
    spark = sized.sparkSession
    found = sized.groupBy("mix_source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()
    # Code points order as UTF-8 does; "=..." comes before "null".
    found.sort(key=lambda r: r["mix_source"].encode())
    sources = [
        Source(r["mix_source"], weights[i % len(weights)], r["n"], r["size"]) for i, r in enumerate(found)
    ]
    targets(sources)
    shards = shards or max(SHARDS, -(-sum(s.size for s in sources) // SHARD_WORDS))
    random = np.random.default_rng(seed)
    factors = random.integers(0, 1 << LEVEL_BITS, (len(sources), REPEATS)) | 1
    shifts = random.integers(0, 1 << LEVEL_BITS, (len(sources), REPEATS))
    for s in sources:
        s.passes = min(REPEATS, int(s.target // s.size)) if s.size else 0
        s.rest = s.target - s.passes * s.size
        s.blocks = 1 << min(LEVEL_BITS, max(0, (s.rows // BLOCK_ROWS).bit_length() - 1))
        s.width = s.blocks << FINE_BITS if s.passes < REPEATS and s.rest > 0 else 0
    extra = _last_pass(sized, sources, factors, shifts)
    for s in sources:
        part = s.cut & ((1 << FINE_BITS) - 1) or extra.get(s.name)
        s.quota = s.passes * s.blocks + (s.cut >> FINE_BITS) + bool(part)
    dealt = split(np.array([s.quota for s in sources]), shards, seed).cumsum(axis=0) if sources else None
    rows = [
        (s.name, (s.size, s.target, s.passes, s.blocks, s.cut, factors[i].tolist(), shifts[i].tolist(),
                  dealt[:-1, i].tolist(), dealt[GROUP - 1 : -1 : GROUP, i].tolist(), extra.get(s.name, [])))
        for i, s in enumerate(sources)
    ]
    return _small(spark.createDataFrame(rows, _PLAN), len(rows))


def _small(plan: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(plan) if rows <= BROADCAST_SOURCES else plan


_PLAN = (
    "mix_source string, mix_p struct<size: bigint, target: double, passes: int, blocks: bigint, cut: bigint, "
    "factors: array<bigint>, shifts: array<bigint>, ends: array<bigint>, groups: array<bigint>, extra: array<bigint>>"
)


def _last_pass(
    sized: DataFrame, sources: list[Source], factors: np.ndarray, shifts: np.ndarray
) -> dict[str, list[int]]:
    """Finds where the last pass over each source ends, and who is taken beyond that.

    The order is narrowed by LEVEL_BITS at a time to the range in which the target is
    reached, until it holds few documents; among them those that fit are taken in turn.
    """
    at = {s.name: i for i, s in enumerate(sources)}
    open_ = [s for s in sources if s.width]
    level = FINE_BITS
    extra: dict[str, list[int]] = {}
    while open_:
        inside = _inside(sized, open_, factors, shifts, at)
        bins = inside.groupBy("mix_source", "rest", F.shiftright("place", level).alias("bin")).agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")
        )
        before = Window.partitionBy("mix_source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
        ends = bins.filter("before <= rest and before + size > rest").collect()
        ended = {r["mix_source"]: r for r in ends}
        leaf = []
        for s in open_:
            row = ended.get(s.name)
            if row is None:
                # The range holds less than the rest: all of it is taken.
                s.cut, s.width = s.cut + s.width, 0
                continue
            s.cut, s.width, s.rest = row["bin"] << level, 1 << level, s.rest - row["before"]
            if row["n"] <= LEAF_ROWS or level == 0:
                leaf.append(s)
        if leaf:
            extra |= _fitting(sized, leaf, factors, shifts, at)
        done = {s.name for s in leaf}
        open_ = [s for s in open_ if s.width and s.name not in done]
        level = max(0, level - LEVEL_BITS)
    return extra


def _inside(
    sized: DataFrame, sources: list[Source], factors: np.ndarray, shifts: np.ndarray, at: dict[str, int]
) -> DataFrame:
    """The documents in the range of their source, with their ``place`` in the last pass."""
    rows = [
        (s.name, s.rest, s.blocks, int(factors[at[s.name], s.passes]), int(shifts[at[s.name], s.passes]),
         s.cut, s.cut + s.width)
        for s in sources
    ]
    now = sized.sparkSession.createDataFrame(
        rows, "mix_source string, rest double, blocks bigint, f bigint, s bigint, lo bigint, hi bigint"
    )
    rank = F.expr("((key & (blocks - 1)) * f + s) & (blocks - 1)")
    place = F.shiftleft(rank, FINE_BITS).bitwiseOR(F.shiftrightunsigned("key", 64 - FINE_BITS))
    inside = sized.join(_small(now, len(rows)), "mix_source").withColumn("place", place)
    return inside.filter("place >= lo and place < hi")


def _fitting(
    sized: DataFrame, sources: list[Source], factors: np.ndarray, shifts: np.ndarray, at: dict[str, int]
) -> dict[str, list[int]]:
    """Of the documents in the last range of each source, those that fit, in their order."""
    inside = _inside(sized, sources, factors, shifts, at)
    # Equal rows are taken together.
    keys = inside.groupBy("mix_source", "key", "place", "rest").agg(F.sum("size").alias("size"))

    def take(rows):
        rows = rows.sort_values(["place", "key"])
        left, taken = float(rows["rest"].iloc[0]), []
        for size in rows["size"]:
            taken.append(size <= left)
            left -= size * taken[-1]
        return rows.loc[taken, ["mix_source", "key"]]

    chosen = keys.groupBy("mix_source").applyInPandas(take, "mix_source string, key long").collect()
    extra: dict[str, list[int]] = {s.name: [] for s in sources}
    for row in chosen:
        extra[row["mix_source"]].append(row["key"])
    return extra

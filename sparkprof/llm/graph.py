"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprof.scratch import write_once

# Links that one task joins by itself; more go through rounds of stars.
AT_ONCE = 100_000


def components(edges: DataFrame) -> DataFrame:
    """Returns ``node, root`` (the smallest node reachable) for every node of ``a, b``.

    Large-star and small-star steps by turns: each step hangs neighbours on the
    smallest node they know of, so paths shrink geometrically.  Minima are combined
    before the shuffle, and the joins with them may be split where a node is hot.
    Every round is written to the shared folder; only a count and a checksum reach
    the driver.  A graph of up to ``AT_ONCE`` links needs no rounds, each of which costs
    the driver three plans: one task joins it.  Rows with a null end and self links are
    left out.  An empty table gives an empty table.
    """
    a, b = F.col("a"), F.col("b")
    links = edges.filter(a.isNotNull() & b.isNotNull() & (a != b))
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    links, before = _kept(links)
    while before[0] > AT_ONCE:
        # A small step reads the large one's links three times.
        links, now = _kept(_small_star(write_once(_large_star(links), "links")))
        if now == before:
            break
        before = now
    if before[0] <= AT_ONCE:
        kind = links.schema["a"].dataType.simpleString()
        return write_once(links.coalesce(1).mapInPandas(_joined, f"node {kind}, root {kind}"), "roots")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return write_once(links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), "roots")


def _kept(links: DataFrame) -> tuple[DataFrame, tuple]:
    written = write_once(links, "links")
    check = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return written, tuple(written.agg(F.count(F.lit(1)), check).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked to the smallest node it knows of."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low"))
    low = low.select("a", F.least("a", "low").alias("low"))
    return (
        both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    low = links.groupBy("a").agg(F.min("b").alias("low"))
    moved = links.join(low, "a").filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The smallest node reachable from each node of a few links."""
    held = [rows[["a", "b"]].to_numpy() for rows in batches]
    if held:
        names, ends = np.unique(np.concatenate(held), return_inverse=True)
        a, b = ends.reshape(-1, 2).T
        yield pd.DataFrame({"node": names, "root": names[local_roots(len(names), a, b)]})


def local_roots(nodes: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest node connected with each node 0..nodes-1."""
    root = np.arange(nodes)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new

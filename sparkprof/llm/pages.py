"""Main text of web pages by wrappers induced from the pages of each host."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprof.llm import dom
from sparkprof.scratch import write_once

# A block is template if so many different pages of the host have it, and over this share.
PAGES = 3
SHARE = 0.5
# Outside an article, a block with a larger share of its text in links is a menu, if it is no paragraph or heading.
LINKED = 0.5
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
# Without an article, the innermost element with so much of the text holds it.
HELD = 0.9
# Instead of the number of a leaf: a text at its path; a page.
PLACED, EVERY = -1, -2


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``id``, ``url``, ``text`` and ``n_chars`` (code points) of every page.

    The page of a host with the smallest hash of id and url lends its tree; every page of
    the host is aligned with it by simple tree matching.  A leaf that holds the same text
    on most of the host's different pages is template, the others are slots.  A text below the
    same elements on most of all different pages is template too, also where the tree lacks it.  Equal
    pages count once.  A host with few pages has no template.

    Template is dropped, and so are menus, site headers, footers, sidebars, notices,
    adverts, forms, scripts, styles and comments, as told by element, role, or the whole of a class
    or id (not by those of an article or main element; if nothing is left, not by class or id).
    What is left inside articles (or a main element) is the text; on a page without these
    it is what is left below the innermost element that holds nine tenths of the text; blocks that
    are mostly links are menus there, but for paragraphs and headings.  Character references are
    decoded, white space within a block (line breaks too) becomes one space, blocks are
    joined by line feeds.

    Null html gives the empty text; a null url is a host of its own; rows with a null id
    count like others, repeated rows stay.  Other columns are not read.  An empty table
    gives an empty table.
    """
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = rows.withColumn("host", _host(F.col("url")))
    place = F.xxhash64("id", "url")
    # A written table has a known size: if it is small, the pages need not be shuffled.
    first = write_once(rows.groupBy("host").agg(F.min(place).alias("place")), "first")
    models = rows.withColumn("place", place).join(first, ["host", "place"])
    models = models.groupBy("host").agg(F.min(F.coalesce("html", F.lit(""))).alias("html"))
    models = write_once(models.select("host", _shape(F.col("html")).alias("shape")), "models")

    found = rows.join(models, "host").select("host", "html", "shape")
    found = found.mapInPandas(_aligned_leaves, "host string, leaf int, text long, page long")
    # Read three times below; the pages are parsed and aligned for it once.
    texts = write_once(found.distinct().groupBy("host", "leaf", "text").agg(F.count(F.lit(1)).alias("n")), "texts")
    leaves = texts.groupBy("host", "leaf").agg(
        F.max("n").alias("most"), F.sum("n").alias("n"), F.max_by("text", "n").alias("text")
    )
    often = (F.col("most") >= PAGES) & (F.col("most") > SHARE * F.col("n"))
    fixed = leaves.filter((F.col("leaf") >= 0) & often).select("host", "text")
    # What is missing from the tree: texts at one path, held against all different pages.
    total = leaves.filter(F.col("leaf") == EVERY).select("host", "n")
    placed = texts.filter(F.col("leaf") == PLACED).select("host", "text", F.col("n").alias("most")).join(total, "host")
    fixed = fixed.unionByName(placed.filter(often).select("host", "text"))
    fixed = fixed.groupBy("host").agg(F.collect_set("text").alias("fixed"))
    wrappers = write_once(models.join(fixed, "host", "left"), "wrappers")

    out = rows.join(wrappers, "host").withColumn("text", _content(F.col("html"), F.col("shape"), F.col("fixed")))
    return out.select(
        F.col("id").alias(id), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars")
    )


def _host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#]*)", 1))
    return F.when(url.isNull(), F.lit("")).otherwise(host)


def _shape(html: Column) -> Column:
    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([json.dumps(dom.parse(p).shape) for p in pages], dtype=object)

    return of(html)


@lru_cache(maxsize=1024)
def _tree(shape: str) -> tuple:
    def tuples(node: list) -> tuple:
        return node[0], tuple(map(tuples, node[1]))

    return tuples(json.loads(shape))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _place(block: dom.Block) -> int:
    return _hash(f"{block.path}\n{block.text}")


def _aligned_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The text that each page has at the leaves of its host's tree, if it may be content."""
    for rows in batches:
        out = {}
        for host, html, shape in zip(rows["host"], rows["html"], rows["shape"]):
            page = dom.parse(html)
            digest = _hash("\n".join(b.text for b in page.blocks))
            if page.blocks:
                out[host, EVERY, 0, digest] = None
            for block in page.blocks:
                if not block.dropped:
                    out[host, PLACED, _place(block), digest] = None
            for leaf, own in dom.aligned(_tree(shape), page.shape):
                block = page.blocks[own]
                if not block.dropped:
                    out[host, leaf, _hash(block.text), digest] = None
        yield pd.DataFrame(list(out), columns=["host", "leaf", "text", "page"])


def _content(html: Column, shape: Column, fixed: Column) -> Column:
    @F.pandas_udf("string")
    def of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pages, shapes, templates in batches:
            yield pd.Series([
                content(dom.parse(page), _tree(model), template)
                for page, model, template in zip(pages, shapes, templates)
            ], dtype=object)

    return of(html, shape, fixed)


def content(page: dom.Page, model: tuple, template) -> str:
    """The text of the slots that belong to the article."""
    known = set() if template is None else {int(t) for t in template}
    fixed = set()
    if known:
        fixed = {
            own for _, own in dom.aligned(model, page.shape) if _hash(page.blocks[own].text) in known
        }
        fixed |= {i for i, b in enumerate(page.blocks) if _place(b) in known}
    slots = [b for i, b in enumerate(page.blocks) if not b.dropped and i not in fixed]
    # If nothing is left, what only a class or id tells to drop is the text.
    slots = slots or [b for i, b in enumerate(page.blocks) if b.named and i not in fixed]
    inside = [b for b in slots if b.region]
    if inside:
        return "\n".join(b.text for b in inside)
    slots = [b for b in slots if b.linked <= LINKED or not PROSE.isdisjoint(b.path.split("/"))]
    weight: Counter[int] = Counter()
    for block in slots:
        for holder in block.holders:
            weight[holder] += len(block.text)
    # Elements are numbered as they begin, so the innermost has the largest number.
    best = max((h for h, n in weight.items() if n >= HELD * sum(len(b.text) for b in slots)), default=None)
    return "\n".join(b.text for b in slots if best in b.holders)

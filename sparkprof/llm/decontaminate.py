"""Benchmark passages in documents, also with other numbers, names and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprof.scratch import write_once

# Tokens of a window; a shorter item is one window.
WINDOW = 8
# Share of an item's windows that make a document contaminated.
SHARE = 0.3
# Tokens in a row that make a document contaminated however long the item is.
RUN = 13
# Tokens of a window that must be words of their own, or all but the slots of a short item.
LITERAL = 3
# Benchmark windows up to this number (a few hundred bytes each) are sent to every executor.
BROADCAST_WINDOWS = 200_000
# Units that follow a number.
UNITS = (
    "mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "ms", "min", "h", "inch", "inches",
    "feet", "foot", "yards", "miles", "mile", "meters", "metres", "kilometers", "kilometres",
    "grams", "kilograms", "pounds", "ounces", "liters", "litres", "gallons", "seconds", "minutes",
    "hours", "days", "weeks", "months", "years", "dollars", "cents", "euros", "degrees", "percent",
)


def contaminated(
    documents: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", window: int = WINDOW, share: float = SHARE,
    run: int = RUN,
) -> DataFrame:
    """Pairs of documents and the benchmark items they hold.

    Numbers, names (capitalised words inside a sentence) and units after numbers become
    typed slots; windows of ``window`` tokens of either side meet by hash.  Within a
    document and an item each value of the item's slots must stand for one value of the
    document's: the most frequent one, of equals the smallest; windows with another are
    not counted.  The same is done for windows of plain lower-case words, so that a verbatim
    copy is found whatever its case and surroundings.  A pair counts if at least ``share``
    of the item's windows of either kind are left, or if windows left in a row cover
    ``run`` tokens.

    Returns ``id``, ``item``, ``matched`` and ``windows`` (of the item), ``share``, ``changed``
    (whether a slot has another value than in the item) and ``run`` (the most tokens in a row).  Null ids, null or
    empty texts and items without words give no row; rows that share an id count as one
    document, items that share an id as one item.  Other columns are not read.
    """
    items = _windows(benchmark, item, item_text, "item", window)
    # Windows without words of their own say nothing; those of documents meet none of them.
    slots = lambda c: F.filter(c, lambda s: s.isNotNull())
    literal = F.col("length") - F.size(slots("slots")) - F.when(F.col("plain"), F.col("numbers")).otherwise(0)
    own = literal >= F.least(F.lit(LITERAL), F.greatest(F.col("length") - 1, F.lit(1)))
    items = items.filter(own | F.col("plain") & (F.col("length") >= window)).withColumn("slots", slots("slots"))
    items = write_once(items.drop("numbers").distinct(), "benchmark")
    sizes = items.groupBy("item", "plain").agg(
        F.countDistinct("place").alias("windows"), F.first("length").alias("length")
    )
    lengths = {False: [], True: []}
    for row in sorted(items.select("plain", "length").distinct().collect()):
        lengths[row["plain"]].append(row["length"])
    held = items.select(
        "item", "plain", "hash", "length", F.col("place").alias("item_place"), F.col("slots").alias("item_slots")
    )
    if held.count() <= BROADCAST_WINDOWS:
        held = F.broadcast(held)
    met = _places(documents, id, text, lengths).join(held, ["plain", "hash"])
    met = write_once(met.drop("hash").distinct(), "met")
    # Slots are cut out only of the texts that hold a window.
    named = documents.select(F.col(id).alias("doc"), F.xxhash64(text).alias("content"), F.col(text).alias("text"))
    keys = write_once(met.filter("not plain").select("doc", "content").distinct(), "keys")
    texts = named.join(keys, ["doc", "content"], "left_semi").dropDuplicates(["doc", "content"])
    texts = texts.select("doc", "content", F.transform(_tokens(marked(F.col("text"))), lambda t: F.when(_slot(t), t)).alias("slot"))
    found = met.join(texts, ["doc", "content"], "left").select(
        "doc", "item", "plain", "place", "item_place", "item_slots",
        F.when(F.col("plain"), F.array().cast("array<string>"))
        .otherwise(slots(F.slice("slot", F.col("place"), F.col("length")))).alias("slots"),
    )
    found = write_once(found.distinct(), "matches")
    slots = found.select(
        "doc", "item", "plain", "place", "item_place",
        F.explode(F.arrays_zip("item_slots", "slots")).alias("slot"),
    ).select(
        "doc", "item", "plain", "place", "item_place", F.col("slot.item_slots").alias("asked"),
        F.col("slot.slots").alias("given"),
    )
    votes = slots.groupBy("doc", "item", "asked", "given").count()
    first = Window.partitionBy("doc", "item", "asked").orderBy(F.desc("count"), "given")
    bound = votes.withColumn("rank", F.row_number().over(first)).filter("rank = 1")
    bound = bound.select("doc", "item", "asked", F.col("given").alias("bound"))
    broken = slots.join(bound, ["doc", "item", "asked"]).filter("given <> bound")
    kept = found.join(broken, ["doc", "item", "plain", "place", "item_place"], "left_anti")
    pairs = kept.groupBy("doc", "item", "plain").agg(
        F.countDistinct("item_place").alias("matched"),
        F.max(F.to_json("slots") != F.to_json("item_slots")).alias("changed"),
    )
    along = Window.partitionBy("doc", "item", "plain", "apart").orderBy("item_place")
    rows = kept.select("doc", "item", "plain", "item_place", (F.col("place") - F.col("item_place")).alias("apart"))
    rows = rows.distinct().withColumn("row", F.col("item_place") - F.row_number().over(along))
    rows = rows.groupBy("doc", "item", "plain", "apart", "row").count()
    rows = rows.groupBy("doc", "item", "plain").agg(F.max("count").alias("in_a_row"))
    pairs = (
        pairs.join(rows, ["doc", "item", "plain"]).join(sizes, ["item", "plain"])
        .withColumn("share", F.col("matched") / F.col("windows"))
        .withColumn("run", (F.col("in_a_row") + F.col("length") - 1).cast("int"))
        .filter((F.col("share") >= share) | (F.col("run") >= run))
    )
    # What is found by slots is reported by slots; a share counts before a run.
    order = F.struct(F.col("share") < share, "plain")
    best = F.min_by(F.struct("matched", "windows", "share", "changed", "run"), order).alias("best")
    return pairs.groupBy("doc", "item").agg(best).select(
        F.col("doc").alias(id), F.col("item").alias(item), "best.*"
    )


def clean(documents: DataFrame, benchmark: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no benchmark item; those without an id stay."""
    dirty = contaminated(documents, benchmark, id=id, **options).select(id).distinct()
    # A written table has a known size: if it is small, the documents need not be shuffled.
    dirty = write_once(dirty, "contaminated")
    return documents.join(dirty, id, "left_anti")


def marked(text: Column) -> Column:
    """Lower-case text with typed slots: a control character and a letter before the value."""
    out = F.translate(F.coalesce(text, F.lit("")), "\u0001\u0002", "  ")
    out = F.regexp_replace(out, r"([^.!?\x09-\x0D ] )(\p{Lu}\p{Ll}+)", "$1\u0001n$2")
    out = F.regexp_replace(out, r"([0-9])[.,]([0-9])", "$1\u0002$2")
    out = F.regexp_replace(F.lower(out), "[0-9][0-9\u0002]*", "\u0001d$0")
    units = "|".join(UNITS)
    return F.regexp_replace(
        out, f"(\u0001d[0-9\u0002]+[ -]?)({units})([^\\p{{L}}\\p{{N}}]|$)", "$1 \u0001u$2$3"
    )


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, "[^\\p{L}\\p{N}\u0001\u0002]+"), lambda t: t != "")


def _slot(token: Column) -> Column:
    return F.substring(token, 1, 1) == "\u0001"


def _hashes(text: Column) -> tuple[Column, Column]:
    """The tokens' hashes, a slot by its type; and those of the plain lower-case words."""
    words = _tokens(F.lower(F.translate(F.coalesce(text, F.lit("")), "\u0001\u0002", "  ")))
    own = lambda t: F.when(_slot(t), F.substring(t, 1, 2)).otherwise(t)
    return F.transform(_tokens(marked(text)), lambda t: F.xxhash64(own(t))), F.transform(words, lambda t: F.xxhash64(t))


def _places(rows: DataFrame, id: str, text: str, lengths: dict[bool, list[int]]) -> DataFrame:
    """``doc, content, plain, hash, place`` of all windows; ``content`` tells texts of one id apart.

    A row is a window's hash and place and nothing else, as hardly any meets an item.
    """
    slotted, plain = _hashes(F.col(text))
    tokens = rows.filter(F.col(id).isNotNull()).select(
        F.col(id).alias("doc"), F.xxhash64(text).alias("content"), slotted.alias("slotted"), plain.alias("plainly")
    )

    def hashes(plain: bool, length: int) -> Column:
        column = "plainly" if plain else "slotted"
        starts = F.when(F.size(column) >= length, F.sequence(F.lit(0), F.size(column) - length))
        # The hash of an array is that of its elements in turn.
        whole = lambda i: F.xxhash64(*[F.get(column, i + k) for k in range(length)], *([F.lit(1)] if plain else []))
        return F.struct(F.lit(plain).alias("plain"), F.transform(starts, whole).alias("hashes"))

    kinds = [hashes(plain, length) for plain in (False, True) for length in lengths[plain] if length > 0]
    if not kinds:
        return tokens.limit(0).select("doc", "content", F.lit(True).alias("plain"), F.lit(0).cast("long").alias("hash"), F.lit(0).alias("place"))
    found = tokens.select("doc", "content", F.explode(F.array(*kinds)).alias("kind"))
    found = found.select("doc", "content", "kind.plain", F.posexplode("kind.hashes").alias("place", "hash"))
    return found.withColumn("place", F.col("place") + 1)


def _windows(rows: DataFrame, id: str, text: str, name: str, window: int) -> DataFrame:
    """``name, plain, hash, place, slots, length, numbers`` of all windows, with slots and as plain words.

    A row of fewer tokens than a window is one window.  ``slots`` has a null for each other
    token; ``numbers`` counts the tokens that begin with a digit.
    """
    words = _tokens(F.lower(F.translate(F.coalesce(F.col(text), F.lit("")), "\u0001\u0002", "  ")))
    slotted, plain = _hashes(F.col(text))
    tokens = rows.select(
        F.col(id).alias(name), slotted.alias("hash"), plain.alias("plain_hash"),
        F.transform(_tokens(marked(F.col(text))), lambda t: F.when(_slot(t), t)).alias("slot"),
        F.transform(words, lambda t: t.rlike("^[0-9]").cast("int")).alias("number"),
    )
    tokens = tokens.filter(F.col(name).isNotNull() & (F.size("hash") > 0))

    def at(plain: bool, length: Column, start: Column) -> Column:
        hash = F.slice("plain_hash" if plain else "hash", start, length)
        # Windows of either kind meet only their own.
        hash = F.xxhash64(hash, F.lit(1)) if plain else F.xxhash64(hash)
        numbers = F.size(F.filter(F.slice("number", start, length), lambda n: n > 0)) if plain else F.lit(0)
        return F.struct(
            F.lit(plain).alias("plain"), hash.alias("hash"), start.alias("place"),
            (F.lit(None).cast("array<string>") if plain else F.slice("slot", start, length)).alias("slots"),
            length.alias("length"), numbers.alias("numbers"),
        )

    every = []
    for plain in (False, True):
        size = F.size("plain_hash" if plain else "hash")
        length = F.least(F.lit(window), size)
        starts = F.when((length > 0) & (size >= length), F.sequence(F.lit(1), size - length + 1))
        part = F.transform(starts, lambda i: at(plain, length, i))  # noqa: B023
        every.append(F.coalesce(part, F.array().cast(_WINDOWS)))
    found = tokens.select(name, F.inline(F.concat(F.array().cast(_WINDOWS), *every)))
    return found.withColumn("slots", F.coalesce("slots", F.array().cast("array<string>")))


_WINDOWS = "array<struct<plain:boolean,hash:bigint,place:int,slots:array<string>,length:int,numbers:int>>"

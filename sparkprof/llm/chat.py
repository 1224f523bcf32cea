"""Chat formatting that is proven by reading it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A turn is OPEN, its role, HEAD, its text, END.
OPEN, HEAD, END = "<s>[INST]", "[/INST]", "</s>"
# Every control string, with any number of escape signs after its bracket.
_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"
LEARNED = "assistant"


def format_conversations(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Renders each conversation as one text, with the spans that a model learns from.

    Returns ``conversation``, ``formatted``, ``escaped`` and ``loss_spans`` (start and
    length in code points of ``formatted``, one for each assistant text).

    A conversation is rendered as it is and read back by ``parse``.  If that does not give
    the same turns, because a text holds control strings or escapes, its control strings
    are escaped and it is read back again; a conversation that still differs is an error.

    Turns are ordered by number (null first), equal numbers by role and text; repeated
    rows stay.  Null roles and texts are empty.  Rows without a conversation id form one.
    Other columns are not read.  An empty table gives an empty table.
    """
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    rows = turns.select(
        F.col(conversation).alias("id"),
        F.struct(F.col(turn).alias("n"), filled(role).alias("role"), filled(text).alias("text")).alias("row"),
    )
    whole = rows.groupBy("id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    whole = whole.select(
        "id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns")
    )
    plain = whole.withColumn("formatted", _rendered("turns", lambda part: part))
    tried = plain.withColumn("escaped", ~_turns(_parts(F.col("formatted"))).eqNullSafe(F.col("turns")))
    escaped = F.when(F.col("escaped"), _rendered("turns", escape)).otherwise(F.col("formatted"))
    read = tried.withColumn("formatted", escaped).withColumn("read", parse(F.col("formatted")))
    same = _turns(F.col("read")).eqNullSafe(F.col("turns"))
    proven = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation is not read back as it is")))
    spans = F.transform(
        F.filter("read", lambda t: t["role"] == LEARNED),
        lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")),
    )
    return read.select(
        F.col("id").alias(conversation), proven.alias("formatted"), "escaped", spans.alias("loss_spans")
    )


def escape(text: Column) -> Column:
    """Adds an escape sign to every control string, so that none is left."""
    return F.regexp_replace(text, _CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def parse(formatted: Column) -> Column:
    """Reads turns back: an array of ``role``, ``text`` (unescaped), ``start`` and ``length``.

    A turn ends at the first END; its role ends at the first HEAD.  Start and length say
    where its text, as it stands, lies in the formatted text.
    """
    parts = _parts(formatted)
    starts = F.aggregate(
        parts, F.array(F.lit(0)),
        lambda seen, p: F.concat(seen, F.array(F.element_at(seen, -1) + p["size"] + len(END))),
    )
    return F.zip_with(parts, F.slice(starts, 1, F.size(parts)), lambda p, start: F.struct(
        p["role"], p["text"], (start + p["skip"]).alias("start"), p["length"],
    ))


def _parts(formatted: Column) -> Column:
    """Turns with their size in the formatted text and what of it comes before the text."""
    pieces = F.split(formatted, r"\Q" + END + r"\E")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        at = F.instr(piece, HEAD)
        text = F.substring(piece, at + len(HEAD), F.length(piece))
        return F.struct(
            unescape(F.substring(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"),
            unescape(text).alias("text"), F.length(piece).alias("size"),
            (at + len(HEAD) - 1).alias("skip"), F.length(text).alias("length"),
        )

    return F.transform(pieces, turn)


def _turns(parsed: Column) -> Column:
    return F.transform(parsed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _rendered(turns: str, treat) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(OPEN), treat(t["role"]), F.lit(HEAD), treat(t["text"]), F.lit(END)
    )), "")

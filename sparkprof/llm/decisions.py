"""Quality rules: an ordered list of threshold conjunctions, learned from labelled statistics.

Sequential covering by aggregates: to grow a rule, Spark counts the labelled rows it still
covers per statistic and bin, a bounded table from which the driver reads the gain of every
threshold; grown rules are pruned by their counts on rows kept apart.  The list is a
conditional expression over the statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprof.scratch import write_once

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Rules of a list and conditions of a rule, at most.
RULES, CONDITIONS = 24, 4
# A rule must be right on this share of the rows kept apart, and cover as many rows of its class in all.
PRECISION, COVERED = 0.97, 5
# Of three labelled rows one prunes.
PARTS = 3
# Bins of a statistic: a step is about 1 / STEPS of the value (of the unit where it is smaller).
STEPS, LAST_BIN = 16, 400
_WHITE = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Condition:
    """``name > threshold``, or ``name <= threshold``."""

    name: str
    above: bool
    threshold: float

    def holds(self) -> Column:
        return F.col(self.name) > self.threshold if self.above else F.col(self.name) <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass
class DecisionList:
    """Rules in order, each for rows of the target label; rows of none keep the other verdict."""

    rules: list[list[Condition]] = field(default_factory=list)

    def kept(self) -> Column:
        """False from the first rule that holds, else true."""
        chain = F
        for rule in self.rules:
            chain = chain.when(_all(rule), False)
        return chain.otherwise(True) if self.rules else F.lit(True)

    def rule(self) -> Column:
        """The number of the first rule that holds, from 1; null if none does."""
        return F.coalesce(*[F.when(_all(r), k) for k, r in enumerate(self.rules, 1)], F.lit(None).cast("int"))

    def __str__(self) -> str:
        return "\n".join(f"drop if {' and '.join(map(str, r))}" for r in self.rules) + "\nelse keep"


def _all(rule: list[Condition]) -> Column:
    return reduce(lambda a, b: a & b, [c.holds() for c in rule], F.lit(True))


def statistics(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and the statistics of every row's whole text; a null text has none of anything.

    Counts (``BASE``): words `[^\\x20\\x09-\\x0D]+`, their code points, characters of
    ``#*$%&|<>``, lines with a word that equal an earlier one, and words in windows of three that
    occur twice or more.  Windows are told apart by 64-bit hashes.  Shares are taken of words,
    lines or characters and are 0 where there are none of these.
    """
    rows = documents.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("text_"))
    # Trimmed first, a text has no empty words but a blank one.
    trimmed = F.trim(F.col("text_"), F.lit(_WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split("text_", "\n"), lambda l: F.trim(l, F.lit(_WHITE)) != "")
    rows = rows.withColumn("words_", words).withColumn("lines_", lines)
    windows = F.transform(
        F.when(F.size("words_") >= 3, F.sequence(F.lit(0), F.size("words_") - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get("words_", i), F.get("words_", i + 1), F.get("words_", i + 2)),
    )
    chars = lambda others: F.length(F.regexp_replace("text_", others, "")).cast("long")
    rows = rows.withColumn("windows_", windows).select(
        *keep,
        F.size("words_").cast("long").alias("n_words"),
        F.length(F.array_join("words_", "")).cast("long").alias("word_chars"),
        chars("[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows_")) < F.size("windows_"), _repeated("windows_"))
        .otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines_").alias("lines_"), F.size(F.array_distinct("words_")).alias("distinct_"),
        chars("\\P{Lu}+").alias("upper_"), chars("[^0-9]+").alias("digits_"), chars("[^.!?]+").alias("stops_"),
    )
    share = lambda part, of: F.coalesce(F.try_divide(part, of), F.lit(0.0)).cast("double")
    return rows.select(
        *keep, *BASE,
        share("word_chars", "n_words").alias("word_length"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "lines_").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("distinct_", "n_words").alias("distinct_share"),
        share("upper_", "word_chars").alias("upper_share"),
        share("digits_", "word_chars").alias("digit_share"),
        share("stops_", "n_words").alias("stop_share"),
        share("n_words", "lines_").alias("line_words"),
    )


# Statistics that rules are made of, with the value below which differences are taken as they are.
FEATURES = {
    "n_words": 1.0, "word_length": 0.1, "symbol_share": 0.001, "dup_line_share": 0.01, "repeat_share": 0.01,
    "distinct_share": 0.01, "upper_share": 0.001, "digit_share": 0.001, "stop_share": 0.01, "line_words": 0.1,
}


def _repeated(windows: str) -> Column:
    """Words in windows that occur twice or more: equal windows are neighbours once sorted."""
    marked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        twice = F.filter(s, lambda x, j: same(x, j + 1) | same(x, j - 1))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    # A window of three adds the words beyond the one before it.
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    # The array of one binds the sorted windows, so they are sorted once.
    found = F.get(F.transform(F.array(marked), places), F.lit(0))
    return F.aggregate(
        found, start,
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def apply(
    documents: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """Which documents stay: by the base limits, then by a decision list learned from the labels.

    Returns one row per input row: the id, the counts ``BASE``, ``base_failed`` (fewer than 50
    words, or over half of them in repeated windows), ``kept`` and ``rule`` (the number of the
    rule that dropped it, null if none did).  The list is learned from all labelled
    documents that pass the base limits; without labels of both kinds it is empty and keeps
    all others.  A null text has no words.  Rows that share an id are labelled alike, of several labels
    of an id the largest counts; null ids have none.  Repeated rows stay.  Other columns are
    not read.  An empty table gives an empty table.
    """
    found = documents.select(F.col(id).alias("id"), F.col(text).alias("text"))
    found = write_once(statistics(found, "text", ("id",)), "statistics")
    marked = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label"))
    marked = marked.filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    chosen = learn(found.filter(~base_failed()).join(marked, "id"))
    judged = found.withColumn("base_failed", base_failed()).withColumn("rule", chosen.rule())
    return judged.select(
        F.col("id").alias(id), *BASE, "base_failed",
        (~F.col("base_failed") & chosen.kept()).alias("kept"),
        F.when(~F.col("base_failed"), F.col("rule")).alias("rule"),
    )


def learn(
    labelled: DataFrame, features: dict[str, float] = FEATURES, target: int = 0, rules: int = RULES,
    conditions: int = CONDITIONS, precision: float = PRECISION, covered: int = COVERED,
) -> DecisionList:
    """A decision list for label ``target`` from rows ``id, label`` and non-negative features.

    A rule takes the condition of most information gain until it covers no other label, gains
    nothing or is long; then it is cut to the prefix with the largest (p - n) / (p + n) among
    the rows of the pruning part.  It is added if ``precision`` of the pruning rows it covers
    are of the target, and ``covered`` rows in all; the first rule that fails this ends the
    list.  At last trailing rules are left out as long as this adds no error.  Which part a row is in
    depends on its id alone.  All labelled rows count.
    """
    bins = [
        F.least(F.lit(LAST_BIN), F.ceil(F.log1p(F.col(n) / unit) * STEPS)).cast("short").alias(f"bin{k}")
        for k, (n, unit) in enumerate(features.items())
    ]
    rows = labelled.select(
        *features, *bins, (F.col("label") == target).cast("long").alias("hit"),
        (F.pmod(F.xxhash64("id"), F.lit(PARTS)) == 0).alias("prunes"),
    )
    rows = write_once(rows, "labelled")
    chosen = DecisionList()
    while len(chosen.rules) < rules:
        left = rows.filter(chosen.rule().isNull())
        rule = _grown(left.filter("not prunes"), features, conditions)
        if not rule:
            break
        cuts = [_all(rule[: k + 1]) for k in range(len(rule))]
        counts = _counts(left, [F.col("prunes") & c for c in cuts] + cuts)
        worth = [(p - n) / max(p + n, 1) for p, n in counts[: len(rule)]]
        best = max(range(len(rule)), key=lambda k: (worth[k], -k))
        p, n = counts[best]
        if p == 0 or p < precision * (p + n) or counts[len(rule) + best][0] < covered:
            break
        chosen.rules.append(rule[: best + 1])
    if chosen.rules:
        # Errors of every shorter list: its wrong hits and the targets it leaves.
        named = rows.groupBy(F.coalesce(chosen.rule(), F.lit(len(chosen.rules) + 1)).alias("k"))
        by_rule = {r["k"]: (r["p"], r["all"] - r["p"]) for r in named.agg(F.sum("hit").alias("p"), F.count("hit").alias("all")).collect()}
        p = [by_rule.get(k, (0, 0)) for k in range(1, len(chosen.rules) + 2)]
        errors = [sum(n for _, n in p[:k]) + sum(t for t, _ in p[k:]) for k in range(len(chosen.rules) + 1)]
        del chosen.rules[errors.index(min(errors)) :]
    return chosen


def _counts(rows: DataFrame, tests: list[Column]) -> list[tuple[int, int]]:
    """(rows of the target, other rows) that pass each test, in one aggregate."""
    sums = [F.sum(F.when(t, x)).alias(f"c{k}_{s}") for k, t in enumerate(tests) for s, x in enumerate((F.col("hit"), 1 - F.col("hit")))]
    found = rows.agg(*sums).first()
    return [(found[2 * k] or 0, found[2 * k + 1] or 0) for k in range(len(tests))]


def _grown(rows: DataFrame, features: dict[str, float], conditions: int) -> list[Condition]:
    names, rule = list(features), []
    while len(rule) < conditions:
        # At most LAST_BIN + 1 rows for each feature.
        place = F.posexplode(F.array(*[f"bin{k}" for k in range(len(names))])).alias("feature", "bin")
        table = rows.filter(_all(rule)).select("hit", place).groupBy("feature", "bin").agg(
            F.sum("hit").alias("p"), F.count("hit").alias("all")
        ).collect()
        split = best_split([(r["feature"], r["bin"], r["p"], r["all"] - r["p"]) for r in table])
        if split is None:
            break
        _, feature, low, high, above, clean = split
        # In the middle of the gap between the bins that hold rows.
        unit = features[names[feature]]
        condition = Condition(names[feature], above, float(f"{(edge(low, unit) + edge(high - 1, unit)) / 2:.5g}"))
        if condition in rule:
            break
        rule.append(condition)
        if clean:
            break
    return rule


def edge(bin: int, unit: float) -> float:
    """The largest value of a bin."""
    return unit * math.expm1(bin / STEPS)


def best_split(table: list[tuple[int, int, int, int]]) -> tuple[float, int, int, int, bool, bool] | None:
    """The condition of most gain from counts ``feature, bin, p, n``.

    Returns the gain, the feature, the bins around the threshold, whether it is passed above
    and whether no n passes it; of equal gains the first feature and the lowest threshold.
    """
    best = None
    for feature in sorted({t[0] for t in table}):
        bins = sorted(t[1:] for t in table if t[0] == feature)
        p_all, n_all = sum(b[1] for b in bins), sum(b[2] for b in bins)
        p_low = n_low = 0
        for (bin, p, n), (following, _, _) in zip(bins, bins[1:]):
            p_low, n_low = p_low + p, n_low + n
            for above, a, b in ((True, p_all - p_low, n_all - n_low), (False, p_low, n_low)):
                if a == 0 or b == n_all:
                    continue
                gain = a * (math.log2(a / (a + b)) - math.log2(p_all / (p_all + n_all)))
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, feature, bin, following, above, b == 0)
    return best

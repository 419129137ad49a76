"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Base statistics (words, symbols, repeated lines, repeated 5-word windows) are computed for every
document. Documents that pass the base test go through a cascade of rules: each rule's cost and
selectivity are measured on a bounded sample, and the rules are ordered by rejections per second among
the survivors of the rules before them. A rule is a branch of one CASE, so a document stops at the first
rule that rejects it. The order never changes a verdict, only the work.

Words are ``[^\\x20\\x09-\\x0D]+``. Everything stays inside one row: repeated windows are found by sorting the
windows of that row, so there is no shuffle, and memory is linear in the longest text.

Defined results: a null or empty text has no words and fails the base test; rows repeat independently;
an empty table gives an empty result; columns of the input that clash with a result name are replaced.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import let

#: Rows the cascade is ordered on (a bound on the sample, not on what is judged).
SAMPLE_ROWS = 2000
WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words_of(text: Column) -> Column:
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))


def _covered(windows: Column) -> Column:
    """Words covered by windows that occur twice or more: sort (window, place), keep those equal to a
    neighbour, and add up the union of their spans."""
    placed = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def repeated(a: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            before, after = F.get(a, i - 1)["w"], F.get(a, i + 1)["w"]
            return F.coalesce(before == x["w"], F.lit(False)) | F.coalesce(after == x["w"], F.lit(False))
        return F.array_sort(F.transform(F.filter(a, twin), lambda x: x["i"]))

    def union(p: Column) -> Column:
        spans = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x)

    return let(placed, lambda a: let(repeated(a), union))


def _repeat_words(words: Column) -> Column:
    """No two equal hashes means no two equal windows; only other rows pay for the exact sort of strings."""
    n = F.size(words) - (WINDOW - 1)
    windows = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(words, i, WINDOW), " "))

    def judged(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(w), F.lit(0).cast("long")).otherwise(_covered(w))

    return F.when(n < 2, F.lit(0).cast("long")).otherwise(let(windows, judged))


def base_stats(text: Column) -> Column:
    """Struct of the base statistics of a text."""
    text = F.coalesce(text, F.lit(""))
    return let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _dup_lines(text).cast("long").alias("n_dup_lines"),
        _repeat_words(w).alias("n_repeat_words")))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


@dataclass(frozen=True)
class Rule:
    """``rejects(text, stats)`` is true for a text to reject; never null."""
    name: str
    rejects: object


def _share(text: Column, pattern: str) -> Column:
    """Characters of ``pattern`` in the text."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


#: Limits follow the usual public heuristics for web text; each is far from ordinary prose.
RULES = [
    Rule("word_length", lambda t, s: (s["word_chars"] < 2 * s["n_words"]) | (s["word_chars"] > 15 * s["n_words"])),
    Rule("symbol_ratio", lambda t, s: 10 * s["n_symbols"] > s["n_words"]),
    Rule("duplicate_lines", lambda t, s: 2 * s["n_dup_lines"] > F.size(F.split(t, "\n"))),
    Rule("upper_case", lambda t, s: 2 * _share(t, r"\p{Lu}") > s["word_chars"]),
    Rule("digits", lambda t, s: 2 * _share(t, r"\p{Nd}") > s["word_chars"]),
    Rule("letters", lambda t, s: 2 * _share(t, r"\p{L}") < s["word_chars"]),
    Rule("shouting", lambda t, s: 10 * _share(t, "!") > s["n_words"]),
]


def plan_cascade(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Order ``rules`` by rejections per cost. The sample holds about ``sample_rows`` rows whatever the input's
    size; each rule is timed over it, and its selectivity is taken among the survivors of those chosen before."""
    total = docs.count()
    if not total:
        return list(rules)
    sample = docs.select("text").sample(min(1.0, sample_rows / total), seed=7)
    sample = sample.select("text", base_stats(F.col("text")).alias("s")).filter(~base_failed(F.col("s"))).cache()
    sample.count()
    cost, verdicts = {}, {}
    for r in rules:
        began = time.perf_counter()
        row = sample.agg(F.collect_list(r.rejects(F.coalesce("text", F.lit("")), F.col("s"))).alias("v")).first()
        cost[r.name], verdicts[r.name] = time.perf_counter() - began, row["v"]
    sample.unpersist()
    alive = [True] * len(verdicts[rules[0].name])
    left, order = list(rules), []
    while left:
        best = max(left, key=lambda r: sum(a and v for a, v in zip(alive, verdicts[r.name])) / cost[r.name])
        order.append(best)
        left.remove(best)
        alive = [a and not v for a, v in zip(alive, verdicts[best.name])]
    return order


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` plus the base statistics, base_failed, rejected_by (the first rule of the cascade that rejects,
    null if none) and kept."""
    order = plan_cascade(docs, RULES if rules is None else rules, sample_rows) if rules != [] else []
    out = [*STATS, "base_failed", "rejected_by", "kept", "quality_stats"]
    docs = docs.drop(*out)
    text, s = F.coalesce("text", F.lit("")), F.col("quality_stats")
    judged = docs.withColumn("quality_stats", base_stats(F.col("text"))).withColumn("base_failed", base_failed(s))
    cascade = F.when(F.col("base_failed"), F.lit(None).cast("string"))
    for r in order:
        cascade = cascade.when(r.rejects(text, s), F.lit(r.name))
    judged = judged.withColumn("rejected_by", cascade)
    return judged.select(*docs.columns, *[s[c].alias(c) for c in STATS], "base_failed", "rejected_by",
                         (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"))

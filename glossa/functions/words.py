"""Words of texts inside tasks: the rules of ``functions.text`` as plain functions on strings, and their counts over Arrow batches.

A batch's words are counted where they are found, so that a shuffle gets a row for each distinct word of a portion of text, not one
for each occurrence.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.session import ship_package

#: Characters of text whose words are counted before the counts go on.
CHARS_AT_ONCE = 16_000_000
WORD_CATEGORIES = ("Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "Pc")
#: Of ``T.PRETOKEN_WORD``: join controls and circled letters. Of ``T.PRETOKEN_SPACE``: all.
WORD_RANGES = ((0x200C, 0x200D), (0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189))
SPACE_RANGES = ((0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F),
                (0x205F, 0x205F), (0x3000, 0x3000))


def _inside(ranges: Sequence[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def _finder(word: str, space: str) -> Callable[[str], list[str]]:
    return re.compile(f"[{word}]+|[^{word}{space}]+").findall


@lru_cache(maxsize=2)
def _pretoken_finder(last: int) -> Callable[[str], list[str]]:
    """For texts of characters up to ``last``: ranges beyond U+FFFF are tried one by one for each character that is in none."""
    ranges, begun = [], None
    for c in range(last + 2):
        inside = c <= last and unicodedata.category(chr(c)) in WORD_CATEGORIES
        if inside and begun is None:
            begun = c
        elif not inside and begun is not None:
            ranges.append((begun, c - 1))
            begun = None
    return _finder(_inside([*ranges, *[r for r in WORD_RANGES if r[0] <= last]]), _inside(SPACE_RANGES))


_ascii_finder = _finder("A-Za-z0-9_", r"\t-\r ")
_beyond = re.compile("[\U00010000-\U0010ffff]").search


def pretokens(text: str) -> list[str]:
    """D1 pre-tokens, as ``T.pretokens``."""
    if text.isascii():
        return _ascii_finder(text)
    return _pretoken_finder(sys.maxunicode if _beyond(text) else 0xFFFF)(text)


def spaced(text: str) -> list[str]:
    """The pieces between white space: ``str.split`` takes the characters of ``T.WS_CHARS``."""
    return text.split()


def with_word_counts(df: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """(*keys, n_chars, n_words): code points and white-space-separated pieces (B9) of each text."""
    ship_package(df.sparkSession)
    names = [*keys, "n_chars", "n_words"]

    def run(batches):
        for b in batches:
            n = [None if t is None else len(t.split()) for t in b.column(len(names) - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=names)

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "n_chars long", "n_words long"])
    return df.select(*keys, F.length(text_col).cast("long").alias("n_chars"), F.col(text_col).alias("_t")).mapInArrow(run, schema)


def type_frequencies(corpus: DataFrame, words_of: Callable[[str], list[str]], target_lang: str, text_col: str = "text") -> DataFrame:
    """(word, train_freq, test_all_freq, test_en_freq, test_target_freq) of the words that ``words_of`` finds in each text."""
    ship_package(corpus.sparkSession)

    def run(batches):
        counts: dict[tuple, Counter] = {}
        held = 0

        def rows():
            for (split, label), words in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array([split] * len(words), pa.string()),
                                                  pa.array([label] * len(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "split", "label", "n"])

        for b in batches:
            for text, split, label in zip(*(c.to_pylist() for c in b.columns)):
                if text is None:
                    continue
                counts.setdefault((split, label), Counter()).update(words_of(text))
                held += len(text)
                if held >= CHARS_AT_ONCE:
                    yield from rows()
                    counts, held = {}, 0
        yield from rows()

    found = corpus.select(F.col(text_col), "split", "label").mapInArrow(run, "word string, split string, label string, n long")
    sp, lab = F.col("split"), F.col("label")
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))
    return found.groupBy("word").agg(
        n(sp == "train").alias("train_freq"), n(sp == "test").alias("test_all_freq"),
        n((sp == "test") & (lab == "en")).alias("test_en_freq"), n((sp == "test") & (lab == target_lang)).alias("test_target_freq"))


def with_pretokens(df: DataFrame, keys: Sequence[str], name: str, text_col: str = "text") -> DataFrame:
    """(*keys, name): the pre-tokens of each text."""
    ship_package(df.sparkSession)
    names = [*keys, name]

    def run(batches):
        for b in batches:
            found = [None if t is None else pretokens(t) for t in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.string()))], names=names)

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(*keys, text_col).mapInArrow(run, ", ".join([*[f"`{k}` {types[k]}" for k in keys], f"`{name}` array<string>"]))

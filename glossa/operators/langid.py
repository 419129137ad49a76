"""Language identification (B12, re-aimed): character n-gram multinomial naive Bayes
(Cavnar & Trenkle 1994; Lui & Baldwin 2012) trained and applied as Spark jobs.

Training: 1..3-grams of lower-cased, space-normalised text, counted in arrays by portions of text -> ``groupBy(lang, gram)``
sums -> add-1/2 log probabilities; every gram counts. Scoring: a text's
score for a language is the sum of its grams' log-probability *gains* over the language's
unseen-gram floor, plus the floor for every gram and the prior. While the model is small
(checked) it is broadcast and texts are scored a portion at a time, in arrays; beyond that the grams
of each text are counted and joined to the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import lattice as LT
from glossa.session import BROADCAST_MAX_ROWS, cut_lineage, ship_package

MAX_N = 3
SMOOTH = 0.5
CHARS_AT_ONCE = 300_000
#: Characters whose grams are counted at a time; numbers of distinct grams up to which bins are kept for all possible ones.
CHARS_COUNTED = 2_000_000
MOST_BINS = 1 << 23


def normalise(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.regexp_replace(T.py_strip(text), f"{T.WS}+", " ")), F.lit(" "))


def grams(text: Column) -> Column:
    """array of all 1..MAX_N character n-grams of the normalised text (overlapping matches via
    a look-ahead capture, so the work stays in the JVM regex engine)."""
    t = normalise(text)
    arrs = [F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in range(1, MAX_N + 1)]
    return F.concat(*arrs)


def normal_texts(lowered: list[str | None]) -> list[str]:
    """``normalise`` of texts that are in lower case already; a null is an empty one."""
    return [f" {' '.join(t.split())} " if t is not None else "" for t in lowered]


def _counted(texts: list[str], n: int) -> tuple[list[str], np.ndarray]:
    """The distinct ``n``-grams of normalised texts, with their numbers."""
    codes, sizes = LT._codes(texts)
    alphabet = np.flatnonzero(np.bincount(codes, minlength=1))
    place = np.zeros(int(alphabet.max(initial=0)) + 1, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    begins = np.flatnonzero(at + n <= np.repeat(sizes, sizes))
    keys = np.zeros(len(begins), np.int64)
    for d in range(n):  # below 2 ** 63, as a code point is below 2 ** 21
        keys = keys * len(alphabet) + place[codes[begins + d]]
    if len(alphabet) ** n <= MOST_BINS:
        bins = np.bincount(keys, minlength=1)
        keys = np.flatnonzero(bins)
        counts = bins[keys]
    else:
        keys, counts = np.unique(keys, return_counts=True)
    chars = np.empty((len(keys), n), "<u4")
    for d in reversed(range(n)):
        keys, chars[:, d] = keys // max(1, len(alphabet)), alphabet[keys % max(1, len(alphabet))]
    text = chars.tobytes().decode("utf-32-le")
    return [text[i:i + n] for i in range(0, len(text), n)], counts


def gram_counts(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, count): every 1- to ``MAX_N``-gram of the normalised texts. A portion of texts is counted in arrays where it is read,
    so that a shuffle gets its distinct grams alone."""
    ship_package(labelled.sparkSession)

    def run(batches):
        for b in batches:
            by_lang: dict[str | None, list[str]] = {}
            for lang, t in zip(b.column(0).to_pylist(), normal_texts(b.column(1).to_pylist())):
                by_lang.setdefault(lang, []).append(t)
            for lang, texts in by_lang.items():
                for part in _portions(texts, CHARS_COUNTED):
                    for n in range(1, MAX_N + 1):
                        grams, counts = _counted(part, n)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()),
                                                          pa.array(counts, pa.int64())], ["lang", "gram", "count"])

    found = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.lower(text_col).alias("_t")).mapInArrow(run, "lang string, gram string, count long")
    return found.groupBy("lang", "gram").agg(F.sum("count").alias("count"))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Model table (lang, gram, count, logp, unseen, prior)."""
    counts = gram_counts(labelled, text_col, lang_col)
    tot = counts.groupBy("lang").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("v"))
    docs = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("d"))
    one = F.lit(1).alias("_one")
    all_docs = docs.agg(F.sum("d").alias("dd")).select("*", one)
    lang_t = (tot.join(docs, "lang").select("*", one).join(all_docs, "_one")  # one-row total
                 .select("lang", (F.log((F.lit(SMOOTH)) / (F.col("n") + F.lit(SMOOTH) * F.col("v")))).alias("unseen"),
                         F.log(F.col("d") / F.col("dd")).alias("prior"), "n", "v"))
    return (counts.join(lang_t, "lang")
               .select("lang", "gram", "count",
                       F.log((F.col("count") + F.lit(SMOOTH)) / (F.col("n") + F.lit(SMOOTH) * F.col("v"))).alias("logp"),
                       "unseen", "prior"))


def _portions(texts: list[str], chars: int = CHARS_AT_ONCE) -> Iterator[list[str]]:
    """Texts of ``chars`` characters at a time (a single longer text is a portion of its own)."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def best_languages(trie: LT.Trie, gains: np.ndarray, base: np.ndarray, texts: list[str]) -> np.ndarray:
    """The best language of each normalised text: its grams are found in a trie, and their rows of the gram-by-language
    matrix are summed. A tie goes to the first language."""
    places = LT.Places.of(texts)
    start, _, gram = places.matches(trie, places.char_place)
    sizes = places.last - places.first
    text = np.repeat(np.arange(len(texts)), sizes + 1)[start]
    n = sum(np.maximum(sizes - k, 0) for k in range(MAX_N))
    score = np.stack([np.bincount(text, gains[gram, k], len(texts)) + n * unseen + prior for k, (unseen, prior) in enumerate(base)], axis=1)
    return score.argmax(axis=1)


def _score_rows(shared, n_keys: int, names: list[str]):
    def run(batches):
        grams, gains, langs, base = shared.value
        trie = LT.Trie(grams)
        for b in batches:
            texts = normal_texts(b.column(n_keys).to_pylist())
            best = [langs[k] for part in _portions(texts) for k in best_languages(trie, gains, base, part).tolist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(best, pa.string())], names=names)
    return run


def predict(model: DataFrame, texts: DataFrame, key_cols: list[str], text_col: str = "text",
            max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """(key..., predicted), a row for each text; keys are any columns to be kept."""
    spark = texts.sparkSession
    model = cut_lineage(model)
    langs = sorted((r["lang"], float(r["unseen"]), float(r["prior"])) for r in model.select("lang", "unseen", "prior").distinct().collect())
    if not langs:
        return texts.select(*key_cols, F.lit(None).cast("string").alias("predicted"))
    gain = model.select("lang", "gram", (F.col("logp") - F.col("unseen")).alias("gain"))
    if gain.limit(max_rows + 1).count() <= max_rows:  # a checked bound
        at = {l: k for k, (l, _, _) in enumerate(langs)}
        rows = gain.toArrow()
        names, place = np.unique(np.array(rows.column("gram").to_pylist(), object), return_inverse=True)
        gains = np.zeros((len(names), len(langs)))
        gains[place, [at[l] for l in rows.column("lang").to_pylist()]] = rows.column("gain").to_numpy()
        ship_package(spark)
        shared = spark.sparkContext.broadcast((names.tolist(), gains, [l for l, _, _ in langs], np.array([(u, p) for _, u, p in langs])))
        types = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
        return texts.select(*key_cols, F.lower(text_col).alias("_t")).mapInArrow(
            _score_rows(shared, len(key_cols), [*key_cols, "predicted"]), ", ".join(f"{k} {types[k]}" for k in key_cols) + ", predicted string")
    # keys may repeat: rows are told apart by a number that is written with them
    rows = cut_lineage(texts.select(*key_cols, F.col(text_col).alias("_t"), F.monotonically_increasing_id().alias("_row")))
    g = rows.select("_row", F.explode(grams(F.col("_t"))).alias("gram")).groupBy("_row", "gram").agg(F.count(F.lit(1)).alias("k"))
    matched = g.join(gain, "gram").groupBy("_row").agg(*[F.coalesce(F.sum(F.when(F.col("lang") == l, F.col("k") * F.col("gain"))), F.lit(0.0))
                                                         .alias(f"_g{i}") for i, (l, _, _) in enumerate(langs)])
    n = rows.select(*key_cols, "_row", F.size(grams(F.col("_t"))).alias("_n")).join(matched, "_row", "left")
    best = None
    for i, (l, u, p) in enumerate(langs):
        cand = F.struct((F.coalesce(f"_g{i}", F.lit(0.0)) + F.col("_n") * F.lit(u) + F.lit(p)).alias("score"), F.lit(l).alias("lang"))
        best = cand if best is None else F.when(cand["score"] > best["score"], cand).otherwise(best)
    return n.select(*key_cols, best["lang"].alias("predicted"))

"""WordPiece encoding (D6) and Unigram LM training / encoding.

All run over the distributed type table in Arrow batches: each task gets the vocabulary (bounded by the requested
size) as a trie and works on the lattices of a batch of distinct words at once (``lattice``); frequencies ride along, so
no join back is needed. Unigram's E-step emits expected piece counts per task that are summed with ``groupBy``; only
the piece table (bounded by the seeds) reaches the driver.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import words
from glossa.operators import lattice as LT
from glossa.operators.bpe import CONT, SLICES, SPECIAL_TOKENS, UNK
from glossa.session import cut_lineage, ship_package, spread

META = "▁"  # fixed value: Unigram word-start marker
MAX_PIECE_LEN = 16
WP_MAX_WORD_CHARS = 100
PIECES_AT_ONCE = 20_000


_SUMS = {"ntok": pa.int64(), "tchars": pa.int64()}
_LISTS = {"word": pa.string(), "tokens": pa.list_(pa.string()), "ids": pa.list_(pa.int32())}
_SQL = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.string()): "array<string>", pa.list_(pa.int32()): "array<int>"}


def _encoded(types: DataFrame, columns: Sequence[str], out: dict[str, pa.DataType], make) -> DataFrame:
    """Some columns of the types (numbers) and what an encoder makes of each batch of words. ``make()`` builds the encoder once a task; it
    maps words to a list of values for each column of ``out``."""
    ship_package(types.sparkSession)

    def run(batches):
        encode = make()
        for b in batches:
            columns = [pa.array(v, t) for v, t in zip(encode(b.column(0).to_pylist()), out.values())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *columns], [*b.schema.names[1:], *out])

    schema = ", ".join([*[f"{c} long" for c in columns], *[f"{n} {_SQL[t]}" for n, t in out.items()]])
    return types.select("word", *columns).mapInArrow(run, schema)


def _slice_sums(enc: DataFrame) -> DataFrame:
    aggs = []
    for s in SLICES:
        aggs += [F.sum(F.col(f"{s}_freq") * F.col("ntok")).alias(f"tokens_{s}"),
                 F.sum(F.col(f"{s}_freq") * F.col("tchars")).alias(f"token_chars_{s}")]
    return enc.agg(*aggs)


_FREQS = [f"{s}_freq" for s in SLICES]


# ----------------------------------------------------------------- WordPiece
def wordpiece_encoder(vocab: Sequence[str]):
    """Greedy longest match first over a trie: (tokens, ids) of each of some words; the whole word is <unk> if any place
    fails or it has more than ``WP_MAX_WORD_CHARS`` characters."""
    names = list(vocab)
    head, tail = LT.Trie(names), LT.Trie([p[len(CONT):] for p in names if p.startswith(CONT) and len(p) > len(CONT)])
    ids = [i for i, p in enumerate(names) if p.startswith(CONT) and len(p) > len(CONT)]
    unk = names.index(UNK) if UNK in names else 0

    def encode(words: Sequence[str]) -> tuple[list[list[str]], list[list[int]]]:
        tokens, numbers = [], []
        for w, cuts in zip(words, LT.longest_first(head, tail, [w[:WP_MAX_WORD_CHARS + 1] for w in words])):
            if cuts is None or len(w) > WP_MAX_WORD_CHARS:
                tokens.append([UNK])
                numbers.append([unk])
            else:
                tokens.append([w[s:e] if not s else CONT + w[s:e] for s, e, _ in cuts])
                numbers.append([p if not s else ids[p] for s, _, p in cuts])
        return tokens, numbers
    return encode


def wordpiece_sums(types: DataFrame, vocab: Sequence[str]) -> DataFrame:
    """Per-slice token totals, each distinct word encoded once."""
    shared = types.sparkSession.sparkContext.broadcast(list(vocab))

    def make():
        encode = wordpiece_encoder(shared.value)
        return lambda words: zip(*[(len(t), sum(map(len, t))) for t in encode(words)[0]])

    return _slice_sums(_encoded(types, _FREQS, _SUMS, make))


def wordpiece_encode(types: DataFrame, vocab: Sequence[str]) -> DataFrame:
    """(word, tokens, ids) for every distinct word; ids are places in the vocabulary."""
    shared = types.sparkSession.sparkContext.broadcast(list(vocab))

    def make():
        encode = wordpiece_encoder(shared.value)
        return lambda words: (words, *encode(words))

    return _encoded(types, [], _LISTS, make)


# ------------------------------------------------------------------- Unigram
def _normal_words(batches):
    """NFKC of the distinct words; white space that it makes splits a word."""
    for b in batches:
        words = [unicodedata.normalize("NFKC", w).split() for w in b.column(0).to_pylist()]
        at = np.repeat(np.arange(len(words)), [len(w) for w in words])
        yield pa.RecordBatch.from_arrays([pa.array([META + x for w in words for x in w], pa.string()),
                                          *[c.take(pa.array(at)) for c in b.columns[1:]]], names=b.schema.names)


def unigram_type_table(corpus: DataFrame, target_lang: str, text_col: str = "text") -> DataFrame:
    """Whitespace words after compatibility normalisation, with the word-start marker, counted per slice (runs of
    spaces collapse)."""
    raw = words.type_frequencies(corpus, words.spaced, target_lang, text_col)
    freqs = [f"{s}_freq" for s in SLICES]
    normal = raw.mapInArrow(_normal_words, "word string, " + ", ".join(f"{c} long" for c in freqs))
    return normal.groupBy("word").agg(*[F.sum(c).alias(c) for c in freqs])


def _heads(batches, k: int):
    """Of a partition's pieces (piece, count): all characters, and the ``k`` with the highest count times length, ties by piece. Pieces that
    fall behind the best ones met so far go at once."""
    held, floor = None, 0
    for b in batches:
        size = pc.utf8_length(b.column(0)).to_numpy().astype(np.int64)
        score = b.column(1).to_numpy() * size
        single = size == 1
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(single)) for c in b.columns], ["piece", "count"])
        kept = pa.array(~single & (score >= floor))
        new = pa.table([*(c.filter(kept) for c in b.columns), pa.array(score).filter(kept)], ["piece", "count", "score"])
        held = new if held is None else pa.concat_tables([held, new])
        if len(held) > 4 * k:
            held, floor = _first(held, k)
    if held is not None:
        yield from _first(held, k)[0].select(["piece", "count"]).to_batches()


def _first(pieces: pa.Table, k: int) -> tuple[pa.Table, int]:
    """(the first ``k`` rows, the least score among them; 0 if there are fewer)"""
    pieces = pieces.take(pc.sort_indices(pieces, [("score", "descending"), ("piece", "ascending")])[:k])
    return pieces.combine_chunks(), pieces["score"][k - 1].as_py() if len(pieces) == k else 0


def seed_pieces(types: DataFrame, seed_size: int) -> DataFrame:
    """All characters plus the ``seed_size`` most frequent substrings (2..16 chars) of train words. Substrings are counted once; each
    task keeps those of its own that can be among the seeds."""
    ship_package(types.sparkSession)
    tw = types.filter(F.col("train_freq") > 0)
    # a word's pieces are made inside its own row, so no row carries the whole word once per piece
    starts = F.sequence(F.lit(1), F.length("word"))
    pieces = F.flatten(F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(MAX_PIECE_LEN), F.length("word") - i + 1)), lambda n: F.substring(F.col("word"), i, n))))
    subs = tw.select("train_freq", F.explode(pieces).alias("piece"))
    counts = subs.groupBy("piece").agg(F.sum("train_freq").alias("count"))
    heads = cut_lineage(counts.mapInArrow(lambda batches: _heads(batches, seed_size), "piece string, count long").withColumn("len", F.length("piece")))
    chars = heads.filter(F.col("len") == 1)
    from glossa.operators.sampling import top_k
    scored = heads.filter(F.col("len") > 1).withColumn("_s", F.col("count") * F.col("len"))
    multi = top_k(scored, [], "_s", "piece", seed_size).drop("_s")
    return chars.unionByName(multi).select("piece", F.col("count").cast("double").alias("count"), "len")


def _expected_counts(words: DataFrame, pieces: list[str], score: np.ndarray) -> np.ndarray:
    """E-step: the expected uses of every piece over the train words (word, train_freq); a number a piece reaches the driver."""
    shared = words.sparkSession.sparkContext.broadcast((pieces, score))

    def run(batches):
        pieces, score = shared.value
        trie, total = LT.Trie(pieces), np.zeros(len(score))
        for b in batches:
            total += LT.expected_uses(trie, b.column(0).to_pylist(), score, b.column(1).to_numpy().astype(np.float64))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["piece", "e"])

    sums = words.mapInArrow(run, "piece int, e double").groupBy("piece").agg(F.sum("e").alias("e")).toArrow()
    shared.unpersist()
    out = np.zeros(len(pieces))
    out[sums.column("piece").to_numpy()] = sums.column("e").to_numpy()
    return out


def _removal_losses(spark, pieces: list[str], score: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """Of every piece: how much log probability its uses lose when its best other segmentation replaces it."""
    shared = spark.sparkContext.broadcast((pieces, score))

    def run(batches):
        pieces, score = shared.value
        trie = LT.Trie(pieces)
        for b in batches:
            ids = b.column(0).to_numpy()
            for at in range(0, len(ids), PIECES_AT_ONCE):
                part = ids[at:at + PIECES_AT_ONCE]
                lat = LT.lattice(trie, [pieces[i] for i in part])
                whole = np.isin(lat.start, lat.first) & np.isin(lat.end, lat.last)
                other = LT.best(lat.without(whole), score)[0]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(np.maximum(other, -1e9))], ["piece", "other"])

    parts = min(spark.sparkContext.defaultParallelism, 1 + len(pieces) // PIECES_AT_ONCE)
    other = spark.range(0, len(pieces), 1, parts).mapInArrow(run, "piece long, other double").toArrow()
    shared.unpersist()
    out = np.zeros(len(pieces))
    out[other.column("piece").to_numpy()] = other.column("other").to_numpy()
    return uses * (score - out)


def train_unigram_grid(types: DataFrame, vocab_sizes: Sequence[int], seed_factor: int = 10, em_iters: int = 2,
                       shrink: float = 0.75) -> dict[int, list[tuple[str, float]] | ValueError]:
    """D4 for a grid: seed -> EM -> prune, in one descending sweep that gives [(piece, logp)] at each size (specials included).

    ``seed_factor`` times the largest size are the seeds. Each round keeps the ``shrink`` share of pieces whose removal
    would cost the most likelihood, never fewer than asked for, until the next size is reached; characters are never
    dropped, so a size below the characters is an error."""
    spark = types.sparkSession
    tw = types.filter(F.col("train_freq") > 0).select("word", "train_freq")
    required = tw.select(F.explode(F.split("word", "")).alias("c")).distinct().count()
    if not required:
        raise ValueError("cannot train a tokenizer: the training sample is empty")
    sizes = sorted({int(v) for v in vocab_sizes}, reverse=True)
    out: dict[int, list[tuple[str, float]] | ValueError] = {
        v: ValueError(f"unigram vocabulary of {v} is too small for {required} characters") for v in sizes if v - len(SPECIAL_TOKENS) < required}
    sizes = [v for v in sizes if v not in out]
    if not sizes:
        return out
    ship_package(spark)
    seeds = sorted((r["piece"], r["count"], r["len"] == 1) for r in seed_pieces(types, seed_factor * sizes[0]).toArrow().to_pylist())
    pieces = [p for p, _, _ in seeds]
    uses, char = np.array([c for _, c, _ in seeds], float), np.array([c for _, _, c in seeds], bool)
    words = spread(tw).persist(StorageLevel.MEMORY_AND_DISK)

    def keep(kept):
        nonlocal pieces, uses, char
        pieces, uses, char = [p for p, k in zip(pieces, kept) if k], uses[kept], char[kept]
        return np.log(uses / uses.sum())

    score = keep(uses > 0)
    for v in sizes:
        n_keep = v - len(SPECIAL_TOKENS)
        while True:
            for _ in range(em_iters):
                uses = _expected_counts(words, pieces, score)
                uses[char] = np.maximum(uses[char], 1e-3)  # characters are never dropped
                score = keep(uses > 0)
            if len(pieces) <= n_keep:
                break
            losses = np.where(char, np.inf, _removal_losses(spark, pieces, score, uses))
            stay = max(n_keep, int(char.sum()) + int((~char).sum() * shrink))
            kept = np.zeros(len(pieces), bool)
            kept[np.argsort(-losses, kind="stable")[:stay]] = True  # ties by piece
            score = score[kept] - np.log(np.exp(score[kept]).sum())
            pieces, uses, char = [p for p, k in zip(pieces, kept) if k], uses[kept], char[kept]
        out[v] = sorted(zip(pieces, score.tolist()), key=lambda kv: (-kv[1], kv[0]))
    words.unpersist()
    return out


def train_unigram(types: DataFrame, vocab_size: int, **params) -> list[tuple[str, float]]:
    """D4 at one size."""
    found = train_unigram_grid(types, [vocab_size], **params)[vocab_size]
    if isinstance(found, ValueError):
        raise found
    return found


def unk_penalty(logp: dict[str, float]) -> float:
    """Score of an unknown character: well below the rarest piece."""
    return min(logp.values()) - 10.0 if logp else -10.0


def unigram_encoder(pieces: Sequence[tuple[str, float]]):
    """(surface, piece number or -1) lists of some words with their markers."""
    trie, scores, floor = LT.Trie([p for p, _ in pieces]), np.array([s for _, s in pieces]), unk_penalty(dict(pieces))
    return lambda words: LT.segment(trie, scores, floor, words)


def unigram_sums(types: DataFrame, pieces: Sequence[tuple[str, float]]) -> DataFrame:
    shared = types.sparkSession.sparkContext.broadcast(list(pieces))

    def make():
        encode = unigram_encoder(shared.value)
        return lambda words: zip(*[(len(t), sum(len(x) for x, _ in t)) for t in encode(words)])

    return _slice_sums(_encoded(types, _FREQS, _SUMS, make))


def unigram_encode(types: DataFrame, pieces: Sequence[tuple[str, float]]) -> DataFrame:
    """(word, tokens, ids) of every distinct word; ids follow the special tokens in the order of ``pieces``, unknown ones are 0."""
    shared = types.sparkSession.sparkContext.broadcast(list(pieces))

    def make():
        encode = unigram_encoder(shared.value)

        def lists(words):
            found = encode(words)
            return words, [[x for x, _ in t] for t in found], [[p + len(SPECIAL_TOKENS) if p >= 0 else 0 for _, p in t] for t in found]
        return lists

    return _encoded(types, [], _LISTS, make)

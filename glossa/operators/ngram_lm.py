"""Language-model quality per slice (F1-F6), re-aimed as a count-based n-gram LM.

F1 block chunking works on each row (no window per
paragraph): ``blocks = [ids[i:i+B] for i in range(0, n-1, B)]`` keeping blocks of >= 2
tokens; the first token of a block is context only and contexts never cross blocks.
Tasks count the grams of portions of text in arrays; these counts are shuffled once, by context, to a table of
distinct grams with their counts in training and in each slice. Each lower order is a table of its own distinct grams, aggregated from the one above;
evaluation joins each order's rows to the probabilities of the one below and averages ``-log p`` weighted by the slice's counts.

Probabilities are interpolated Kneser-Ney: the highest order counts grams, every lower one the distinct tokens met on the
left of a gram (a block's begin is one), and the discount of an order is n1 / (n1 + 2 n2) from its counts of counts (0.75
where either is zero). The lowest order falls back to one over the vocabulary and an unknown token, so every loss is finite.
Any number of models, told apart by key columns, are trained and evaluated in the same jobs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import reduce
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from glossa.session import cut_lineage, ship_package

#: Tokens whose grams a task counts at a time, distinct grams of a model and distinct words it holds before it starts anew, and rows of counts in a batch.
TOKENS_AT_ONCE = 2_000_000
GRAMS_HELD = 2_000_000
WORDS_AT_ONCE = 1 << 19
ROWS_AT_ONCE = 50_000
DISCOUNT = 0.75


def blocks(df: DataFrame, ids_col: str, block_size: int) -> DataFrame:
    """one row per block (array) with its number; rows with < 2 ids give none."""
    n = F.size(ids_col)
    starts = F.sequence(F.lit(0), n - 2, F.lit(block_size))
    chunks = F.transform(starts, lambda i: F.slice(F.col(ids_col), i + 1, block_size))
    chunks = F.filter(chunks, lambda b: F.size(b) >= 2)
    keep = [c for c in df.columns if c != ids_col]
    return (df.filter(n >= 2)
              .select(*keep, F.posexplode(chunks).alias("block_no", "block")))


def ngrams(blk: DataFrame, order: int) -> DataFrame:
    """Predicted positions of each block with up to ``order-1`` context tokens (NULL when the
    context would cross the block start)."""
    keep = [c for c in blk.columns if c != "block"]
    idx = F.sequence(F.lit(2), F.size("block"))  # 1-based positions 2..n are predicted

    def gram(i):
        fields = [F.element_at("block", i).alias("w"), (i == 2).alias("first")]
        for k in range(1, order):
            fields.append(F.when(i - k >= 1, F.element_at("block", F.greatest(i - k, F.lit(1)))).alias(f"c{k}"))
        return F.struct(*fields)

    g = blk.select(*keep, F.explode(F.transform(idx, gram)).alias("g"))
    return g.select(*keep, "g.*")


def _numbering() -> defaultdict:
    """Numbers what it is asked for, from 0."""
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__
    return numbers


class _Words:
    """Numbers of the distinct words of texts; the texts are looked at once for all models."""

    def __init__(self):
        self.numbers = _numbering()

    def by_side(self, sides: list[tuple], rows: list[list[str] | None]) -> list[tuple[tuple, np.ndarray, np.ndarray]]:
        """(side, numbers of the words of all its rows, words of each row)"""
        together: dict[tuple, list] = {}
        for side, row in zip(sides, rows):
            if row:
                together.setdefault(side, []).append(row)
        out = []
        for side, some in together.items():
            sizes = np.fromiter(map(len, some), np.int64, len(some))
            out.append((side, np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(some)), np.int64, int(sizes.sum())), sizes))
        return out


class _Portion:
    """A model's tokens as numbers, and the counts of the grams of those that went before, until these go on."""

    def __init__(self, block_size: int, order: int, words: _Words | None = None, coarser: dict | None = None, codes: dict | None = None):
        """``coarser``: by name, encoders that follow from this one's tokens (their ``known`` says which they keep). ``codes``: numbers of
        tokens that are the same in all tasks, which go on in their place."""
        self.block_size, self.order = block_size, order
        self.coarser, self.codes = coarser or {}, codes
        self.numbers = _numbering()  # of an encoder's tokens
        self.numbers[None]  # 0 is no token
        self.encoded = False
        self.meet(words or _Words())
        self.clear()

    def meet(self, words: _Words) -> None:
        """Words are numbered anew. An encoder's tokens keep their numbers, as its vocabulary bounds them."""
        self.words = words
        self.tokens, self.ends = np.empty(0, np.int64), np.zeros(1, np.int64)  # of the words met so far, one after the other
        self.single = True  # each word so far is one token

    def clear(self) -> None:
        self.held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}  # by side: keys of distinct grams in order, their numbers
        self.clear_tokens()

    def clear_tokens(self) -> None:
        self.ids: dict[tuple, tuple[list, list]] = {}  # by side: numbers of all rows, lengths
        self.size = 0

    def add(self, sides: list[tuple], rows: list[list[str] | None], encoder) -> None:
        self.take(self.words.by_side(sides, rows), encoder)

    def take(self, found: list[tuple[tuple, np.ndarray, np.ndarray]], encoder) -> None:
        """What ``words.by_side`` gave for a batch."""
        self.encoded = encoder is not None
        if self.encoded:
            self._encode(list(islice(self.words.numbers, len(self.ends) - 1, None)), encoder)
        for side, ids, sizes in found:
            if self.encoded and self.single:
                ids = self.tokens[ids]
            elif self.encoded:
                n = (self.ends[1:] - self.ends[:-1])[ids]
                ends = np.cumsum(n)
                row_ends = np.cumsum(sizes)
                begins = np.concatenate([[0], ends])
                sizes = begins[row_ends] - begins[row_ends - sizes]
                ids = self.tokens[np.arange(begins[-1]) + np.repeat(self.ends[ids] - (ends - n), n)]
            else:
                ids = ids + 1
            flat, lengths = self.ids.setdefault(side, ([], []))
            flat.append(ids)
            lengths.append(sizes)
            self.size += len(ids)

    def _encode(self, new: list[str], encoder) -> None:
        if not new:
            return
        if hasattr(encoder, "numbered"):
            tokens, n = encoder.numbered(new, self.numbers)
        else:
            made = list(encoder(new))
            n = np.fromiter(map(len, made), np.int64, len(made))
            tokens = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(made)), np.int64, int(n.sum()))
        self.single = self.single and bool((n == 1).all())
        self.tokens = np.concatenate([self.tokens, tokens])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n)])

    def names(self) -> list[str | None]:
        return list(self.numbers) if self.encoded else [None, *self.words.numbers]

    def _kinds(self) -> int:
        return len(self.numbers) if self.encoded else len(self.words.numbers) + 1

    def _grams(self, ids: np.ndarray, sizes: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
        """(distinct grams as rows w, c1, ..., first; numbers)"""
        n_blocks = -(-sizes // self.block_size)
        ends = np.cumsum(n_blocks)
        begins = np.repeat(np.cumsum(sizes) - sizes, n_blocks) + (np.arange(n_blocks.sum()) - np.repeat(ends - n_blocks, n_blocks)) * self.block_size
        after = [begins + k for k in range(self.order + 1)]
        after = [a[a < len(ids)] for a in after]  # tokens that close to a block's begin have no more context
        first = np.zeros(len(ids), np.int64)
        first[after[1]] = 1
        rest = np.ones(len(ids), bool)
        rest[begins] = False
        columns = [ids]
        for k in range(1, self.order):
            c = np.zeros(len(ids), np.int64)
            c[k:] = ids[:len(ids) - k]
            for near in after[:k]:
                c[near] = 0
            columns.append(c)
        bits = kinds.bit_length()
        if bits * self.order > 62:
            return np.unique(np.stack([c[rest] for c in [*columns, first]], axis=1), axis=0, return_counts=True)
        key = columns[0].copy()
        for c in columns[1:]:
            key <<= bits
            key |= c
        key <<= 1
        key |= first
        key, n = _distinct(key[rest], bits * self.order + 1)
        return _unpacked(key, self.order, bits), n

    def fold(self) -> None:
        """The tokens so far go into the counts held."""
        kinds = self._kinds()
        for side, (flat, sizes) in self.ids.items():
            grams, n = self._grams(np.concatenate(flat), np.concatenate(sizes), kinds)
            key = _packed(grams, 62 // self.order)
            if side in self.held:
                key, n = _summed(np.concatenate([self.held[side][0], key]), np.concatenate([self.held[side][1], n]))
            else:
                key, n = _summed(key, n)
            self.held[side] = key, n
        self.clear_tokens()

    def full(self) -> bool:
        """Whether its counts are to go on, after a batch."""
        if self.size < TOKENS_AT_ONCE:
            return False
        if self._kinds().bit_length() > 62 // self.order:  # no key holds a gram
            return True
        self.fold()
        return sum(len(key) for key, _ in self.held.values()) >= GRAMS_HELD

    def sums(self):
        """(side, distinct grams as rows w, c1, ..., first, numbers). Sides begin with the name of a model, where there is one; those of ``coarser``
        follow."""
        bits = 62 // self.order
        if self.ids and self._kinds().bit_length() <= bits:
            self.fold()
        for side, (key, n) in self.held.items():
            yield side, _unpacked(key, self.order, bits), n
        for side, (flat, sizes) in self.ids.items():
            yield side, *self._grams(np.concatenate(flat), np.concatenate(sizes), self._kinds())
        names = self.names()
        for other, encoder in self.coarser.items():
            kept = np.array([i if t is None or encoder.known(t) else self.numbers[encoder.unknown] for i, t in enumerate(names)], np.int64)
            for (_, *side), (key, n) in self.held.items():
                grams = _unpacked(key, self.order, bits)
                grams[:, :-1] = kept[grams[:, :-1]]
                key, n = _summed(_packed(grams, bits), n)
                yield (other, *side), _unpacked(key, self.order, bits), n

    def counted(self, schema: pa.Schema):
        """Batches of (*side, first, w, c1, ..., n)."""
        names = self.names()
        for side, grams, n in self.sums():
            yield from self._batches(side, grams, n, names, schema)

    def _batches(self, side: tuple, grams: np.ndarray, n: np.ndarray, names: list[str | None], schema: pa.Schema):
        names = pa.array(names if self.codes is None else [None, *[self.codes[t] for t in names[1:]]], schema.field("w").type)
        for s in range(0, len(n), ROWS_AT_ONCE):
            part = grams[s:s + ROWS_AT_ONCE]
            yield pa.RecordBatch.from_arrays([*[pa.array([v] * len(part), schema.field(j).type) for j, v in enumerate(side)],
                                              pa.array(part[:, -1] == 1), *[names.take(pa.array(part[:, k])) for k in range(self.order)],
                                              pa.array(n[s:s + ROWS_AT_ONCE], pa.int64())], schema=schema)


def _distinct(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and their numbers."""
    if bits > 22:
        return np.unique(key, return_counts=True)
    bins = np.bincount(key, minlength=1)
    key = np.flatnonzero(bins)
    return key, bins[key]


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sums of their numbers."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[begins], np.add.reduceat(n, begins)


def _packed(grams: np.ndarray, bits: int) -> np.ndarray:
    """Rows w, c1, ..., first as keys."""
    key = np.zeros(len(grams), np.int64)
    for k in range(grams.shape[1] - 1):
        key = key << bits | grams[:, k]
    return key << 1 | grams[:, -1]


def _unpacked(key: np.ndarray, order: int, bits: int) -> np.ndarray:
    out = np.empty((len(key), order + 1), np.int64)
    out[:, -1] = key & 1
    key = key >> 1
    for k in reversed(range(order)):
        out[:, k] = key & (1 << bits) - 1
        key = key >> bits
    return out


def _followers(encoders: dict, order: int) -> dict:
    """By name, the encoders whose texts are encoded, each with those (by name) whose tokens follow from its own: the grams of a smaller
    lexical vocabulary are those of a larger one, with its other tokens unknown."""
    out: dict = {}
    for name, encoder in sorted(encoders.items(), key=lambda e: -len(getattr(e[1], "vocab", ()))):
        finer = next((n for n in out if hasattr(encoder, "follows") and encoder.follows(encoders[n])
                      and (len(encoders[n].vocab) + 2).bit_length() <= 62 // order), None)
        if finer is None:
            out[name] = {}
        else:
            out[finer][name] = encoder
    return out


def full_portions(batches, n_sides: int, block_size: int, order: int, words_of, encoders: dict, named: bool, codes: dict | None = None):
    """Portions of a task's batches of (*sides, tokens or text) whose counts are to go on: each text is looked at once, whatever the number of
    encoders. A portion starts anew behind its ``yield``."""
    words = _Words()
    portions = {name: _Portion(block_size, order, words, coarser, (codes or {}).get(name)) for name, coarser in _followers(encoders, order).items()}

    def done(names):
        for name in names:
            yield portions[name]
            portions[name].clear()

    for b in batches:
        if len(words.numbers) >= WORDS_AT_ONCE:
            words = _Words()
            yield from done([name for name in portions if encoders[name] is None])
            for portion in portions.values():
                portion.meet(words)
        rows = b.column(n_sides).to_pylist()
        if words_of is not None:
            rows = [None if t is None else words_of(t) for t in rows]
        found = words.by_side(list(zip(*(b.column(j).to_pylist() for j in range(n_sides)))), rows)
        for name, portion in portions.items():
            portion.take([((name, *side) if named else side, ids, sizes) for side, ids, sizes in found], encoders[name])
            if portion.full():
                yield from done([name])
    yield from done(portions)


def counted_batches(batches, schema: pa.Schema, n_sides: int, block_size: int, order: int, words_of, encoders: dict, named: bool):
    """What ``gram_counts`` does with a task's batches."""
    codes = {name: {t: i for i, t in enumerate(sorted(encoders[name].tokens()))} if pa.types.is_integer(schema.field("w").type) else None for name in encoders}
    for portion in full_portions(batches, n_sides, block_size, order, words_of, encoders, named, codes):
        yield from portion.counted(schema)


def gram_counts(texts: DataFrame, tokens_col: str, block_size: int, order: int, by: Sequence[str] = (), words_of=None, encoders: dict | None = None,
                numbered: bool = False) -> DataFrame:
    """F1 and the counts of F2: (*by, split, label, first, w, c1, ..., n), a row for each distinct gram of a portion of rows.

    ``tokens_col`` holds tokens, or texts where ``words_of`` finds words. Each of ``encoders`` is a model, named in a further column
    ``cell``: ``encoder(words)`` gives each word's tokens. They are broadcast (their size is bounded by the vocabulary); a text is read and its words are
    found once for all of them, and a word is encoded where it is new. With ``numbered``, where all encoders can list their ``tokens()``, w and
    c1, ... are numbers of tokens, the same ones in all tasks for a cell. As ``blocks`` and ``ngrams``, without a row for each occurrence."""
    spark = texts.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(encoders or {None: None})
    cell, sides = ["cell"] if encoders else [], [*by, "split", "label"]
    types = {f.name: f.dataType for f in texts.schema.fields}
    token = IntegerType() if numbered and encoders and all(hasattr(e, "tokens") for e in encoders.values()) else StringType()
    fields = StructType([*[StructField(c, StringType()) for c in cell], *[StructField(c, types[c]) for c in sides], StructField("first", BooleanType()),
                         StructField("w", token), *[StructField(c, token) for c in _context(order)], StructField("n", LongType())])
    schema = to_arrow_schema(fields)

    def run(batches):
        yield from counted_batches(batches, schema, len(sides), block_size, order, words_of, shared.value, bool(cell))

    return texts.select(*sides, tokens_col).mapInArrow(run, fields)


def gram_table(grams: DataFrame, order: int, slices: dict[str, Column], by: Sequence[str]) -> DataFrame:
    """One row for each distinct gram, written once: its occurrences in training (n) and in each slice, how many of these are a block's
    first, and what its context has in training (total, kinds of followers). The one shuffle of all grams here is by context."""
    n, first = F.col("n"), F.col("first")
    aggs = [F.sum(F.when(F.col("split") == side, n).otherwise(0)).alias(f"_{side}") for side in ("train", "test")]
    for name, cond in slices.items():
        aggs += [F.sum(F.when(cond, n).otherwise(0)).alias(f"_n_{name}"), F.sum(F.when(cond & first, n).otherwise(0)).alias(f"_f_{name}")]
    dealt = grams.repartition(*[F.col(c) for c in [*by, *(_context(order) or ["w"])]])
    table = dealt.groupBy(*by, *_context(order), "w").agg(*aggs).withColumn("n", F.col("_train"))
    return cut_lineage(_with_context(table, order, by))


def _context(k: int) -> list[str]:
    return [f"c{j}" for j in range(1, k)]


def _with_context(table: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """total and kinds of what follows each context; the lowest order has one context a model, whose sums are in ``_sizes``."""
    if k == 1:
        return table
    w = Window.partitionBy(*by, *_context(k))
    return table.select("*", F.sum("n").over(w).alias("total"), F.count_if(F.col("n") > 0).over(w).alias("kinds"))


def _sizes(table: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """Of each model, an order's discount, occurrences and distinct grams."""
    whole = table.filter((F.col("n") > 0) & (F.col(f"c{k - 1}").isNotNull() if k > 1 else F.lit(True)))
    n1, n2 = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    return whole.groupBy(*by).agg(F.when((n1 > 0) & (n2 > 0), n1 / (n1 + 2 * n2)).otherwise(F.lit(DISCOUNT)).alias("_d"),
                                  F.sum("n").alias("_total"), F.count(F.lit(1)).alias("_kinds"))


def score(table: DataFrame, order: int, by: Sequence[str]) -> DataFrame:
    """-log p of every gram of a ``gram_table`` (column ``nll``). Lower orders are tables of their own distinct grams, with the probability
    that the next order falls back to: all grams are shuffled to count the ones of the next order, and to meet their probabilities."""
    tables = {order: table}
    for k in range(order - 1, 0, -1):  # distinct left neighbours in training; no neighbour is one
        shorter = tables[k + 1].groupBy(*by, *_context(k), "w").agg(F.count_if(F.col("n") > 0).alias("n"))
        tables[k] = cut_lineage(_with_context(shorter, k, by))
    below = None
    for k in range(1, order + 1):
        s = tables[k].join(F.broadcast(_sizes(tables[k], k, by)), list(by), "left")  # a row for each model
        if k == 1:
            s = s.select("*", F.col("_total").alias("total"), F.col("_kinds").alias("kinds"), (1 / (F.col("_kinds") + 1.0)).alias("_p"))
        else:
            keys = [*by, *_context(k - 1), "w"]
            below = below.select(*[F.col(c).alias(f"_k_{c}") for c in keys], "_p")
            s = s.join(below, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]), "left").drop(*[f"_k_{c}" for c in keys])
        d, known = F.coalesce("_d", F.lit(DISCOUNT)), F.col("total") > 0
        if k > 1:
            known = known & F.col(f"c{k - 1}").isNotNull()
        p = F.when(known, (F.greatest(F.col("n") - d, F.lit(0.0)) + d * F.col("kinds") * F.col("_p")) / F.col("total")).otherwise(F.col("_p"))
        below = s.withColumn("_p", p).drop("_d", "_total", "_kinds")
    return below.withColumn("nll", -F.log("_p"))


def missing_sides(table: DataFrame, by: Sequence[str]) -> list[tuple[dict, str]]:
    """(key, side) of the models without a block on a side; a key with no grams at all isn't known here."""
    have = table.groupBy(*by).agg(F.sum("_train").alias("train"), F.sum("_test").alias("test")).collect()  # a row a model
    return [({k: r[k] for k in by}, side) for r in have for side in ("train", "test") if not r[side]]


def no_block(side: str) -> str:
    return f"language model: the {side} side has no block of two or more tokens"


def evaluate(table: DataFrame, order: int, slices: dict[str, Column], by: Sequence[str]) -> DataFrame:
    """F2-F5 on a ``gram_table``: loss / ppl / blocks per slice; a row for each model of ``by``."""
    # every block has exactly one first predicted position: counting those counts blocks
    blocks_of = table.groupBy(*by).agg(*[F.sum(f"_f_{name}").alias(f"_blocks_{name}") for name in slices])
    weights = [f"_n_{name}" for name in slices]
    lean = table.select(*by, *_context(order), "w", "n", *(["total", "kinds"] if order > 1 else []), *weights)
    loss = score(lean, order, by).groupBy(*by).agg(*[
        F.try_divide(F.sum(F.when(F.col(f"_n_{name}") > 0, F.col(f"_n_{name}") * F.col("nll"))), F.sum(f"_n_{name}")).alias(f"_loss_{name}") for name in slices])
    return loss.join(F.broadcast(blocks_of), list(by))


def lm_record(agg: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """the 12 LM result fields (train_loss = F3 on the train side)."""
    def loss(n):
        return F.col(f"_loss_{n}")

    def ppl(n):
        return F.exp(F.col(f"_loss_{n}"))

    return agg.select(
        *by, ppl("test").alias("ppl"), loss("test").alias("eval_loss"), loss("train").alias("train_loss"),
        ppl("en").alias("ppl_en"), loss("en").alias("loss_en"), F.col("_blocks_en").cast("int").alias("test_en_blocks"),
        ppl("target").alias("ppl_target"), loss("target").alias("loss_target"),
        F.col("_blocks_target").cast("int").alias("test_target_blocks"),
        (F.col("_loss_target") - F.col("_loss_en")).alias("gap_loss"),
        F.col("_blocks_train").cast("int").alias("train_blocks"), F.col("_blocks_test").cast("int").alias("test_blocks"))


def standard_slices(target_lang: str) -> dict[str, Column]:
    sp, lab = F.col("split"), F.col("label")
    return {"train": sp == "train", "test": sp == "test", "en": (sp == "test") & (lab == "en"),
            "target": (sp == "test") & (lab == target_lang)}


def lm_for_grams(grams: DataFrame, order: int, target_lang: str, by: Sequence[str] = ()) -> tuple[DataFrame, list[tuple[dict, str]]]:
    """F1-F5 on ``gram_counts``: (an LM record for each model, what F6 finds). Without ``by``, a finding is an error."""
    keys, slices = list(by) or ["_model"], standard_slices(target_lang)
    table = gram_table(grams if by else grams.withColumn("_model", F.lit(0)), order, slices, keys)
    missing = missing_sides(table, keys)
    if not by and (missing or not table.limit(1).count()):
        raise ValueError(no_block(missing[0][1] if missing else "train"))
    return lm_record(evaluate(table, order, slices, keys), by), missing


def lm_for_tokens(seqs: DataFrame, block_size: int, order: int, target_lang: str, by: Sequence[str] = ()) -> tuple[DataFrame, list[tuple[dict, str]]]:
    """F1-F5 on token sequences (column ids)."""
    return lm_for_grams(gram_counts(seqs, "ids", block_size, order, by), order, target_lang, by)

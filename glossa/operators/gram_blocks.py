"""The LM of ``ngram_lm`` on compressed blocks of grams, for tables of grams that are larger than their text.

A task's portion of grams goes on as blocks: for each bucket the portion's words, then sorted keys of their local numbers, as differences, compressed.
Buckets go by a gram's nearest context word c1, so that all counts of the orders from 2 on are made where the bucket's blocks meet; slices
of a bucket go by c2, and only one slice at a time is held, with the bucket's pairs. The lowest order has one number a word, which are asked from
the tasks that sum up a share of the words. Sizes and discounts of a model are a few numbers, which the driver has. Rows pass from task to task as blocks only;
nothing else is written.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators import ngram_lm as LM
from glossa.session import cut_lineage, local_frame, ship_package

SLICE_NAMES = ("train", "test", "en", "target")
#: Slices of a bucket, by the second context word.
PARTS = 8
KEY_BITS = 62
#: A portion's side: train, or test with the slices that its label is in.
TRAIN, TEST, EN, TARGET = 0, 1, 1, 2
SIDE_BITS = 4  # with whether a gram is its block's first
MERGED, PAIRS, ASKED, STATS, ANSWER = range(5)
WORDS, ANSWERS, PAIRS_AT = -1, -2, -1  # slices that come first
_SENT = pa.schema([("cell", pa.string()), ("bucket", pa.int32()), ("slice", pa.int32()), ("portion", pa.int64()), ("block", pa.binary())])
_KEPT = pa.schema([("cell", pa.string()), ("kind", pa.int32()), ("bucket", pa.int32()), ("slice", pa.int32()), ("block", pa.binary())])
_SQL = {"sent": "cell string, bucket int, slice int, portion long, block binary", "kept": "cell string, kind int, bucket int, slice int, block binary"}


# ------------------------------------------------------------------- blocks
def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 on, by planes of bytes, compressed."""
    head, body = [len(arrays)], []
    for a in arrays:
        width = max(1, -(-int(a.max(initial=0)).bit_length() // 8))
        head += [len(a), width]
        body.append(np.ascontiguousarray(a, "<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    raw = np.array(head, "<i8").tobytes() + b"".join(body)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _opened(block: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(memoryview(block)[8:], int.from_bytes(block[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 2 * n, 8).tolist(), 8 + 16 * n, []
    for size, width in zip(head[::2], head[1::2]):
        a = np.zeros((size, 8), np.uint8)
        a[:, :width] = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
        out.append(a.view("<i8").ravel())
        at += size * width
    return out


def _rows(cols: list[np.ndarray], bits: list[int], *rest: np.ndarray) -> bytes:
    """A block of rows; in the order of ``cols`` where a key holds them, else as they come."""
    if sum(bits) > KEY_BITS:
        return _squeezed(np.array([0, *bits]), *cols, *rest)
    key = cols[0]
    for c, b in zip(cols[1:], bits[1:]):
        key = key << b | c
    order = np.argsort(key, kind="stable")
    return _squeezed(np.array([1, *bits]), np.diff(key[order], prepend=0), *[r[order] for r in rest])


def _read(block: bytes) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """(bits, cols, rest) of ``_rows``"""
    (packed, *bits), *arrays = (a if i else a.tolist() for i, a in enumerate(_opened(block)))
    if not packed:
        return bits, arrays[:len(bits)], arrays[len(bits):]
    key, cols = np.cumsum(arrays[0]), []
    for b in reversed(bits):
        cols.append(key & (1 << b) - 1)
        key = key >> b
    return bits, cols[::-1], arrays[1:]


def _text(words: pa.StringArray) -> list[np.ndarray]:
    """(lengths, bytes) of some words"""
    if not len(words):
        return [np.empty(0, np.int64)] * 2
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    return [np.diff(ends), np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]].astype(np.int64)]


def _words(lengths: np.ndarray, text: np.ndarray) -> pa.StringArray:
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends.tobytes()), pa.py_buffer(text.astype(np.uint8).tobytes()))


def _hashes(words: Sequence[str]) -> np.ndarray:
    return np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))


def _key(cols: list[np.ndarray], kinds: int) -> np.ndarray:
    """A number for each row, in the order of ``cols``, whose numbers are below ``kinds``."""
    bits = int(kinds).bit_length()
    key, held = cols[0], bits
    for c in cols[1:]:
        if held + bits > KEY_BITS:
            found, key = np.unique(key, return_inverse=True)
            held = len(found).bit_length()
        key, held = key << bits | c, held + bits
    return key


def _runs(key: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)


# ------------------------------------------------------------- from the texts
def side_of(split: str, label: str | None, target: str) -> int | None:
    return TRAIN if split == "train" else TEST + EN * (label == "en") + TARGET * (label == target) if split == "test" else None


def _dealt(sides: list[tuple[int, np.ndarray, np.ndarray]], names: pa.StringArray, hashes: np.ndarray, order: int, n_buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, slice, block) of a portion's grams (side, rows w, c1, ..., first, numbers); number 0 of ``names`` is no word."""
    grams, n = np.concatenate([g for _, g, _ in sides]), np.concatenate([k for _, _, k in sides])
    side = (np.repeat([s for s, _, _ in sides], [len(k) for _, _, k in sides]) << 1 | grams[:, -1]).astype(np.int32)
    cols = [*(grams[:, k] for k in range(1, order)), grams[:, 0]]
    part = (hashes[cols[1]] >> 16) % PARTS if order > 2 else np.zeros(len(n), np.int64)
    place = hashes[cols[0]] % n_buckets * PARTS + part
    by = np.argsort(place, kind="stable")
    place, cols, side, n = place[by], [c[by] for c in cols], side[by], n[by]
    del grams, part, by
    local, used = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    cuts = _runs(place // PARTS)
    for s, e in zip(cuts, [*cuts[1:], len(place)]):
        used[:] = False
        for c in cols:
            used[c[s:e]] = True
        used[0] = False
        mine = np.flatnonzero(used)
        local[mine] = np.arange(1, len(mine) + 1)
        bucket, bits = int(place[s]) // PARTS, [len(mine).bit_length()] * order + [SIDE_BITS]
        yield bucket, WORDS, _squeezed(*_text(names.take(pa.array(mine))))
        inner = _runs(place[s:e]) + s
        for a, z in zip(inner, [*inner[1:], e]):
            yield bucket, int(place[a]) % PARTS, _rows([*(local[c[a:z]] for c in cols), side[a:z]], bits, n[a:z])


def sent_grams(texts: DataFrame, tokens_col: str, block_size: int, order: int, target: str, n_buckets: int, words_of: Callable | None = None,
               encoders: dict | None = None) -> DataFrame:
    """F1 and the counts of F2 as blocks; ``texts`` and the models are those of ``ngram_lm.gram_counts``, the column ``cell`` is null without ``encoders``."""
    spark = texts.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(encoders or {None: None})

    def run(batches):
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        for portion in LM.full_portions(batches, 2, block_size, order, words_of, shared.value, True):
            names = ["", *portion.names()[1:]]
            hashes, table, cells = _hashes(names), pa.array(names, pa.string()), {}
            hashes[0] = 0
            for (cell, split, label), grams, n in portion.sums():
                if len(n) and (side := side_of(split, label, target)) is not None:
                    cells.setdefault(cell, []).append((side, grams.astype(np.int32), n))
            for cell, sides in cells.items():
                for rows in _some(_dealt(sides, table, hashes, order, n_buckets)):
                    buckets, slices, blocks = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array([cell] * len(rows), pa.string()), pa.array(buckets, pa.int32()), pa.array(slices, pa.int32()),
                                                      pa.array([number] * len(rows), pa.int64()), pa.array(blocks, pa.binary())], schema=_SENT)
            number += 1

    return texts.select("split", "label", tokens_col).mapInArrow(run, _SQL["sent"])


def _some(rows: Iterator[tuple], n: int = 64) -> Iterator[list[tuple]]:
    out = []
    for r in rows:
        out.append(r)
        if len(out) == n:
            yield out
            out = []
    if out:
        yield out


# ------------------------------------------------------------ in the buckets
def _in_order(batches) -> Iterator[tuple]:
    """Rows as tuples, a bucket's next to each other."""
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _kept(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for some in _some(rows):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), _KEPT.types)], schema=_KEPT)


def _shorter(cols: list[np.ndarray], n: np.ndarray, kinds: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The grams without their last context word: (cols, distinct words met there in training, the row of each one given)."""
    less = [*cols[:-2], cols[-1]]
    _, at, row = np.unique(_key(less, kinds), return_index=True, return_inverse=True)
    return [c[at] for c in less], np.bincount(row, n > 0, len(at)).astype(np.int64), row


def _ones_and_twos(n: np.ndarray, whole: np.ndarray | bool = True) -> list[int]:
    return [int(((n == k) & whole).sum()) for k in (1, 2)]


def merged_rows(batches, order: int, n_buckets: int) -> Iterator[tuple]:
    """Of each bucket: its distinct grams by slice, its pairs, what it asks of its words and its numbers of each order."""
    for (cell, bucket), rows in groupby(_in_order(batches), lambda r: r[:2]):
        blocks = np.zeros(len(SLICE_NAMES), np.int64)
        tokens, twos = blocks.copy(), np.zeros((order + 1, 2), np.int64)
        pairs: list[tuple[list[np.ndarray], np.ndarray]] = []
        for part, some in groupby(rows, lambda r: r[2]):
            some = list(some)
            if part == WORDS:
                texts = [_words(*_opened(r[4])) for r in some]
                names = pa.concat_arrays(texts).dictionary_encode()
                number, names = names.indices.to_numpy().astype(np.int64) + 1, names.dictionary
                ends = np.cumsum([len(t) for t in texts])
                number_of = {r[3]: np.concatenate([[0], number[e - len(t):e]]) for r, t, e in zip(some, texts, ends)}
                kinds = len(names) + 1
                bits = kinds.bit_length()
                continue
            found = [(number_of[r[3]], *_read(r[4])[1:]) for r in some]
            cols = [np.concatenate([number[c[k]] for number, c, _ in found]) for k in range(order)]
            side, n = np.concatenate([c[order] for _, c, _ in found]), np.concatenate([rest[0] for _, _, rest in found])
            key = _key(cols, kinds)
            by = np.argsort(key, kind="stable")
            begins = _runs(key[by])
            side, n, cols = side[by], n[by], [c[by[begins]] for c in cols]
            first, side = (side & 1) > 0, side >> 1
            row = np.repeat(np.arange(len(begins)), np.diff([*begins, len(n)]))
            members = (side == TRAIN, side >= TEST, (side >= TEST) & ((side - TEST) & EN > 0), (side >= TEST) & ((side - TEST) & TARGET > 0))
            weights = [np.bincount(row[m], n[m], len(begins)).astype(np.int64) for m in members]
            blocks += [int(n[m & first].sum()) for m in members]
            tokens += [int(w.sum()) for w in weights]
            yield cell, MERGED, bucket, part, _rows(cols, [bits] * order, *weights)
            level, k = (cols, weights[0]), order
            while k > 2:
                twos[k] += _ones_and_twos(level[1], level[0][k - 2] > 0)
                level, k = _shorter(*level, kinds)[:2], k - 1
            pairs.append(level)
        cols, n = [np.concatenate([p[0][k] for p in pairs]) for k in range(min(order, 2))], np.concatenate([p[1] for p in pairs])
        if order > 2:  # a pair has a row in many slices
            found, row = np.unique(_key(cols, kinds), return_inverse=True)
            cols, n = [found >> bits, found & (1 << bits) - 1], np.bincount(row, n, len(found)).astype(np.int64)
            yield cell, PAIRS, bucket, PAIRS_AT, _rows(cols, [bits] * 2, n)
        if order > 1:
            twos[2] += _ones_and_twos(n)
        yield cell, STATS, bucket, 0, _squeezed(blocks, tokens, twos.ravel())
        sums = np.bincount(cols[-1], n > 0 if order > 1 else n, kinds).astype(np.int64)
        asked = np.unique(cols[-1])
        words = names.take(pa.array(asked - 1))
        place = _hashes(words.to_pylist()) % n_buckets
        by = np.argsort(place, kind="stable")
        cuts = _runs(place[by])
        for s, e in zip(cuts, [*cuts[1:], len(by)]):
            mine = by[s:e]
            yield cell, ASKED, int(place[mine[0]]), bucket, _squeezed(*_text(words.take(pa.array(mine))), asked[mine], sums[asked[mine]])


def answers(batches) -> Iterator[tuple]:
    """The lowest order: each word's sum over all buckets, for those that asked, and the numbers of words."""
    for (cell, bucket), rows in groupby(((c, b, s, block) for c, _, b, s, block in _in_order(batches)), lambda r: r[:2]):
        asked = [(s, *_opened(block)) for _, _, s, block in rows]
        texts = [_words(lengths, text) for _, lengths, text, _, _ in asked]
        number = pa.concat_arrays(texts).dictionary_encode().indices.to_numpy()
        sums = np.bincount(number, np.concatenate([n for *_, n in asked])).astype(np.int64)
        met = sums[sums > 0]
        yield cell, STATS, bucket, 0, _squeezed(np.array([*_ones_and_twos(met), met.sum(), len(met)], np.int64))
        at = 0
        for (s, _, _, ids, _), t in zip(asked, texts):
            yield cell, ANSWER, s, ANSWERS, _squeezed(ids, sums[number[at:at + len(t)]])
            at += len(t)


def _interpolated(contexts: list[np.ndarray], n: np.ndarray, whole: np.ndarray | bool, d: float, below: np.ndarray, kinds: int) -> np.ndarray:
    """probabilities of an order's grams, which are sorted by context."""
    begins = _runs(_key(contexts, kinds))
    sizes = np.diff([*begins, len(n)])
    total, followers = (np.repeat(np.add.reduceat(x, begins), sizes) for x in (n, (n > 0).astype(np.int64)))
    return np.where((total > 0) & whole, (np.maximum(n - d, 0.0) + d * followers * below) / np.maximum(total, 1), below)


def bucket_losses(batches, order: int, models: dict[str | None, dict]) -> Iterator[tuple]:
    """(cell, sums of -log p of each slice) of each bucket."""
    for (cell, _), rows in groupby(((c, b, s, block) for c, _, b, s, block in _in_order(batches)), lambda r: r[:2]):
        model, sums = models[cell], np.zeros(len(SLICE_NAMES))
        d = model["discounts"]
        for part, some in groupby(rows, lambda r: r[2]):
            if part == ANSWERS:
                ids, n = (np.concatenate(x) for x in zip(*(_opened(r[3]) for r in some)))
                lowest = np.zeros(int(ids.max()) + 1)
                lowest[ids] = (np.maximum(n - d[1], 0.0) + d[1] * model["kinds"] / (model["kinds"] + 1.0)) / model["total"]
                continue
            (_, _, _, block), = some
            (bits, *_), cols, rest = _read(block)
            if part == PAIRS_AT:
                pair_keys, pair_p = cols[0] << bits | cols[1], _interpolated(cols[:1], rest[0], True, d[2], lowest[cols[1]], 1 << bits)
                continue
            kinds = (1 << bits) - 1
            levels, below_row = [(cols, rest[0])], []
            while len(levels[-1][0]) > 3:
                *level, row = _shorter(*levels[-1], kinds)
                levels.append(level)
                below_row.append(row)
            near = levels[-1][0]
            p = pair_p[np.searchsorted(pair_keys, near[0] << bits | near[-1])] if order > 2 else lowest[near[-1]]
            for at in reversed(range(len(levels))):
                c, n = levels[at]
                if len(c) > 1:
                    p = _interpolated(c[:-1], n, c[-2] > 0, d[len(c)], p, kinds)
                if at:
                    p = p[below_row[at - 1]]
            nll = -np.log(p)
            sums += [float((nll * w).sum()) for w in rest]
        yield cell, *sums.tolist()


# ---------------------------------------------------------------- the models
def buckets(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _met(df: DataFrame, *sort: str) -> DataFrame:
    """A bucket's rows next to each other."""
    parts = buckets(df.sparkSession)
    return df.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("cell", "bucket", *sort)


def kept_grams(sent: DataFrame, order: int, n_buckets: int) -> DataFrame:
    """the counts of all orders from 2 on, by bucket, written once; the texts are not read again."""
    return cut_lineage(_met(sent, "slice", "portion").mapInArrow(lambda batches: _kept(merged_rows(batches, order, n_buckets)), _SQL["kept"]))


def lm_losses(kept: DataFrame, order: int) -> dict[str | None, dict]:
    """F2-F5 on ``kept_grams``: for each cell the losses, tokens and blocks of the slices (a loss is None without tokens or training)."""
    told = cut_lineage(_met(kept.filter(F.col("kind") == ASKED), "slice").mapInArrow(lambda batches: _kept(answers(batches)), _SQL["kept"]))
    models: dict[str | None, dict] = {}
    for r in kept.filter(F.col("kind") == STATS).toArrow().to_pylist():  # a row a bucket and cell
        blocks, tokens, twos = _opened(r["block"])
        m = models.setdefault(r["cell"], {"blocks": 0, "tokens": 0, "twos": 0, "lowest": 0, "sums": []})
        m["blocks"], m["tokens"], m["twos"] = m["blocks"] + blocks, m["tokens"] + tokens, m["twos"] + twos.reshape(order + 1, 2)
    for r in told.filter(F.col("kind") == STATS).toArrow().to_pylist():
        models[r["cell"]]["lowest"] = models[r["cell"]]["lowest"] + _opened(r["block"])[0]
    trained = {}
    for cell, m in models.items():
        *m["twos"][1], total, kinds = m["lowest"].tolist()
        if total:
            trained[cell] = {"total": total, "kinds": kinds, "discounts": [n1 / (n1 + 2 * n2) if n1 and n2 else LM.DISCOUNT for n1, n2 in m["twos"].tolist()]}
    rows = kept.filter(F.col("kind").isin(MERGED, PAIRS)).unionByName(told.filter(F.col("kind") == ANSWER))
    if len(trained) < len(models):
        rows = rows.filter(F.col("cell").isin([c for c in trained if c is not None]))

    def run(batches):
        for some in _some(bucket_losses(batches, order, trained)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), [pa.string()] + [pa.float64()] * len(SLICE_NAMES))], ["cell", *SLICE_NAMES])

    if trained:
        for r in _met(rows, "slice").mapInArrow(run, "cell string, " + ", ".join(f"{s} double" for s in SLICE_NAMES)).toArrow().to_pylist():  # a row a bucket and cell
            models[r["cell"]]["sums"].append([r[s] for s in SLICE_NAMES])
    return {cell: {"tokens": m["tokens"].tolist(), "blocks": m["blocks"].tolist(),
                   "losses": [math.fsum(s) / n if n and cell in trained else None for s, n in zip(zip(*m["sums"]) if m["sums"] else [()] * len(SLICE_NAMES), m["tokens"].tolist())]}
            for cell, m in models.items()}


def lm_records(spark, models: dict[str | None, dict]) -> tuple[DataFrame, list[tuple[str | None, str]]]:
    """(an LM record for each cell, (cell, side) of those without a block on a side)."""
    rows = [(cell, *m["losses"], *m["blocks"]) for cell, m in models.items()]
    schema = ", ".join(["cell string", *[f"_loss_{s} double" for s in SLICE_NAMES], *[f"_blocks_{s} long" for s in SLICE_NAMES]])
    missing = [(cell, side) for cell, m in models.items() for side, n in zip(("train", "test"), m["tokens"]) if not n]
    return LM.lm_record(local_frame(spark, rows, schema), ["cell"]), missing

"""Suffix-array dedup: remove every byte covered by a ``WINDOW``-byte string that starts earlier elsewhere.

Equal windows must meet before their suffixes can be sorted together, without shipping each window. A window's key is
the smallest hash of its ``GRAM``-byte substrings: equal windows have equal keys, and neighbours mostly share one, so a run of
windows with one key travels as one short string, its context. Then

1. every key is counted over the corpus (only the distinct keys of a batch are shuffled), and keys met once are forgotten:
   their windows occur once;
2. the contexts of the other keys are collected, equal ones of a batch as one row with their first place (so a passage
   in a third of all documents stays small); a key that is met very often is split by a second hash of the windows, and
   where a split key still has many distinct contexts (the windows over the edge of a common passage, where each document
   goes on differently) every window goes by a hash of all its bytes, so that none but equal windows share a key;
3. contexts with a key meet in one task, where equal ones are one again and a suffix array is built by two-stage
   sorting; runs of adjacent suffixes with a common prefix of ``WINDOW`` bytes are equal strings, and the earliest place
   of each is kept;
4. each document gets its kept windows back; its other windows with a repeated key are copies, and the bytes they
   cover go.

A text equal to that of a smaller ``doc_id`` repeats it wholly and needs no contexts. Hashes only bring strings
together; equality is that of the sorted bytes. Texts cross the shuffles compressed.

Rows that share a ``doc_id`` (or have none) are told apart by a 64-bit hash of their texts, so every list is that of one
text, however many rows an id has.

Defined results: a null or empty text has no bytes; texts shorter than the window lose nothing; null ids come after all
others, as one document; rows that share a ``doc_id`` are versions of one document, where an earlier start is earlier, and at
equal starts the text with the smaller hash; equal rows have equal results; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import as_bytes, map_docs, store
from glossa.llm.suffix_sort import adjacent_equal, joined, suffix_order, words8

WINDOW, GRAM = 100, 20
#: Windows hashed at a time, bytes sorted at a time, and occurrences of a key above which it is split.
CHUNK, BLOCK_BYTES, CROWD = 1 << 18, 3 << 20, 20_000
#: Crowded keys of texts and texts that have some, up to which they are broadcast (at most 32 MB) instead of the texts shuffled.
BROADCAST_KEYS = 1 << 20
LAST = (1 << 63) - 1

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Multipliers of the first and the second hash of a substring.
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 4 * WINDOW), base & (2**64 - 1), _U)
        steps[0] = 1
        _powers[base] = have = np.multiply.accumulate(steps)
    return have[:n]


# ---- keys of windows ----------------------------------------------------------------------------

def gram_hashes(text: np.ndarray, gram: int, level: int = 0) -> np.ndarray:
    """Hash of the ``gram`` bytes from each place on: a polynomial modulo 2**64, mixed."""
    n = len(text) - gram + 1
    total = np.zeros(len(text) + 1, _U)
    np.cumsum((text.astype(_U) + _U(1)) * _power(_BASE, len(text)), out=total[1:])
    h = (total[gram:] - total[:-gram]) * _power(pow(_BASE, -1, 1 << 64), n)
    h ^= h >> _U(29)
    h *= _U(_MIX[level])
    h ^= h >> _U(32)
    return h


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over each ``width`` neighbours, by doubling."""
    w = 1
    while 2 * w <= width:
        x = pick(x[:-w], x[w:])
        w *= 2
    return pick(x[:len(x) - (width - w)], x[width - w:]) if width > w else x


def window_keys(text: np.ndarray, window: int, gram: int, level: int = 0):
    """(first window, key of each window, hash of each gram) of the text, a chunk at a time."""
    for at in range(0, max(0, len(text) - window + 1), CHUNK):
        h = gram_hashes(text[at:at + CHUNK + window - 1], gram, level)
        yield at, sliding(h, window - gram + 1, np.minimum), h


def text_keys(text: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The key of every place that is the smallest gram of some window: a window repeated anywhere, even in the
    same run of windows, shows as a key met twice."""
    out = []
    width = window - gram + 1
    for _, key, h in window_keys(text, window, gram):
        edge = np.zeros(width - 1, _U)
        out.append(h[h == sliding(np.concatenate([edge, key, edge]), width, np.maximum)])
    return np.concatenate(out) if out else np.zeros(0, _U)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view("i1"), [0]])))
    return edge[::2], edge[1::2]


def _within(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which ``values`` are in the sorted ``chosen``."""
    if not len(chosen):
        return np.zeros(len(values), bool)
    return chosen[np.minimum(np.searchsorted(chosen, values), len(chosen) - 1)] == values


def contexts(text: np.ndarray, keys: np.ndarray, crowded: np.ndarray, window: int, gram: int, dense: np.ndarray = np.zeros(0, _U)):
    """(key, start, end) arrays of the runs of windows with one key, of sorted ``keys`` and ``crowded`` ones; the windows of
    a crowded key go by that key and another hash, and those of them whose split key is ``dense`` each by its own
    bytes. Runs are cut between chunks, which only makes more contexts."""
    for at, key, _ in window_keys(text, window, gram):
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        many = np.diff(np.append(cut, len(key)))
        plain, crowd = (np.repeat(_within(key[cut], k), many) for k in (keys, crowded))
        if crowd.any():
            part = text[at:at + len(key) + window - 1]
            other = sliding(gram_hashes(part, gram, 1), window - gram + 1, np.minimum)
            key = np.where(crowd, (key ^ (other >> _U(1))) * _U(_BASE), key)
            alone = crowd & _within(key, dense)
            if alone.any():
                key = np.where(alone, gram_hashes(part, window, 1), key)
            cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (crowd[1:] != crowd[:-1]) | alone[1:] | alone[:-1]))
        end = np.append(cut[1:], len(key))
        chosen = (plain | crowd)[cut]
        yield key[cut][chosen], at + cut[chosen], at + end[chosen]


# ---- passes over texts --------------------------------------------------------------------------

def _batch(cols: list, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def _texts(batch, at: int):
    return [np.frombuffer(t or b"", np.uint8) for t in as_bytes(batch.column(at))]


def _count_keys(window: int, gram: int):
    def run(batches):
        for b in batches:
            keys = [text_keys(t, window, gram) for t in _texts(b, 1)]
            key, n = np.unique(np.concatenate(keys or [np.zeros(0, _U)]), return_counts=True)
            yield _batch([key.view("i8"), n], ["key", "n"], [pa.int64(), pa.int64()])
    return run


def _keys_of_docs(window: int, gram: int):
    def run(batches):
        for b in batches:
            rows = dict(zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), _texts(b, 2), strict=True))  # equal rows once
            keys = [np.unique(text_keys(t, window, gram)) for t in rows.values()]
            doc, own = (np.repeat(np.array(x, "i8"), [len(k) for k in keys]) for x in (zip(*rows) if rows else ((), ())))
            yield _batch([doc, own, np.concatenate(keys or [np.zeros(0, _U)]).view("i8")], ["doc", "sub", "key"], [pa.int64()] * 3)
    return run


def _packed(batches):
    """(doc, sub, doc_id, z): order key, the text's hash, id and compressed bytes of a text."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for b in batches:
        z = pa.array([squeeze.compress(t or b"") for t in as_bytes(b.column(3))], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), z], names=["doc", "sub", "doc_id", "z"])


def _digests(batches):
    for b in batches:
        texts = [t or b"" for t in as_bytes(b.column(2))]
        yield _batch([b.column(0), b.column(1), [hashlib.sha256(t).digest() for t in texts], [len(t) for t in texts]],
                     ["doc", "sub", "sid", "n"], [pa.int64(), pa.int64(), pa.binary(), pa.int64()])


CONTEXTS = "key long, context binary, doc long, at long, sub long"


class _Contexts(dict):
    """(key, context) -> its first (doc, place, text's hash)."""
    held = 0

    def add(self, at: tuple[int, bytes], place: tuple[int, int, int]) -> None:
        known = self.get(at)
        if known is None:
            self.held += len(at[1])
        if known is None or place < known:
            self[at] = place

    def batch(self) -> pa.RecordBatch:
        keys, parts = zip(*self) if self else ((), ())
        docs, places, subs = zip(*self.values()) if self else ((), (), ())
        return _batch([keys, parts, docs, places, subs], ["key", "context", "doc", "at", "sub"], [pa.int64(), pa.binary(), *[pa.int64()] * 3])


def _sorted_keys(values) -> np.ndarray:
    return np.sort(np.array(values or (), "i8").view(_U))


def _split_keys(window: int, gram: int):
    """(doc, sub, key, n): the split keys of each text, and the bytes of their contexts that no document before it in the
    batch has."""
    def run(batches):
        inflate = zstandard.ZstdDecompressor()
        none = np.zeros(0, _U)
        for b in batches:
            seen, rows = set(), []
            for doc, own, z, crowded, copy in zip(*(b.column(c).to_pylist() for c in ("doc", "sub", "z", "crowded", "copy")), strict=True):
                if not crowded or copy:
                    continue
                raw, new = inflate.decompress(z), {}
                for key, start, end in contexts(np.frombuffer(raw, np.uint8), none, _sorted_keys(crowded), window, gram):
                    for k, s, e in zip(key.view("i8").tolist(), start.tolist(), end.tolist()):
                        at = (k, xxhash.xxh3_64_intdigest(raw[s:e + window - 1]))
                        new[k] = new.get(k, 0) + (0 if at in seen else e - s + window - 1)
                        seen.add(at)
                rows += [(doc, own, k, n) for k, n in new.items()]
            cols = list(zip(*rows)) or [()] * 4
            yield _batch(cols, ["doc", "sub", "key", "n"], [pa.int64()] * 4)
    return run


def _text_contexts(window: int, gram: int):
    def run(batches):
        inflate = zstandard.ZstdDecompressor()
        for b in batches:
            found = _Contexts()
            names = ("doc", "sub", "z", "keys", "crowded", "copy", "dense")
            for doc, own, z, keys, crowded, copy, dense in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if not (keys or crowded) or copy:
                    continue
                raw = inflate.decompress(z)
                for key, start, end in contexts(np.frombuffer(raw, np.uint8), _sorted_keys(keys), _sorted_keys(crowded), window, gram, _sorted_keys(dense)):
                    for k, s, e in zip(key.view("i8").tolist(), start.tolist(), end.tolist()):
                        found.add((k, raw[s:e + window - 1]), (doc, s, own))
                if found.held > BLOCK_BYTES:
                    yield found.batch()
                    found = _Contexts()
            yield found.batch()
    return run


# ---- the suffix array of a block ----------------------------------------------------------------

def kept_windows(parts: list[bytes], docs: np.ndarray, places: np.ndarray, subs: np.ndarray, window: int):
    """(doc, sub, start, end) arrays: runs of windows that are the earliest of their string. ``places`` is where a context starts."""
    text, starts = joined(parts, window)
    words = words8(text)
    many = np.fromiter(map(len, parts), "i8", len(parts)) - window + 1
    edge = np.zeros(len(text) + 1, "i8")
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + many, -1)
    wanted = np.cumsum(edge[:-1]) > 0
    sa = suffix_order(text, words, wanted, window)
    first = np.append(True, ~adjacent_equal(sa, words, window))
    string = np.cumsum(first) - 1
    owner = np.searchsorted(starts, sa, "right") - 1
    doc, at = docs[owner], places[owner] + sa - starts[owner]
    heads = np.flatnonzero(first)
    least_doc = np.minimum.reduceat(doc, heads)[string]
    least = doc == least_doc
    least &= at == np.minimum.reduceat(np.where(least, at, LAST), heads)[string]
    own = subs[owner]
    least &= own == np.minimum.reduceat(np.where(least, own, LAST), heads)[string]
    kept = np.zeros(len(text), bool)
    kept[sa[least]] = True
    s, e = _runs(kept)
    owner = np.searchsorted(starts, s, "right") - 1
    shift = places[owner] - starts[owner]
    return docs[owner], subs[owner], s + shift, e + shift


def _sort_blocks(window: int):
    """Rows come sorted by key; a block ends between keys."""
    def run(batches):
        block, last = _Contexts(), None

        def flush():
            docs, places, subs = (np.array(x, "i8") for x in zip(*block.values()))
            return _batch(kept_windows([part for _, part in block], docs, places, subs, window), ["doc", "sub", "start", "end"], [pa.int64()] * 4)

        for b in batches:
            for key, part, doc, at, own in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if block.held > BLOCK_BYTES and key != last:
                    yield flush()
                    block = _Contexts()
                block.add((key, part), (doc, at, own))
                last = key
        if block:
            yield flush()
    return run


# ---- removal ------------------------------------------------------------------------------------

def removed_spans(text: np.ndarray, keys: np.ndarray, kept: list, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs of bytes."""
    copy = np.zeros(max(0, len(text) - window + 1), bool)
    for _, start, end in contexts(text, keys, keys[:0], window, gram):
        for s, e in zip(start.tolist(), end.tolist()):
            copy[s:e] = True
    for k in kept:
        copy[k["start"]:k["end"]] = False
    s, e = _runs(copy)
    e = e + (window - 1) * (e > s)
    new = np.append(True, s[1:] > e[:-1])[:len(s)]
    return s[new], e[np.append(new[1:], True)[:len(s)]]


RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def _remove(window: int, gram: int):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        inflate = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for doc_id, z, keys, crowded, copy, kept in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                raw = inflate.decompress(z)
                if copy:
                    s, e = np.array([0]), np.array([len(raw)])
                elif keys or crowded:
                    s, e = removed_spans(np.frombuffer(raw, np.uint8), _sorted_keys([*(keys or ()), *(crowded or ())]), kept or [], window, gram)
                else:
                    s = e = np.zeros(0, "i8")
                s, e = s.tolist(), e.tolist()
                left = b"".join(raw[a:c] for a, c in zip([0, *e], [*s, len(raw)]))
                rows.append((doc_id, len(raw), len(raw) - len(left), [{"start": a, "end": c} for a, c in zip(s, e)], left))
            cols = list(zip(*rows)) or [()] * 5
            yield _batch(cols, ["doc_id", "n_bytes", "n_removed", "spans", "kept"], [pa.int64(), pa.int64(), pa.int64(), span, pa.binary()])
    return run


ROW = ["doc", "sub"]


def repeated_contexts(docs: DataFrame, window: int, gram: int, crowd: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(compressed texts, keys of each text and whether it is a copy, contexts of its repeated keys)."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
                      F.xxhash64(F.coalesce("text", F.lit(""))).alias("sub"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    digests = store(map_docs(own.select(*ROW, "text"), _digests, "doc long, sub long, sid binary, n long"))
    if digests.groupBy("doc").agg(F.min("sub").alias("a"), F.max("sub").alias("b")).filter("a < b").isEmpty():
        # every id has one text: the id alone names it, and a constant costs the shuffles nothing
        own, digests = (x.withColumn("sub", F.lit(0).cast("long")) for x in (own, digests))
    text = own.select(*ROW, "text")
    packed = map_docs(own, _packed, "doc long, sub long, doc_id long, z binary")
    # 1. repeated keys, and the keys of each text among them
    counted = map_docs(text.select("doc", "text"), _count_keys(window, gram), "key long, n long")
    repeated = store(counted.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key", (F.col("n") > crowd).alias("crowd")))
    held = (map_docs(text, _keys_of_docs(window, gram), "doc long, sub long, key long").join(repeated, "key").groupBy(*ROW)
            .agg(F.collect_set(F.when(~F.col("crowd"), F.col("key"))).alias("keys"), F.collect_set(F.when(F.col("crowd"), F.col("key"))).alias("crowded")))
    long = digests.filter(F.col("n") >= window)
    firsts = store(long.groupBy("sid").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last"))
    copies = long.join(firsts, "sid").filter("doc > first").select(*ROW, F.lit(True).alias("copy")).distinct()
    info = store(held.join(copies, ROW, "full"))
    # 2. their contexts; a split key may have as many bytes of them as a key that is just not crowded
    if repeated.filter("crowd").isEmpty():
        known = info.withColumn("dense", F.lit(None).cast("array<long>"))
    else:
        having = info.filter(F.size("crowded") > 0).select(*ROW, "crowded", "copy")
        if (having.agg(F.sum(F.size("crowded") + 1)).first()[0] or 0) <= BROADCAST_KEYS:
            having = F.broadcast(having)
        split = store(map_docs(packed.join(having, ROW), _split_keys(window, gram), "doc long, sub long, key long, n long"))
        dense = split.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > crowd * 2 * window).select("key")
        known = info.join(split.select(*ROW, "key").join(dense, "key").groupBy(*ROW).agg(F.collect_set("key").alias("dense")), ROW, "left")
    return packed, info, map_docs(packed.join(known, ROW), _text_contexts(window, gram), CONTEXTS)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): the removed runs of each text's bytes, and what is left of them."""
    if not 8 <= gram < window:
        raise ValueError(f"gram must be from 8 to below the window: {gram}, {window}")
    packed, info, found = repeated_contexts(docs, window, gram, crowd)
    # 3. suffix arrays
    kept = map_docs(found.repartition("key").sortWithinPartitions("key"), _sort_blocks(window), "doc long, sub long, start long, end long")
    kept = kept.groupBy(*ROW).agg(F.collect_list(F.struct("start", "end")).alias("kept"))
    # 4. removal
    known = info.join(kept, ROW, "left")
    return map_docs(packed.join(known, ROW, "left").select("doc_id", "z", "keys", "crowded", "copy", "kept"), _remove(window, gram), RESULT)

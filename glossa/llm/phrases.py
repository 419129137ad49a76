"""Phrase collocations by SON partitioning: frequent phrases of two to four words, scored by their weakest cut.

1. One pass counts words, and the words of each language in each shard (a shard is a fixed part of the documents by a hash of
   their texts). Words rarer than the support can be in no frequent phrase.
2. Each shard is mined completely at a local support lowered in proportion to its share of the language's words: a phrase that
   reaches the support in all has to reach its share in one shard at least, whatever the shares. Shards are few and of any
   size, so local supports stay well above one however large the corpus is, and a shard is mined by many tasks: they send the
   64-bit hashes of their phrases, counted, by ranges of the hash. First pairs are mined, then longer phrases whose pairs were all found.
3. The union of the shards' phrases is a set of hashes, more than the truth at worst (hashes may collide). A last pass counts
   the phrases of that set, as strings, in the whole corpus, and those that reach the support are the candidates.

Between the passes the sets travel as bit filters of at most ``FILTER_BITS``: a false hit costs work in the next pass, never a
result. What tasks hold is bounded by ``FLUSH_WORDS`` and by ``BUCKET_GRAMS``.

Null texts count as empty, a null language as ``und``; empty texts have no words. Rows are independent, repeated rows and ids
count as often as they come, and extra columns are not read. An empty table has no phrases. Ties are broken by the contract's order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import as_bytes, map_docs, store

SUPPORT = 30
#: A sub-phrase goes if a longer candidate holds this percentage of its occurrences.
COVERED_PERCENT = 80
SHARDS = 8
#: Languages, most words first, whose shards' shares are known to every task; in others a shard's local support is one.
LANGS = 1000
#: Words a task gathers before it sends their phrases, and phrases that one bucket of hashes may get.
FLUSH_WORDS = 1_000_000
BUCKET_GRAMS = 1_000_000
#: Bits of a filter at most (32 MB), bits a member, and members a slice is built from.
FILTER_BITS = 1 << 28
FILTER_SPREAD = 12
SLICE_MEMBERS = 1_000_000
#: Words that are a thousandth of all or more, so a thousand at most, are joined by broadcast: many phrases hold them.
HOT_SHARE = 1000

#: Sentence marks and line breaks end a piece, tabs separate words like spaces.
_MARKS = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_GAP, _END = 0, 1
_U = np.uint64
_ODD = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


class Words(dict):
    """Numbers words as they come; empty strings and piece ends have fixed numbers."""

    def __init__(self):
        super().__init__({b"": _GAP, b"\n": _END})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def of(self, text: bytes) -> np.ndarray:
        """The words of a text by number, with an end mark after each piece."""
        parts = (text.lower().translate(_MARKS).replace(b"\n", b" \n ") + b" \n").split(b" ")
        ids = np.fromiter(map(self.__getitem__, parts), np.int32, len(parts))
        return ids[ids != _GAP]


def _mixed(x: np.ndarray, odd: np.uint64) -> np.ndarray:
    x = x * odd
    return x ^ (x >> _U(32))


def _hashes(words) -> np.ndarray:
    """A 64-bit hash for each word number."""
    from xxhash import xxh64_intdigest
    return np.fromiter(map(xxh64_intdigest, words), _U, len(words))


def _of_lang(hashes: np.ndarray, lang: str) -> np.ndarray:
    return _mixed(hashes ^ _U(zlib.crc32(lang.encode("utf-8", "replace"))), _ODD[0])


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hash of all but its last word and that of the last."""
    return _mixed(_mixed(left, _ODD[0]) ^ right, _ODD[1])


class Filter:
    """A bit filter in slices by the upper bits of a hash."""

    def __init__(self, bits: bytes, slices: int):
        self.bits = np.frombuffer(bits, np.uint8)
        self.size = _U(len(self.bits) * 8 // slices)
        self.slices = _U(slices)

    @staticmethod
    def places(h: np.ndarray, size: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        return h % size, _mixed(h, _ODD[1]) % size

    @staticmethod
    def slice_of(h: np.ndarray, slices: int) -> np.ndarray:
        return (h >> _U(32)) % _U(slices)

    def has(self, h: np.ndarray) -> np.ndarray:
        base = self.slice_of(h, self.slices) * self.size
        out = np.ones(len(h), bool)
        for p in self.places(h, self.size):
            p = base + p
            out &= (self.bits[p >> _U(3)] >> (p & _U(7)).astype(np.uint8)) & np.uint8(1) != 0
        return out


def _gathered(batches, sharded: bool) -> Iterator[tuple[Words, dict[tuple[str, int], np.ndarray]]]:
    """The words of some texts at a time: word numbers by language and shard."""
    words, parts, size = Words(), {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            ids = words.of(text)
            parts.setdefault((lang, zlib.crc32(text) % SHARDS if sharded else 0), []).append(ids)
            size += len(ids)
            if size >= FLUSH_WORDS:
                yield words, {k: np.concatenate(v) for k, v in parts.items()}
                words, parts, size = Words(), {}, 0
    if parts:
        yield words, {k: np.concatenate(v) for k, v in parts.items()}


def _count_words(batches):
    for words, parts in _gathered(batches, sharded=True):
        names = pa.array(list(words), pa.binary())
        by_lang: dict[str, np.ndarray] = {}
        fields = ("lang", pa.string()), ("word", pa.string()), ("shard", pa.int32()), ("n", pa.int64())
        sums = []
        for (lang, shard), ids in parts.items():
            n = np.bincount(ids, minlength=len(names))
            n[_END] = 0
            by_lang[lang] = by_lang[lang] + n if lang in by_lang else n
            sums.append((lang, None, shard, int(n.sum())))
        yield _batch(sums, *fields)
        for lang, n in by_lang.items():
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(met), np.int64))), names.take(pa.array(met)).cast(pa.string()),
                                              pa.nulls(len(met), pa.int32()), pa.array(n[met], pa.int64())], [f for f, _ in fields])


def _batch(rows: list[tuple], *fields: tuple[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _unique(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(h, return_counts=True)


def _pairs(ids: np.ndarray, hashes: np.ndarray, frequent: Filter) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the pair at each place, and whether it lies in a piece and both words are frequent."""
    known = frequent.has(hashes)
    known[[_GAP, _END]] = False
    w, ok = hashes[ids], known[ids]
    return _join(w[:-1], w[1:]), ok[:-1] & ok[1:]


def _longer(pair: np.ndarray, ok: np.ndarray, ids: np.ndarray, hashes: np.ndarray):
    """Hashes of the phrases of three and four words whose pairs are all ``ok``, with their places."""
    at = np.flatnonzero(ok[:-1] & ok[1:])
    three = _join(pair[at], hashes[ids[at + 2]])
    inner = np.flatnonzero(np.diff(at) == 1)
    return (at, three), (at[inner], _join(three[inner], hashes[ids[at[inner] + 3]]))


def _send_grams(level: int, buckets: int, supports: dict, frequent, pairs=None):
    """Map side of mining: the distinct phrases of some texts, counted, by bucket."""
    def run(batches):
        words_filter = Filter(*frequent.value)
        pairs_filter = Filter(*pairs.value) if pairs else None
        for words, parts in _gathered(batches, sharded=True):
            sent, hashes, any_lang = [], {}, _hashes(words)
            for (lang, shard), ids in parts.items():
                if lang not in hashes:
                    hashes[lang] = _of_lang(any_lang, lang)
                pair, ok = _pairs(ids, hashes[lang], words_filter)
                if level == 2:
                    grams = [pair[ok]]
                else:
                    ok[ok] = pairs_filter.has(pair[ok])
                    grams = [h for _, h in _longer(pair, ok, ids, hashes[lang])]
                h, n = _unique(np.concatenate(grams))
                sent.append((h, np.full(len(h), shard, np.uint8), np.full(len(h), supports.get((lang, shard), 1), np.uint32), n.astype(np.uint32)))
            columns = [np.concatenate(c) for c in zip(*sent)]
            bucket = (columns[0] >> _U(16)) % _U(buckets)
            order = np.argsort(bucket, kind="stable")
            columns, bucket = [c[order] for c in columns], bucket[order]
            starts = np.flatnonzero(np.diff(bucket, prepend=_U(buckets)))
            ends = [*starts[1:], len(bucket)]
            yield _batch([(int(bucket[s]), *(c[s:e].tobytes() for c in columns)) for s, e in zip(starts, ends)],
                         ("bucket", pa.int64()), *((c, pa.binary()) for c in ("hashes", "shards", "supports", "counts")))
    return run


def _locally_frequent(table: pa.Table) -> pa.Table:
    """Reduce side of mining: the phrases of a bucket that reach the local support of some shard."""
    h, shard, support, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (
        ("hashes", _U), ("shards", np.uint8), ("supports", np.uint32), ("counts", np.uint32)))
    key = _mixed(h ^ (shard.astype(_U) + _U(1)) * _ODD[0], _ODD[1])
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    total = np.add.reduceat(n[order].astype(np.int64), starts)
    kept = total >= np.minimum.reduceat(support[order], starts)
    found = np.unique(h[order[starts[kept]]])
    return pa.table({"hashes": pa.array([found.tobytes()], pa.binary()), "n": pa.array([len(found)], pa.int64())})


def _filter_of(spark: SparkSession, members: DataFrame, n: int):
    """Broadcast bit filter of the hashes packed in the first column of ``members``, ``n`` in all."""
    slices = 64
    while slices * SLICE_MEMBERS < n and slices < FILTER_BITS // 1024:
        slices *= 2
    bits = 1 << 16
    while bits < min(FILTER_BITS, FILTER_SPREAD * n):
        bits *= 2
    size = bits // slices

    def split(batches):
        for batch in batches:
            h = np.frombuffer(b"".join(batch.column(0).to_pylist()), _U)
            at = Filter.slice_of(h, slices)
            order = np.argsort(at, kind="stable")
            h, at = h[order], at[order]
            starts = np.flatnonzero(np.diff(at, prepend=_U(slices)))
            yield _batch([(int(at[s]), h[s:e].tobytes()) for s, e in zip(starts, [*starts[1:], len(h)])], ("slice", pa.int64()), ("hashes", pa.binary()))

    def build(table):
        marks = np.zeros(size, np.uint8)
        for packed in table.column("hashes").to_pylist():
            for p in Filter.places(np.frombuffer(packed, _U), _U(size)):
                marks[p.astype(np.int64)] = 1
        return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    built = map_docs(members, split, "slice long, hashes binary").groupBy("slice").applyInArrow(build, "slice long, bits binary")
    parts = {r.slice: r.bits for r in built.collect()}  # FILTER_BITS at most
    empty = bytes(size // 8)
    return spark.sparkContext.broadcast((b"".join(parts.get(s, empty) for s in range(slices)), slices))


def _mine(texts: DataFrame, level: int, grams: int, supports: dict, frequent, pairs=None):
    """Broadcast filter of the phrases that are frequent in some shard; ``grams`` bounds their occurrences."""
    buckets = max(1, -(-grams // BUCKET_GRAMS))
    sent = map_docs(texts, _send_grams(level, buckets, supports, frequent, pairs),
                    "bucket long, hashes binary, shards binary, supports binary, counts binary")
    found = store(sent.groupBy("bucket").applyInArrow(_locally_frequent, "hashes binary, n long"))
    return _filter_of(texts.sparkSession, found, found.agg(F.sum("n")).first()[0] or 0)


def _count_phrases(frequent, pairs, longer):
    """Occurrences of the candidates in some texts, as strings. Phrases are told apart by word numbers, not by hashes."""
    def run(batches):
        words_filter, pairs_filter, longer_filter = (Filter(*b.value) for b in (frequent, pairs, longer))
        for words, parts in _gathered(batches, sharded=False):
            names, any_lang = list(words), _hashes(words)
            for (lang, _), ids in parts.items():
                hashes = _of_lang(any_lang, lang)
                pair, ok = _pairs(ids, hashes, words_filter)
                ok[ok] = pairs_filter.has(pair[ok])
                at = np.flatnonzero(ok)
                wide = ids.astype(np.int64)
                two, number, n = np.unique(wide[at] << 32 | wide[at + 1], return_inverse=True, return_counts=True)
                number_at = np.zeros(len(ids), np.int64)
                number_at[at] = number
                first, second = two >> 32, two & 0xFFFFFFFF
                found = [(n, first, second)]
                (at3, h3), (at4, h4) = _longer(pair, ok, ids, hashes)
                at3, at4 = at3[longer_filter.has(h3)], at4[longer_filter.has(h4)]
                key, n = _unique(number_at[at3] << 32 | wide[at3 + 2])
                found.append((n, first[key >> 32], second[key >> 32], key & 0xFFFFFFFF))
                key, n = _unique(number_at[at4] << 32 | number_at[at4 + 2])
                found.append((n, first[key >> 32], second[key >> 32], first[key & 0xFFFFFFFF], second[key & 0xFFFFFFFF]))
                for n, *columns in found:
                    phrases = [b" ".join(p) for p in zip(*([names[i] for i in c] for c in columns))]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()),
                                                      pa.array(n.astype(np.int64))], ["lang", "phrase", "n"])
    return run


def mine(docs: DataFrame, support: int = SUPPORT, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates: lang, phrase, f), (words of at least the support: lang, phrase, f) and (all words: lang, n)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    counted = map_docs(texts, _count_words, "lang string, word string, shard int, n long")
    counted = store(counted.groupBy("lang", "word", "shard").agg(F.sum("n").alias("n")).filter(F.col("word").isNull() | (F.col("n") >= support)))
    words = counted.filter("word IS NOT NULL").select("lang", F.col("word").alias("phrase"), F.col("n").alias("f"))
    shares = counted.filter("word IS NULL")
    totals = shares.groupBy("lang").agg(F.sum("n").alias("n"))
    top = totals.orderBy(F.desc("n"), "lang").limit(LANGS)
    supports = {(r.lang, r.shard): max(1, -(-support * r.n // r.total)) for r in shares.join(
        F.broadcast(top.withColumnRenamed("n", "total")), "lang").filter("n > 0").collect()}  # LANGS x SHARDS rows at most
    n_words, n_frequent = totals.agg(F.sum("n")).first()[0] or 0, words.count()

    def packed(batches):
        for batch in batches:
            rows: dict[str, list[bytes]] = {}
            for lang, word in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                rows.setdefault(lang, []).append(word)
            yield _batch([(_of_lang(_hashes(ws), lang).tobytes(),) for lang, ws in rows.items()], ("hashes", pa.binary()))

    frequent = _filter_of(spark, map_docs(words.select("lang", "phrase"), packed, "hashes binary"), n_frequent)
    pairs = _mine(texts, 2, n_words, supports, frequent)
    longer = _mine(texts, 4, 2 * n_words, supports, frequent, pairs)
    found = map_docs(texts, _count_phrases(frequent, pairs, longer), "lang string, phrase string, n long")
    candidates = store(found.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= support))
    return candidates, words, totals


def _exact(name: str) -> str:
    return f"CAST({name} AS DECIMAL(19, 0))"


def _scored(candidates: DataFrame, words: DataFrame, n_words: int) -> DataFrame:
    """Candidates with the frequencies around their weakest cut."""
    cut = candidates.withColumn("w", F.split("phrase", " ")).select("lang", "phrase", "f", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    parts = cut.select("lang", "phrase", "f", F.explode(F.expr(
        "array(named_struct('side', concat('l', k), 'part', array_join(slice(w, 1, k), ' ')),"
        " named_struct('side', concat('r', k), 'part', array_join(slice(w, k + 1, size(w)), ' ')))")).alias("p")).select("lang", "phrase", "f", "p.*")
    hot = F.col("f") * HOT_SHARE >= n_words
    known = words.withColumnsRenamed({"phrase": "part", "f": "part_f"})
    common = F.broadcast(words.filter(hot).withColumnsRenamed({"phrase": "part", "f": "part_f"}))  # HOT_SHARE rows at most
    rest = known.filter(F.col("part_f") * HOT_SHARE < n_words).union(candidates.withColumnsRenamed({"phrase": "part", "f": "part_f"}))
    met = parts.join(common, ["lang", "part"]).unionByName(parts.join(common, ["lang", "part"], "left_anti").join(rest, ["lang", "part"]))
    wide = met.groupBy("lang", "phrase").agg(F.first("f").alias("a"), *[
        F.max(F.when(F.col("side") == s, F.col("part_f"))).alias(s) for s in ("l1", "r1", "l2", "r2", "l3", "r3")])
    score = "CAST(2000000 AS DECIMAL(7, 0)) * {0} DIV ({1} + {2})"
    cuts = ", ".join(f"IF(l{k} IS NULL, NULL, named_struct('score', {score.format(_exact('a'), _exact(f'l{k}'), _exact(f'r{k}'))}, 'k', {k}, 'l', l{k}, 'r', r{k}))"
                     for k in (1, 2, 3))
    return wide.withColumn("least", F.expr(f"array_min(filter(array({cuts}), x -> x IS NOT NULL))")).select("lang", "phrase", "a", "least.l", "least.r", "least.score")


def _covered(candidates: DataFrame) -> DataFrame:
    """Phrases inside longer candidates, with the largest frequency of these."""
    inner = candidates.withColumn("w", F.split("phrase", " ")).filter("size(w) > 2").select("lang", "f", F.explode(F.expr(
        "array_distinct(flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), s -> array_join(slice(w, s, m), ' ')))))")).alias("phrase"))
    return inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, support: int = SUPPORT, top: int | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the phrases of at least ``support`` occurrences that no longer one covers,
    best first in each language; the first ``top`` of each language, or all."""
    candidates, words, totals = mine(docs, support, text, lang)
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    kept = _scored(candidates, words, n_words).join(_covered(candidates), ["lang", "phrase"], "left").filter(
        f"longer IS NULL OR CAST(100 AS DECIMAL(3, 0)) * {_exact('longer')} < CAST({COVERED_PERCENT} AS DECIMAL(3, 0)) * {_exact('a')}")
    if top is None:
        ranked = kept.withColumn("rank", F.lit(None).cast("long"))
    else:
        ranked = kept.withColumn("rank", F.expr("CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT)")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))

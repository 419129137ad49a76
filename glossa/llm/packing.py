"""Best-fit packing by a configuration linear program.

Documents become token pieces of at most ``capacity`` tokens. The length histogram (at most ``capacity``
numbers, whatever the corpus) goes to the driver, where the configuration LP -- as few sequences as possible,
each a multiset of lengths that fits, every length covered -- is solved by multiplicative weights: a length's
weight falls exponentially with its coverage, a knapsack dynamic program prices configurations for all
capacities at once, and the least covered lengths each take the best configuration that holds them. The
solution is rounded greedily within the remaining counts, and what rounding leaves is packed by best fit.

Only the plan is made on the driver. Each piece finds its place in Spark from its rank among the pieces of its
length: ranks come from salted buckets (count, running total, rank inside a bucket), so a length that a
third of the pieces share is spread over tasks; the plan is a broadcast whose size depends on ``capacity``.

Defined results: a null text is empty, and an empty text is the end id alone; repeated rows are packed each on
its own; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.llm.common import as_bytes, map_docs, store
from glossa.llm.tokens import SpacedIds, read_tokenizer, shared

CAPACITY = 4096
END_ID = 1
#: Share of a length's count that one step covers, and lengths served per pricing.
STEP = 0.125
ANCHORS = 512
#: Pieces a bucket of the ranking holds on average.
BUCKET_ROWS = 250_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---- pieces -------------------------------------------------------------------------------------

def _cut(spec, capacity: int, end_id: int, with_ids: bool):
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        ids_of = shared(SpacedIds, spec.value)
        step = 4 * capacity
        for b in batches:
            texts = [t or b"" for t in as_bytes(b.column(1))]
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), ids_of.encode_all(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            cols = list(zip(*rows)) or [()] * 6
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(cols[5], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 with_ids: bool = False) -> DataFrame:
    """One row per piece of a document's ids: its ordinal, start, length and CRC-32; with ``with_ids`` also the ids,
    packed as little-endian unsigned 32-bit numbers. ``tokenizer`` is the path of a file that drops white space."""
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))
    return map_docs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
                    _cut(spec, capacity, end_id, with_ids), PIECES + ", ids binary" * with_ids)


# ---- the plan (driver, bounded by capacity) -----------------------------------------------------

def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the most value in c tokens; take[c]: the item taken last there, -1 for an idle token."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            v = best[c - lengths[:k]] + values[:k]
            i = int(v.argmax())
            if v[i] > best[c]:
                best[c], take[c] = v[i], i
    return best, take


def _traced(take: np.ndarray, lengths: np.ndarray, room: int) -> list[int]:
    items = []
    while room > 0:
        i = take[room]
        if i < 0:
            room -= 1
        else:
            items.append(int(i))
            room -= int(lengths[i])
    return items


def solve_lp(lengths: np.ndarray, counts: np.ndarray, capacity: int, step: float = STEP,
             anchors: int = ANCHORS) -> dict[tuple[int, ...], float]:
    """Fractional uses of configurations (sorted tuples of item indexes) that cover every count.

    Coverage rises in phases of ``step``. In a phase every length below the phase's target is an anchor: it takes
    the best-priced configuration around it for ``step`` of its count. Prices are length times weight, with a
    small premium for long items, which are the hard ones to place; weights decay with coverage."""
    uses: dict[tuple[int, ...], float] = defaultdict(float)
    covered = np.zeros(len(lengths))
    share = lengths / capacity
    for phase in range(1, ceil(1 / step) + 1):
        target = min(1.0, phase * step)
        while (low := np.flatnonzero(covered < target - 1e-9)).size:
            weight = np.exp(-2.0 * (covered - covered.min()))
            weight[covered >= target] *= 0.5
            _, take = knapsack(lengths, weight * share * (1 + 0.05 * share), capacity)
            for i in low[::-1][:anchors]:  # longest first
                if covered[i] >= target - 1e-9:
                    continue
                config = (int(i), *_traced(take, lengths, capacity - int(lengths[i])))
                theta = (target - covered[i]) * counts[i] / config.count(int(i))
                uses[tuple(sorted(config))] += theta
                for j in config:
                    covered[j] += theta / counts[j]
    return uses


def best_fit(rest: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best fit decreasing over a histogram; bins with equal contents are kept as one group with a count."""
    groups: dict[int, list[tuple[list[int], int]]] = defaultdict(list)  # by room left
    rooms: list[int] = []

    def put(room: int, items: list[int], n: int) -> None:
        if not groups[room]:
            insort(rooms, room)
        groups[room].append((items, n))

    for size in sorted(rest, reverse=True):
        n = rest[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                fit = min(n, capacity // size)
                put(capacity - fit * size, [size] * fit, n // fit)
                n -= fit * (n // fit)
                continue
            room = rooms[at]
            items, m = groups[room].pop()
            if not groups[room]:
                rooms.pop(at)
            used = min(m, n)
            if m > used:
                put(room, items, m - used)
            put(room - size, [*items, size], used)
            n -= used
    return [g for room in sorted(groups) for g in groups[room]]


def _rounded(uses: dict, lengths: np.ndarray, counts: np.ndarray, capacity: int, least: int, up: bool) -> list[tuple[tuple[int, ...], int]]:
    """Whole uses of the configurations that fill at least ``least``, fullest first and within the counts; fractions of a use are
    rounded up or down, and what is left goes to best fit."""
    remaining, plan = counts.copy(), []
    fill = {c: int(lengths[list(c)].sum()) for c in uses}
    for config in sorted((c for c in uses if fill[c] >= least), key=lambda c: (-fill[c], -uses[c], c)):
        items, copies = np.unique(config, return_counts=True)
        whole = ceil(uses[config] - 1e-9) if up else int(uses[config] + 1e-9)
        n = min(whole, int((remaining[items] // copies).min()))
        if n > 0:
            remaining[items] -= copies * n
            plan.append((tuple(int(lengths[i]) for i in config), n))
    rest = {int(k): int(n) for k, n in zip(lengths, remaining) if n}
    return plan + [(tuple(items), n) for items, n in best_fit(rest, capacity)]


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences), holding exactly the histogram: the best of the programme's roundings (full
    configurations alone, all of them rounded up, or down) and of best fit without it."""
    left = {k: n for k, n in histogram.items() if n}
    plan = [((k,), left.pop(k)) for k in [k for k in left if k >= capacity]]
    if not left:
        return plan
    lengths = np.array(sorted(left))
    counts = np.array([left[k] for k in lengths])
    uses = solve_lp(lengths, counts, capacity)
    roundings = [_rounded(uses, lengths, counts, capacity, least, up) for least, up in ((capacity, True), (0, False), (0, True))]
    roundings.append(_rounded({}, lengths, counts, capacity, 0, False))
    return plan + min(roundings, key=lambda found: sum(n for _, n in found))


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first sequence and offset of each run of places."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    filled: dict[int, int] = defaultdict(int)
    sequence = 0
    for items, n in plan:
        offset = 0
        for size in items:
            runs[size].append((filled[size], sequence, offset))
            filled[size] += n
            offset += size
        sequence += n
    return {k: tuple(np.array(c, "i8") for c in zip(*v)) for k, v in runs.items()}


# ---- placing ------------------------------------------------------------------------------------

def _place(slots, out_names: list[str]):
    def run(batches):
        for b in batches:
            size, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "pack_rank"))
            sequence, offset = np.zeros(len(size), "i8"), np.zeros(len(size), "i8")
            for k in np.unique(size):
                at = np.flatnonzero(size == k)
                first, base, off = slots.value[int(k)]
                i = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = base[i] + rank[at] - first[i], off[i]
            kept = [b.column(b.schema.get_field_index(c)) for c in out_names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=out_names)
    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` plus sequence_id and offset: places in as few sequences of ``capacity`` tokens as the plan finds."""
    pieces = store(pieces)
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(plan_sequences(histogram, capacity)))
    # a row for each length, so ``capacity`` at most
    ways = F.broadcast(spark.createDataFrame([(k, 1 + n // BUCKET_ROWS) for k, n in histogram.items()], "length long, pack_ways long"))
    salted = pieces.join(ways, "length").withColumn("pack_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("pack_ways"))).drop("pack_ways")
    before = (salted.groupBy("length", "pack_salt").agg(F.count("*").alias("n"))
              .withColumn("pack_before", F.sum("n").over(W.partitionBy("length").orderBy("pack_salt")) - F.col("n")).drop("n"))
    inside = W.partitionBy("length", "pack_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (salted.withColumn("pack_rank", F.row_number().over(inside) - 1)
              .join(before, ["length", "pack_salt"])
              .withColumn("pack_rank", F.col("pack_rank") + F.col("pack_before")))
    names = [*pieces.columns, "sequence_id", "offset"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return map_docs(ranked, _place(slots, names), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise and pack: one row per piece with its place."""
    return pack_pieces(token_pieces(docs, tokenizer, capacity, end_id), capacity)

"""Hard negatives: for each anchor its nearest rows of the same label, and just below each of these the nearest of other labels.

Rows are dealt to blocks of about ``BLOCK`` by a hash, and each block gets a cover tree, built once and kept in the shared folder.
The anchors, a stated query set, go in packs of ``ANCHORS`` to every block; a block's answer to an anchor is ``k`` rows at
most, and the best ``k`` of all blocks are merged by a window. The first search finds the positives, the second one the
negatives within the positives' score windows. Whole vectors never meet but in leaves that no bound excludes.

Vectors count by whole numbers: each component x becomes floor(scale * x). Rows with a null id or label, a null vector, or a
null or non-finite component (also one that is not finite once scaled) take no part. Shorter vectors count as filled up with
zeros; an empty one has product 0 with all. Repeated rows are rows of their own, so a copy of an anchor may be its positive;
ties go to the smaller id. Products beyond 64 bits are an error. An empty table, or one without anchors, has no result.
Extra columns are not read.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import map_docs, prepare, store
from glossa.llm.cover_tree import Tree, build, narrow, search

BLOCK = 8192
ANCHORS = 512


def _whole(vectors: list, scale: float) -> np.ndarray:
    """Vectors as rows of whole numbers, filled up with zeros."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    out = np.floor(out * scale)
    if np.abs(out).max(initial=0.0) < 2.0 ** 53:
        return out.astype(np.int64)
    return np.array([[int(x) for x in row] for row in out], object).reshape(out.shape)


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def _first_copies(points, ids, labels, k: int) -> np.ndarray:
    """Places of the first ``k`` + 1 rows by id of each vector and label: no search of ``k`` rows returns others."""
    if points.dtype == object or not len(points):
        return np.arange(len(points))
    keyed = np.ascontiguousarray(np.column_stack([points, labels]))
    number = np.unique(keyed.view(np.dtype((np.void, keyed.dtype.itemsize * keyed.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.lexsort((ids, number))
    start = np.flatnonzero(np.diff(number[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(start, np.diff([*start, len(order)]))
    return order[rank <= k]


def _ints(table, name: str) -> np.ndarray:
    return np.asarray(table.column(name).to_numpy(), np.int64)


def _trees(kept: DataFrame, blocks: int, scale: float, k: int) -> DataFrame:
    def plant(table):
        points, ids, rows, labels = _whole(table.column("vector").to_pylist(), scale), *(_ints(table, c) for c in ("id", "row", "label"))
        some = _first_copies(points, ids, labels, k)
        tree = build(points[some], ids[some], rows[some], labels[some])
        return pa.table({"block": table.column("block")[:1], "tree": pa.array([tree.dumps()], pa.binary())})

    dealt = kept.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    return store(dealt.select("block", "row", "id", "label", "vector").groupBy("block").applyInArrow(plant, "block long, tree binary"))


def _packs(anchors: DataFrame, packs: int, scale: float) -> DataFrame:
    """Anchors (row, label, vector, windows: array of low and high, null for no bound) packed for the search."""
    def pack(table):
        windows = table.column("windows").to_pylist()
        times = np.array([len(w) for w in windows], np.int64)
        points = narrow(_whole(table.column("vector").to_pylist(), scale))
        out = io.BytesIO()
        np.savez(out, points=np.repeat(points, times, axis=0), row=np.repeat(_ints(table, "row"), times), label=np.repeat(_ints(table, "label"), times),
                 low=np.array([w["low"] if w["low"] is not None else -np.inf for ws in windows for w in ws]),
                 high=np.array([w["high"] if w["high"] is not None else np.inf for ws in windows for w in ws]))
        return pa.table({"pack": table.column("pack")[:1], "queries": pa.array([out.getvalue()], pa.binary())})

    dealt = anchors.withColumn("pack", F.pmod(F.xxhash64("row"), F.lit(packs)))
    return dealt.select("pack", "row", "label", "vector", "windows").groupBy("pack").applyInArrow(pack, "pack long, queries binary")


def _searched(packs: DataFrame, trees: DataFrame, blocks: int, same: bool, k: int) -> DataFrame:
    """row, high, score, id: of each anchor's window the first ``k`` rows of every block."""
    def look(batches):
        held, tree = None, None
        for batch in batches:
            for block, data, queries in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if block != held:
                    held, tree = block, Tree.loads(data)
                with np.load(io.BytesIO(queries), allow_pickle=True) as z:
                    points, row, label, low, high = (z[c] for c in ("points", "row", "label", "low", "high"))
                points, tree.points = _same_width(points, tree.points)
                q, score, ids = search(tree, points, label, row, low, high, same, k)
                bounded = high.dtype == object or not np.isinf(high).any()
                yield pa.RecordBatch.from_arrays([
                    pa.array(row[q]), pa.array([int(x) for x in high[q]] if bounded else [None] * len(q), pa.int64()),
                    pa.array([int(x) for x in score], pa.int64()), pa.array(ids)], ["row", "high", "score", "id"])

    parts = min(2 * blocks, max(blocks // 4, 2000))
    asked = packs.withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    met = trees.repartition(parts, "block").join(asked.repartition(parts, "block").hint("merge"), "block").select("block", "tree", "queries")
    return map_docs(met, look, "row long, high long, score long, id long")


def _best(found: DataFrame, k: int, *by: str) -> DataFrame:
    rank = F.expr(f"row_number() OVER (PARTITION BY {', '.join(by)} ORDER BY score DESC, id)")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(rows: DataFrame, id: str, vector: str, label: str, anchor, scale: float = 256, positives: int = 5, negatives: int = 5,
         low_percent: int = 80, high_percent: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row that meets the condition ``anchor``, the
    first ``positives`` other rows of its label by product, and for each of these the first ``negatives`` rows of other labels whose
    product is ``low_percent`` to ``high_percent`` of the positive's."""
    prepare(rows.sparkSession)
    x = F.col(vector).cast("array<double>")
    kept = rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    kept = kept.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").filter(
        F.forall("vector", lambda v: F.coalesce((F.abs(v * F.lit(float(scale))) < F.lit(float("inf"))), F.lit(False))))
    kept = store(kept.withColumn("row", F.monotonically_increasing_id()))
    blocks = max(1, -(-kept.count() // BLOCK))
    anchors = kept.filter("anchor")
    packs = max(1, -(-anchors.count() // ANCHORS))
    trees = _trees(kept, blocks, scale, max(positives, negatives))

    unbounded = F.expr("array(named_struct('low', CAST(NULL AS BIGINT), 'high', CAST(NULL AS BIGINT)))")
    near = _searched(_packs(anchors.withColumn("windows", unbounded), packs, scale), trees, blocks, True, positives)
    near = store(_best(near, positives, "row").select("row", F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
                 .join(anchors.select("row", F.col("id").alias("anchor_id")), "row"))
    bounds = near.select("row", "positive_score", F.expr(f"CAST(ceil({low_percent} * CAST(positive_score AS DECIMAL(19, 0)) / 100) AS BIGINT)").alias("low"),
                         F.expr(f"CAST(floor({high_percent} * CAST(positive_score AS DECIMAL(19, 0)) / 100) AS BIGINT)").alias("high")).filter("low <= high")
    windows = bounds.groupBy("row").agg(F.collect_set(F.struct("low", "high")).alias("windows"))  # ``positives`` at most
    far = _searched(_packs(anchors.join(windows, "row"), packs, scale), trees, blocks, False, negatives)
    far = _best(far, negatives, "row", "high").select("row", "high", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(bounds.select("row", "positive_score", "high").distinct(), ["row", "positive_score"]).join(far, ["row", "high"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

"""SimHash near-duplicates by a binary-trie self-join.

A document's fingerprint has a bit where more than half of its shingle hashes have it. Distinct fingerprints form a
binary trie, and all links are found by joining the trie with itself: pairs of nodes go down together, bits in
which their paths differ add up, and a pair is dropped once the sum exceeds the error budget, so no link is
lost and no other pair is compared.

Scale: exact copies collapse to one fingerprint before anything is joined. The top of the trie is cut into cells;
a cell with more than ``CELL_ROWS`` fingerprints is cut again, four bits deeper, so a third of all fingerprints under
one prefix becomes many cells. Cell pairs within the budget come from flipping at most that many bits of a
prefix (an equi-join, no cross join); each is one bounded row whose subtrees are walked together inside a task. A task
returns a spanning forest of its links, at most one link per fingerprint, and the forests meet in
``components``, so a dense group never emits its pairs.

Defined results: a null or empty text, or one without words, has fingerprint 0, which links like any other; fewer
words than a shingle make one shingle; repeated rows share a fingerprint; a null ``doc_id`` is no candidate for
``component_id`` (null only if no member has an id); an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import as_bytes, free_name, map_docs, store
from glossa.llm.components import component_labels

SHINGLE = 3
BUDGET = 2
SEED = 42
#: Bits of the trie above a cell at first, bits added when a cell is too full, and fingerprints of a full cell.
TOP_BITS, MORE_BITS, CELL_ROWS = 6, 4, 32_768
#: Node pairs walked at a time, and point pairs below which two subtrees are compared directly.
FRONTIER, LEAF_PAIRS = 400_000, 32

_U = np.uint64


# ---- fingerprints -------------------------------------------------------------------------------

def shingle_hashes(text: bytes, width: int) -> list[int]:
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1)
    starts = [0, *ends[:-width].tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[width - 1:] - 1).tolist(), strict=True)]


def majority(hashes: list[int]) -> int:
    """Bits set in more than half of the hashes."""
    if not hashes:
        return 0
    total = np.zeros(64, "i8")
    for at in range(0, len(hashes), 65_536):  # bounds the unpacked bits of a very long text
        part = np.array(hashes[at:at + 65_536], ">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype="i8")
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def _text_hash():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _fingerprints(width: int):
    def run(batches):
        for b in batches:
            fps = np.array([majority(shingle_hashes(t or b"", width)) for t in as_bytes(b.column(1))], _U)
            more = b.columns[2:]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view("i8")), *more], names=["doc_id", "fp", *["text_hash"][:len(more)]])
    return run


def fingerprints(docs: DataFrame, width: int = SHINGLE, hashed: bool = False) -> DataFrame:
    """(doc_id, fp): a row's fingerprint, its 64 bits as a long; and text_hash if ``hashed``."""
    more = [_text_hash().alias("text_hash")] if hashed else []
    return map_docs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more), _fingerprints(width),
                    "doc_id long, fp long" + ", text_hash long" * hashed)


# ---- the walk inside a task ---------------------------------------------------------------------

class _Forest:
    """Union of point indexes, vectorised: hook the larger root to the smaller, then flatten."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.root[u], self.root[v]
            open_ = a != b
            if not open_.any():
                return
            u, v, a, b = u[open_], v[open_], a[open_], b[open_]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (up := self.root[self.root]).tolist() != self.root.tolist():
                self.root = up


def walk(a: np.ndarray, b: np.ndarray, depth: int, differ: int, budget: int, same: bool):
    """Yield (i, j) index arrays with a[i] and b[j] within ``budget`` bits; ``a`` and ``b`` are sorted and distinct, agree on no
    more than their first ``depth`` bits within each, and differ there in ``differ`` bits. ``same``: one subtree with itself."""
    one = np.array
    stack = [(depth, one([0]), one([len(a)]), one([0]), one([len(b)]), one([differ]))]
    while stack:
        k, al, ah, bl, bh, d = stack.pop()
        if len(al) > FRONTIER:  # depth first, so the frontier stays bounded
            half = len(al) // 2
            stack += [(k, *(x[:half] for x in (al, ah, bl, bh, d))), (k, *(x[half:] for x in (al, ah, bl, bh, d)))]
            continue
        many = (ah - al) * (bh - bl)
        small = many <= LEAF_PAIRS if k < 64 else np.ones(len(al), bool)
        if small.any():
            n, width = many[small], (bh - bl)[small]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i = np.repeat(al[small], n) + at // np.repeat(width, n)
            j = np.repeat(bl[small], n) + at % np.repeat(width, n)
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            yield i[near], j[near]
        if small.all():
            continue
        al, ah, bl, bh, d = (x[~small] for x in (al, ah, bl, bh, d))
        bit = _U(1) << _U(63 - k)
        middle = lambda x, lo, hi: np.clip(np.searchsorted(x, (x[lo] & ~(bit | (bit - _U(1)))) | bit), lo, hi)
        am, bm = middle(a, al, ah), middle(b, bl, bh)
        mirrored = (al == bl) & (ah == bh) if same else np.zeros(len(al), bool)
        parts = [(al, am, bl, bm, d), (am, ah, bm, bh, d), (al, am, bm, bh, d + 1),
                 tuple(x[~mirrored] for x in (am, ah, bl, bm, d + 1))]
        al, ah, bl, bh, d = (np.concatenate(x) for x in zip(*parts))
        go = (ah > al) & (bh > bl) & (d <= budget)  # prune: the error budget is exceeded
        if go.any():
            stack.append((k + 1, *(x[go] for x in (al, ah, bl, bh, d))))


def _forest_links(budget: int):
    def run(batches):
        for batch in batches:
            us, vs = [], []
            for row in batch.to_pylist():
                same = row["b"] is None
                a = np.sort(np.array(row["a"], "i8").view(_U))
                b = a if same else np.sort(np.array(row["b"], "i8").view(_U))
                points = a if same else np.concatenate([a, b])
                forest, shift = _Forest(len(points)), 0 if same else len(a)
                for i, j in walk(a, b, row["depth"], row["differ"], budget, same):
                    forest.add(i, j + shift)
                linked = np.flatnonzero(forest.root != np.arange(len(points)))
                us.append(points[linked].view("i8"))
                vs.append(points[forest.root[linked]].view("i8"))
            empty = [np.zeros(0, "i8")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us or empty)), pa.array(np.concatenate(vs or empty))], names=["u", "v"])
    return run


# ---- cells --------------------------------------------------------------------------------------

def _prefix(depth):
    """The first ``depth`` (1 to 63, a column or a number) bits of fp."""
    return F.shiftrightunsigned("fp", 64 - depth) if isinstance(depth, int) else F.expr(f"shiftrightunsigned(fp, 64 - {depth})")


def _cells(fps: DataFrame, cell_rows: int) -> DataFrame:
    """(depth, prefix, fps): the trie cut so that no cell holds more than ``cell_rows`` fingerprints (or at 62 bits)."""
    placed = fps.select("fp", F.lit(TOP_BITS).alias("depth"), _prefix(TOP_BITS).alias("prefix"))
    deepest = TOP_BITS
    while deepest + MORE_BITS < 64:
        full = store(placed.groupBy("depth", "prefix").agg(F.count("*").alias("n")).filter(F.col("n") > cell_rows).drop("n"))
        if full.isEmpty():
            break
        deepest += MORE_BITS
        placed = (placed.join(full.withColumn("more", F.lit(MORE_BITS)), ["depth", "prefix"], "left")
                  .select("fp", (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
                  .withColumn("prefix", _prefix("depth")))
        placed = store(placed)
    return store(placed.groupBy("depth", "prefix").agg(F.collect_list("fp").alias("fps")))


def _cell_pairs(cells: DataFrame, budget: int) -> DataFrame:
    """(a, b, depth, differ): pairs of cells whose common prefix differs in at most ``budget`` bits, each once; b is null for
    a cell with itself. The shallower cell flips its prefix; the other is met at that depth."""
    depths = [r["depth"] for r in cells.select("depth").distinct().collect()]  # at most 15
    own = cells.select(F.lit(True).alias("same"), F.col("fps").alias("a"), F.lit(None).cast("array<bigint>").alias("b"), "depth", F.lit(0).alias("differ"))
    pairs = own
    for depth in depths:
        masks = [(sum(1 << i for i in c), len(c)) for r in range(budget + 1) for c in combinations(range(depth), r)]
        flips = F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(n).alias("differ")) for m, n in masks]))
        near = (cells.filter(F.col("depth") == depth).select(F.col("prefix").alias("pa"), flips.alias("f"))
                .select("pa", F.col("pa").bitwiseXOR(F.col("f.mask")).alias("meet"), "f.differ"))
        met = (cells.filter(F.col("depth") >= depth)
               .select(F.col("depth").alias("db"), F.col("prefix").alias("pb"),
                       F.expr(f"shiftrightunsigned(prefix, depth - {depth})").alias("meet")))
        found = near.join(met, "meet").filter((F.col("db") > depth) | (F.col("pa") < F.col("pb")))
        left = cells.filter(F.col("depth") == depth).select(F.col("prefix").alias("pa"), F.col("fps").alias("a"))
        right = cells.select(F.col("depth").alias("db"), F.col("prefix").alias("pb"), F.col("fps").alias("b"))
        pairs = pairs.union(found.join(left, "pa").join(right, ["db", "pb"])
                            .select(F.lit(False), "a", "b", F.lit(depth), "differ"))
    return pairs.drop("same")


def fingerprint_links(fps: DataFrame, budget: int = BUDGET, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that connect exactly those within ``budget`` bits, reduced to a
    spanning forest for each pair of cells."""
    pairs = _cell_pairs(_cells(fps, cell_rows), budget)
    parts = max(fps.sparkSession.sparkContext.defaultParallelism, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return map_docs(pairs.repartition(4 * parts), _forest_links(budget), "u long, v long")


def _labelled(marked: DataFrame, budget: int, cell_rows: int) -> DataFrame:
    """(fp, first, label) of the distinct fingerprints of ``marked``: the smallest ``doc_id`` of each, and its component."""
    nodes = store(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = component_labels(fingerprint_links(nodes.select("fp"), budget, cell_rows)).withColumnRenamed("node", "fp")
    return store(nodes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, budget: int = BUDGET, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: the fingerprint as 16 hexadecimal digits, and the smallest
    ``doc_id`` that links reach."""
    marked = store(fingerprints(docs, width))
    named = _labelled(marked, budget, cell_rows)
    smallest = store(named.groupBy("label").agg(F.min("first").alias("component_id")))
    members = store(named.join(smallest, "label").select("fp", "component_id"))
    return marked.join(members, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, width: int = SHINGLE, budget: int = BUDGET, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest ``doc_id``, and of its rows there that whose text has
    the smallest hash, once if it repeats. Rows that share a ``doc_id`` are told apart by their texts. Rows without a
    ``doc_id`` can't be named as copies of one another and stay."""
    key, text_key = free_name(docs, "near_doc"), free_name(docs, "near_text")
    marked = store(fingerprints(docs, width, hashed=True))
    labels = _labelled(marked, budget, cell_rows).select("fp", "label")
    kept = (marked.filter(F.col("doc_id").isNotNull()).join(labels, "fp").groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
            .select(F.col("row.doc_id").alias(key), F.col("row.text_hash").alias(text_key)))
    named = docs.filter(F.col("doc_id").isNotNull()).withColumn(text_key, _text_hash())
    met = named.join(kept.withColumnRenamed(text_key, f"{text_key}_kept"),
                     (F.col("doc_id").cast("long") == F.col(key)) & (F.col(text_key) == F.col(f"{text_key}_kept")), "left_semi")
    return met.dropDuplicates(["doc_id", text_key]).drop(text_key).union(docs.filter(F.col("doc_id").isNull()))

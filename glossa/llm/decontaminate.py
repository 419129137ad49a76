"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact containment.

A document leaks a test item if it contains at least ``threshold`` of the item's distinct shingles (``width`` words,
lower-cased ``\\w+``). Items are partitioned by size into powers of two. An item's sketch is its bottom-k MinHash with
k = n - ceil(threshold * n) + 1: a document that holds enough of n shingles misses fewer than k, so it holds at least
one sketched shingle. Banded signatures lose short items in long documents (a similarity near 0 needs a signature as
long as the document); the bottom-k sketch of the short side has full recall at any document length. A document probes
only partitions whose smallest qualifying size it can reach, and candidates are verified on the shingles themselves.

Scale: items go out in blocks of at most about ``BLOCK_BYTES`` of text, each a bounded broadcast and one pass over the
documents, so neither side is bounded in total; documents are never shuffled, however long or often copied.

Defined results: items without words match nothing; an item of fewer than ``width`` words is one shingle of all its words
and is looked up among windows of that many words; null or empty documents match nothing; each repeated row of either
side gives its own link row (items by (item_id, text)); empty tables give an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from math import ceil

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import free_name, map_docs

WIDTH = 5
THRESHOLD = 0.8
BLOCK_BYTES = 8 << 20

_WORD = re.compile(r"\w+")
_hash = xxhash.xxh3_64_intdigest

LINKS = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str], width: int) -> set[str]:
    return {" ".join(words[i:i + width]) for i in range(len(words) - width + 1)}


def need(n: int, threshold: float) -> int:
    """Shingles of n that must be shared."""
    return max(1, ceil(threshold * n - 1e-9))


class ItemIndex:
    """Sketches of a block of items: (shingle width, size class) -> {shingle hash: items}."""

    def __init__(self, items: list[tuple[int, str]], width: int = WIDTH, threshold: float = THRESHOLD):
        self.threshold, self.items = threshold, []
        self.parts: dict[tuple[int, int], dict[int, list[int]]] = {}
        self.smallest: dict[tuple[int, int], int] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            w = min(width, len(words))
            whole = shingles(words, w)
            at, n = len(self.items), len(whole)
            self.items.append((item_id, whole))
            part = (w, n.bit_length())
            self.smallest[part] = min(self.smallest.get(part, n), need(n, threshold))
            sketch = sorted(_hash(s) for s in whole)[:n - need(n, threshold) + 1]
            table = self.parts.setdefault(part, {})
            for h in sketch:
                table.setdefault(h, []).append(at)
        self.widths = sorted({w for w, _ in self.parts})

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, its shingles, shared shingles) of every item the text leaks."""
        words, found = words_of(text), []
        for w in self.widths:
            if len(words) < w:
                continue
            joined = [" ".join(g) for g in zip(*(words[i:] for i in range(w)))]
            hashes = set(map(_hash, joined))
            candidates = {i for part, table in self.parts.items()
                          if part[0] == w and self.smallest[part] <= len(hashes)
                          for h in table.keys() & hashes for i in table[h]}
            if candidates:
                own = set(joined)
                for i in sorted(candidates):
                    item_id, whole = self.items[i]
                    shared = len(whole & own)
                    if shared >= need(len(whole), self.threshold):
                        found.append((item_id, len(whole), shared))
        return found


def _search(block, width: int, threshold: float):
    def run(batches):
        index = ItemIndex(block.value, width, threshold)
        for b in batches:
            rows = [(doc, item, n, k, k / n) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                    for item, n, k in index.search(text)]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (*[pa.int64()] * 4, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                             names=["doc_id", "item_id", "n_shingles", "n_shared", "containment"])
    return run


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): every leak of an item in a document."""
    spark = docs.sparkSession
    items = items.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for k in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # about block_bytes
        block = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in mine])
        part = map_docs(docs, _search(block, width, threshold), LINKS)
        found = part if found is None else found.union(part)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that leak an item. A document without a ``doc_id`` can't be named and stays."""
    key = free_name(docs, "leak_doc")
    bad = leaks(docs, items, width, threshold, block_bytes).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad[key], "left_anti")

"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over
the threshold, reassemble by position.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased. Keys of
at least ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines,
except in the largest ``doc_id`` that holds the key. Everything else stays, joined by ``\\n``.

Scale: a document sends each distinct key once, as a 16-byte digest, so a boilerplate line costs
one small row a document and is counted with map-side combine; the text itself moves at most once,
to meet its own document's list of dropped keys.

Defined results: a null or empty text is one empty line; a null ``doc_id`` holds no key (never the
largest, never counted) but loses lines of dropped keys; rows that repeat a ``doc_id`` count as one
document and each row is cleaned; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import as_bytes, free_name, map_docs, store, with_fields

MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: bytes) -> bytes:
    """Normalised line; ``bytes.strip``/``lower`` know exactly the ASCII white space and letters."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars


def _keys(min_chars: int):
    def run(batches):
        for b in batches:
            ids, rows, hashes = [], [], []
            for doc, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True):
                keys = {line_key(x) for x in (text or b"").split(b"\n")}
                found = {_digest(k) for k in keys if _long_enough(k, min_chars)}
                ids += [doc] * len(found)
                rows += [row] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(hashes, pa.binary())],
                                             names=["doc", "row", "h"])
    return run


def dropped_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, row, drops): the digests of the keys each text of a document loses; ``row`` is a hash of the text, so that rows of one id,
    or of none, have lists of their own."""
    keys = store(map_docs(docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("row"), "text"), _keys(min_chars),
                          "doc long, row long, h binary"))
    # stored, so that both sides of the join are plain shuffles and a hot key can be split
    common = store(keys.groupBy("h").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keeper"))
                   .filter(F.col("n") >= min_docs).select("h", "keeper"))
    lost = keys.join(common, "h").filter(F.col("doc").isNull() | (F.col("doc") != F.col("keeper")))
    return lost.groupBy("doc", "row").agg(F.collect_set("h").alias("drops"))


def _reassemble(text_at: int, min_chars: int):
    def run(batches):
        for b in batches:
            texts, lines, dropped = [], [], []
            drops = b.column(b.num_columns - 1).to_pylist()
            for text, lost in zip(as_bytes(b.column(text_at)), drops, strict=True):
                parts = (text or b"").split(b"\n")
                kept = parts
                if lost:
                    lost = set(lost)
                    kept = [x for x in parts if not (_long_enough(k := line_key(x), min_chars) and _digest(k) in lost)]
                texts.append(text if len(kept) == len(parts) else b"\n".join(kept))
                lines.append(len(parts))
                dropped.append(len(parts) - len(kept))
            cols = b.columns[:-1]
            cols[text_at] = pa.array(texts, pa.large_binary()).cast(pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                                             names=[*b.schema.names[:-1], "n_lines", "n_dropped"])
    return run


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` reassembled from the kept lines, plus n_lines (before dropping) and n_dropped."""
    docs = docs.drop("n_lines", "n_dropped")
    key, row, drops = (free_name(docs, n) for n in ("line_doc", "line_row", "line_drops"))
    lost = dropped_keys(docs, min_chars, min_docs).select(F.col("doc").alias(key), F.col("row").alias(row), F.col("drops").alias(drops))
    met = docs.join(lost, docs["doc_id"].cast("long").eqNullSafe(lost[key]) & (F.xxhash64(docs["text"]) == lost[row]), "left").drop(key, row)
    return map_docs(met, _reassemble(docs.columns.index("text"), min_chars),
                    with_fields(docs.schema, ("n_lines", "long"), ("n_dropped", "long")))

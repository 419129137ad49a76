"""Token counts of a document's sections, by offset-mapped attribution.

Each document has the character span of every token of its whole text (put together from the spans of its pre-tokens where
the tokenizer file allows it, else by encoding it as a whole); an interval join of the sorted spans with the sorted
section spans attributes the tokens. A token that crosses a boundary is allocated by an explicit rule:
``first`` (to the section of its first character), ``last`` (of its last) or ``most`` (of most of its characters, the
earliest if equal). So a document's counts always add up to its number of tokens, which encoding sections one by one
would not give.

Sections are the lines of the text, each with its line break: together they cover every character. Spans are in code
points. A document and its sections are one row, so the interval join needs no shuffle, and a very long text costs
its own length.

Defined results: a null or empty text is one empty section without tokens; repeated rows are counted each; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import map_docs
from glossa.llm.tokens import Generations, load, read_tokenizer, shared

RULES = ("first", "last", "most")
SECTIONS = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"


#: The expression of a byte-level pre-tokenizer that splits by its own.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def splits_by(spec: str, pattern: str) -> bool:
    """Whether the tokenizer file does nothing to a text across pre-tokens, and splits it by ``pattern``."""
    spec = json.loads(spec)
    byte = spec.get("pre_tokenizer") or {}
    split = BYTE_LEVEL
    if byte.get("type") == "Sequence" and len(byte["pretokenizers"]) == 2:
        first, byte = byte["pretokenizers"]
        split = first.get("pattern", {}).get("Regex") if first["type"] == "Split" and first["behavior"] == "Isolated" and not first["invert"] else None
        split = None if byte.get("use_regex", True) else split
    elif not byte.get("use_regex", True):
        split = None
    return (byte.get("type") == "ByteLevel" and not byte["add_prefix_space"] and split == pattern and not spec.get("normalizer")
            and not spec.get("post_processor") and all(t["special"] for t in spec.get("added_tokens") or ()))


class SpanEncoder(Generations):
    """Token spans by pre-token, for tokenizers whose pre-tokenizer is ``pattern``: each pre-token is encoded by itself, so the
    spans of a text are those of its pre-tokens, shifted. Packed as 32-bit (start, end) pairs. With any other tokenizer
    file, texts are encoded whole."""

    def __init__(self, spec: str, pattern: str):
        super().__init__()
        self.tokenizer = load(spec)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = not splits_by(spec, pattern)
        self.split = regex.compile(pattern).findall

    def make(self, key: str) -> bytes:
        return np.asarray(self.tokenizer.encode(key, add_special_tokens=False).offsets, "<i4").tobytes()

    def spans(self, text: str) -> np.ndarray:
        """(tokens, 2): first character and the one after the last."""
        if self.whole:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, "i8").reshape(-1, 2)
        pieces = self.split(text)
        packed = [self[p] for p in pieces]
        sizes = np.fromiter(map(len, pieces), "i8", len(pieces))
        tokens = np.fromiter(map(len, packed), "i8", len(pieces)) // 8
        found = np.frombuffer(b"".join(packed), "<i4").reshape(-1, 2).astype("i8")
        return found + np.repeat(np.cumsum(sizes) - sizes, tokens)[:, None]


def line_sections(text: str) -> np.ndarray:
    """Start of each line, and the end of the text."""
    starts = [0]
    at = text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array([*starts, len(text)], "i8")


def allocate(spans: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens allocated to each section [edges[i], edges[i + 1]), and how many of those cross one of its ends."""
    sections = len(edges) - 1
    first = np.searchsorted(edges[1:-1], spans[:, 0], "right")
    last = np.searchsorted(edges[1:-1], spans[:, 1] - 1, "right")
    crossing = np.flatnonzero(first != last)
    to = first if rule == "first" else last
    if rule == "most":
        to = first.copy()
        for t in crossing:
            s = np.arange(first[t], last[t] + 1)
            to[t] = s[(np.minimum(edges[s + 1], spans[t, 1]) - np.maximum(edges[s], spans[t, 0])).argmax()]
    return np.bincount(to, minlength=sections), np.bincount(to[crossing], minlength=sections)


def _counts(spec, pattern: str, rule: str):
    def run(batches):
        encoder = shared(SpanEncoder, spec.value, pattern)
        for b in batches:
            docs, parts = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                edges = line_sections(text or "")
                tokens, crossing = allocate(encoder.spans(text or ""), edges, rule)
                docs += [doc] * len(tokens)
                parts.append((np.arange(len(tokens)), edges[:-1], edges[1:], tokens, crossing))
            cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, "i8")] * 5
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(cols[0].astype("i4")), *map(pa.array, cols[1:])],
                                             names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])
    return run


def section_tokens(docs: DataFrame, tokenizer: str, pattern: str, rule: str = "first") -> DataFrame:
    """One row per section of a document: its span, the tokens allocated to it and those among them that cross its end or
    start. ``tokenizer``: path of a tokenizer file; ``pattern``: the expression its pre-tokenizer splits by."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}: {rule!r}")
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))
    return map_docs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _counts(spec, pattern, rule), SECTIONS)

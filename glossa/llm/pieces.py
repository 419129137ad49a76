"""SentencePiece encoding and decoding, exact for BPE models with byte fallback.

A merge-type encoding of a string is the one sequence of pieces in which every two neighbours are compatible: merging the
characters of both once more gives the same two pieces. It is found by backtracking instead of by merging: take the longest
piece at a place (an Aho-Corasick automaton over the reversed string gives the longest piece that starts at every place),
check it against the piece before, else try the next shorter piece that is its prefix; where none fits, the place is marked
in a bitfield as failed, the piece before is given up, and shorter ones are tried for it. A place fails at most once, so the
work is linear in the string.

Texts are cut where no piece of the vocabulary reaches across (before white space, and between any two characters that
are neighbours in no piece), so a part met before costs one look-up in a bounded cache.

Null texts count as empty; empty texts have no ids and decode to the empty text. Rows are independent: repeated rows, null
ids and extra columns pass through unchanged. Memory is bounded by the longest text of a batch and the caches.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glossa.llm.common import free_name, map_docs, with_fields
from glossa.llm.tokens import Generations, shared

SPACE = "▁"
#: Pairs of pieces whose compatibility a worker remembers.
CACHE_PAIRS = 2_000_000
#: Piece types of the model file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
#: The score of a merge that no piece allows.
NEVER = float("-inf")


def read_model(path: str) -> bytes:
    """The model file; its size does not depend on the corpus."""
    with open(path, "rb") as f:
        return f.read()


def _cut_points(pieces: list[str]) -> set[str]:
    """Pairs of characters that are neighbours in some piece."""
    return {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}


class Vocabulary:
    """Pieces, scores and longest matches of a model."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != BPE or not trainer.byte_fallback:
            raise ValueError("the model must be of BPE type with byte fallback")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only models without normalisation, with white space as a prefix, are supported")
        if any(p.type in (USER_DEFINED, UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = norm.add_dummy_prefix
        self.types = [p.type for p in proto.pieces]
        self.unk_surface = trainer.unk_surface
        self.text = [p.piece for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.byte_id = [0] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.byte_id[int(p.piece, 16) if p.piece.startswith("0x") else int(p.piece[3:5], 16)] = i
        self.near = _cut_points(list(self.id))
        self.alphabet = set("".join(self.id))
        # a character that is part of pieces but no piece itself stands alone until merged
        self.matches = {**{c: c for c in self.alphabet}, **{p: p for p in self.id}}
        self.automaton = ahocorasick.Automaton()
        for p in self.matches:
            self.automaton.add_word(p[::-1], p)
        self.automaton.make_automaton()
        #: Whether white space begins a part in every piece, so that texts may be cut before it.
        self.spaced = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        self._shorter: dict[str, str] = {}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._history: dict[str, list | None] = {}

    def shorter(self, piece: str) -> str:
        """The longest piece that is a proper prefix; empty if there is none."""
        found = self._shorter.get(piece)
        if found is None:
            found = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.matches), "")
            self._shorter[piece] = found
        return found

    def history(self, piece: str) -> list[tuple[float, str, str]] | None:
        """How the characters of a piece merge, best score and then leftmost first: the next merge's score and the first and last
        symbol, step by step. None if they don't end as the piece."""
        if piece in self._history:
            return self._history[piece]
        score, symbols, steps = self.score, list(piece), []
        while True:
            best, at = NEVER, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1], NEVER)
                if s > best:
                    best, at = s, i
            steps.append((best, symbols[0], symbols[-1]))
            if at < 0:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        found = self._history[piece] = steps if len(symbols) == 1 else None
        return found

    def remerge(self, left: str, right: str) -> bool:
        """Whether merging the characters of both, best score and then leftmost first, ends with these two pieces: their own
        merges take turns by score, and none across the edge may come first."""
        a, b = self.history(left), self.history(right)
        if a is None or b is None:
            return False
        score, i, j = self.score.get, 0, 0
        while True:
            (next_a, _, last), (next_b, first, _) = a[i], b[j]
            across = score(last + first, NEVER)
            if across > next_a and across >= next_b:
                return False
            if next_a >= next_b:
                if next_a == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def compatible(self, left: str, right: str) -> bool:
        found = self._pairs.get((left, right))
        if found is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            found = self._pairs[left, right] = self.remerge(left, right) if left else self.history(right) is not None
        return found

    def longest(self, part: str) -> dict[int, str]:
        """The longest piece that starts at each place of a string over the alphabet, by the place's distance from the last one."""
        found = list(self.automaton.iter(part[::-1]))  # of one place, longer pieces come first
        found.reverse()
        return dict(found)

    def pieces(self, part: str) -> list[str]:
        """The merge-type encoding of a string over the alphabet, by backtracking."""
        if part in self.matches and self.compatible("", part):
            return [part]
        longest, end = self.longest(part), len(part) - 1
        failed = bytearray(len(part) + 1)
        pairs, out = self._pairs, []
        at, piece = 0, longest[end]
        while at <= end:
            last = out[-1] if out else ""
            while piece:
                fits = pairs.get((last, piece))
                if (self.compatible(last, piece) if fits is None else fits) and not failed[at + len(piece)]:
                    break
                piece = self.shorter(piece)
            if piece:
                out.append(piece)
                at += len(piece)
                piece = longest.get(end - at)
            else:
                if not out:
                    raise ValueError("the vocabulary has no merge-type encoding of a text")
                failed[at] = 1
                piece = out.pop()
                at -= len(piece)
        return out


class PieceEncoder(Generations):
    """Maps a part of a text (white space as the space symbol) to its ids, packed as little-endian 32-bit numbers."""

    def __init__(self, model: bytes):
        super().__init__()
        self.v = v = Vocabulary(model)
        # ASCII characters of no piece are cut off as well, as line feeds mostly are
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in v.alphabet and chr(c) != " ")
        self.parts = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else "")) if v.spaced else re.compile("(?s).+")
        self.surface = [self._surface(i) for i in range(len(v.types))]
        self.controls = {i for i, kind in enumerate(v.types) if kind == CONTROL}

    def _surface(self, i: int) -> bytes:
        kind, text = self.v.types[i], self.v.text[i]
        if kind == BYTE:
            return bytes([self.v.byte_id.index(i)])
        if kind == CONTROL:
            return b""
        return (self.v.unk_surface if kind == UNKNOWN else text.replace(SPACE, " ")).encode("utf-8")

    def _bytes(self, char: str) -> list[int]:
        return [self.v.byte_id[b] for b in char.encode("utf-8", "replace")]

    def make(self, key: str) -> bytes:
        v = self.v
        cuts = [0, *(i for i in range(1, len(key)) if key[i - 1:i + 1] not in v.near), len(key)]
        if len(cuts) > 2:
            return b"".join([self[key[s:e]] for s, e in zip(cuts, cuts[1:])])
        ids = []
        for p in v.pieces(key) if key[0] in v.alphabet else [key]:
            ids += [v.id[p]] if p in v.id else self._bytes(p)
        return np.asarray(ids, "<i4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, without begin or end ids."""
        if not text:
            return np.empty(0, "<i4")
        text = text.replace(" ", SPACE)
        parts = self.parts.findall(SPACE + text if self.v.prefix else text)
        return np.frombuffer(b"".join(map(self.__getitem__, parts)), "<i4")

    def decode(self, ids) -> str:
        """Text of ids: white space restored, the space put before the text removed, byte pieces joined to characters."""
        if not len(ids):
            return ""
        types, surface = self.v.types, self.surface
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        head = b""
        if self.v.prefix:  # the first visible piece loses one space, unless bytes precede it
            k = 0
            while k < len(ids) and types[ids[k]] == CONTROL:
                k += 1
            ids = ids[k:]
            if ids and types[ids[0]] == NORMAL and surface[ids[0]][:1] == b" ":
                head, ids = surface[ids[0]][1:], ids[1:]
        if self.controls.isdisjoint(ids):  # a control piece ends a run of bytes
            try:
                return (head + b"".join([surface[i] for i in ids])).decode("utf-8")
            except UnicodeDecodeError:
                pass
        return head.decode("utf-8") + self._decode_runs(ids)

    def _decode_runs(self, ids: list[int]) -> str:
        """Runs of byte pieces that are no valid UTF-8: each byte that begins no character becomes U+FFFD."""
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.v.types[i] == BYTE:
                run += self.surface[i]
                continue
            while run:
                size = next((k for k in (1, 2, 3, 4) if len(run) >= k and _one_character(bytes(run[:k]))), 0)
                out.append(bytes(run[:size]).decode("utf-8") if size else "�")
                del run[:size or 1]
            if i is not None:
                out.append(self.surface[i].decode("utf-8"))
        return "".join(out)


def _one_character(data: bytes) -> bool:
    try:
        return len(data.decode("utf-8")) == 1
    except UnicodeDecodeError:
        return False


def encode_texts(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns of ``docs`` with two more: the ids of each whole text and the text decoded from them. Where a name is taken,
    the new column gets underscores before it."""
    model = read_model(model_path)
    ids_name, back_name = free_name(docs, ids), free_name(docs, decoded)
    schema = with_fields(docs.schema, (ids_name, "array<int>"), (back_name, "string"))
    at = docs.columns.index(text)

    def run(batches):
        coder = shared(PieceEncoder, model)
        for batch in batches:
            coded = [coder.encode(t or "") for t in batch.column(at).to_pylist()]
            ends = np.cumsum([0, *map(len, coded)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, "<i4"), *coded]).astype(np.int32)))
            back = pa.array([coder.decode(c) for c in coded], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, back], [*batch.schema.names, ids_name, back_name])

    return map_docs(docs, run, schema)

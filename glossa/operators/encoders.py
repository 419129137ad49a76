"""Encoders of words (D6) for the language model: small callables, bounded by the vocabulary, that are broadcast and
applied to the unseen words of a batch of paragraphs at once."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np

from glossa.operators import forecast as FC
from glossa.operators import subword as W
from glossa.operators.bpe import UNK


@dataclass
class Lexical:
    """Words, or their characters; a unit outside the vocabulary is ``<unk>``, so an LM depends on the size."""
    method: str
    vocab: frozenset[str]
    unknown = UNK

    def __call__(self, words: Sequence[str]) -> list[list[str]]:
        return [[u if u in self.vocab else UNK for u in ([w] if self.method == "word" else w)] for w in words]

    def tokens(self) -> frozenset[str]:
        return self.vocab | {UNK}

    def known(self, token: str) -> bool:
        return token in self.vocab

    def follows(self, other: object) -> bool:
        """Whether the tokens of ``other`` give its own: those it doesn't know are unknown."""
        return isinstance(other, Lexical) and self.method == other.method and self.vocab <= other.vocab

    def numbered(self, words: Sequence[str], numbers: Mapping[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words as ``numbers`` has them, and how many each word has."""
        unknown = numbers[UNK]
        if self.method == "word":
            known = {u: numbers[u] for u in self.vocab}
            return np.fromiter(map(known.get, words, repeat(unknown)), np.int64, len(words)), np.ones(len(words), np.int64)
        units = sorted(u for u in self.vocab if len(u) == 1)
        table = np.full(max(map(ord, units), default=0) + 2, unknown, np.int64)  # the last one for all beyond
        for u in units:
            table[ord(u)] = numbers[u]
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        return table[np.minimum(codes, len(table) - 1)], np.fromiter(map(len, words), np.int64, len(words))


@dataclass
class Merges:
    """BPE: the pair of the lowest rank merges until none is left."""
    merges: list[tuple[str, str, str]]
    alphabet: frozenset[str]
    rank: dict[tuple[str, str], int] = field(init=False)

    def __post_init__(self):
        self.rank = {}
        for i, (l, r, _) in enumerate(self.merges):
            self.rank.setdefault((l, r), i)

    def _word(self, word: str) -> list[str]:
        s = [c if c in self.alphabet else UNK for c in word]
        while (best := min((self.rank[p] for p in zip(s, s[1:]) if p in self.rank), default=None)) is not None:
            s = FC.merge_once(s, *self.merges[best])
        return s

    def __call__(self, words: Sequence[str]) -> list[list[str]]:
        return [self._word(w) for w in words]


class Built:
    """An encoder that is built from what is shipped where it is first used."""
    _encode = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_encode"}


@dataclass
class WordPiece(Built):
    vocab: Sequence[str]

    def __call__(self, words: Sequence[str]) -> list[list[str]]:
        self._encode = self._encode or W.wordpiece_encoder(self.vocab)
        return self._encode(words)[0]


@dataclass
class Unigram(Built):
    """Raw white-space words with the marker: compatibility normalisation, then each word that is left."""
    pieces: Sequence[tuple[str, float]]

    def __call__(self, words: Sequence[str]) -> list[list[str]]:
        self._encode = self._encode or W.unigram_encoder(self.pieces)
        parts = [[W.META + x for x in unicodedata.normalize("NFKC", w[len(W.META):]).split()] for w in words]
        found = iter(self._encode([x for p in parts for x in p]))
        return [[t for _ in p for t, _ in next(found)] for p in parts]

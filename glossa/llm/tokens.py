"""Token ids from a public tokenizer file, with a bounded cache of chunks.

The files' pre-tokenizers never look across the boundaries used here, so a text's ids are the ids
of its chunks put together; the tests hold this against encoding whole texts. A chunk seen before costs one
dictionary look-up, so most of a corpus is encoded at the speed of ``bytes.split``.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Chunks a generation of a cache may hold (two are kept), and the longest chunk it keeps: together they bound a
#: worker's memory.
CACHE_CHUNKS = 600_000
CACHE_CHUNK_BYTES = 64
#: Unseen chunks that are encoded as one text.
LEARN_CHUNKS = 2000
#: Lower-case Latin words: letters only, so one pre-token, and stable under the normaliser (NFC, lower case).
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def read_tokenizer(path: str) -> str:
    """The tokenizer file as text; a few MB whatever the corpus, so it can be broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def load(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_str(spec)


def byte_characters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(256 + i) for i, b in enumerate(others)}


_shared: dict = {}


def shared(kind, *args):
    """One encoder a worker process and arguments: its cache serves all tasks that the process runs."""
    if (kind, args) not in _shared:
        _shared.clear()  # one at a time: its memory is the bound
        _shared[kind, args] = kind(*args)
    return _shared[kind, args]


class Generations(dict):
    """A cache that forgets what it hasn't met since it was last full."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def keep(self, key, value) -> None:
        if len(self) >= CACHE_CHUNKS:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= CACHE_CHUNK_BYTES:
            self.keep(key, found)
        return found


#: Punctuation between an ASCII letter and white space is a pre-token of its own: cut off, it leaves fewer distinct chunks.
#: (An apostrophe may not be.)
_TAIL = re.compile(rb"(?<=[a-z])[!-&(-/:-@\[-`{-~]+(?=\s|\Z)")


class SpacedIds(Generations):
    """For tokenizers that lower-case and drop white space: maps a chunk between ASCII white space to its ids, packed as
    little-endian unsigned 32-bit numbers."""

    def __init__(self, spec: str):
        super().__init__()
        self.tokenizer = load(spec)
        self.model = self.tokenizer.model
        self.byte_chars = byte_characters()

    def make(self, key: bytes) -> bytes:
        ids = self.tokenizer.encode(key.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()

    @staticmethod
    def chunks(text: bytes) -> list[bytes]:
        if b"<|" in text:  # may hold special tokens, which are found in the text as it is
            return text.split()
        return _TAIL.sub(rb" \g<0>", text.lower()).split()

    def _words(self, words: list[bytes]) -> None:
        """Words that are one pre-token: the merges alone."""
        tokenize, byte_chars, out = self.model.tokenize, self.byte_chars, {}
        for w in words:
            text = w.decode("ascii") if w.isascii() else w.decode("latin-1").translate(byte_chars)
            out[w] = array("I", [t.id for t in tokenize(text)]).tobytes()
        self.update(out)

    def _together(self, chunks: list[bytes]) -> None:
        """Any chunks: as one text, cut up again by the offsets of its tokens."""
        for at in range(0, len(chunks), LEARN_CHUNKS):
            part = chunks[at:at + LEARN_CHUNKS]
            texts = [c.decode("utf-8", "replace") for c in part]
            encoded = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
            ids = np.asarray(encoded.ids, "<u4").tobytes()
            cuts = (4 * np.searchsorted([s for s, _ in encoded.offsets], starts)).tolist()
            self.update(zip(part, (ids[s:e] for s, e in zip(cuts, cuts[1:]))))

    def learn(self, chunks: set[bytes]) -> None:
        """Encode the unseen chunks of a batch."""
        if len(self) >= CACHE_CHUNKS:
            self.old = dict(self)
            self.clear()
        old, words, rest = self.old, [], []
        for c in chunks - self.keys():
            if c in old:
                self[c] = old[c]
            elif c.isalpha() or _PLAIN.fullmatch(c):  # of bytes: ASCII letters only
                words.append(c)
            elif len(c) <= CACHE_CHUNK_BYTES:
                rest.append(c)
        self._words(words)
        self._together(rest)

    def encode(self, text: bytes) -> bytes:
        """Ids of a text, packed."""
        return b"".join(map(self.__getitem__, self.chunks(text)))

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text; unseen chunks of all of them are encoded together."""
        cut = [self.chunks(t) for t in texts]
        self.learn(set().union(*cut))
        return [b"".join(map(self.__getitem__, t)) for t in cut]

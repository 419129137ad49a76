"""Two-stage suffix sorting of a block of byte strings, to a given depth.

A suffix that is smaller than its successor is of type S, the others are of type L. Only S suffixes are sorted directly
(eight bytes at a time, each round on the still tied ones); the L suffixes are induced by scanning the buckets of first
bytes in order: the predecessors of a bucket's suffixes, in that order, are next in their own buckets. Everything is
vectorised over a bucket, so the work is a few array operations a bucket and a suffix.
"""

from __future__ import annotations

import numpy as np

#: Between strings; no byte of UTF-8, and larger than all of them.
SEPARATOR = 0xFF


def joined(parts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings with separators, padded beyond ``depth``, and where each starts."""
    sep = bytes([SEPARATOR])
    text = np.frombuffer(sep.join(parts) + sep * (depth + 16), np.uint8)
    sizes = np.fromiter(map(len, parts), "i8", len(parts))
    return text, np.cumsum(sizes + 1) - sizes - 1


def words8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a big-endian number (the last seven places are zero)."""
    out = np.zeros(len(text), np.uint64)
    for r in range(8):
        whole = text[r:r + (len(text) - r) // 8 * 8]
        got = whole.copy().view(">u8")
        out[r:r + 8 * len(got):8] = got
    return out


def s_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last is not."""
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    nxt = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    nxt = np.minimum(nxt, n - 2)
    return text[nxt] < text[nxt + 1]


def direct_sort(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Places ordered by their first ``depth`` bytes (rounded up to eight)."""
    at = at[np.argsort(words[at], kind="stable")]
    key = words[at]
    first = np.append(True, key[1:] != key[:-1]) if len(at) else np.zeros(0, bool)
    group = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0)) if len(at) else np.zeros(0, "i8")
    for d in range(8, depth, 8):
        tied = np.append(group[1:] == group[:-1], False)
        tied[1:] |= tied[:-1].copy()
        act = np.flatnonzero(tied)
        if not act.size:
            break
        key = words[at[act] + d]
        order = np.lexsort((key, group[act]))
        at[act], key = at[act][order], key[order]
        own = group[act]
        first = np.append(True, (own[1:] != own[:-1]) | (key[1:] != key[:-1]))
        group[act] = act[np.maximum.accumulate(np.where(first, np.arange(len(act)), 0))]
    return at


def suffix_order(text: np.ndarray, words: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The ``wanted`` suffixes (a mask) in the order of at least their first ``depth`` bytes.

    Runs of wanted places must be followed by their next S suffix within ``text``, as they are inside ``joined`` strings."""
    small = s_types(text)
    n = len(text)
    next_s = np.minimum.accumulate(np.where(small, np.arange(n), n - 1)[::-1])[::-1]
    ends = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
    grow = np.zeros(n + 1, "i8")  # from each run's end to its next S suffix
    np.add.at(grow, ends, 1)
    np.add.at(grow, next_s[ends] + 1, -1)
    needed = wanted | (np.cumsum(grow[:-1]) > 0)
    induced = needed & ~small
    direct = direct_sort(np.flatnonzero(needed & small), words, depth)
    cuts = np.searchsorted(text[direct], np.arange(257))
    heads: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        scan = [np.concatenate(heads[c])] if heads[c] else []
        while scan and scan[-1].size:  # predecessors that start with the same byte join this bucket
            before = scan[-1] - 1
            before = before[before >= 0]
            scan.append(before[induced[before] & (text[before] == c)])
        whole = np.concatenate([*scan, direct[cuts[c]:cuts[c + 1]]]) if scan or cuts[c] < cuts[c + 1] else None
        if whole is None:
            continue
        out.append(whole)
        before = whole - 1
        before = before[before >= 0]
        before = before[induced[before] & (text[before] > c)]
        byte = text[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        for v in np.unique(byte):
            lo, hi = np.searchsorted(byte, [v, v + 1] if v < 255 else [v, 256])
            heads[v].append(before[lo:hi])
    sa = np.concatenate(out) if out else np.zeros(0, "i8")
    return sa[wanted[sa]]


def adjacent_equal(sa: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix but the first: whether it shares its first ``depth`` (8 at least) bytes with the one before."""
    a, b = sa[:-1], sa[1:]
    same = np.ones(len(a), bool)
    for d in [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:
        at = np.flatnonzero(same)
        same[at] = words[a[at] + d] == words[b[at] + d]
    return same

"""Segmentation lattices of many words at once, over a vocabulary trie in arrays.

A batch of words is one array of characters; its lattice is one array of edges (a piece, from one place of a word to a later
one). The trie finds all edges, a character deeper at a time, for all places where some piece still goes on. Sums over the
segmentations (forward and backward) and the best one (Viterbi) go through the places by their distance from the word's
begin, for all words together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

_CHAR_BITS = 21  # code points are below 2 ** 21
UNKNOWN = -1
#: Nodes times characters of a trie up to which its steps are a table.
TABLE_CELLS = 1 << 23
#: Characters of words whose sums are made at a time, and the product from which plain numbers are exact enough.
CHARS_AT_ONCE = 200_000
LEAST_PRODUCT = 1e-290


def _codes(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, lengths)"""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), np.array([len(w) for w in words], np.int64)


class Trie:
    """Pieces by number; children by (node, character), in sorted keys."""
    _table = None

    def __init__(self, pieces: Sequence[str]):
        codes, sizes = _codes(pieces)
        starts = np.cumsum(sizes) - sizes
        at = np.zeros(len(pieces), np.int64)  # the node each piece has reached; 0 is the root
        live, n_nodes = np.arange(len(pieces)), 1
        keys, ends = [], [np.full(1, UNKNOWN)]
        self.depth = int(sizes.max(initial=0))
        for d in range(self.depth):
            live = live[sizes[live] > d]
            found, number = np.unique(at[live] << _CHAR_BITS | codes[starts[live] + d], return_inverse=True)
            keys.append(found)
            at[live] = n_nodes + number
            end = np.full(len(found), UNKNOWN)
            done = sizes[live] == d + 1
            end[number[done]] = live[done]
            ends.append(end)
            n_nodes += len(found)
        # nodes are numbered level by level and by key within a level, and keys grow with their parent's number
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        self.end = np.concatenate(ends)

    def steps(self, codes: np.ndarray):
        """As ``child``, by the places of characters in ``codes``: a look into a table of all nodes and characters, where that is small."""
        if self._table is None:
            chars = np.unique(self.keys & (1 << _CHAR_BITS) - 1)
            self._width = len(chars) + 1
            self._number = np.zeros(int(chars.max(initial=0)) + 2, np.int64)  # a character that is in no piece is the first one
            self._number[chars] = np.arange(1, self._width)
            self._table = np.zeros(len(self.end) * self._width if len(self.end) * self._width <= TABLE_CELLS else 0, np.int32)
            if len(self._table):
                self._table[(self.keys >> _CHAR_BITS) * self._width + self._number[self.keys & (1 << _CHAR_BITS) - 1]] = np.arange(1, len(self.keys) + 1)
        if not len(self._table):
            return lambda nodes, at: self.child(nodes, codes[at])
        mine = self._number[np.minimum(codes, len(self._number) - 1)]
        return lambda nodes, at: self._table[nodes * self._width + mine[at]]

    def child(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The child of each node by a character; 0 where there is none."""
        key = nodes << _CHAR_BITS | chars
        i = np.searchsorted(self.keys, key)
        i[i == len(self.keys)] = 0
        return np.where(self.keys[i] == key, i + 1, 0) if len(self.keys) else np.zeros(len(key), np.int64)


@dataclass
class Lattice:
    """Edges of a batch of words. Word w has the places first[w] (before its first character) to last[w] (behind its last)."""
    first: np.ndarray
    last: np.ndarray
    start: np.ndarray  # of each edge: places and piece
    end: np.ndarray
    piece: np.ndarray
    order: np.ndarray  # of each place: its distance from the word's begin
    forward: list[np.ndarray]  # edges by the distance of their end, sorted by end and start
    back: list[np.ndarray]  # edges by the distance of their start, sorted by start

    @property
    def n_places(self) -> int:
        return len(self.order)

    def without(self, drop: np.ndarray) -> Lattice:
        """The lattice without some edges (a mask)."""
        kept = ~drop
        return Lattice(self.first, self.last, self.start, self.end, self.piece, self.order, [e[kept[e]] for e in self.forward], [e[kept[e]] for e in self.back])


def _by_distance(edges: np.ndarray, distance: np.ndarray) -> list[np.ndarray]:
    """Edges, sorted already, cut into groups of growing distance."""
    cuts = np.flatnonzero(np.diff(distance[edges], prepend=-1))
    return [edges[s:e] for s, e in zip(cuts, [*cuts[1:], len(edges)])]


@dataclass
class Places:
    """The places of a batch of words: before each character and behind the last one."""
    codes: np.ndarray
    first: np.ndarray  # of each word
    last: np.ndarray
    char_place: np.ndarray  # place before each character
    char_at: np.ndarray  # character behind each place
    begin: np.ndarray  # of each place: the first and the last place of its word
    stop: np.ndarray

    @classmethod
    def of(cls, words: Sequence[str]) -> Places:
        codes, sizes = _codes(words)
        last = np.cumsum(sizes + 1) - 1
        first = last - sizes
        inner = np.ones(int((sizes + 1).sum()), bool)
        inner[last] = False
        return cls(codes, first, last, np.flatnonzero(inner), np.cumsum(inner) - 1, np.repeat(first, sizes + 1), np.repeat(last, sizes + 1))

    def matches(self, trie: Trie, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all pieces that begin at some places; of one start, shorter pieces come first."""
        node, starts, ends, pieces = np.zeros(len(at), np.int64), [], [], []
        for d in range(trie.depth):
            node = trie.child(node, self.codes[self.char_at[at + d]])
            ok = node > 0
            at, node = at[ok], node[ok]
            done = trie.end[node] != UNKNOWN
            starts.append(at[done])
            ends.append(at[done] + d + 1)
            pieces.append(trie.end[node[done]])
            more = at + d + 1 < self.stop[at]
            at, node = at[more], node[more]
            if not len(at):
                break
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, ends, pieces))


def lattice(trie: Trie, words: Sequence[str], unknown: bool = False) -> Lattice:
    """All edges. With ``unknown``, a character that is no piece is an edge of piece ``UNKNOWN``."""
    at = Places.of(words)
    first, last, places = at.first, at.last, at.begin
    start, end, piece = at.matches(trie, at.char_place)
    if unknown:
        single = np.zeros(len(places), bool)
        single[start[end == start + 1]] = True
        lone = at.char_place[~single[at.char_place]]
        start, end, piece = np.concatenate([start, lone]), np.concatenate([end, lone + 1]), np.concatenate([piece, np.full(len(lone), UNKNOWN)])
    order = np.arange(len(places)) - at.begin
    # one sort key each: distance, place, then the shorter way to the other end last (or first)
    n, size = len(places), end - start
    fwd = np.argsort((order[end] * n + end) * (trie.depth + 2) + trie.depth + 1 - size)
    back = np.argsort((order[start] * n + start) * (trie.depth + 2) + size)
    return Lattice(first, last, start, end, piece, order, _by_distance(fwd, order[end]), _by_distance(back, order[start]))


def _log_sums(values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each run of equal ``groups`` begins, log of the sum of exponentials of its values)"""
    cut = np.flatnonzero(np.diff(groups, prepend=-1))
    top = np.maximum.reduceat(values, cut)
    safe = np.where(np.isfinite(top), top, 0.0)
    sums = np.add.reduceat(np.exp(values - np.repeat(safe, np.diff([*cut, len(values)]))), cut)
    with np.errstate(divide="ignore"):
        return cut, np.log(sums) + safe


def expected(lat: Lattice, score: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in all words, a word counting ``weight`` times; words without a segmentation count nothing."""
    s = score[lat.piece]
    alpha = np.full(lat.n_places, -np.inf)
    beta = alpha.copy()
    alpha[lat.first], beta[lat.last] = 0.0, 0.0
    for e in lat.forward:
        cut, total = _log_sums(alpha[lat.start[e]] + s[e], lat.end[e])
        alpha[lat.end[e[cut]]] = total
    for e in reversed(lat.back):
        cut, total = _log_sums(beta[lat.end[e]] + s[e], lat.start[e])
        beta[lat.start[e[cut]]] = total
    sizes = lat.last - lat.first + 1
    whole = np.repeat(alpha[lat.last], sizes)[lat.start]
    with np.errstate(invalid="ignore"):
        part = np.exp(alpha[lat.start] + s + beta[lat.end] - whole)
    part = np.where(np.isfinite(whole), part, 0.0)
    return np.bincount(lat.piece, part * np.repeat(weight, sizes)[lat.start], len(score))


def expected_uses(trie: Trie, words: Sequence[str], score: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """What ``expected`` gives on the words' lattice, from products of plain probabilities. Words with a place that these are too small for
    are summed by logarithms."""
    total, sizes = np.zeros(len(score)), np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    s = 0
    while s < len(words):
        e = max(s + 1, int(np.searchsorted(ends, ends[s] - sizes[s] + CHARS_AT_ONCE, "right")))
        some = words[s:e]
        sums, small = _plain_uses(trie, some, score, weight[s:e])
        total += sums
        if len(small):
            total += expected(lattice(trie, [some[i] for i in small]), score, weight[s:e][small])
        s = e
    return total


def _plain_uses(trie: Trie, words: Sequence[str], score: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(expected uses of each piece, words that are left out). Places lie by their distance from the word's begin, words from the longest
    one on, so that those with a place of some distance are the first ones of a row."""
    codes, sizes = _codes(words)
    by = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    if not longest:
        return np.zeros(len(score)), np.empty(0, np.int64)
    reach = np.searchsorted(-sizes[by], -np.arange(longest + 1), "left").tolist()  # words with a character at each distance
    row = np.concatenate([[0], np.cumsum(reach)])  # where the characters of each distance begin
    far = np.repeat(np.arange(longest), reach[:-1])
    word = np.arange(len(far)) - row[far]
    have = [len(words), *reach[:-1]]  # words with a place at each distance, that behind the last character among them
    place_row = np.concatenate([[0], np.cumsum(have)])
    step = trie.steps(codes[(np.cumsum(sizes) - sizes)[by][word] + far])
    odds = np.exp(score)
    depth = min(trie.depth, longest)
    prob = np.zeros((depth, len(far)))
    behind_it = row[far + 1] + word  # the next character
    behind_it[word >= np.array(reach)[far + 1]] = -1
    at = here = np.arange(len(far))
    node = np.zeros(len(far), np.int64)
    starts, pieces = [], []
    for d in range(depth):
        node = step(node, here)
        ok = np.flatnonzero(node)
        at, here, node = at[ok], here[ok], node[ok]
        found = trie.end[node]
        done = np.flatnonzero(found != UNKNOWN)
        starts.append(at[done])
        pieces.append(found[done])
        prob[d, starts[-1]] = odds[pieces[-1]]
        here = behind_it[here]
        more = np.flatnonzero(here >= 0)
        at, here, node = at[more], here[more], node[more]
        if not len(at):
            break
    before, behind = np.zeros(place_row[-1]), np.zeros(place_row[-1])
    before[:len(words)] = 1.0
    with np.errstate(under="ignore"):
        for d in range(1, longest + 1):
            n = have[d]
            sums = before[place_row[d]:place_row[d] + n]
            for k in range(1, min(d, len(starts)) + 1):
                sums += before[place_row[d - k]:place_row[d - k] + n] * prob[k - 1, row[d - k]:row[d - k] + n]
        for d in range(longest, -1, -1):
            sums = behind[place_row[d]:place_row[d] + have[d]]
            sums[reach[d]:] = 1.0
            for k in range(1, min(longest - d, len(starts)) + 1):
                n = have[d + k]
                sums[:n] += prob[k - 1, row[d]:row[d] + n] * behind[place_row[d + k]:place_row[d + k] + n]
        parts = [before[place_row[far[a]] + word[a]] * odds[p] * behind[place_row[far[a] + k] + word[a]] for k, (a, p) in enumerate(zip(starts, pieces), 1)]
    part, piece, of = np.concatenate(parts), np.concatenate(pieces), word[np.concatenate(starts)]
    good = np.ones(len(words), bool)
    good[of[part < LEAST_PRODUCT]] = False
    good[behind[:len(words)] <= 0] = False  # without a segmentation, or with a too small one
    share = np.where(good, weight[by] / np.where(good, behind[:len(words)], 1.0), 0.0)
    return np.bincount(piece, part * share[of], len(score)), by[~good]


def best(lat: Lattice, score: np.ndarray, unknown: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(score of the best segmentation of each word, the edge by which each place is best reached; -1 for none). Of equally good
    edges the one that begins first counts."""
    s = np.where(lat.piece == UNKNOWN, unknown, score[lat.piece]) if len(score) else np.full(len(lat.piece), unknown)
    value = np.full(lat.n_places, -np.inf)
    value[lat.first] = 0.0
    by = np.full(lat.n_places, -1)
    for e in lat.forward:
        if not len(e):
            continue
        got = value[lat.start[e]] + s[e]
        ends = lat.end[e]
        cut = np.flatnonzero(np.diff(ends, prepend=-1))
        top = np.maximum.reduceat(got, cut)
        hit = np.flatnonzero(got == np.repeat(top, np.diff([*cut, len(e)])))
        chosen = hit[np.flatnonzero(np.diff(ends[hit], prepend=-1))]
        value[ends[cut]] = top
        by[ends[cut]] = np.where(np.isfinite(top), e[chosen], -1)
    return value[lat.last], by


def paths(lat: Lattice, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, edge) of all best segmentations, in the order of the text."""
    words, edges = [], []
    live = np.flatnonzero(by[lat.last] >= 0)
    at = lat.last[live]
    while len(live):
        edge = by[at]
        words.append(live)
        edges.append(edge)
        at = lat.start[edge]
        more = at > lat.first[live]
        live, at = live[more], at[more]
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word, edge = np.concatenate(words), np.concatenate(edges)
    order = np.lexsort((lat.start[edge], word))
    return word[order], edge[order]


def segment(trie: Trie, score: np.ndarray, unknown: float, words: Sequence[str]) -> list[list[tuple[str, int]]]:
    """(surface, piece) of each word's best segmentation; unknown characters next to each other are one token."""
    lat = lattice(trie, words, unknown=True)
    word, edge = paths(lat, best(lat, score, unknown)[1])
    out: list[list[tuple[str, int]]] = [[] for _ in words]
    begin = lat.order[lat.start[edge]]
    for w, s, e, p in zip(word.tolist(), begin.tolist(), (begin + lat.end[edge] - lat.start[edge]).tolist(), lat.piece[edge].tolist()):
        tokens = out[w]
        if p == UNKNOWN and tokens and tokens[-1][1] == UNKNOWN:
            tokens[-1] = (tokens[-1][0] + words[w][s:e], UNKNOWN)
        else:
            tokens.append((words[w][s:e], p))
    return out


def longest_first(head: Trie, tail: Trie, words: Sequence[str]) -> list[list[tuple[int, int, int]] | None]:
    """(begin, end, piece) of each word's cut into longest matches: a piece of ``head`` first, then of ``tail``; None for a word where
    some place has no match."""
    places = Places.of(words)
    reach, piece = np.zeros(len(places.begin), np.int64), np.full(len(places.begin), UNKNOWN)
    starts = places.first[places.last > places.first]
    for trie, at in ((tail, places.char_place[places.char_place > places.begin[places.char_place]]), (head, starts)):
        start, end, found = places.matches(trie, at)
        reach[start], piece[start] = end, found  # the last one of a start is the longest
    out: list[list[tuple[int, int, int]] | None] = [[] for _ in words]
    live = np.flatnonzero(places.last > places.first)
    at = places.first[live]
    while len(live):
        good = piece[at] != UNKNOWN
        for w in live[~good].tolist():
            out[w] = None
        live, at = live[good], at[good]
        base = places.first[live]
        for w, s, e, p in zip(live.tolist(), (at - base).tolist(), (reach[at] - base).tolist(), piece[at].tolist()):
            out[w].append((s, e, p))
        at = reach[at]
        more = at < places.last[live]
        live, at = live[more], at[more]
    return out

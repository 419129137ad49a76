"""Greedy merging by forecast and check, the core of BPE and WordPiece training.

The next merges are guessed on a bounded sample of word types with an inverted index from pair to words; all types then
apply the guess and report, merge by merge, how the pair counts changed. Exact counts then take merges of the guess in their own
order, up to the first one that it lacks or that meets a merge passed over (``accepted``). Counts of a bounded list of pairs are exact throughout: they start from one full count and
change only by these reports. A pair off the list counts no more than the list's last one, so the list serves until its best
pair is not ahead of that one; then pairs are counted again.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

Pair = tuple[str, str]
#: (left, right, merged)
Merge = tuple[str, str, str]
#: Merges of a guess that may be passed over at a time.
MOST_PASSED = 64


def merge_once(s: list[str], left: str, right: str, merged: str) -> list[str]:
    """Every occurrence of the pair from left to right."""
    out, i, n = [], 0, len(s)
    while i < n:
        if s[i] == left and i + 1 < n and s[i + 1] == right:
            out.append(merged)
            i += 2
        else:
            out.append(s[i])
            i += 1
    return out


def merge_and_count(s: list[str], left: str, right: str, merged: str, freq: int, changes: dict[Pair, int]) -> list[str]:
    """As ``merge_once``; ``changes`` gets the changes of the pair counts, which all lie next to the merged places."""
    out, i, n, end = [], 0, len(s), -1
    while i < n:
        x = s[i]
        if x == left and i + 1 < n and s[i + 1] == right:
            changes[left, right] -= freq
            if out:  # the neighbour on the left, which may have been merged just now
                before = out[-1]
                changes[right if end == i else before, left] -= freq
                changes[before, merged] += freq
            out.append(merged)
            i = end = i + 2
        else:
            if end == i:
                changes[right, x] -= freq
                changes[merged, x] += freq
            out.append(x)
            i += 1
    return out


def apply_in_order(s: list[str], steps: dict[Pair, int], merges: list[Merge], changes: list[dict] | None = None, freq: int = 0) -> list[str]:
    """A word's symbols after the merges, one after the other. ``changes`` of each step gets the changes of pair counts times
    ``freq``. A pair made by a step can only be merged by a later one."""
    if steps.keys().isdisjoint(zip(s, s[1:])):
        return s
    at = -1
    while (step := min((k for p in zip(s, s[1:]) if (k := steps.get(p, -1)) > at), default=None)) is not None:
        s = merge_once(s, *merges[step]) if changes is None else merge_and_count(s, *merges[step], freq, changes[step])
        at = step
    return s


def step_of(merges: list[Merge]) -> dict[Pair, int]:
    return {(l, r): i for i, (l, r, _) in enumerate(merges)}


@dataclass
class Counts:
    """Exact counts of the listed pairs, and the key that pairs off the list don't come before."""
    count: dict[Pair, int]
    floor: tuple[int, str, str] | None  # (-count, left, right) of the first pair off the list; None if all are on it
    heap: list[tuple[int, str, str]] = field(default_factory=list)

    def __post_init__(self):
        self.heap = [(-c, *p) for p, c in self.count.items()]
        heapq.heapify(self.heap)

    def copy(self) -> Counts:
        new = Counts.__new__(Counts)
        new.count, new.floor, new.heap = self.count.copy(), self.floor, self.heap[:]
        return new

    @property
    def least(self) -> int:
        """A pair that comes new needs this many occurrences to be listed."""
        return 1 if self.floor is None else -self.floor[0]

    def best(self) -> tuple[int, Pair] | None:
        """The pair that greedy merging takes next; None if the list can't tell."""
        while self.heap:
            c, *p = self.heap[0]
            p = tuple(p)
            if self.count.get(p) == -c:
                if self.floor is not None and self.heap[0] >= self.floor:
                    return None
                return -c, p
            heapq.heappop(self.heap)
        return (0, ("", "")) if self.floor is None else None

    def change(self, pair: Pair, by: int) -> None:
        old = self.count.get(pair, 0)
        if new := old + by:
            self.count[pair] = new
            heapq.heappush(self.heap, (-new, *pair))
        else:
            self.count.pop(pair, None)

    def prune(self) -> None:
        """Drop pairs that are no longer ahead of those off the list."""
        self.count = {p: c for p, c in self.count.items() if c >= self.least}
        self.__post_init__()


class Forecast:
    """A sample of word types (symbols, frequency) that merges along."""

    def __init__(self, words: Iterable[tuple[list[str], int]]):
        self.words = [(s, f) for s, f in words if len(s) > 1]
        self.index: dict[Pair, set[int]] = defaultdict(set)
        for i, (s, _) in enumerate(self.words):
            for p in zip(s, s[1:]):
                self.index[p].add(i)

    def guess(self, counts: Counts, n: int, new_strings: int, vocab: set[str], min_count: int, join) -> list[Merge]:
        """Up to ``n`` merges that greedy merging would take if other words merged like those of the sample."""
        counts = counts.copy()
        now: dict[int, list[str]] = {}
        added: dict[Pair, set[int]] = defaultdict(set)
        self.trail: list[list[tuple[int, list[str]]]] = []
        out: list[Merge] = []
        made: set[str] = set()
        words, index = self.words, self.index
        while len(out) < n and len(made) < new_strings:
            if (top := counts.best()) is None or top[0] < min_count:
                break
            c, (left, right) = top
            merged = join(left, right)
            out.append((left, right, merged))
            if merged in vocab or merged in made:
                self.trail.append(self._merge(out[-1], now, added, defaultdict(int)))
                break  # not a new string: pairs with it may already count, so it ends the guess
            made.add(merged)
            changes: dict[Pair, int] = defaultdict(int)
            self.trail.append(self._merge(out[-1], now, added, changes))
            seen = -changes.pop((left, right), 0)
            scale = max(1.0, c / seen) if seen else 1.0  # occurrences outside the sample change alike
            counts.change((left, right), -c)
            for p, d in changes.items():
                if d and (p in counts.count or d * scale >= counts.least):
                    counts.change(p, max(int(d * scale), -counts.count.get(p, 0)))
        self.added, self.guessed = added, out
        return out

    def _merge(self, merge: Merge, now: dict[int, list[str]], added: dict[Pair, set[int]], changes: dict[Pair, int]) -> list[tuple[int, list[str]]]:
        """The words that a merge changes, after it; ``now`` holds words that have changed already."""
        left, right, merged = merge
        pair, words, out = (left, right), self.words, []
        for i in self.index.get(pair, set()) | added.get(pair, set()):
            s = now.get(i) or words[i][0]
            after = merge_and_count(s, left, right, merged, words[i][1], changes)
            if len(after) < len(s):
                now[i] = after
                out.append((i, after))
                last = None
                for x in after:
                    if last == merged or (x == merged and last is not None):
                        added[last, x].add(i)
                    last = x
        return out

    def apply(self, merges: list[Merge]) -> None:
        """Take up merges of the last guess. The first ones in its order are known already."""
        n = next((i for i, (m, g) in enumerate(zip(merges, self.guessed)) if m != g), len(merges))
        for changed in self.trail[:n]:
            for i, after in changed:
                self.words[i] = (after, self.words[i][1])
        for left, right, _ in merges[:n]:
            self.index.pop((left, right), None)
        made = {m for _, _, m in merges[:n]}
        for p, some in self.added.items():
            if not made.isdisjoint(p):  # words that hold a pair no longer, or not yet, are looked at in vain
                self.index[p] |= some
        for merge in merges[n:]:
            added: dict[Pair, set[int]] = defaultdict(set)
            for i, after in self._merge(merge, {}, added, defaultdict(int)):
                self.words[i] = (after, self.words[i][1])
            self.index.pop(merge[:2], None)
            for p, some in added.items():
                self.index[p] |= some


def accepted(counts: Counts, guess: list[Merge], changes: dict[int, list[tuple[Pair, int]]], min_count: int) -> list[tuple[Merge, int]]:
    """Merges of the guess that greedy merging takes, in its order, with counts; ``counts`` follows it. ``changes`` by step, of all listed
    pairs and of all with a string that the guess makes.

    A merge may come before others of the guess (passed over) if these took none of its places in any word, so that as many were left
    after them as there are now: the order then changes no word's symbols. What it changed next to a string that isn't made yet counts for the pair with
    that string's outer symbol until the string is made."""
    out, place, at = [], step_of(guess), 0
    over: set[int] = set()  # steps passed over
    parts: dict[str, Pair] = {}  # their strings
    moved: dict[Pair, int] = defaultdict(int)  # changes of pairs with such strings

    def now(pair: Pair) -> Pair:
        left, right = pair
        while left in parts:
            left = parts[left][1]
        while right in parts:
            right = parts[right][0]
        return left, right

    def places(step: int) -> int:
        return -sum(d for p, d in changes.get(step, ()) if p == guess[step][:2])

    while (top := counts.best()) is not None and top[0] >= min_count:
        step = place.get(top[1])
        if step is None:
            break
        merged = guess[step][2]
        if (step > at or any(k < step for k in over)) and (len(over) + step - at > MOST_PASSED or step == len(guess) - 1 or places(step) != top[0]):
            break  # the last merge of a guess may make a string that is known
        for k in range(at, step):
            over.add(k)
            parts[guess[k][2]] = guess[k][:2]
        at = max(at, step + 1)
        if step in over:
            over.remove(step)
            was = {p: now(p) for p in moved}
            del parts[merged]
            for p, q in was.items():
                if (r := now(p)) != q:
                    counts.change(q, -moved[p])
                    counts.change(r, moved[p])
                    if r == p:
                        del moved[p]
        out.append((guess[step], top[0]))
        for p, by in changes.get(step, ()):
            q = now(p)
            counts.change(q, by)
            if q != p:
                moved[p] += by
    counts.prune()
    return out

"""A cover tree over norm-augmented vectors, and batches of best-first searches in it.

A vector x gets one more component, so that all of a tree have the same norm M; a query gets a zero there. Inner products stay
as they are, and on the sphere they are |q| M cos(angle), so a node whose points lie within an angle of its centre bounds
the inner products of all of them. Radii shrink level by level, every point of a node lies within its radius, and the
centres of a level are farther apart than it. A node of few points is a leaf.

Vectors are whole numbers: bounds are floating point with a margin, the products of the points in leaves are exact.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

LEAF = 192
#: Covering radius of a level to that of the one above.
SHRINK = 0.75
#: Whole numbers up to this are exact in floating point.
EXACT = float(2 ** 53)
#: Of a bound: share of |q| M that rounding may take.
MARGIN = 1e-9


@dataclass
class Tree:
    points: np.ndarray  # (n, d) whole numbers, ordered so that each leaf's points are together
    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    centre: np.ndarray  # node -> index of its centre in points
    radius: np.ndarray  # node -> largest angle from the centre
    parent: np.ndarray  # node -> node above; parents come first, -1 for the root
    first: np.ndarray  # leaf's points are first:last, both 0 for inner nodes
    last: np.ndarray
    norm: float

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, points=narrow(self.points), ids=self.ids, rows=self.rows, labels=self.labels, centre=self.centre, radius=self.radius,
                 parent=self.parent, first=self.first, last=self.last, norm=np.float64(self.norm))
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data), allow_pickle=True) as z:
            return cls(**{k: z[k] for k in z.files if k != "norm"}, norm=float(z["norm"]))


def narrow(points: np.ndarray) -> np.ndarray:
    """The smallest whole-number type that holds the values."""
    if points.dtype == object:
        return points
    top = int(np.abs(points).max(initial=0))
    return points.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max))


def norms(points: np.ndarray) -> np.ndarray:
    """Lengths, infinite where floating point can't hold a square."""
    x = points.astype(np.float64)
    with np.errstate(over="ignore"):
        return np.sqrt((x * x).sum(axis=1))


def build(points: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> Tree:
    n = len(points)
    length = norms(points)
    top = float(length.max(initial=0.0))
    scale = top if 0 < top < np.inf else 1.0
    if not np.isfinite(top):  # no angles: one leaf
        return Tree(points, ids, rows, labels, np.zeros(1, np.int64), np.full(1, np.pi), np.full(1, -1), np.zeros(1, np.int64), np.full(1, n), top)
    unit = np.column_stack([points.astype(np.float64) / scale, np.sqrt(np.maximum(0.0, 1 - (length / scale) ** 2))])
    centre, radius, parent, spans, order = [], [], [], [], []
    # (points of the node, its centre, covering radius as a chord, node above)
    todo = [(np.arange(n), 0, 2.0, -1)] if n else []
    while todo:
        members, mid, chord, above = todo.pop()
        node = len(centre)
        cosine = np.clip(unit[members] @ unit[mid], -1.0, 1.0)
        centre.append(mid)
        parent.append(above)
        radius.append(float(np.arccos(cosine.min())))
        if len(members) <= LEAF or radius[-1] < 1e-6:
            spans.append((len(order), len(order) + len(members)))
            order.extend(members[np.argsort(ids[members], kind="stable")].tolist())
            continue
        spans.append((0, 0))
        parts = []
        while len(parts) < 2:  # levels at which one centre covers all are skipped
            chord *= SHRINK
            parts = _cover(unit, members, mid, chord)
        small = [p for p, _ in parts if len(p) <= LEAF // 8]
        for p, c in parts:
            if len(p) > LEAF // 8:
                todo.append((p, c, chord, node))
        todo += _gather(small, chord, node)
    order, parent = np.asarray(order, np.int64), np.asarray(parent, np.int64)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    first, last = np.asarray(spans, np.int64).reshape(-1, 2).T
    return Tree(points[order], ids[order], rows[order], labels[order], place[np.asarray(centre, np.int64)] if n else np.empty(0, np.int64),
                np.asarray(radius), parent, first, last, top)


def _cover(unit: np.ndarray, members: np.ndarray, mid: int, chord: float) -> list[tuple[np.ndarray, int]]:
    """Centres farther than ``chord`` apart, the node's own first, and the points that each covers."""
    least = 1 - chord * chord / 2
    parts, left, c = [], members, mid
    while len(left):
        near = unit[left] @ unit[c] >= least
        near |= left == c
        parts.append((left[near], c))
        left = left[~near]
        if len(left):
            c = int(left[0])
    return parts


def _gather(small: list[np.ndarray], chord: float, node: int) -> list[tuple[np.ndarray, int, float, int]]:
    """Centres that cover few points share a leaf; its radius is measured, as every node's is."""
    out, held, size = [], [], 0
    for p in [*small, None]:
        if held and (p is None or size + len(p) > LEAF):
            joined = np.concatenate(held)
            out.append((joined, int(joined[0]), chord, node))
            held, size = [], 0
        if p is not None:
            held.append(p)
            size += len(p)
    return out


def _products(queries: np.ndarray, points: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return queries @ points.T
    return queries.astype(object) @ points.astype(object).T


def search(tree: Tree, queries: np.ndarray, labels: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
    """For each query the first ``k`` points by product, then id, with low <= product <= high and the query's label (``same``) or
    another one, the query's own row left out: arrays (query, product, point's id).

    All queries descend together. A node outside a query's window is skipped with all below it; the leaves left are visited
    best bound first, until the k-th product found is above the next bound."""
    n = len(queries)
    if not n or not len(tree.points):
        return np.empty(0, np.int64), np.empty(0, object), np.empty(0, np.int64)
    length = norms(queries)
    exact = queries.dtype != object and tree.points.dtype != object and float(length.max()) * tree.norm < EXACT
    whole = np.int64 if exact else object
    points = tree.points.astype(np.float64 if exact else object)
    asked = queries.astype(np.float64 if exact else object)
    reach = length * tree.norm
    low_f, high_f = low.astype(np.float64), high.astype(np.float64)
    slack = MARGIN * reach + 1 + 1e-9 * np.maximum(np.abs(low_f), np.abs(high_f), where=np.isfinite(low_f), out=np.zeros(n))

    with np.errstate(all="ignore"):
        at_centre = (queries.astype(np.float64) @ tree.points[tree.centre].astype(np.float64).T) / np.where(reach > 0, reach, 1)[:, None]
    angle = np.arccos(np.clip(np.nan_to_num(at_centre), -1.0, 1.0))
    unknown = ~np.isfinite(reach)  # too long for floating point: nothing is skipped
    reach = np.where(unknown, 0.0, reach)
    best = reach[:, None] * np.cos(np.maximum(0.0, angle - tree.radius - 1e-7)) + slack[:, None]
    worst = reach[:, None] * np.cos(np.minimum(np.pi, angle + tree.radius + 1e-7)) - slack[:, None]
    best[unknown], worst[unknown], slack[unknown] = np.inf, -np.inf, np.inf
    alive = (best >= low_f[:, None]) & (worst <= high_f[:, None])
    for node in range(1, len(tree.parent)):
        above = tree.parent[node]
        alive[:, node] &= alive[:, above]
        np.minimum(best[:, node], best[:, above], out=best[:, node])

    leaves = np.flatnonzero(tree.last > tree.first)
    best = np.where(alive[:, leaves], best[:, leaves], -np.inf)
    turn = np.argsort(-best, axis=1, kind="stable")
    kth = np.full(n, -np.inf)
    found_q, found_s, found_i = np.empty(0, np.int64), np.empty(0, whole), np.empty(0, np.int64)
    everyone = np.arange(n)
    for step in range(len(leaves)):
        leaf = turn[:, step]
        active = np.flatnonzero((best[everyone, leaf] > -np.inf) & (best[everyone, leaf] >= kth))
        if not len(active):
            break
        active = active[np.argsort(leaf[active], kind="stable")]
        cuts = np.flatnonzero(np.diff(leaf[active], prepend=-1))
        met = [(found_q, found_s, found_i)]
        for s, e in zip(cuts, [*cuts[1:], len(active)]):
            q, node = active[s:e], leaves[leaf[active[s]]]
            span = slice(tree.first[node], tree.last[node])
            got = _products(asked[q], points[span], exact)
            fits = (tree.labels[span] == labels[q, None]) == same
            fits &= (got >= np.maximum(low_f[q], kth[q])[:, None] - slack[q, None]) & (got <= high_f[q, None] + slack[q, None])
            r, c = np.nonzero(fits & (tree.rows[span] != rows[q, None]))
            met.append((q[r], got[r, c].astype(whole), tree.ids[span][c]))
        found_q, found_s, found_i = (np.concatenate(x) for x in zip(*met))
        inside = _inside(found_q, found_s, low, high)
        found_q, found_s, found_i = found_q[inside], found_s[inside], found_i[inside]
        order = _by_rank(found_q, found_s, found_i)
        found_q, found_s, found_i = found_q[order], found_s[order], found_i[order]
        start = np.flatnonzero(np.diff(found_q, prepend=-1))
        rank = np.arange(len(found_q)) - np.repeat(start, np.diff([*start, len(found_q)]))
        kept = rank < k
        last = rank == k - 1
        kth[found_q[last]] = found_s[last].astype(np.float64)
        found_q, found_s, found_i = found_q[kept], found_s[kept], found_i[kept]
    return found_q, found_s, found_i


def _by_rank(q: np.ndarray, s: np.ndarray, i: np.ndarray) -> np.ndarray:
    if s.dtype == object:
        return np.array(sorted(range(len(q)), key=lambda x: (q[x], -s[x], i[x])), np.int64)
    return np.lexsort((i, -s, q))


def _inside(q: np.ndarray, s: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Exactly: bounds are whole numbers or infinite."""
    if low.dtype == object or s.dtype == object:
        return np.array([a <= x <= b for x, a, b in zip(s, low[q], high[q])], bool)
    return (s >= low[q]) & (s <= high[q])

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glossa.llm import simhash_trie as S
from glossa.llm.components import component_labels

from .helpers import ODD_TEXTS, clashing, empty_docs


def brute_fingerprint(text, width=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(rows, budget=2):
    """rows: (id, fingerprint); id -> smallest id reachable."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    best = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            best[find(i)] = min(best.get(find(i), doc), doc)
    return [best.get(find(i)) for i in range(len(rows))]


def balls(rng, centres, size, flips):
    """Fingerprints in dense balls around a few centres."""
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(size):
            x = c
            for _ in range(rng.randrange(flips + 1)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_walk_finds_exactly_the_close_pairs(seed, monkeypatch):
    monkeypatch.setattr(S, "FRONTIER", 50)
    monkeypatch.setattr(S, "LEAF_PAIRS", 1 + seed)
    rng = random.Random(seed)
    pts = balls(rng, 8, 30, 4) + [0, 2**64 - 1, 1, 3]
    a = np.array(sorted(set(pts[::2])), "u8")
    b = np.array(sorted(set(pts[1::2]) - set(pts[::2])), "u8")
    got = {(int(a[i]), int(b[j])) for u, v in S.walk(a, b, 0, 0, 2, False) for i, j in zip(u, v)}
    assert got == {(int(x), int(y)) for x in a for y in b if (int(x) ^ int(y)).bit_count() <= 2}
    got = [(int(i), int(j)) for u, v in S.walk(a, a, 0, 0, 2, True) for i, j in zip(u, v)]
    want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if int(a[i] ^ a[j]).bit_count() <= 2}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("cell_rows", [3, 40, 10_000])
def test_links_connect_what_brute_force_connects(spark, cell_rows):
    rng = random.Random(cell_rows)
    fps = balls(rng, 6, 25, 5) + balls(rng, 40, 1, 0)
    # one hot prefix: everything below differs in the low bits only
    fps += [(7 << 60) | x for x in rng.sample(range(1 << 12), 120)]
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = S.fingerprint_links(df, 2, cell_rows).collect()
    u64 = lambda x: x & (2**64 - 1)
    assert all((u64(r.u) ^ u64(r.v)).bit_count() >= 1 for r in links)
    labels = {r.node: r.label for r in component_labels(spark.createDataFrame(links, "u long, v long")).collect()}
    groups = {}
    for x, s in zip(fps, signed):
        groups.setdefault(labels.get(s, s), set()).add(x)
    brute = {}
    for x, c in zip(fps, brute_components([(x, x) for x in fps])):
        brute.setdefault(c, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(500, 500), (501, 502), (502, 501)]
    labels = {r.node: r.label for r in component_labels(spark.createDataFrame(links, "u long, v long")).collect()}
    assert len({labels[i] for i in range(100, 161)}) == 1 and len({labels[i] for i in range(1, 40)}) == 1
    assert len({labels[i] for i in (1, 100, 501)}) == 3 and labels[501] == labels[502] and 500 not in labels
    assert component_labels(spark.createDataFrame([], "u long, v long")).collect() == []


def near_texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    out = []
    for base in range(6):
        text = [rng.choice(words) for _ in range(200)]
        for _ in range(8):
            copy = list(text)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


def test_documents_match_brute_force(spark):
    rows = ODD_TEXTS + [(1000 - i, t) for i, t in enumerate(near_texts())]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"), fp=1, fingerprint="x", label=2, u=3)
    got = sorted(((r.doc_id or -1, r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()), key=str)
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    want = sorted(((d or -1, f"{f:016x}", c) for (d, f), c in zip(fps, brute_components(fps))), key=str)
    assert got == want
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({c for c in brute_components(fps) if c is not None})
    assert ids.count(None) == 1


def test_rows_of_one_id_with_different_texts_are_told_apart(spark):
    """Id 5 holds a text of its own and a copy of id 3's; 8 copies id 5's own text, 9 has two near texts, 7 one row twice."""
    a, b, c, d = ([f"{x}{i}" for i in range(80)] for x in "abcd")
    rows = [(3, a), (5, a), (5, b), (8, b), (9, c), (9, [*c[:-1], "c"]), (7, d), (7, d)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id long, text string")
    got = [sorted((r.doc_id, r.text) for r in S.one_of_each(docs.repartition(n, "text"), budget=20).collect()) for n in (1, 5)]
    assert got[0] == got[1]
    assert [k for k, _ in got[0]] == [3, 5, 7, 9] and got[0][1] == (5, " ".join(b))


def test_empty_table(spark):
    assert S.near_duplicates(empty_docs(spark)).collect() == []
    assert S.one_of_each(empty_docs(spark)).collect() == []


def test_spark_hash_agrees(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert h & (2**64 - 1) == S.shingle_hashes(b"A b\tC", 3)[0]

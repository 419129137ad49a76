import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import suffix_dedup as D
from glossa.llm import suffix_sort as S

from .helpers import ODD_TEXTS, clashing, empty_docs


def random_bytes(rng, n, letters):
    return bytes(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("seed", range(12))
def test_order_matches_sorted_suffixes(seed):
    rng = random.Random(seed)
    parts = [random_bytes(rng, rng.randint(12, 60), b"ab" if seed % 2 else b"abcd\xf0") for _ in range(12)] + [b"a" * 40, b"b" * 30, b"ab" * 20]
    depth = 10
    text, starts = S.joined(parts, depth)
    wanted = np.zeros(len(text), bool)
    for s, p in zip(starts, parts):
        wanted[s:s + len(p) - depth + 1] = True
    raw = text.tobytes()
    words = S.words8(text)
    sa = S.suffix_order(text, words, wanted, depth)
    assert sorted(sa.tolist()) == np.flatnonzero(wanted).tolist()
    keys = [raw[i:i + depth] for i in sa]
    assert keys == sorted(keys)
    assert S.adjacent_equal(sa, words, depth).tolist() == [a == b for a, b in zip(keys, keys[1:])]


def test_types():
    assert S.s_types(np.frombuffer(b"mississippi", np.uint8)).tolist() == [b == "S" for b in "LSLLSLLSLLL"]


@pytest.mark.parametrize("seed", range(5))
def test_every_equal_window_has_the_key_and_repeats_show(seed):
    rng = random.Random(seed)
    text = np.frombuffer(random_bytes(rng, 300, b"ab") + b"xyxyx" * 20, np.uint8)
    keys = np.concatenate([k for _, k, _ in D.window_keys(text, 24, 8)])
    raw, by = text.tobytes(), {}
    for i, k in enumerate(keys.tolist()):
        assert by.setdefault(raw[i:i + 24], k) == k
    met = D.text_keys(text, 24, 8).tolist()
    for i, k in enumerate(keys.tolist()):
        if raw.count(raw[i:i + 24]) > 1 or raw.find(raw[i:i + 24], i + 1) >= 0:
            assert met.count(k) > 1


def brute(rows, window, hashes=None):
    """``hashes`` ranks the versions of an id that hold a string at one place."""
    order = lambda d: D.LAST if d is None else d
    first = {}
    texts = [(order(d), (t or "").encode()) for d, t in rows]
    own = lambda b: hashes[b] if hashes else 0
    for d, b in texts:
        for i in range(len(b) - window + 1):
            w = b[i:i + window]
            first[w] = min(first.get(w, (d, i, own(b))), (d, i, own(b)))
    out = []
    for (d, b), (doc, _) in zip(texts, rows):
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if first[b[i:i + window]] < (d, i, own(b)):
                gone[i:i + window] = [True] * window
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((str(doc), len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out)


def texts(window):
    rng = random.Random(window)
    words = ["alpha", "béta", "gam ma", "日本", "delta\n", "e", "zz zz"]
    passage = " ".join(rng.choice(words) for _ in range(window))
    out = [(d, t[:400] if t else t) for d, t in ODD_TEXTS]
    for d in range(40):
        t = " ".join(rng.choice(words) for _ in range(rng.randrange(2 * window)))
        if d % 3 == 0:
            at = rng.randrange(len(t) + 1)
            cut = rng.randrange(len(passage))
            t = t[:at] + passage[cut:cut + 3 * window] + t[at:]
        out.append((100 - d, t))
    out += [(600 + i, f"{i} " + passage[7:7 + 2 * window] + f" {i * i}") for i in range(12)]
    out += [(300 + i, out[20][1]) for i in range(4)] + [(400, out[25][1] + "!"), (None, out[21][1]), (401, "ab" * 3 * window), (402, "-" * 300),
            (403, "x" + "-" * 200), (404, "periodic" * window), (404, "periodic" * window), (404, "version " + "periodic" * window)]
    return out


@pytest.mark.parametrize("window,gram,crowd", [(30, 8, 20_000), (30, 12, 3), (100, 20, 20_000)])
def test_matches_brute_force(spark, window, gram, crowd, monkeypatch):
    rows = texts(window)
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), doc=1, key="k", z=2, kept=3)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in
                 D.dedup_substrings(docs, window, gram, crowd).collect())
    want = brute(rows, window)
    assert got == want
    assert sum(w[2] for w in want) > 1000


def test_no_key_gathers_the_edges_of_a_common_passage(spark):
    """Around a passage that all documents hold each goes on differently: its windows have their keys inside the passage."""
    rng = random.Random(5)
    own = lambda n: random_bytes(rng, n, b"abcdefghij ").decode()
    passage = own(200).upper()
    rows = [(i, own(60) + passage + own(60)) for i in range(150)]
    window, gram, crowd = 30, 8, 10
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    _, _, found = D.repeated_contexts(docs, window, gram, crowd)
    by = {}
    for r in found.collect():
        by.setdefault(r.key, set()).add(bytes(r.context))
    assert max(sum(map(len, contexts)) for contexts in by.values()) <= 2 * crowd * window
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in D.dedup_substrings(docs, window, gram, crowd).collect())
    assert got == brute(rows, window)


@pytest.mark.parametrize("crowd,small", [(20_000, 1 << 20), (10, 1 << 20), (10, 0)])
def test_an_id_on_a_third_of_the_rows_has_a_list_for_each_text(spark, crowd, small, monkeypatch):
    """Versions of one id, rows without an id and equal rows, with a passage that all hold and a common beginning."""
    monkeypatch.setattr(D, "BROADCAST_KEYS", small)
    rng = random.Random(11)
    own = lambda n: random_bytes(rng, n, b"abcdefghij ").decode()
    passage, head, window, gram = own(90), own(50).upper(), 30, 8
    rows = [(doc, (head if i % 4 == 0 else "") + own(60) + passage + own(60)) for doc in (7, None) for i in range(40)]
    rows += [(i, own(80) + passage[i:] + own(40)) for i in range(30)] + [rows[0]] * 12 + [rows[41]] * 12 + [(7, rows[50][1]), (7, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashes = {(r.text or "").encode(): r.h for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    _, info, _ = D.repeated_contexts(docs, window, gram, crowd)
    assert max(len(r["keys"] or ()) + len(r["crowded"] or ()) for r in info.collect()) <= max(len(t or "") for _, t in rows)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in D.dedup_substrings(docs, window, gram, crowd).collect())
    assert got == brute(rows, window, hashes)


def test_long_texts_are_cut_into_chunks(monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 64)
    rng = random.Random(0)
    text = np.frombuffer(random_bytes(rng, 500, b"abc"), np.uint8)
    whole = np.concatenate([k for _, k, _ in D.window_keys(text, 20, 8)])
    monkeypatch.setattr(D, "CHUNK", 1 << 18)
    assert whole.tolist() == np.concatenate([k for _, k, _ in D.window_keys(text, 20, 8)]).tolist()


def test_empty_and_parameters(spark):
    assert D.dedup_substrings(empty_docs(spark)).collect() == []
    with pytest.raises(ValueError):
        D.dedup_substrings(empty_docs(spark), 10, 10)

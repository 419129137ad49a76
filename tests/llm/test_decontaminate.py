import random

import pytest

from glossa.llm import decontaminate as D

from .helpers import ODD_TEXTS, clashing, empty_docs, odd_docs


def brute(docs, items, width=5, threshold=0.8):
    out = []
    for doc, text in docs:
        words = D.words_of(text)
        for item, t in items:
            iw = D.words_of(t)
            if not iw:
                continue
            w = min(width, len(iw))
            want = {tuple(iw[i:i + w]) for i in range(len(iw) - w + 1)}
            have = {tuple(words[i:i + w]) for i in range(len(words) - w + 1)}
            if len(want & have) >= threshold * len(want) - 1e-9:
                out.append((doc, item, len(want), len(want & have)))
    return sorted(out, key=str)


def data():
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 15, 40, 41])))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "..."), (103, items[8][1]), (103, items[8][1])]
    docs = list(ODD_TEXTS)
    for d in range(120):
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 30, 400]))]
        for _ in range(rng.randrange(3)):
            item = D.words_of(rng.choice(items)[1])
            for _ in range(rng.randrange(3)):  # edits, so that some fall below the threshold
                if item:
                    item[rng.randrange(len(item))] = "edit"
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() if rng.random() < 0.3 else w for w in item]
        docs.append((1000 + d, " ".join(words)))
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_links_match_brute_force(spark, block_bytes):
    docs, items = data()
    d = clashing(spark.createDataFrame(docs, "doc_id long, text string"), item_id=1, containment=2)
    i = clashing(spark.createDataFrame(items, "item_id long, text string"), doc_id=1)
    got = sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in D.leaks(d, i, block_bytes=block_bytes).collect()), key=str)
    want = brute(docs, items)
    assert got == want and len(want) > 30


def test_decontaminate_drops_leaking_documents_only(spark):
    docs, items = data()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    bad = {r[0] for r in brute(docs, items)}
    kept = D.decontaminate(d, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x) for x, _ in docs if x not in bad)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.leaks(odd_docs(spark), none).collect() == []
    assert D.decontaminate(odd_docs(spark), none).count() == len(ODD_TEXTS)
    assert D.leaks(empty_docs(spark), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).collect() == []

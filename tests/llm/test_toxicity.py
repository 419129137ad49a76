import random
import zlib

import pytest

from glossa.llm import toxicity as X

from .helpers import ODD_TEXTS, clashing, empty_docs


def corpus(n=900, seed=4):
    """Toxic documents hold a toxic sentence somewhere; 'grumb' is a stem of many forms."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(800)]
    docs, labels, spans = [], [], {}
    for d in range(n):
        sents = [" ".join(rng.choice(vocab) for _ in range(rng.randint(4, 12))) for _ in range(rng.randint(2, 15))]
        toxic = rng.random() < 0.2
        if toxic:
            k = rng.randrange(len(sents))
            sents[k] += " " + rng.choice(["vile", "grumb" + rng.choice(vocab)])
            spans[d] = k
        docs.append((d, ". ".join(sents) + "."))
        labels.append((d, int(toxic)))
    return docs, labels, spans


def auc(pairs):
    pairs = sorted(pairs)
    pos = sum(y for _, y in pairs)
    rank = sum(i + 1 for i, (_, y) in enumerate(pairs) if y)
    return (rank - pos * (pos + 1) / 2) / (pos * (len(pairs) - pos))


def test_held_out_accuracy_and_sentences(spark):
    docs, labels, spans = corpus()
    d = clashing(spark.createDataFrame(docs + [(5000 + (k or 0), t) for k, t in ODD_TEXTS], "doc_id long, text string"), score="s", toxic=3)
    lab = spark.createDataFrame(labels + [(None, 1), (7, None), (99999, 1)], "doc_id long, toxic int")
    out = X.classify(d, lab)
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(docs) + len(ODD_TEXTS) - 1
    assert out.columns == ["doc_id", "text", "toxic", "held_out", "score", "predicted", "offending"]
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in rows.items())
    truth = dict(labels)
    held = [(rows[k].score, y) for k, y in truth.items() if rows[k].held_out]
    assert auc(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    hit = [k for k in spans if rows[k].predicted]
    assert len(hit) > 0.9 * len(spans)
    for k in hit:
        text, off = rows[k].text, rows[k].offending
        assert off and any("vile" in text[o.start:o.end] or "grumb" in text[o.start:o.end] for o in off)
    assert sum(rows[k].predicted for k, y in truth.items() if not y) < 0.02 * len(truth)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels, _ = corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(k, 1 - y if zlib.crc32(str(k).encode()) % 4 == 2 else y) for k, y in labels]
    a, b = ({r.doc_id: r.score for r in X.classify(d, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, flipped))
    assert a == pytest.approx(b)


def test_gradient_learns_the_guilty_feature():
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        toxic = rng.random() < 0.3
        ids = [[rng.randrange(1, 6)] for _ in range(rng.randint(1, 6))]
        if toxic:
            ids[0].append(0)
        rows.append({"toxic": int(toxic), "weight": 1.0, "plain": rng.randrange(4), "ids": [i for s in ids for i in s], "sizes": [len(s) for s in ids]})
    bias, w = X.fit_bags(rows, 6)
    assert w[0] > 4 + max(w[1:]) and bias < -2


def test_a_repeated_id_is_one_row_of_the_sample(spark):
    rows = [(3, f"text {i}") for i in range(60)] + [(1, "one"), (2, "two"), (2, "two")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert not any(zlib.crc32(str(k).encode()) % 4 == 2 for k in (1, 2, 3))
    got = [sorted((r.text, r.toxic, r.weight) for r in X.training_sample(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels).collect())
           for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 3


def test_repeated_bags_count_as_often_as_they_are_met():
    sent = [([0, 1], 3), ([2], 2)]
    other = {"toxic": 0, "weight": 2.0, "plain": 3, "ids": [1, 2], "sizes": [1, 1]}
    long = {"toxic": 1, "weight": 1.0, "plain": 1, "ids": [i for b, n in sent for _ in range(n) for i in b], "sizes": [len(b) for b, n in sent for _ in range(n)]}
    short = {"toxic": 1, "weight": 1.0, "plain": 1, "ids": [0, 1, 2], "sizes": [2, 1], "times": [3, 2]}
    a, b = (X.fit_bags([r, other], 3) for r in (long, short))
    assert a[0] == pytest.approx(b[0]) and a[1].tolist() == pytest.approx(b[1].tolist())


def test_without_labels_or_rows(spark):
    d = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in X.classify(d, none).collect()} == {0.0}
    ones = spark.createDataFrame([(4, 1), (5, 1), (6, 1), (7, 1), (8, 1), (11, 1)], "doc_id long, toxic int")
    assert {r.score for r in X.classify(d, ones).collect()} == {1.0}
    assert X.classify(empty_docs(spark), none).collect() == []


def test_scores_are_the_noisy_or_of_their_sentences(spark):
    """Each row's score and offending sentences against a plain evaluation of the fitted weights."""
    import math
    import re
    docs, labels, _ = corpus(400, 8)
    d = spark.createDataFrame(docs + [(9000 + (k or 0), t) for k, t in ODD_TEXTS], "doc_id long, text string")
    model = X.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.weights
    for r in X.score_documents(d, model).collect():
        miss, offending = 1.0, []
        for s in re.finditer(r"[^.!?\n]+", r.text or ""):
            words = {w.lower() for w in re.findall(r"\w+", s.group())}
            if words:
                z = model.bias + sum(v for f, v in model.weights.items() for w in words if (w == f[:-1] if f.endswith("$") else 3 <= len(f) <= 8 and w.startswith(f)))
                p = 1 / (1 + math.exp(-z))
                miss *= 1 - p
                if p >= X.THRESHOLD:
                    offending.append((s.start(), s.end()))
        score = 1 - miss if re.search(r"\w", r.text or "") else 1 / (1 + math.exp(-model.bias))
        assert r.score == pytest.approx(score, abs=1e-9) and [(o.start, o.end) for o in r.offending] == offending


def test_every_significant_feature_is_used(spark):
    """Thousands of rare words, each significant: none is left out."""
    rows = [(i, " ".join(f"bad{k}x" for k in range(200 * (i % 30), 200 * (i % 30) + 200)) if i < 1300 else "plain words here") for i in range(2600)]
    lab = spark.createDataFrame([(i, int(i < 1300)) for i in range(2600)], "doc_id long, toxic int")
    assert len(X.fit(spark.createDataFrame(rows, "doc_id long, text string"), lab).weights) > 5000

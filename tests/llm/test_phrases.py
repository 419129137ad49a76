"""Phrase mining against a brute-force count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from glossa.llm import phrases
from tests.llm.helpers import ODD_TEXTS, odd_docs

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, support, top=None):
    """{lang: ranked rows} of (phrase, a, l, r, n, score)."""
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        candidates = [p for p, a in f.items() if len(p) > 1 and a >= support]
        covered = {}
        for p in candidates:
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    covered[p[s:s + m]] = max(covered.get(p[s:s + m], 0), f[p])
        ranked = []
        for p in candidates:
            a = f[p]
            if 100 * covered.get(p, 0) >= 80 * a and p in covered:
                continue
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank if top else None, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out, key=repr)


def mined(spark, rows, support, top=None):
    docs = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in phrases.collocations(docs, support=support, top=top).collect()), key=repr)


def corpus(seed, n=300):
    rng = random.Random(seed)
    vocab = ["the", "The", "of", "new", "york", "é", "x y", "#", "san", "juan", "🙂", "a'b"] + [f"w{i}" for i in range(60)]
    weights = [30, 10, 20, 8, 8, 3, 2, 2, 4, 4, 1, 1] + [1] * 60
    rows = []
    for i in range(n):
        words = rng.choices(vocab, weights, k=rng.randint(0, 60))
        if rng.random() < 0.3:
            words += ["new", "york", "city", "hall"]
        seps = rng.choices([" ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b"], [60, 5, 3, 4, 2, 3, 1, 1], k=len(words))
        rows.append((i, "".join(w + s for w, s in zip(words, seps)), rng.choice(["en", "en", "de", None, "und", ""])))
    return rows + rows[:40]


@pytest.mark.parametrize("seed,support,top", [(1, 8, None), (2, 3, 25), (3, 1, None)])
def test_equals_brute_force(spark, seed, support, top):
    rows = corpus(seed, 300 if support > 1 else 40)
    want = brute(rows, support, top)
    assert want and mined(spark, rows, support, top) == want


def test_small_flushes_buckets_and_filters(spark, monkeypatch):
    """Many flushes, many buckets and filters that are nearly full give the same phrases."""
    rows = corpus(5)
    want = brute(rows, 6, 50)
    monkeypatch.setattr(phrases, "FLUSH_WORDS", 200)
    monkeypatch.setattr(phrases, "BUCKET_GRAMS", 300)
    monkeypatch.setattr(phrases, "LANGS", 1)
    assert mined(spark, rows, 6, 50) == want


def test_hot_words_are_joined_apart(spark, monkeypatch):
    rows = corpus(6)
    monkeypatch.setattr(phrases, "HOT_SHARE", 10)
    assert mined(spark, rows, 5) == brute(rows, 5)


def test_a_third_of_all_rows_are_copies(spark):
    rows = corpus(7, 100) + [(1, "copy of one text, again and again a copy", "en")] * 60
    assert mined(spark, rows, 5) == brute(rows, 5)


def test_odd_and_empty_tables(spark):
    from pyspark.sql import functions as F
    docs = odd_docs(spark).withColumn("lang", F.lit(None).cast("string")).withColumn("phrase", F.lit("x")).withColumn("n", F.lit(1))
    want = brute([(i, t, None) for i, t in ODD_TEXTS], 2)
    assert sorted((tuple(r) for r in phrases.collocations(docs, support=2).collect()), key=repr) == want
    assert mined(spark, [], 2) == [] and mined(spark, [(1, None, None), (2, "", "en"), (3, "alone", "en")], 1) == []


def test_full_filters_only_let_more_through():
    members = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    size = np.uint64(64)
    marks = np.zeros(64 * 64, np.uint8)
    for p in phrases.Filter.places(members, size):
        marks[(phrases.Filter.slice_of(members, 64) * size + p).astype(np.int64)] = 1
    assert phrases.Filter(np.packbits(marks, bitorder="little").tobytes(), 64).has(members).all()


def test_scores_beyond_64_bits(spark):
    big = 10 ** 14
    words = spark.createDataFrame([("en", "a", 4 * big), ("en", "b", big)], "lang string, phrase string, f long")
    pairs = spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, f long")
    row = phrases._scored(pairs, words, 5 * big).first()
    assert (row.l, row.r, row.score) == (4 * big, big, 2000000 * big // (5 * big))

"""The LM on compressed blocks of grams: the records of ``ngram_lm``, and what it leaves on disk."""

import os
import random

import numpy as np
import pyarrow as pa

from glossa.functions import words
from glossa.operators import gram_blocks as GB
from glossa.operators import ngram_lm as LM
from glossa.plans import registered as R

SF = "/root/testdata/sf0.001"


def test_blocks_give_back_their_rows():
    rng = np.random.default_rng(1)
    for bits in ([3, 20, 20, 4], [30, 30, 30, 4], [1], [5, 4]):  # the second needs more than a key's bits
        cols, n = [rng.integers(0, 1 << b, 200) for b in bits], rng.integers(1, 1 << 40, 200)
        got_bits, got, (got_n,) = GB._read(GB._rows(cols, bits, n))
        assert got_bits == bits and sorted(zip(*(c.tolist() for c in got), got_n.tolist())) == sorted(zip(*(c.tolist() for c in cols), n.tolist()))
    empty, large = GB._opened(GB._squeezed(np.empty(0, np.int64), np.array([0, 1 << 62])))
    assert not len(empty) and large.tolist() == [0, 1 << 62]
    some = pa.array(["", "é", "a\x00b", "日本", "😀"])
    assert GB._words(*GB._text(some)).to_pylist() == some.to_pylist() and GB._words(*GB._text(some.slice(2, 2))).to_pylist() == ["a\x00b", "日本"]
    key = GB._key([np.array([2, 0, 2]), np.array([1, 5, 1]), np.array([7, 7, 0])], 1 << 40)  # no key holds three such numbers
    assert key[1] < key[2] < key[0]


def test_blocks_give_the_records_of_grams(spark, monkeypatch):
    """All orders; words that all contexts share, words of the test side alone, labels that are null, and portions that end early."""
    rng = random.Random(8)
    pick = lambda: rng.choice(["the", "the", "the", rng.choice("abcdefgh"), "w" + str(rng.randint(0, 300)), "é😀"])
    rows = [(rng.choice(["train", "train", "test"]), rng.choice(["en", "de", "unknown", None]), " ".join(pick() for _ in range(rng.choice([0, 1, 2, 9, 40])))) for _ in range(150)]
    texts = spark.createDataFrame(rows, "split string, label string, text string").repartition(3).cache()
    for order, held, n, target in ((1, 1 << 20, 5, "de"), (2, 40, 8, "de"), (3, 1 << 20, 8, "en"), (3, 40, 3, "de"), (4, 1 << 20, 8, "de")):
        monkeypatch.setattr(LM, "GRAMS_HELD", held)
        monkeypatch.setattr(LM, "TOKENS_AT_ONCE", 10 * held)
        rec, missing = GB.lm_records(spark, GB.lm_losses(GB.kept_grams(GB.sent_grams(texts, "text", 8, order, target, n, words.pretokens), order, n), order))
        want = LM.lm_for_grams(LM.gram_counts(texts, "text", 8, order, words_of=words.pretokens), order, target)[0].first()
        got = rec.first()
        assert not missing and got["cell"] is None
        assert all(abs(got[c] - want[c]) < 1e-9 for c in want.asDict()), (order, got, want)
    one = texts.filter("split = 'test'")
    rec, missing = GB.lm_records(spark, GB.lm_losses(GB.kept_grams(GB.sent_grams(one, "text", 8, 3, "de", 4, words.pretokens), 3, 4), 3))
    assert missing == [(None, "train")] and rec.first()["eval_loss"] is None
    none = texts.filter("split = 'x'")
    assert GB.lm_losses(GB.kept_grams(GB.sent_grams(none, "text", 8, 3, "de", 4, words.pretokens), 3, 4), 3) == {}


def test_the_lm_leaves_less_than_its_text(spark):
    """No uncompressed copies of the text or of the grams lie in the checkpoint folder."""
    from urllib.parse import urlparse
    folder = urlparse(spark.sparkContext.getCheckpointDir()).path
    files = lambda: {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs}
    text = R.paragraphs(spark, SF).selectExpr("sum(octet_length(text))").first()[0]
    before = files()
    assert R.QUERIES["ngram_lm_eval"](spark, SF).count() == 1
    left = sum(n for f, n in files().items() if f not in before)
    assert left < 2.5 * text, (left, text)

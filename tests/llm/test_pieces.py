"""Encoding and decoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from glossa.llm import queries
from glossa.llm.pieces import PieceEncoder, encode_texts, read_model
from tests.conftest import SF
from tests.llm.helpers import ODD_TEXTS, clashing, empty_docs, odd_docs

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def coder():
    return PieceEncoder(read_model(MODEL))


def test_runs_of_one_pattern(library, coder):
    for pattern in (" ", "=", "-", "/", "0", "\r", ";\r", "a", "ab", "é", "...", "▁", "\n", "日", "🙂", " \n", "\t "):
        for n in range(70):
            for text in (pattern * n, "x" + pattern * n, pattern * n + "the y"):
                assert coder.encode(text).tolist() == library.encode(text), (pattern, n)


def test_random_texts_and_ids(library, coder):
    rng = random.Random(7)
    known = [p.replace("▁", " ") for p in coder.v.id]
    for _ in range(20000):
        k, kind = rng.randint(1, 8), rng.random()
        if kind < 0.6:
            text = "".join(rng.choice(known[:600] if kind < 0.3 else known) for _ in range(2 * k))
        else:
            text = "".join(rng.choice(" \t\nabcdeéß日本▁\r;=*-_(){}.,'\"0123🙂ﬁ\x00") for _ in range(4 * k))
        ids = coder.encode(text)
        assert ids.tolist() == library.encode(text), text
        assert coder.decode(ids) == library.decode(ids.tolist()), text
        some = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(262) for _ in range(k)]
        assert coder.decode(some) == library.decode(some), some


def test_backtracks(coder):
    """Some encodings do not begin with the longest piece: the search gives up pieces that lead nowhere."""
    rng = random.Random(3)
    known = [p for p in coder.v.id if p.isascii() and p.isalpha()]
    words = ["".join(rng.choice(known) for _ in range(3)) for _ in range(3000)]
    assert any(coder.v.pieces(w)[0] != coder.v.longest(w)[len(w) - 1] for w in words)


def test_merges_across_are_incompatible(coder):
    v = coder.v
    assert not v.compatible("t", "he") or "the" not in v.id
    for piece in list(v.id)[:3000]:
        for k in range(1, len(piece)):
            if piece[:k] in v.id and piece[k:] in v.id:
                assert not v.compatible(piece[:k], piece[k:]) or v.history(piece) is None, piece


def test_long_text_without_a_space(library, coder):
    text = "".join(random.Random(5).choice("abcdefghijklmnopqrst") for _ in range(200_000))
    assert coder.encode(text).tolist() == library.encode(text)


def test_operator_keeps_rows_and_columns(spark, library):
    docs = clashing(odd_docs(spark), ids=1, decoded="x", _ids=2)
    rows = encode_texts(docs, MODEL).collect()
    assert len(rows) == len(ODD_TEXTS)
    for r in rows:
        assert r["__ids"] == library.encode(r["text"] or "") and r["_decoded"] == library.decode(r["__ids"]) and (r["ids"], r["_ids"], r["decoded"]) == (1, 2, "x")
    assert encode_texts(empty_docs(spark), MODEL).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(read_model(MODEL))
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        PieceEncoder(proto.SerializeToString())
    proto.normalizer_spec.remove_extra_whitespaces = False
    proto.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        PieceEncoder(proto.SerializeToString())


def test_query_on_a_whole_table(spark, library):
    got = {r.doc_id: r for r in queries.op11_sentencepiece(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text)
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_empty_ids(coder):
    assert coder.decode(np.empty(0, int)) == "" and coder.encode("").tolist() == []

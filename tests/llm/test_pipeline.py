import os
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as P  # noqa: E402

from .test_decontaminate import brute as leaks  # noqa: E402
from .test_lines_rules import key  # noqa: E402
from .test_near_dups import brute_components, brute_fingerprint  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows after each stage, each written and read again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs.collect())]
    root = tmp_path_factory.mktemp("stages")
    for name, f in P.STAGES:
        f(spark, docs, SF).write.parquet(str(root / name))
        docs = spark.read.parquet(str(root / name))
        out.append((name, docs.collect()))
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    columns = stages[0][1][0].__fields__
    assert all(rows[0].__fields__ == columns for _, rows in stages[1:5])


def test_toxic_documents_go_and_most_stay(spark, stages):
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    before, after = ({r.doc_id for r in rows} for _, rows in stages[:2])
    assert after < before and len(after) > 0.8 * len(before) and len(before - after & toxic) > 0


def test_line_dedup_matches_brute_force(stages):
    rows = stages[1][1]
    held = {}
    for r in rows:
        for line in r.text.split("\n"):
            if len(key(line)) >= 40:
                held.setdefault(key(line), set()).add(r.doc_id)
    drop = {k: max(v) for k, v in held.items() if len(v) >= 5}
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if drop.get(key(x), r.doc_id) == r.doc_id) for r in rows}
    assert {r.doc_id: r.text for r in stages[2][1]} == want
    assert all(r.n_chars == len(r.text) for r in stages[2][1])


def test_near_dedup_matches_brute_force(stages):
    rows = stages[2][1]
    best = set(brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in rows]))
    assert sorted(r.doc_id for r in stages[3][1]) == sorted(best)


def test_decontamination_matches_brute_force(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {x[0] for x in leaks([(r.doc_id, r.text) for r in stages[3][1]], items)}
    assert sorted(r.doc_id for r in stages[4][1]) == sorted(r.doc_id for r in stages[3][1] if r.doc_id not in bad)


def test_packing_holds_every_token(stages):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in stages[4][1]}
    got, places = {}, {}
    for r in stages[5][1]:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for at in places.values():
        assert [o for o, _ in sorted(at)] == [0, *np.cumsum([n for _, n in sorted(at)])[:-1].tolist()] and sum(n for _, n in at) <= 4096


def test_run_and_odd_rows(spark, tmp_path, stages):
    assert sorted((r.doc_id, r.piece, r.length) for r in P.run(spark, SF).collect()) == sorted((r.doc_id, r.piece, r.length) for r in stages[5][1])
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = docs.limit(3).withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes}).union(docs).union(docs)
    odd.withColumns({c: F.lit(1) for c in ("score", "fp", "length", "h", "n_lines")}).write.parquet(str(tmp_path / "documents.parquet"))
    ids = [r.doc_id for r in P.run(spark, str(tmp_path)).collect()]
    assert ids.count(None) == 3 and all(ids.count(i) >= 1 for i in ids)
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []

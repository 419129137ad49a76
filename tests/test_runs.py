"""Runs in folders: what a run writes becomes visible with its status, which is written last."""

import pytest
from pyspark.sql import functions as F

from glossa.plans import registered as R
from glossa.plans import runs as X
from glossa.plans.experiment import ExperimentParams
from glossa.sources import io as IO

SF = "/root/testdata/sf0.001"
P = dict(language="de", tokenizer_methods=["bpe", "word"], vocab_sizes=[60, 120])


def test_a_run_is_whole_in_its_folder(spark, tmp_path):
    texts = R.paragraphs(spark, SF)
    out = X.run_in_folder(spark, texts, ExperimentParams(**P), str(tmp_path), "run_1", "corpora/de.txt")
    rows = X.committed_results(spark, str(tmp_path)).collect()
    assert {(r.run_id, r.method, r.vocab_size) for r in rows} == {("run_1", m, v) for m in ("bpe", "word") for v in (60, 120)}
    for r in rows:
        pieces = spark.read.parquet(r.tokenizer_path)
        assert 0 < pieces.count() <= max(r.vocab_size, pieces.filter(F.length("piece") == 1).count() + 5)
    led = IO.run_ledger(spark, str(tmp_path)).collect()
    assert [(r.run_id, r.status, r.language, r.corpus_path if "corpus_path" in r else "") for r in led] == [("run_1", "completed", "de", "")]
    assert led[0].updated_at
    cols = ["doc_id", "pos", "lang", "text"]
    frozen = spark.read.parquet(f"{tmp_path}/run_1/corpus")
    assert frozen.select(cols).exceptAll(texts.select(cols)).isEmpty() and frozen.count() == texts.count()
    train = out.split_stats.first().train_texts
    assert spark.read.text(f"{tmp_path}/run_1/trainer_lines").count() == train
    assert spark.read.parquet(f"{tmp_path}/run_1/split_stats").first().train_texts == train
    with pytest.raises(ValueError):  # an id is used once
        X.run_in_folder(spark, texts, ExperimentParams(**P), str(tmp_path), "run_1")
    assert IO.run_ledger(spark, str(tmp_path)).first().status == "completed"


def test_a_run_that_fails_or_is_lost_shows_no_tables(spark, tmp_path, monkeypatch):
    texts = R.paragraphs(spark, SF)
    with pytest.raises(RuntimeError):
        X.run_in_folder(spark, texts, ExperimentParams(**P, min_texts=10 ** 9), str(tmp_path), "run_few")
    with pytest.raises(ValueError):
        X.run_in_folder(spark, texts, ExperimentParams(**P), str(tmp_path), "other")
    real = IO.write_status

    class Lost(BaseException):
        pass

    def dies(spark, folder, run_id, status, message=""):  # after all tables, before the last status
        if status != "running":
            raise Lost
        real(spark, folder, run_id, status, message)

    monkeypatch.setattr(IO, "write_status", dies)
    with pytest.raises(Lost):
        X.run_in_folder(spark, texts, ExperimentParams(**(P | {"tokenizer_methods": ["word"], "vocab_sizes": [60]})), str(tmp_path), "run_lost")
    assert spark.read.parquet(f"{tmp_path}/run_lost/results").count() == 1
    led = {r.run_id: (r.status, r.message) for r in IO.run_ledger(spark, str(tmp_path)).collect()}
    assert led["run_lost"] == ("running", "") and led["run_few"][0] == "failed" and "not enough" in led["run_few"][1]
    assert X.committed_results(spark, str(tmp_path)).collect() == []

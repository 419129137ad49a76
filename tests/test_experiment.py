"""One experiment end to end on the smallest tables: grid rows, per-cell LM, failure isolation."""

from glossa.plans import registered as R
from glossa.plans.experiment import ExperimentParams, run_experiment

SF = "/root/testdata/sf0.001"


def test_experiment_grid_and_lm(spark, tmp_path):
    p = ExperimentParams(language="de", tokenizer_methods=["bpe", "word", "char"], vocab_sizes=[60, 120],
                         run_language_model=True, block_size=32)
    res = run_experiment(spark, R.paragraphs(spark, SF), p, tokenizers_dir=str(tmp_path))
    rows = {(r.method, r.vocab_size): r for r in res.results.collect()}
    assert set(rows) == {(m, v) for m in ("bpe", "word", "char") for v in (60, 120)}
    assert res.status == "completed" and res.errors.count() == 0
    # BPE below its alphabet size makes no merge: it tokenizes exactly like the char method
    assert rows[("bpe", 60)].n_tokens == rows[("char", 60)].n_tokens
    # the LM sees the vocabulary: units outside it are <unk>
    assert rows[("word", 60)].ppl != rows[("word", 120)].ppl and rows[("char", 60)].ppl != rows[("bpe", 60)].ppl
    assert all(r.ppl is not None and r.ppl > 1 for r in rows.values())
    assert all(r.tokenizer_path for r in rows.values())
    saved = spark.read.parquet(f"{tmp_path}/vocab").groupBy("method", "vocab_size").count().collect()
    assert {(r.method, r.vocab_size) for r in saved} == set(rows)
    best = {r.criterion for r in res.best.collect()}
    assert {"best_tokens_per_char", "best_ppl", "best_gap_loss"} <= best


def test_experiment_guard(spark):
    import pytest
    with pytest.raises(RuntimeError):
        run_experiment(spark, R.paragraphs(spark, SF), ExperimentParams(language="de", min_texts=10 ** 9,
                                                                        tokenizer_methods=["word"], vocab_sizes=[50]))


def test_parameters_are_checked():
    ok = ExperimentParams("de")
    assert ok.problems() == []
    for bad in (dict(split_strategy="stratfied"), dict(test_fraction=0.9), dict(test_fraction=0.0), dict(vocab_sizes=[]), dict(vocab_sizes=[0]),
                dict(min_texts=1), dict(tokenizer_methods=["x"]), dict(run_language_model=True, block_size=1), dict(language=" ")):
        assert ExperimentParams(**({"language": "de"} | bad)).problems(), bad


def test_a_failing_cell_stops_no_other(spark, monkeypatch):
    """One size of one method is too small to train, and one cell's LM fails: both are recorded."""
    from glossa.plans import experiment as X
    real = X.lm_records

    def flaky(frames, p):  # of all cells, then of this one alone
        if any(c.startswith("char") for c in frames):
            raise ValueError("no LM today")
        return real(frames, p)

    monkeypatch.setattr(X, "lm_records", flaky)
    p = ExperimentParams("de", tokenizer_methods=["word", "char", "unigram"], vocab_sizes=[20], run_language_model=True, block_size=32)
    res = run_experiment(spark, R.paragraphs(spark, SF), p)
    assert [(r.method, r.vocab_size) for r in res.results.collect()] == [("word", 20)]
    errors = {r.stage: r.error for r in res.errors.collect()}
    assert "no LM today" in errors["char/vocab_20"] and "too small" in errors["unigram/vocab_20"] and res.status == "partially_completed"


def test_cells_of_a_run_read_its_texts_together(spark):
    """One scan for all cells on pre-tokens, one for those on marked words."""
    from glossa.operators import encoders as E
    from glossa.plans import experiment as X
    split = spark.createDataFrame([("train", "en", "a b a b"), ("test", "de", "b a c")], "split string, label string, text string")
    cells = {f"{m}/{v}": X.CellTexts(split, m, E.Lexical(m, frozenset("ab"[:v]))) for m in ("word", "char") for v in (1, 2)}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    grams = X.cell_grams(cells, ExperimentParams("de", lm_order=2))
    assert plan(grams).count("MapInArrow") == 1
    unk = "<unk>"
    assert {(r["split"], r["first"], r["w"], r["c1"]): r["n"] for r in grams.filter("cell = 'word/1'").collect()} == {
        ("train", True, unk, "a"): 1, ("train", False, "a", unk): 1, ("train", False, unk, "a"): 1, ("test", True, "a", unk): 1, ("test", False, unk, "a"): 1}
    cells["unigram/3"] = X.CellTexts(split, "unigram", E.Unigram([("\u2581", -1.0), ("a", -2.0), ("b", -2.0)]))
    assert plan(X.cell_grams(cells, ExperimentParams("de"))).count("MapInArrow") == 2


def test_numbers_of_tokens_give_the_records_of_tokens(spark):
    """Lexical cells shuffle numbers; a cell whose encoder lists no tokens keeps them all as strings, and null stays no token."""
    import random

    from glossa.operators import encoders as E
    from glossa.operators import ngram_lm as LM
    from glossa.plans import experiment as X
    rng = random.Random(6)
    rows = [(rng.choice(["train", "train", "test"]), rng.choice(["en", "de"]), " ".join(rng.choice(["a", "bb", "cab", "<unk>", "é"]) for _ in range(rng.randint(0, 30))))
            for _ in range(60)]
    split = spark.createDataFrame(rows, "split string, label string, text string").repartition(4)
    p = ExperimentParams("de", lm_order=3, block_size=8)
    cells = {f"{m}/{len(v)}": X.CellTexts(split, m, E.Lexical(m, frozenset(v))) for m, v in (("word", ["a", "bb"]), ("word", ["a"]), ("char", list("ab")), ("char", list("abcé")))}
    numbers = X.cell_grams(cells, p, numbered=True)
    assert dict(numbers.dtypes)["w"] == dict(numbers.dtypes)["c2"] == "int"
    mixed = {**cells, "bpe/1": X.CellTexts(split, "bpe", E.Merges([("a", "b", "ab")], frozenset("abc")))}
    assert dict(X.cell_grams(mixed, p, numbered=True).dtypes)["w"] == "string"
    got = X.lm_records(cells, p)
    want = {r["cell"]: r for r in LM.lm_for_grams(X.cell_grams(cells, p), 3, "de", ["cell"])[0].collect()}
    assert got.keys() == want.keys() == cells.keys()
    for cell, r in want.items():
        assert all(abs(got[cell][f] - r[f]) < 1e-9 for f in X.LM_FIELDS), cell


def test_small_tables_of_the_driver_start_no_python(spark):
    from glossa.session import local_frame
    rows = [("a", 1, None), (None, 2, 0.5)]
    df = local_frame(spark, rows, "s string, n int, x double")
    assert [tuple(r) for r in df.collect()] == rows and df.dtypes == [("s", "string"), ("n", "int"), ("x", "double")]
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()
    none = local_frame(spark, [], "s string, n int")
    assert none.collect() == [] and none.columns == ["s", "n"]


def test_lm_needs_both_sides(spark):
    import pytest

    from glossa.operators import ngram_lm as LM
    rows = [("train", "en", ["a", "b", "c"], 1, 1)]
    df = spark.createDataFrame(rows, "split string, label string, ids array<string>, doc_id int, pos int")
    with pytest.raises(ValueError, match="test side"):
        LM.lm_for_tokens(df, 8, 2, "de")


def test_means_of_large_values(spark):
    from glossa.operators import rollup as G
    df = spark.createDataFrame([("bpe", 1e14), ("bpe", 3e14), ("bpe", None)], "method string, ppl_target double")
    assert [(r.mean, r.n) for r in G.mean_by(df, ["method"]).collect()] == [(2e14, 2)]


def test_the_lm_of_cells_shuffles_blocks(spark):
    """One row holds many grams of a cell, so that ten cells on one corpus don't shuffle ten tables of strings."""
    from glossa.operators import encoders as E
    from glossa.plans import experiment as X
    texts = [("train" if i % 4 else "test", ["en", "de"][i % 2], " ".join(f"w{i * j % 97}" for j in range(60))) for i in range(200)]
    split = spark.createDataFrame(texts, "split string, label string, text string").coalesce(1)
    cells = {f"{m}/{v}": X.CellTexts(split, m, E.Lexical(m, frozenset([f"w{i}" for i in range(v)] if m == "word" else "w0123456789"[:v]))) for m in ("word", "char") for v in (5, 11)}
    p = ExperimentParams("de", block_size=16)
    rows = X.cell_blocks(cells, p, 2)
    assert 10 * rows.count() < X.cell_grams(cells, p).count() and {r["cell"] for r in rows.select("cell").distinct().collect()} == set(cells)
    assert X.lm_records(cells, p).keys() == cells.keys()

"""E1 blank slice, F1 block rule, G2 best-row rules, G4 status (FIXTURES §3)."""

from pyspark.sql import functions as F

from glossa.operators import metrics as M
from glossa.operators import ngram_lm as LM
from glossa.operators import rollup as G


def test_blank_slice_is_null(spark):
    sc = spark.createDataFrame([("   ", "test", "en"), ("hello there", "test", "de")], "text string, split string, label string")
    st = M.text_stats(sc, "fr")
    sums = spark.createDataFrame([("word", 100, 2, 11, 0, 0, 0, 0)],
                                 "method string, vocab_size int, tokens_test_all long, token_chars_test_all long, "
                                 "tokens_test_en long, token_chars_test_en long, tokens_test_target long, token_chars_test_target long")
    r = M.result_rows(st, sums).collect()[0]
    assert r.tokens_per_char_en is None and r.n_texts_en == 0 and r.n_tokens_en == 0
    assert r.tokens_per_char_target is None and r.compression_penalty_char is None
    assert r.n_texts == 2 and abs(r.tokens_per_char - 2 / 11) < 1e-6


def test_block_rule(spark):
    rows = [(1, list(range(1))), (2, list(range(2))), (3, list(range(129))), (4, list(range(130)))]
    df = spark.createDataFrame(rows, "id long, ids array<long>")
    got = {}
    for r in LM.blocks(df, "ids", 128).collect():
        got.setdefault(r.id, []).append(len(r.block))
    assert got == {2: [2], 3: [128], 4: [128, 2]}


def test_best_rows_rules(spark):
    rows = [("bpe", 100, 0.3, -0.1, -0.3), ("bpe", 200, 0.2, 0.05, 0.1), ("wp", 100, 0.25, 0.2, None)]
    df = spark.createDataFrame(rows, "method string, vocab_size int, tokens_per_char double, compression_penalty_char double, gap_loss double")
    b = {r.criterion: (r.method, r.vocab_size, r.value) for r in G.best_rows(df).collect()}
    assert b["best_compression_penalty_char"] == ("bpe", 200, 0.05)
    assert b["best_gap_loss"] == ("bpe", 100, -0.3)
    assert b["best_tokens_per_char"] == ("bpe", 200, 0.2)


def test_run_status(spark):
    df = spark.createDataFrame([(2, 0), (1, 1), (0, 2)], "r long, e long")
    got = [x[0] for x in df.select(G.run_status(F.col("r"), F.col("e"))).collect()]
    assert got == ["completed", "partially_completed", "failed"]


def test_mean_by_missing_columns_is_empty(spark):
    df = spark.createDataFrame([("a", 1.0)], "method string, x double")
    assert G.mean_by(df, ["method", "vocab_size"]).count() == 0


def test_undefined_tokens_per_char_still_has_a_best_row(spark):
    df = spark.createDataFrame([("a", "word", 200, None, None), ("a", "char", 100, None, 2.0), ("b", "word", 100, 0.5, None)],
                               "run string, method string, vocab_size int, tokens_per_char double, ppl double")
    got = {(r.run, r.criterion): (r.method, r.vocab_size, r.value) for r in G.best_rows(df, ["run"]).collect()}
    assert got == {("a", "best_tokens_per_char"): ("char", 100, None), ("b", "best_tokens_per_char"): ("word", 100, 0.5), ("a", "best_ppl"): ("char", 100, 2.0)}


def plain_kneser_ney(train, texts, order):
    """Mean -log p over the predicted tokens of ``texts``, by the textbook recursion."""
    from collections import Counter
    import math
    grams = Counter()
    for block in train:
        for i in range(1, len(block)):
            grams[tuple(block[i - j] if i - j >= 0 else None for j in range(order))] += 1  # w, c1, c2 ...
    tables = {order: Counter({g: n for g, n in grams.items() if g[-1] is not None})}
    rest = set(grams)
    for k in range(order - 1, 0, -1):
        shorter = Counter(g[:k] for g in rest)
        tables[k] = Counter({g: n for g, n in shorter.items() if k == 1 or g[-1] is not None})
        rest = set(shorter)
    discount = {}
    for k, t in tables.items():
        n1, n2 = (sum(v == x for v in t.values()) for x in (1, 2))
        discount[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.75

    def p(g, k):
        if k == 0:
            return 1 / (len(tables[1]) + 1)
        same = [n for h, n in tables[k].items() if h[1:] == g[1:k]]
        if not same or (k > 1 and g[k - 1] is None):
            return p(g, k - 1)
        d = discount[k]
        return (max(tables[k][g[:k]] - d, 0) + d * len(same) * p(g, k - 1)) / sum(same)

    logs = [math.log(p(tuple(b[i - j] if i - j >= 0 else None for j in range(order)), order)) for b in texts for i in range(1, len(b))]
    return -sum(logs) / len(logs)


def test_kneser_ney_equals_the_plain_recursion_for_all_models_at_once(spark):
    import random
    rng = random.Random(3)
    rows, want = [], {}
    for model, letters in (("x", "abcd"), ("y", "abcdefghij")):
        sides = {side: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n)] for side, n in (("train", 40), ("test", 15))}
        rows += [(model, side, "en", i, list(t)) for side, ts in sides.items() for i, t in enumerate(ts)]
        want[model] = {order: plain_kneser_ney(sides["train"], sides["test"], order) for order in (1, 2, 3, 4)}
    df = spark.createDataFrame(rows, "cell string, split string, label string, doc_id int, ids array<string>")
    for order in (1, 2, 3, 4):
        rec, missing = LM.lm_for_tokens(df, 128, order, "de", ["cell"])
        assert not missing
        for r in rec.collect():
            assert abs(r.eval_loss - want[r.cell][order]) < 1e-9, (order, r.cell)
    one, _ = LM.lm_for_tokens(df.filter("cell = 'x'").drop("cell"), 128, 3, "de")
    assert abs(one.first().eval_loss - want["x"][3]) < 1e-9

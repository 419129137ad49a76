"""Words counted inside tasks follow the rules of the column expressions; a corpus is cleaned once for its split."""

import random
from collections import Counter

from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions import words
from glossa.operators import ngram_lm as LM
from glossa.plans import registered as R
from glossa.plans.experiment import ExperimentParams, prepare

SF = "/root/testdata/sf0.001"
TEXTS = ["Größe: 3,5 km²!  naïve_x", "été ‍ x", "日本の、한국어 Привет", "a\x85b c　d \x1ce", "", "   ", "Ⅷ ½ ⓐ 😀😀 --", None, "hindi हिन्दी."]


def test_pretokens_and_word_counts_follow_the_columns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    for r in df.select("i", T.pretokens("text").alias("p")).collect():
        assert (r.p if TEXTS[r.i] is not None else None) == (None if TEXTS[r.i] is None else words.pretokens(TEXTS[r.i]))
    want = {r.i: (r.c, r.n) for r in df.select("i", F.length("text").alias("c"), T.word_count("text").alias("n")).collect() if TEXTS[r.i] is not None}
    got = {r.i: (r.n_chars, r.n_words) for r in words.with_word_counts(df, ["i"]).collect()}
    assert got.pop(7) == (None, None) and got == want


def test_type_frequencies_count_each_slice(spark):
    rng = random.Random(1)
    rows = [(" ".join(rng.choice("abcdef") for _ in range(5)), rng.choice(["train", "test"]), rng.choice(["en", "de", "unknown", None])) for _ in range(200)]
    df = spark.createDataFrame([*rows, (None, "train", "en")], "text string, split string, label string")
    got = {r.word: tuple(r)[1:] for r in words.type_frequencies(df.repartition(5), words.spaced, "de").collect()}
    kinds = [lambda s, l: s == "train", lambda s, l: s == "test", lambda s, l: s == "test" and l == "en", lambda s, l: s == "test" and l == "de"]
    want = {w: tuple(sum(t.split().count(w) for t, s, l in rows if k(s, l)) for k in kinds) for w in "abcdef"}
    assert got == want


def test_grams_are_counted_by_portion():
    """As ``blocks`` and ``ngrams``: also with more words than fit a key of 62 bits, and where a row's last block has one token."""
    rng = random.Random(2)
    for order, block, n_words in ((1, 4, 5), (2, 4, 3), (3, 8, 40), (3, 128, 3000), (5, 16, 9000)):
        rows = [[f"w{rng.randrange(n_words)}" for _ in range(rng.choice([0, 1, 2, 5, 9, 129, 400]))] for _ in range(60)]
        sides = [(rng.choice(["train", "test"]), rng.choice(["en", None])) for _ in rows]
        portion = LM._Portion(block, order)
        for at in range(0, 60, 20):
            portion.add(sides[at:at + 20], [*rows[at:at + 20]], None)
        import pyarrow as pa
        names = ["split", "label", "first", "w", *[f"c{k}" for k in range(1, order)], "n"]
        schema = pa.schema([(c, pa.bool_() if c == "first" else pa.int64() if c == "n" else pa.string()) for c in names])
        got = Counter()
        for b in portion.counted(schema):
            for *key, n in zip(*(c.to_pylist() for c in b.columns)):
                assert tuple(key) not in got
                got[tuple(key)] = n
        want = Counter()
        for side, row in zip(sides, rows):
            for s in range(0, len(row) - 1, block):
                blk = row[s:s + block]
                want.update((*side, i == 1, blk[i], *[blk[i - k] if i >= k else None for k in range(1, order)]) for i in range(1, len(blk)))
        assert got == want, order


def test_texts_are_looked_at_once_for_all_cells(monkeypatch):
    """Grams of each encoder's tokens as ``blocks`` and ``ngrams`` give them, also where portions end early and words are numbered anew."""
    import pyarrow as pa

    from glossa.operators import encoders as E
    rng = random.Random(4)
    texts = [None if rng.random() < .1 else " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([0, 1, 2, 7, 40])))
             for _ in range(90)]
    sides = [(rng.choice(["train", "test"]), rng.choice(["en", "de", None])) for _ in texts]
    cells = {"word": E.Lexical("word", frozenset(["a", "ab", "c", "dd"])), "char": E.Lexical("char", frozenset("abc")), "raw": None}
    schema = pa.schema([(c, pa.bool_() if c == "first" else pa.int64() if c == "n" else pa.string()) for c in ["cell", "split", "label", "first", "w", "c1", "c2", "n"]])
    batches = [pa.RecordBatch.from_arrays([pa.array([s[0] for s in sides[at:at + 9]]), pa.array([s[1] for s in sides[at:at + 9]], pa.string()),
                                           pa.array(texts[at:at + 9], pa.string())], names=["split", "label", "text"]) for at in range(0, 90, 9)]
    want = Counter()
    for side, text in zip(sides, texts):
        for cell, encoder in cells.items():
            found = words.pretokens(text or "")
            row = found if encoder is None else [t for part in encoder(found) for t in part]
            for s in range(0, len(row) - 1, 8):
                blk = row[s:s + 8]
                want.update((cell, *side, i == 1, blk[i], *[blk[i - k] if i >= k else None for k in (1, 2)]) for i in range(1, len(blk)))
    for tokens, kinds in ((1 << 20, 1 << 20), (100, 1 << 20), (1 << 20, 30), (50, 20)):
        monkeypatch.setattr(LM, "TOKENS_AT_ONCE", tokens)
        monkeypatch.setattr(LM, "WORDS_AT_ONCE", kinds)
        looked, got = [], Counter()
        for b in LM.counted_batches(iter(batches), schema, 2, 8, 3, lambda t: looked.append(t) or words.pretokens(t), cells, True):
            for *key, n in zip(*(c.to_pylist() for c in b.columns)):
                got[tuple(key)] += n
        assert got == want and len(looked) == sum(t is not None for t in texts), (tokens, kinds)


def test_a_task_gives_a_gram_once_and_small_vocabularies_follow_from_large_ones(monkeypatch):
    """Portions of a task are summed before they go on; a lexical cell whose units a larger one has is not counted from texts again."""
    import pyarrow as pa

    from glossa.operators import encoders as E
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdé😀") for _ in range(rng.randint(1, 2))) for _ in range(rng.choice([0, 1, 2, 9, 40]))) for _ in range(80)]
    sides = [(rng.choice(["train", "test"]), rng.choice(["en", None])) for _ in texts]
    cells = {"word/2": E.Lexical("word", frozenset(["a", "bé"])), "word/3": E.Lexical("word", frozenset(["a", "bé", "<unk>"])), "word/0": E.Lexical("word", frozenset()),
             "word/x": E.Lexical("word", frozenset(["c"])), "char/3": E.Lexical("char", frozenset("a😀b")), "char/1": E.Lexical("char", frozenset("b")),
             "char/same": E.Lexical("char", frozenset("a😀b")), "bpe": E.Merges([("a", "b", "ab")], frozenset("abc"))}
    schema = pa.schema([(c, pa.bool_() if c == "first" else pa.int64() if c == "n" else pa.string()) for c in ["cell", "split", "label", "first", "w", "c1", "c2", "n"]])
    batches = [pa.RecordBatch.from_arrays([pa.array([s[0] for s in sides[at:at + 8]]), pa.array([s[1] for s in sides[at:at + 8]], pa.string()),
                                           pa.array(texts[at:at + 8], pa.string())], names=["split", "label", "text"]) for at in range(0, 80, 8)]
    want = Counter()
    for side, text in zip(sides, texts):
        for cell, encoder in cells.items():
            row = [t for part in encoder(words.pretokens(text)) for t in part]
            for s in range(0, len(row) - 1, 8):
                blk = row[s:s + 8]
                want.update((cell, *side, i == 1, blk[i], *[blk[i - k] if i >= k else None for k in (1, 2)]) for i in range(1, len(blk)))
    assert set(LM._followers(cells, 3)) == {"word/3", "word/x", "char/3", "bpe"}
    monkeypatch.setattr(LM, "TOKENS_AT_ONCE", 60)
    monkeypatch.setattr(LM, "WORDS_AT_ONCE", 9)
    for held in (1 << 20, 40):
        monkeypatch.setattr(LM, "GRAMS_HELD", held)
        got, rows = Counter(), 0
        for b in LM.counted_batches(iter(batches), schema, 2, 8, 3, words.pretokens, cells, True):
            rows += b.num_rows
            for *key, n in zip(*(c.to_pylist() for c in b.columns)):
                got[tuple(key)] += n
        assert got == want and (rows == len(want)) == (held > 40)


def test_gates_of_the_repair_and_of_scripts_miss_no_character(spark):
    codes = [c for c in [*range(0x0, 0xD800), *range(0xE000, 0x10000), 0x10400, 0x20000]]
    df = spark.createDataFrame([(c, f"x{chr(c)}y") for c in codes], "c int, t string").repartition(8)
    plain = lambda p: F.col("t").rlike(p)
    forms = r"[\x{132}\x{133}\x{2018}-\x{201f}\x{3000}\x{fb00}-\x{fb06}\x{ff01}-\x{ff5e}]"
    breaks = r"[\x{0}-\x{8}\x{b}\x{d}-\x{1f}\x{7f}\x{85}\x{2028}\x{2029}\x{feff}]"
    tag = F.lit("other")
    for name, p in reversed(T.SCRIPT_RULES):
        tag = F.when(plain(p), name).otherwise(tag)
    bad = df.filter((plain(forms) != (T.repair_forms("t") != F.col("t"))) | (plain(breaks) != (T.repair_breaks("t") != F.col("t"))) | (tag != T.script_tag("t")))
    assert [r.c for r in bad.collect()] == []


def test_a_run_cleans_its_corpus_once(spark):
    """The split reads its input several times; what it reads is written, not cleaned again for each read."""
    docs = R.paragraphs(spark, SF)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    n = docs.count()
    counted = docs.mapInArrow(count, docs.schema)
    prepare(counted, ExperimentParams("de"))
    assert seen.value == n

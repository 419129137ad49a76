"""BPE batching equals one-at-a-time greedy BPE; encoders restore words; metrics edge cases."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from glossa.operators import bpe as B
from glossa.operators import encoders as E
from glossa.operators import forecast as FC
from glossa.operators import lattice as LT
from glossa.operators import subword as W


def greedy_bpe(words: Counter, vocab_size: int, min_freq: int = 2):
    """Plain-Python twin: one merge at a time, ties by (left, right)."""
    seqs = {w: list(w) for w in words}
    vocab = list(B.SPECIAL_TOKENS) + sorted({c for w in words for c in w})
    vs = set(vocab)
    merges = []
    while len(vocab) < vocab_size:
        pc = Counter()
        for w, f in words.items():
            s = seqs[w]
            for a, b in zip(s, s[1:]):
                pc[(a, b)] += f
        if not pc:
            break
        (a, b), c = min(pc.items(), key=lambda kv: (-kv[1], kv[0]))
        if c < min_freq:
            break
        m = a + b
        merges.append((a, b))
        if m not in vs:
            vs.add(m)
            vocab.append(m)
        for w in seqs:
            s, out, i = seqs[w], [], 0
            while i < len(s):
                if i + 1 < len(s) and s[i] == a and s[i + 1] == b:
                    out.append(m)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            seqs[w] = out
    return merges, vocab, seqs


def test_batched_bpe_equals_greedy(spark):
    rnd = random.Random(5)
    for trial in range(3):
        words = Counter("".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 7))) for _ in range(300))
        rows = [(w, f, f, 0, 0) for w, f in words.items()]
        types = spark.createDataFrame(rows, "word string, train_freq long, test_all_freq long, test_en_freq long, test_target_freq long")
        tr = B.train_merges(types, [40], "bpe", keep_states=True)
        merges, vocab, seqs = greedy_bpe(words, 40)
        assert [(l, r) for _, l, r, _, _ in tr.merges] == merges
        assert tr.vocab == vocab
        got = {r.word: r.seg.split() for r in tr.states[40].collect()}
        assert got == seqs


def plain_wordpiece(word, vocab):
    if len(word) > W.WP_MAX_WORD_CHARS:
        return ["<unk>"]
    out, start = [], 0
    while start < len(word):
        end = next((e for e in range(len(word), start, -1) if ("##" if start else "") + word[start:e] in vocab), None)
        if end is None:
            return ["<unk>"]
        out.append(("##" if start else "") + word[start:end])
        start = end
    return out


def plain_best(word, logp, unknown):
    best, back = [0.0] + [-math.inf] * len(word), [0] * (len(word) + 1)
    for i in range(len(word)):
        for j in range(i + 1, len(word) + 1):
            s = best[i] + logp.get(word[i:j], unknown if j == i + 1 else -math.inf)
            if s > best[j]:
                best[j], back[j] = s, i
    cuts, j = [], len(word)
    while j:
        cuts.append((back[j], j))
        j = back[j]
    out, last = [], False
    for i, j in reversed(cuts):
        alone = word[i:j] not in logp
        if alone and last:
            out[-1] += word[i:j]
        else:
            out.append(word[i:j])
        last = alone
    return out


def plain_expected(word, logp):
    """By all segmentations of the word."""
    def cuts(rest):
        if not rest:
            yield []
        for k in range(1, len(rest) + 1):
            if rest[:k] in logp:
                yield from ([rest[:k], *more] for more in cuts(rest[k:]))
    weighed = [(math.exp(sum(logp[p] for p in c)), c) for c in cuts(word)]
    out = Counter()
    for p, c in weighed:
        for x in c:
            out[x] += p / sum(w for w, _ in weighed)
    return out


def random_words(rnd, n, letters="abcé🙂", most=9):
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, most))) for _ in range(n)]


def test_wordpiece_encoder():
    vocab = ["<unk>", "un", "##aff", "##able", "a", "##b"]
    assert W.wordpiece_encoder(vocab)(["unaffable", "unx", "", "ab"]) == ([["un", "##aff", "##able"], ["<unk>"], [], ["a", "##b"]], [[1, 2, 3], [0], [], [4, 5]])
    rnd = random.Random(2)
    for _ in range(50):
        vocab = ["<unk>"] + sorted({rnd.choice(["", "##"]) + w for w in random_words(rnd, 25, "abcé", 4) if w})
        words = random_words(rnd, 40) + ["a" * 100, "a" * 101, "##", "##a"]
        tokens, ids = W.wordpiece_encoder(vocab)(words)
        assert tokens == [plain_wordpiece(w, set(vocab)) for w in words]
        assert [[vocab[i] for i in x] for x in ids] == tokens


def test_lattices_equal_plain_sums_and_paths():
    rnd = random.Random(4)
    for _ in range(40):
        pieces = sorted({w for w in random_words(rnd, 20, "abcé", 4) if w})
        scores = np.array([-5 * rnd.random() for _ in pieces])
        logp, words = dict(zip(pieces, scores)), random_words(rnd, 25)
        weights = np.array([rnd.randint(0, 5) for _ in words], float)
        trie = LT.Trie(pieces)
        assert [[x for x, _ in t] for t in LT.segment(trie, scores, -20.0, words)] == [plain_best(w, logp, -20.0) for w in words]
        want = Counter()
        for w, f in zip(words, weights):
            for p, e in plain_expected(w, logp).items():
                want[p] += e * f
        got = LT.expected(LT.lattice(trie, words), scores, weights)
        assert np.allclose(got, [want[p] for p in pieces])


def test_unigram_viterbi_restores_word():
    lp = [("▁", -3.0), ("a", -2.0), ("b", -2.0), ("ab", -1.0), ("▁ab", -0.5)]
    toks, other = W.unigram_encoder(lp)(["▁abab", "▁xyab"])
    assert [x for x, _ in toks] == ["▁ab", "ab"] and [p for _, p in toks] == [4, 3]
    assert [x for x, _ in other] == ["▁", "xy", "ab"]  # an unknown run is one token, its surface kept


def test_unigram_grid_is_one_sweep(spark):
    rnd = random.Random(6)
    rows = [("▁" + w, rnd.randint(1, 30), 1, 0, 0) for w in sorted(set(random_words(rnd, 400, "abcdef", 8))) if w]
    types = spark.createDataFrame(rows, "word string, train_freq long, test_all_freq long, test_en_freq long, test_target_freq long")
    grid = W.train_unigram_grid(types, [60, 30, 8])
    assert isinstance(grid[8], ValueError) and [len(grid[v]) for v in (60, 30)] == [55, 25]
    small, large = ({p for p, _ in grid[v]} for v in (30, 60))
    assert small < large and grid[60] == W.train_unigram(types, 60)
    assert all(abs(sum(math.exp(s) for _, s in grid[v]) - 1) < 1e-9 for v in (30, 60))
    enc = {r.word: r for r in W.unigram_encode(types, grid[60]).collect()}
    for w, *_ in rows:
        assert "".join(enc[w].tokens) == w and [grid[60][i - 5][0] for i in enc[w].ids] == enc[w].tokens


def test_forecasts_never_change_the_merges(spark):
    """The list of exact counts, the sample and the checkpoints may be of any size; also for WordPiece."""
    rnd = random.Random(13)
    words = Counter(w for w in random_words(rnd, 200, "abcd", 7) if w)
    rows = [(w, f, f, 0, 0) for w, f in words.items()]
    types = spark.createDataFrame(rows, "word string, train_freq long, test_all_freq long, test_en_freq long, test_target_freq long")
    for method in ("bpe", "wordpiece"):
        runs = [B.train_merges(types, [25, 32], method, top_n=n, sample_types=k, checkpoint_every=c) for n, k, c in ((16384, 1000, 12), (5, 60, 1), (50, 1, 3))]
        assert len({tuple(r.merges) for r in runs}) == 1 and len({tuple(r.vocab) for r in runs}) == 1 and len({str(r.cuts) for r in runs}) == 1
        assert runs[1].recounts > runs[0].recounts == 1
    assert [(l, r) for _, l, r, _, _ in B.train_merges(types, [32]).merges] == greedy_bpe(words, 32)[0]


def test_unigram_training_small(spark):
    rows = [("▁" + w, f, f, 0, 0) for w, f in [("hello", 30), ("help", 20), ("world", 25), ("word", 10), ("hold", 5)]]
    types = spark.createDataFrame(rows, "word string, train_freq long, test_all_freq long, test_en_freq long, test_target_freq long")
    pieces = W.train_unigram(types, 30)
    assert len(pieces) <= 25
    chars = {c for w, *_ in rows for c in w}
    assert chars <= {p for p, _ in pieces}
    sums = W.unigram_sums(types, pieces).collect()[0]
    assert sums["token_chars_test_all"] == sum(len(w) * f for w, f, *_ in rows)


def test_batched_bpe_with_few_candidates(spark):
    """A short candidate list bounds what is not on it by its last count; batching stays exact (just smaller)."""
    rnd = random.Random(11)
    words = Counter("".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 6))) for _ in range(200))
    rows = [(w, f, f, 0, 0) for w, f in words.items()]
    types = spark.createDataFrame(rows, "word string, train_freq long, test_all_freq long, test_en_freq long, test_target_freq long")
    tr = B.train_merges(types, [20, 30], "bpe", top_n=4, sample_types=20)
    merges, vocab, seqs = greedy_bpe(words, 30)
    assert [(l, r) for _, l, r, _, _ in tr.merges] == merges and tr.vocab == vocab
    assert tr.cuts[20][0] == 20 and tr.cuts[30] == (len(vocab), len(merges))
    encode = E.Merges([m[1:4] for m in tr.merges], frozenset(tr.alphabet))
    assert dict(zip(words, encode(list(words)))) == seqs and encode(["aZb"]) == [["a", "<unk>", "b"]]


def test_pretokens_match_the_public_pretokenizer(spark):
    from tokenizers.pre_tokenizers import Whitespace

    from glossa.functions import text as T
    texts = ["cafe\u0301 na\u00efve", "हिन्दी भाषा", "日本語 テスト、です", "a_b‿c d\u200ce", "x²y ½ Ⅷ Ⓐb", "don't stop--now!!", "ไทย ภาษา", "1,000.5 €£", "עִבְרִית", "한국어 테스트", "a\u00a0b\u3000c"]
    texts += ["".join(chr(c) for c in range(lo, lo + 96)) for lo in (0x20, 0xa0, 0x300, 0x370, 0x590, 0x600, 0x900, 0xe00, 0x1100, 0x2000, 0x2070, 0x2100, 0x2150, 0x2460, 0x24b0, 0x3040, 0xac00)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", T.pretokens("t").alias("p")).collect():
        assert r.p == [w for w, _ in Whitespace().pre_tokenize_str(r.t)], r.t


def test_unigram_normalises_and_prunes_by_loss(spark):
    corpus = spark.createDataFrame([("ＡＢ ﬁne x\u00a0y", "train", "en"), ("AB fine", "test", "en")], "text string, split string, label string")
    types = {r.word: (r.train_freq, r.test_en_freq) for r in W.unigram_type_table(corpus, "de").collect()}
    assert types["▁AB"] == (1, 1) and types["▁fine"] == (1, 1) and "▁ＡＢ" not in types
    rows = [("▁" + w, f, f, 0, 0) for w, f in [("hello", 30), ("help", 20), ("world", 25), ("word", 10), ("hold", 5)]]
    t = spark.createDataFrame(rows, "word string, train_freq long, test_all_freq long, test_en_freq long, test_target_freq long")
    assert len(W.train_unigram(t, 20)) == 15
    import pytest
    with pytest.raises(ValueError, match="too small"):
        W.train_unigram(t, 10)


def plain_changes(words, guess, wanted):
    """What ``count_changes`` finds, of all words: by step, changes of the pairs that ``wanted`` keeps."""
    total, steps = [Counter() for _ in guess], FC.step_of(guess)
    for s, f in words:
        FC.apply_in_order(s, steps, guess, total, f)
    return {k: [(p, d) for p, d in c.items() if d and wanted(p)] for k, c in enumerate(total)}


def plain_counts(words):
    pairs = Counter()
    for s, f in words:
        for p in zip(s, s[1:]):
            pairs[p] += f
    return pairs


def test_merges_are_taken_past_others_of_the_guess():
    words = [(list("ab"), 5), (list("cd"), 8), (list("abcd"), 1), (list("cdab"), 1)]
    guess = [("a", "b", "ab"), ("c", "d", "cd"), ("x", "y", "xy")]  # the second comes first, also next to an "a b"
    counts = FC.Counts(dict(plain_counts(words)), None)
    assert FC.accepted(counts, guess, plain_changes(words, guess, lambda p: True), 1)[:2] == [(guess[1], 10), (guess[0], 7)]
    assert counts.count == {("ab", "cd"): 1, ("cd", "ab"): 1}
    guess = [("a", "b", "ab"), ("b", "c", "bc"), ("x", "y", "xy")]
    words = [(list("abc"), 5), (list("bc"), 1)]  # these meet: the second can't be taken past the first
    assert not FC.accepted(FC.Counts(dict(plain_counts(words)), None), guess, plain_changes(words, guess, lambda p: True), 1)


def test_merges_from_wrong_guesses_are_greedy_ones():
    rnd = random.Random(8)
    passed = 0
    for case in range(150):
        letters = "abcdefgh"[:rnd.randint(2, 8)]
        words = [(list(w), rnd.randint(1, 30)) for w in random_words(rnd, 60, letters, 8) if w]
        top_n = rnd.choice([6, 20, 1000])
        plain, want = list(words), []
        for _ in range(25):
            pairs = plain_counts(plain)
            best = min(pairs, key=lambda p: (-pairs[p], p), default=None)
            if best is None or pairs[best] < 2:
                break
            want.append((best, pairs[best]))
            plain = [(FC.merge_once(s, *best, "".join(best)), f) for s, f in plain]
        vocab, got, counts = set(letters), [], None
        sample = FC.Forecast([w for w in words if rnd.random() < 0.5])
        for _ in range(200):
            if counts is None or counts.best() is None:
                listed = sorted((-c, *p) for p, c in plain_counts(words).items())
                counts = FC.Counts({(l, r): -c for c, l, r in listed[:top_n]}, listed[top_n] if len(listed) > top_n else None)
            if counts.best()[0] < 2 or len(got) >= 25:
                break
            guess = sample.guess(counts, rnd.choice([3, 10]), 100, vocab, 2, str.__add__)
            made = {m for _, _, m in guess}
            listed = set(counts.count)
            taken = FC.accepted(counts, guess, plain_changes(words, guess, lambda p: p in listed or not made.isdisjoint(p)), 2)
            merges = [m for m, _ in taken]
            assert merges, "the first merge of a guess is the best pair"
            passed += merges != guess[:len(merges)]
            got += [(m[:2], c) for m, c in taken]
            sample.apply(merges)
            words = [(FC.apply_in_order(s, FC.step_of(merges), merges), f) for s, f in words]
            exact = plain_counts(words)
            assert all(exact[p] == c for p, c in counts.count.items())
            if any(m in vocab for _, _, m in merges) or len({m for _, _, m in merges}) < len(merges):
                counts = None
            vocab |= {m for _, _, m in merges}
        assert got[:25] == want[:len(got[:25])] and len(got) >= len(want)
        assert all(FC.apply_in_order(s, {}, []) == s for s, _ in sample.words)
        now = {("".join(s)): s for s, _ in words}
        assert all(s == now["".join(s)] for s, _ in sample.words)
    assert passed > 20


def test_plain_products_equal_sums_of_logarithms(monkeypatch):
    """Expected uses in one sweep without a lattice: also of words too long or too rare for plain numbers, of words that no pieces cover,
    and where the trie has no table."""
    rng = random.Random(11)
    words = ["", "a", "zz", "abz", *("".join(rng.choice("abcdé😀") for _ in range(rng.choice([1, 3, 8, 20]))) for _ in range(120)), "ab" * 400]
    pieces = sorted({*"abcdé😀", *("".join(rng.choice("abcdé😀") for _ in range(rng.randint(2, 5))) for _ in range(60))})
    for low in (-3.0, -60.0, -800.0):
        scores, weights = np.array([rng.uniform(low, -0.5) for _ in pieces]), np.array([float(rng.randint(1, 9)) for _ in words])
        for cells, chars in ((1 << 23, 200_000), (0, 40)):
            monkeypatch.setattr(LT, "TABLE_CELLS", cells)
            monkeypatch.setattr(LT, "CHARS_AT_ONCE", chars)
            trie = LT.Trie(pieces)
            want, got = LT.expected(LT.lattice(trie, words), scores, weights), LT.expected_uses(trie, words, scores, weights)
            assert np.allclose(got, want, rtol=1e-9, atol=0), (low, cells)
    assert not LT.expected_uses(trie, ["", "zz"], scores, np.ones(2)).any() and not LT.expected_uses(trie, [], scores, np.empty(0)).any()


def test_seeds_count_substrings_once_and_keep_ties_by_piece(spark):
    rng = random.Random(12)
    words = {"▁" + "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))): rng.randint(0, 4) for _ in range(300)}
    types = spark.createDataFrame(list(words.items()), "word string, train_freq long").repartition(5)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    want = Counter()
    for w, n in words.items():
        want.update({p: n * c for p, c in Counter(w[s:e] for s in range(len(w)) for e in range(s + 1, len(w) + 1)).items()})
    want = {p: n for p, n in want.items() if n}
    for k in (7, 60, 10 ** 6):
        several = sorted((p for p in want if len(p) > 1), key=lambda p: (-want[p] * len(p), p))[:k]
        got = {r["piece"]: (r["count"], r["len"]) for r in W.seed_pieces(types.mapInArrow(count, types.schema), k).collect()}
        assert got == {p: (want[p], len(p)) for p in [*several, *(p for p in want if len(p) == 1)]}
    assert seen.value == 3 * len(words)

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glossa.llm import packing as P
from glossa.llm import token_counts as TC
from glossa.llm.tokens import SpacedIds, read_tokenizer

from .helpers import ODD_TEXTS, clashing, empty_docs, odd_docs

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "abcXYZ é ß Σ ς İ ı \n\t\r\x0b\x0c\x1c\x85  ​́'’!?.,-_<>|&1234²½ 日本語 한글 😀👍🏽"


def random_texts(n, seed):
    rng = random.Random(seed)
    extra = ["'s", "'ll", "<|endoftext|>", "<|startoftext|>", "  ", "\n\n", " the", "ing"]
    return ["".join(rng.choice(extra) if rng.random() < 0.15 else rng.choice(ALPHABET) for _ in range(rng.randrange(80)))
            for _ in range(n)]


def test_cached_ids_equal_whole_texts():
    whole, ids = Tokenizer.from_file(WORD_BPE), SpacedIds(read_tokenizer(WORD_BPE))
    for t in random_texts(3000, 1) + [t for _, t in ODD_TEXTS if t]:
        want = whole.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids.encode(t.encode()), "<u4").tolist() == want, t


def test_cached_spans_equal_whole_texts():
    whole = Tokenizer.from_file(BYTE_BPE)
    whole.encode_special_tokens = True
    spans = TC.SpanEncoder(read_tokenizer(BYTE_BPE), public_tokenizers.PATTERN)
    for t in random_texts(3000, 2) + [t for _, t in ODD_TEXTS if t]:
        want = whole.encode(t, add_special_tokens=False).offsets
        assert [tuple(x) for x in spans.spans(t).tolist()] == want, t


def test_a_tokenizer_that_the_pattern_does_not_describe_encodes_whole_texts():
    import json
    spec = read_tokenizer(BYTE_BPE)
    base = json.loads(spec)
    assert not TC.SpanEncoder(spec, public_tokenizers.PATTERN).whole and TC.SpanEncoder(spec, r"\S+|\s+").whole
    byte = base["pre_tokenizer"]
    same = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": public_tokenizers.PATTERN}, "behavior": "Isolated", "invert": False},
                                                  byte | {"use_regex": False}]}
    for change, by_whole in (({"normalizer": {"type": "Replace", "pattern": {"String": "a"}, "content": ""}}, True),
                             ({"pre_tokenizer": byte | {"add_prefix_space": True}}, True), ({"pre_tokenizer": byte | {"use_regex": False}}, True),
                             ({"pre_tokenizer": same}, False)):
        changed = json.dumps(base | change)
        whole, spans = Tokenizer.from_str(changed), TC.SpanEncoder(changed, public_tokenizers.PATTERN)
        whole.encode_special_tokens = True
        assert spans.whole is by_whole
        for t in random_texts(200, 3) + ["", "a  banana's 12 x", "日本 é"]:
            assert [tuple(x) for x in spans.spans(t).tolist()] == whole.encode(t, add_special_tokens=False).offsets, (change, t)


@pytest.mark.parametrize("capacity,n,spread", [(16, 40, 10), (64, 500, 30), (256, 2000, 256), (16, 5, 16)])
def test_plan_holds_the_histogram_and_is_tight(capacity, n, spread):
    rng = random.Random(capacity * n)
    sizes = [rng.randint(1, min(spread, capacity)) for _ in range(n)]
    hist = {k: sizes.count(k) for k in set(sizes)}
    plan = P.plan_sequences(hist, capacity)
    got = {}
    for items, uses in plan:
        assert sum(items) <= capacity and uses > 0
        for i in items:
            got[i] = got.get(i, 0) + uses
    assert got == hist
    used, bound = sum(n for _, n in plan), -(-sum(sizes) // capacity)
    assert used <= bound + 1 + (spread * 2 > capacity) * n // 50


def test_plan_beats_decreasing_fits_where_they_fail():
    """Items of 7, 5 and 4 in 12s: pairing 7 with 5 and 4 with 4 and 4 is best."""
    assert sum(n for _, n in P.plan_sequences({7: 30, 5: 30, 4: 30}, 12)) == 40


def test_configurations_that_do_not_fill_a_sequence_are_kept():
    """A third of a sequence's tokens stay free in each, and no other way needs fewer: plain best fit takes 1100."""
    assert sum(n for _, n in P.plan_sequences({2080: 600, 1100: 600, 1060: 600, 930: 1200}, 4096)) == 900


def fewest(sizes, capacity):
    """Exact, by the sets of pieces that one more sequence can hold."""
    n = len(sizes)
    fill = [sum(sizes[i] for i in range(n) if s >> i & 1) for s in range(1 << n)]
    best = [0] + [n] * ((1 << n) - 1)
    for s in range(1, 1 << n):
        low, rest = s & -s, s & (s - 1)
        part = rest
        while True:
            if fill[part | low] <= capacity:
                best[s] = min(best[s], 1 + best[rest ^ part])
            if not part:
                break
            part = (part - 1) & rest
    return best[-1]


def test_plans_are_within_one_of_the_fewest():
    rng = random.Random(11)
    for _ in range(60):
        capacity = rng.choice([10, 30, 100])
        sizes = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(capacity // 5, capacity // 2) for _ in range(rng.randint(1, 9))]
        used = sum(n for _, n in P.plan_sequences({k: sizes.count(k) for k in set(sizes)}, capacity))
        assert fewest(sizes, capacity) <= used <= fewest(sizes, capacity) + 1, (sizes, capacity)


def test_knapsack_matches_brute_force():
    rng = random.Random(5)
    for _ in range(20):
        lengths = np.array(sorted(rng.sample(range(1, 15), 4)))
        values = np.array([rng.random() for _ in lengths])
        best, take = P.knapsack(lengths, values, 30)
        brute = [0.0] * 31
        for c in range(1, 31):
            brute[c] = max([brute[c - 1]] + [brute[c - k] + v for k, v in zip(lengths.tolist(), values) if k <= c])
        assert np.allclose(best, brute)
        traced = P._traced(take, lengths, 30)
        assert lengths[traced].sum() <= 30 and np.isclose(values[traced].sum(), best[30])


def test_packing_round_trip(spark):
    texts = ODD_TEXTS + [(100 + i, "some words here " * (i % 90)) for i in range(150)]
    docs = clashing(spark.createDataFrame(texts, "doc_id long, text string"), length=5, offset="x", ids="y", pack_rank=1)
    whole = Tokenizer.from_file(WORD_BPE)
    rows = P.pack_documents(docs, WORD_BPE, capacity=256).collect()
    want = []
    for doc, text in texts:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at:at + 256]
            want.append((doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(want, key=key)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in seqs.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    assert len(seqs) <= -(-sum(r.length for r in rows) // 256) + 2


def test_ids_column_and_empty_table(spark):
    r = P.token_pieces(spark.createDataFrame([(1, "hello world")], "doc_id long, text string"), WORD_BPE, with_ids=True).first()
    assert np.frombuffer(r.ids, "<u4").tolist()[-1] == 1 and len(r.ids) == 4 * r.length
    assert P.pack_documents(empty_docs(spark), WORD_BPE).collect() == []
    assert TC.section_tokens(empty_docs(spark), BYTE_BPE, public_tokenizers.PATTERN).collect() == []


def brute_sections(text, rule):
    whole = Tokenizer.from_file(BYTE_BPE)
    whole.encode_special_tokens = True
    owner, n = [], 0
    for ch in text:
        owner.append(n)
        n += ch == "\n"
    counts, cross = [0] * (n + 1), [0] * (n + 1)
    for s, e in whole.encode(text, add_special_tokens=False).offsets:
        own = owner[s:e]
        to = {"first": own[0], "last": own[-1], "most": min(set(own), key=lambda x: (-own.count(x), x))}[rule]
        counts[to] += 1
        cross[to] += own[0] != own[-1]
    return counts, cross


@pytest.mark.parametrize("rule", TC.RULES)
def test_sections_match_brute_force(spark, rule):
    texts = ODD_TEXTS + [(200 + i, t) for i, t in enumerate(random_texts(60, 3))]
    docs = clashing(spark.createDataFrame(texts, "doc_id long, text string"), section=1, start="q")
    got = {}
    for r in TC.section_tokens(docs, BYTE_BPE, public_tokenizers.PATTERN, rule).collect():
        got.setdefault(r.doc_id, []).append(r)
    for doc, text in {k: t for k, t in texts}.items():
        counts, cross = brute_sections(text or "", rule)
        copies = [k for k, _ in texts].count(doc)
        rows = sorted(got[doc], key=lambda r: r.section)
        assert [r.n_tokens for r in rows][::copies] == counts and [r.n_crossing for r in rows][::copies] == cross
        assert "".join((text or "")[r.start:r.end] for r in rows[::copies]) == (text or "")


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        TC.section_tokens(odd_docs(spark), BYTE_BPE, public_tokenizers.PATTERN, "middle")

"""Pre-token type table (D1) and BPE / WordPiece-style merge training.

The unit of work is the *type table*: one row per distinct pre-token with its train and
test-slice frequencies. Text is scanned once to build it (an aggregation with map-side
combine, so a word that is a third of all tokens costs one partial count per task).

Training keeps each type's current segmentation as a padded string, every symbol wrapped
in its own spaces (`` t  h  e ``); pre-tokens never contain whitespace, so the space is a
safe separator. The next merges are guessed on a bounded sample and checked on all types
(``forecast``): a round is one job, in which every type takes up the merges accepted last, then tries the
guess and reports the changes of pair counts. All pairs are counted only when the list of exact counts is
used up. The merges are those of one-at-a-time greedy BPE, ties by (left, right).

Test words carry along, so their encoding at every vocabulary size is the segmentation
at the moment the vocabulary reached that size: a single aggregate per snapshot. Merge
sequences are prefixes of each other, so one sweep at max(V) serves the whole grid.
Lineage is cut with a reliable checkpoint every few rounds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import words
from glossa.operators import forecast as FC
from glossa.session import cut_lineage, ship_package, spread

# Special tokens occupy ids 0-4 and count toward vocab_size.
SPECIAL_TOKENS = ["<unk>", "<pad>", "<s>", "</s>", "<mask>"]
UNK = "<unk>"
CONT = "##"  # WordPiece continuation prefix

# Pairs with exact counts and word types of the sample that the driver holds, and merges that a round may guess.
LISTED_PAIRS = 16384
SAMPLE_TYPES = 300_000
MOST_AHEAD = 1024

SLICES = ["train", "test_all", "test_en", "test_target"]


def type_table(corpus: DataFrame, target_lang: str, text_col: str = "text") -> DataFrame:
    """(word, train_freq, test_all_freq, test_en_freq, test_target_freq) from a corpus with
    ``split`` and ``label`` columns. Newlines are spaces for the trainer; pre-tokens never
    span whitespace, so the text is tokenised as is."""
    return words.type_frequencies(corpus, words.pretokens, target_lang, text_col)


def _chars(col) -> F.Column:
    return F.regexp_extract_all(col, F.lit(r"(?s)."), 0)


def _char_class(chars: Sequence[str]) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in sorted(chars))


def initial_segments(types: DataFrame, alphabet: Sequence[str], wordpiece: bool = False) -> DataFrame:
    """Padded segmentation: each code point its own symbol; characters outside the train
    alphabet become ``<unk>`` (BPE); WordPiece marks non-initial symbols with ``##``."""
    sep = f"  {CONT}" if wordpiece else "  "
    seg = F.concat(F.lit(" "), F.array_join(_chars(F.col("word")), sep), F.lit(" "))
    if alphabet and not wordpiece:
        seg = F.regexp_replace(seg, f" [^ {_char_class(alphabet)}] ", f" {UNK} ")
    return types.withColumn("seg", seg)


def n_symbols(seg) -> F.Column:
    s = F.col(seg) if isinstance(seg, str) else seg
    return ((F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))) / 2).cast("long")


def symbols(seg: str) -> F.Column:
    """array of symbols (splitting at a single space takes the JVM's path without a regex)"""
    return F.split(F.replace(F.trim(F.col(seg)), F.lit("  "), F.lit(" ")), " ")


def symbol_chars(seg) -> F.Column:
    s = F.col(seg) if isinstance(seg, str) else seg
    return F.length(F.replace(s, F.lit(" "), F.lit(""))).cast("long")


def pair_counts(state: DataFrame) -> DataFrame:
    """Adjacent pairs weighted by train frequency: (left, right, count)."""
    act = state.filter((F.col("train_freq") > 0) & (n_symbols("seg") > 1))
    syms = symbols("seg")
    n = F.size(syms)
    pairs = act.select(F.explode(F.arrays_zip(F.slice(syms, 1, n - 1).alias("l"), F.slice(syms, 2, n - 1).alias("r"))).alias("p"), "train_freq")
    return pairs.groupBy(F.col("p.l").alias("left"), F.col("p.r").alias("right")).agg(F.sum("train_freq").alias("count"))


def merged_symbol(left: str, right: str, wordpiece: bool) -> str:
    if wordpiece and right.startswith(CONT):
        return left + right[len(CONT):]
    return left + right


def _state_schema() -> str:
    return "word string, seg string, " + ", ".join(f"{s}_freq long" for s in SLICES)


def _split(seg: str) -> list[str]:
    return seg[1:-1].split("  ")


def apply_merges(state: DataFrame, merges: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Every type's segmentation after the merges, one after the other."""
    merges = list(merges)

    def run(batches):
        steps = FC.step_of(merges)
        for b in batches:
            segs = []
            for seg in b.column(1).to_pylist():
                s = _split(seg)
                after = FC.apply_in_order(s, steps, merges)
                segs.append(seg if after is s else f" {'  '.join(after)} ")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(segs, pa.string()), *b.columns[2:]], b.schema.names)

    return state.mapInArrow(run, _state_schema())


def count_changes(state: DataFrame, guess: list[tuple[str, str, str]], counts: FC.Counts) -> dict[int, list[tuple[tuple[str, str], int]]]:
    """By step of the guess: changes of the counts of listed pairs, and of pairs with a string that the guess makes."""
    listed = state.sparkSession.sparkContext.broadcast(frozenset(counts.count))  # a bounded list

    def run(batches):
        steps, total = FC.step_of(guess), [defaultdict(int) for _ in guess]
        for b in batches:
            for seg, freq in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if freq:
                    FC.apply_in_order(_split(seg), steps, guess, total, freq)
        made = {m for _, _, m in guess}  # of other pairs off the list, which only lose, changes don't matter
        rows = [(*p, step, d) for step, changes in enumerate(total) for p, d in changes.items() if d and (p in listed.value or not made.isdisjoint(p))]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())],
                                         ["l", "r", "step", "d"])

    # at most four pairs for each step and symbol
    rows = state.mapInArrow(run, "l string, r string, step int, d long").groupBy("l", "r", "step").agg(F.sum("d").alias("d")).filter("d <> 0").toArrow()
    listed.unpersist()
    out: dict[int, list] = defaultdict(list)
    for l, r, step, d in zip(*(c.to_pylist() for c in rows.columns)):
        out[step].append(((l, r), d))
    return out


@dataclass
class MergeTraining:
    method: str
    alphabet: list[str]
    merges: list[tuple[int, str, str, str, int]] = field(default_factory=list)  # rank, left, right, merged, count
    vocab: list[str] = field(default_factory=list)
    rounds: int = 0
    recounts: int = 0
    cuts: dict[int, tuple[int, int]] = field(default_factory=dict)  # vocab_size -> (vocabulary rows, merges)
    snapshots: dict[int, DataFrame] = field(default_factory=dict)  # vocab_size -> slice token sums (1 row)
    states: dict[int, DataFrame] = field(default_factory=dict)  # vocab_size -> type table with seg


def slice_sums(state: DataFrame) -> DataFrame:
    """Token and token-character totals per slice for the current segmentation."""
    nt, nc = n_symbols("seg"), symbol_chars("seg")
    aggs = []
    for s in SLICES:
        f = F.col(f"{s}_freq")
        aggs += [F.sum(f * nt).alias(f"tokens_{s}"), F.sum(f * nc).alias(f"token_chars_{s}")]
    return state.agg(*aggs)


def train_merges(types: DataFrame, vocab_sizes: Sequence[int], method: str = "bpe", min_frequency: int = 2, top_n: int = LISTED_PAIRS,
                 sample_types: int = SAMPLE_TYPES, checkpoint_every: int = 12, keep_states: bool = False) -> MergeTraining:
    """D2 (``bpe``) / D3 (``wordpiece``) training over a type table, snapshotting every requested vocabulary size in one sweep.

    The driver holds ``top_n`` pairs and ``sample_types`` types; neither changes the result."""
    wordpiece = method == "wordpiece"
    spark = types.sparkSession
    ship_package(spark)
    train_words = types.filter(F.col("train_freq") > 0)
    alphabet = sorted(r[0] for r in train_words.select(F.explode(_chars(F.col("word"))).alias("c")).distinct().collect())
    if not alphabet:
        raise ValueError("cannot train a tokenizer: the training sample is empty")
    base = types if not wordpiece else train_words
    state = spread(initial_segments(base, alphabet, wordpiece).select("word", "seg", *[f"{s}_freq" for s in SLICES]))
    if wordpiece:
        first = train_words.select(F.substring("word", 1, 1).alias("s"))
        rest = train_words.filter(F.length("word") > 1).select(
            F.explode(F.slice(_chars(F.col("word")), 2, F.length("word") - 1)).alias("c")).select(
            F.concat(F.lit(CONT), F.col("c")).alias("s"))
        init_symbols = sorted(r[0] for r in first.unionByName(rest).distinct().collect())
    else:
        init_symbols = alphabet
    vocab = list(SPECIAL_TOKENS) + [s for s in init_symbols if s not in SPECIAL_TOKENS]
    vocab_set = set(vocab)
    res = MergeTraining(method=method, alphabet=alphabet, vocab=vocab)
    state = cut_lineage(state).persist(StorageLevel.MEMORY_AND_DISK)
    held = [state]
    sample = FC.Forecast((_split(r["seg"]), r["train_freq"]) for r in state.filter("train_freq > 0").orderBy(
        F.desc("train_freq"), "word").limit(sample_types).select("seg", "train_freq").toArrow().to_pylist())
    counts, done, ahead = None, False, 32
    for target in sorted(set(int(v) for v in vocab_sizes)):
        while not done and len(vocab) < target:
            if counts is None or counts.best() is None:
                listed = pair_counts(state).orderBy(F.desc("count"), "left", "right").limit(top_n + 1).toArrow().to_pylist()
                floor = (-listed[top_n]["count"], listed[top_n]["left"], listed[top_n]["right"]) if len(listed) > top_n else None
                counts = FC.Counts({(r["left"], r["right"]): r["count"] for r in listed[:top_n]}, floor)
                res.recounts += 1
            best = counts.best()
            if best is None or best[0] < min_frequency:  # None: the first pair off the list ties with the best one, which has its key
                done = True
                break
            guess = sample.guess(counts, ahead, target - len(vocab), vocab_set, min_frequency, lambda l, r: merged_symbol(l, r, wordpiece))
            taken = FC.accepted(counts, guess, count_changes(state, guess, counts), min_frequency)
            ahead = min(MOST_AHEAD, max(32, 2 * len(taken)))
            for (l, r, m), c in taken:
                res.merges.append((len(res.merges) + 1, l, r, m, c))
                if m in vocab_set:
                    counts = None  # pairs off the list may have grown
                else:
                    vocab_set.add(m)
                    vocab.append(m)
            merges = [m for m, _ in taken]
            sample.apply(merges)
            res.rounds += 1
            state = apply_merges(state, merges)
            if res.rounds % checkpoint_every == 0:
                state = cut_lineage(state)
            state = state.persist(StorageLevel.MEMORY_AND_DISK)  # filled by the next round's job
            held.append(state)
            while len(held) > 2:
                held.pop(0).unpersist()
        state = cut_lineage(state)
        res.cuts[target] = (len(vocab), len(res.merges))
        res.snapshots[target] = spark.createDataFrame(slice_sums(state).collect(), slice_sums(state).schema)
        if keep_states:
            res.states[target] = state
    for old in held:
        old.unpersist()
    res.vocab = vocab
    return res


def merges_frame(spark, tr: MergeTraining, n: int | None = None) -> DataFrame:
    return spark.createDataFrame(tr.merges if n is None else tr.merges[:n], "rank int, left string, right string, merged string, count long")


def vocab_frame(spark, tr: MergeTraining, vocab_size: int | None = None) -> DataFrame:
    """Ids 0-4 special tokens, then the alphabet, then merged strings in merge order."""
    v = tr.vocab if vocab_size is None else tr.vocab[:vocab_size]
    return spark.createDataFrame(list(enumerate(v)), "id int, piece string")

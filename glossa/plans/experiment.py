"""One experiment run (the reference's single-run entry) as a Spark job graph.

corpus -> clean (B8, written once) -> size guard (C8) -> split (C3 stratified or C1 random +
C2/C5 labels) -> type tables (D1) -> one training sweep per method over all vocab sizes
(D2/D3/D4/D7) -> saved tokenizers (A15) -> compression metrics (E1-E5) -> optional n-gram LM
per cell (F) -> result table (G1), error table (G5), best rows (G2), status (G4). A failing
cell becomes an error row and stops no other, as in the reference's per-cell try/except.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from glossa.functions import text as T
from glossa.functions import words
from glossa.operators import bpe as BPE
from glossa.operators import encoders as E
from glossa.operators import gram_blocks as GB
from glossa.operators import metrics as M
from glossa.operators import ngram_lm as LM
from glossa.operators import rollup as G
from glossa.operators import sampling as S
from glossa.operators import subword as W
from glossa.session import cut_lineage, local_frame
from glossa.sources.io import save_tokenizer, trainer_lines

METHODS = ("bpe", "wordpiece", "unigram", "word", "char")
# Vocabulary sizes offered (D9), the default grid and the split strategies.
VOCAB_SIZES_OFFERED = [500, 1000, 2000, 4000, 8000, 16000, 32000, 64000]
DEFAULT_VOCAB_SIZES = VOCAB_SIZES_OFFERED[1:3]
SPLIT_STRATEGIES = ("random", "stratified_by_language")


@dataclass
class ExperimentParams:
    language: str
    tokenizer_methods: list[str] = field(default_factory=lambda: ["bpe", "wordpiece"])
    vocab_sizes: list[int] = field(default_factory=lambda: list(DEFAULT_VOCAB_SIZES))
    test_fraction: float = 0.1
    seed: int = 42
    split_strategy: str = "stratified_by_language"
    min_texts: int = 10
    run_language_model: bool = False
    block_size: int = 128
    lm_order: int = 3

    def problems(self) -> list[str]:
        """What is wrong with the parameters; empty when a run may start."""
        out = []
        if not (self.language or "").strip():
            out.append("no language")
        if not self.tokenizer_methods:
            out.append("no tokenizer method")
        if not self.vocab_sizes:
            out.append("no vocabulary size")
        out += [f"vocabulary size must be positive: {v}" for v in self.vocab_sizes if int(v) <= 0]
        if not 0 < self.test_fraction < 0.9:
            out.append("test_fraction must be between 0 and 0.9")
        if self.split_strategy not in SPLIT_STRATEGIES:
            out.append(f"unknown split strategy: {self.split_strategy}")
        if self.min_texts < 2:
            out.append("min_texts must be at least 2")
        if self.run_language_model and self.block_size <= 1:
            out.append("block_size must be above 1")
        out += [f"unknown tokenizer method: {m}" for m in self.tokenizer_methods if m not in METHODS]
        return out

    def validate(self) -> None:
        if bad := self.problems():
            raise ValueError("; ".join(bad))


@dataclass
class ExperimentResult:
    results: DataFrame
    errors: DataFrame
    split_stats: DataFrame
    best: DataFrame
    status: str


def prepare(paragraphs: DataFrame, p: ExperimentParams, detected: str = "lang") -> DataFrame:
    """Clean with the run language and label, written once, as the split reads its rows several times; split, written once (read by every
    later step)."""
    from glossa.sources.corpus import clean_corpus
    c = clean_corpus(paragraphs, F.lit(p.language))
    c = cut_lineage(c.withColumn("label", T.language_label(F.col("text"), p.language, F.col(detected))))
    if p.split_strategy == "stratified_by_language":
        s = S.stratified_split(c, ["doc_id", "pos"], "label", p.test_fraction, p.seed)
    else:
        s = S.random_split(c, ["doc_id", "pos"], p.test_fraction, p.seed)
    return cut_lineage(s)


LM_FIELDS = M.LM_COLUMNS
SUM_COLUMNS = ["method", "vocab_size"] + [f"{k}_test_{s}" for s in ("all", "en", "target") for k in ("tokens", "token_chars")]


@dataclass
class Cell:
    """A trained (method, vocabulary size): its slice token totals, its encoder and its tables."""
    sums: DataFrame
    encode: object
    vocab: DataFrame
    merges: DataFrame | None = None


def train_cells(method: str, types: DataFrame, utypes: DataFrame | None, sizes: list[int]):
    """Yield (size, Cell or Exception). One sweep serves all sizes of a merge method; a size that can't be trained
    fails alone."""
    spark = types.sparkSession
    sizes = sorted({int(v) for v in sizes})

    def row(sums: DataFrame, v: int) -> DataFrame:
        return sums.select(F.lit(method).alias("method"), F.lit(v).alias("vocab_size"), *[F.col(c).cast("long").alias(c) for c in SUM_COLUMNS[2:]])

    if method in ("word", "char"):
        units = cut_lineage(M.unit_table(types, method))
        ranked = cut_lineage(M.ranked_units(units, sizes[-1]))
        sums = cut_lineage(M.unit_sums(units, ranked, sizes, method))
        for v in sizes:
            mine = ranked.filter(F.col("rk") <= v - len(BPE.SPECIAL_TOKENS))
            known = frozenset(r["unit"] for r in mine.select("unit").collect())  # bounded by v
            table = mine.select((F.col("rk") + len(BPE.SPECIAL_TOKENS) - 1).alias("id"), F.col("unit").alias("piece"))
            yield v, Cell(row(sums.filter(F.col("vocab_size") == v), v), E.Lexical(method, known), table)
    elif method in ("bpe", "wordpiece"):
        tr = BPE.train_merges(types, sizes, method)
        for v in sizes:
            rows, merges = tr.cuts[v]
            vocab = tr.vocab[:rows]
            if method == "bpe":
                sums, encode = tr.snapshots[v], E.Merges([m[1:4] for m in tr.merges[:merges]], frozenset(tr.alphabet))
            else:
                sums, encode = W.wordpiece_sums(types, vocab), E.WordPiece(vocab)
            yield v, Cell(row(sums, v), encode, BPE.vocab_frame(spark, tr, rows), BPE.merges_frame(spark, tr, merges))
    else:
        for v, pieces in sorted(W.train_unigram_grid(utypes, sizes).items()):
            if isinstance(pieces, Exception):
                yield v, pieces  # this size's error, the others do
                continue
            table = spark.createDataFrame([(i, p, float(s)) for i, (p, s) in enumerate(pieces, len(BPE.SPECIAL_TOKENS))], "id int, piece string, score double")
            yield v, Cell(row(W.unigram_sums(utypes, pieces), v), E.Unigram(pieces), table)


def _marked(text: str) -> list[str]:
    return [W.META + w for w in words.spaced(text)]


@dataclass
class CellTexts:
    """What a cell's LM reads: the run's split and the cell's encoder."""
    split: DataFrame
    method: str
    encode: object


def _by_words(cells: dict[str, CellTexts]) -> dict:
    """By the way words are found: the cells that take them. An encoder takes pre-tokens, or white-space words with the marker."""
    together: dict = {}
    for name, cell in cells.items():
        together.setdefault(_marked if cell.method == "unigram" else words.pretokens, {})[name] = cell
    return together


def cell_grams(cells: dict[str, CellTexts], p: ExperimentParams, numbered: bool = False) -> DataFrame:
    """The LM's input: the grams of each cell's own tokens, or with ``numbered`` of their numbers, of every text of the run. Cells that take the
    same words read the texts together."""
    return reduce(DataFrame.unionByName, [LM.gram_counts(next(iter(some.values())).split, "text", p.block_size, p.lm_order, words_of=words_of,
                                                         encoders={name: cell.encode for name, cell in some.items()}, numbered=numbered)
                                          for words_of, some in _by_words(cells).items()])


def cell_blocks(cells: dict[str, CellTexts], p: ExperimentParams, n_buckets: int) -> DataFrame:
    """As ``cell_grams``, in compressed blocks."""
    return reduce(DataFrame.unionByName, [GB.sent_grams(next(iter(some.values())).split, "text", p.block_size, p.lm_order, p.language, n_buckets, words_of,
                                                        {name: cell.encode for name, cell in some.items()})
                                          for words_of, some in _by_words(cells).items()])


def _records(frames: dict[str, object], job) -> tuple[dict[str, object], dict[str, str]]:
    """A result for each cell from one job over all of them, ``job(frames)``; where that fails, cell by cell, so that a failing cell
    stops no other."""
    try:
        return job(frames), {}
    except Exception as e:  # noqa: BLE001
        if len(frames) == 1:
            return {}, {next(iter(frames)): repr(e)}
    found, failed = {}, {}
    for cell, frame in frames.items():
        ok, bad = _records({cell: frame}, job)
        found.update(ok)
        failed.update(bad)
    return found, failed


def lm_records(frames: dict[str, CellTexts], p: ExperimentParams) -> dict[str, object]:
    """F on each cell's grams: one model a cell, all in the same jobs. A cell without a block on a side raises where it is alone."""
    spark = next(iter(frames.values())).split.sparkSession
    n = GB.buckets(spark)
    rec, missing = GB.lm_records(spark, GB.lm_losses(GB.kept_grams(cell_blocks(frames, p, n), p.lm_order, n), p.lm_order))
    found = {r["cell"]: r for r in rec.collect()}  # a row a cell
    lacking = dict(missing) | {c: "train" for c in frames if c not in found}
    if lacking:
        raise ValueError(LM.no_block(next(iter(lacking.values()))))
    return found


def run_experiment(spark: SparkSession, paragraphs: DataFrame, p: ExperimentParams, tokenizers_dir: str | None = None,
                   run_id: str = "run", detected: str = "lang", lines_dir: str | None = None) -> ExperimentResult:
    """``detected`` names the column with the classifier's language of each text (B12). With ``tokenizers_dir`` every
    result row's tokenizer is saved there; with ``lines_dir`` the train side, a fragment a line (A14)."""
    p.validate()
    split = prepare(paragraphs, p, detected)
    stats = cut_lineage(S.split_stats(split, "label"))  # one row
    n_clean = stats.select("total_texts").first()[0]
    if n_clean < p.min_texts:
        raise RuntimeError(f"not enough text fragments after cleaning: {n_clean}; minimum {p.min_texts}")
    if lines_dir:
        trainer_lines(split.filter(F.col("split") == "train")).write.text(lines_dir)
    types = cut_lineage(BPE.type_table(split, p.language))
    utypes = cut_lineage(W.unigram_type_table(split, p.language)) if "unigram" in p.tokenizer_methods else None
    text_stats = cut_lineage(M.text_stats(split, p.language))
    sums, tokens, errors = {}, {}, {}
    cells = [f"{m}/vocab_{v}" for m in p.tokenizer_methods for v in sorted({int(v) for v in p.vocab_sizes})]

    saving = Lock()

    def train(method):
        left = sorted({int(v) for v in p.vocab_sizes})
        try:
            for v, cell in train_cells(method, types, utypes, left[:]):
                left.remove(v)
                name = f"{method}/vocab_{v}"
                try:
                    if isinstance(cell, Exception):
                        raise cell
                    if tokenizers_dir:
                        with saving:  # one writer of a folder at a time
                            save_tokenizer(cell.vocab, cell.merges, tokenizers_dir, run_id, method, v)
                    if p.run_language_model:
                        tokens[name] = CellTexts(split, method, cell.encode)
                    sums[name] = cell.sums
                except Exception as e:  # noqa: BLE001 - a failing cell is recorded, the grid goes on
                    errors[name] = repr(e)
        except Exception as e:  # noqa: BLE001 - the sweep of this method failed: its remaining cells did
            errors.update({f"{method}/vocab_{v}": repr(e) for v in left})

    with ThreadPoolExecutor(max(1, len(p.tokenizer_methods))) as pool:  # methods share the cluster; each has its own cells
        list(pool.map(inheritable_thread_target(spark)(train), p.tokenizer_methods))
    schema = M.result_rows(text_stats, spark.createDataFrame([], ", ".join(
        f"{c} {'string' if c == 'method' else 'int' if c == 'vocab_size' else 'long'}" for c in SUM_COLUMNS))).schema

    def metric_rows(frames):
        made = M.result_rows(text_stats, reduce(DataFrame.unionByName, frames.values()))
        return {f"{r['method']}/vocab_{r['vocab_size']}": r for r in made.collect()}  # a row a cell

    found, failed = _records(sums, metric_rows) if sums else ({}, {})
    errors |= failed
    if p.run_language_model and found:
        models, failed = _records({c: t for c, t in tokens.items() if c in found}, lambda frames: lm_records(frames, p))
        errors |= failed
        schema = StructType([*schema.fields, *[StructField(c, IntegerType() if c.endswith("_blocks") else DoubleType()) for c in LM_FIELDS]])
        found = {c: (*found[c], *[models[c][f] for f in LM_FIELDS]) for c in found if c in models}
    rows = [found[c] for c in cells if c in found]
    errors = [(c, errors[c]) for c in cells if c in errors]
    err_df = local_frame(spark, errors, "stage string, error string")
    status = "completed" if rows and not errors else ("partially_completed" if rows else "failed")
    if not rows:
        empty = spark.createDataFrame([], "method string, vocab_size int")
        return ExperimentResult(empty, err_df, stats, empty, status)
    table = local_frame(spark, rows, schema)  # one row per cell of the grid
    table = G.result_table(table, p.run_language_model)
    return ExperimentResult(table, err_df, stats, G.best_rows(table), status)

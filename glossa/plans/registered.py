"""Registered Spark queries: one per SURVEY §2 operator family, each over whole tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column names
equal the matching oracle SQL in ``glossa.plans.oracle``. Branches the test tables never
reach (Cyrillic, CJK, escapes, markers, mojibake) are covered by derived input: a literal
is attached to each paragraph chosen by ``(doc_id + pos) % 9``, the same in both engines.
Every row is still processed.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import sampling as S
from glossa.sources import corpus as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

TARGET = "de"
TEST_FRACTION = 0.1
SEED = 42

# Fixed derived-input literals (attached by (doc_id + pos) % 9; slot 8 leaves the text as is).
INJECT_PREFIX = {0: "_START_ARTICLE_", 1: "\\xe9", 4: "Привет ", 5: "日本の、", 6: "한국어! ",
                 7: "&amp; “quoted” ﬁne ＡＢＣ cafÃ© "}
INJECT_SUFFIX = {2: " a\\nb", 3: " x�"}
# Clean language per document: (doc_id % 4) -> ja, ko, zh-cn, own language.
CLEAN_LANGS = {0: "ja", 1: "ko", 2: "zh-cn"}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def inject(text: Column, doc_id: Column, pos: Column) -> Column:
    slot = (doc_id + pos) % 9
    out = text
    for k, v in INJECT_PREFIX.items():
        out = F.when(slot == k, F.concat(F.lit(v), text)).otherwise(out)
    for k, v in INJECT_SUFFIX.items():
        out = F.when(slot == k, F.concat(text, F.lit(v))).otherwise(out)
    return out


def clean_lang(doc_id: Column, lang: Column) -> Column:
    out = lang
    for k, v in CLEAN_LANGS.items():
        out = F.when(doc_id % 4 == k, F.lit(v)).otherwise(out)
    return out


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison with the oracle; stored results are full doubles."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def paragraphs(spark, d) -> DataFrame:
    return C.paragraph_scan(C.documents(spark, d))


def cleaned(spark, d) -> DataFrame:
    """Cleaned corpus (doc_id, lang, pos, text) with each document's own language, written
    once to the checkpoint folder: every later step reads it more than once."""
    from glossa.session import cut_lineage
    return cut_lineage(C.clean_corpus(paragraphs(spark, d)))


def labels(spark, d) -> DataFrame:
    """Cleaned corpus + B11 label for target ``de``; ``documents.lang`` stands in for B12."""
    c = C.clean_corpus(paragraphs(spark, d))
    return c.withColumn("label", T.language_label(F.col("text"), TARGET, F.col("lang")))


def labelled(spark, d) -> DataFrame:
    """``labels``, written once."""
    from glossa.session import cut_lineage
    return cut_lineage(labels(spark, d))


# --------------------------------------------------------------------- A: scans
@register("paragraph_scan")
def q_paragraph_scan(spark, d):
    return paragraphs(spark, d).select("doc_id", "lang", "pos", "text")


@register("field_fallback")
def q_field_fallback(spark, d):
    docs = C.documents(spark, d)
    # derived record shapes: text blank on some rows, content/article filled on others
    m = F.col("doc_id") % 3
    rec = docs.select("doc_id",
                      F.when(m == 0, F.lit("   ")).otherwise(F.col("text")).alias("text"),
                      F.when(m == 0, F.col("text")).when(m == 1, F.lit(" ")).alias("content"),
                      F.concat(F.lit("article "), F.col("lang")).alias("article"))
    return rec.select("doc_id", C.field_fallback(rec).alias("picked"))


@register("clean_paragraphs")
def q_clean_paragraphs(spark, d):
    p = paragraphs(spark, d)
    p = p.withColumn("text", inject(F.col("text"), F.col("doc_id"), F.col("pos")))
    c = C.clean_corpus(p, clean_lang(F.col("doc_id"), F.col("lang")))
    return c.select("doc_id", "pos", "lang", "text")


@register("corpus_stats")
def q_corpus_stats(spark, d):
    from glossa.functions import words
    c = words.with_word_counts(C.clean_corpus(paragraphs(spark, d)), ["lang"])
    g = c.groupBy("lang").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n_chars").alias("n_chars"), F.sum("n_words").alias("n_words"))
    return g.withColumn("chars_per_word", F.round(F.try_divide(F.col("n_chars").cast("double"), F.col("n_words")), 6))


@register("force_decode")
def q_force_decode(spark, d):
    p = paragraphs(spark, d)
    slot = (F.col("doc_id") + F.col("pos")) % 3
    raw = (F.when(slot == 0, F.concat(F.lit("b'"), F.col("text"), F.lit(" caf\\xc3\\xa9 50% a+b\\n'")))
            .when(slot == 1, F.concat(F.lit("b'"), F.col("text"), F.lit(" \\xzz'")))
            .otherwise(F.col("text")))
    return p.select("doc_id", "pos", T.force_decode(raw).alias("text"))


@register("repair_text")
def q_repair_text(spark, d):
    p = paragraphs(spark, d)
    slot = (F.col("doc_id") + F.col("pos")) % 4
    raw = (F.when(slot == 0, F.concat(F.lit("cafÃ© â€œokâ€\x9d "), F.col("text")))
            .when(slot == 1, F.concat(F.lit("&lt;b&gt; &amp; ﬂow ＦＵＬＬ　‘x’ "), F.col("text"), F.lit("\r\nz\x07")))
            .when(slot == 2, F.concat(F.lit("<p>&amp;</p> "), F.col("text")))
            .otherwise(F.col("text")))
    return T.repair_text_frame(p.select("doc_id", "pos", raw.alias("text")), "text")


@register("script_tags")
def q_script_tags(spark, d):
    p = paragraphs(spark, d)
    t = inject(F.col("text"), F.col("doc_id"), F.col("pos"))
    return (p.select(T.script_tag(t).alias("script"))
             .groupBy("script").agg(F.count(F.lit(1)).alias("n_texts")))


@register("language_label")
def q_language_label(spark, d):
    p = paragraphs(spark, d)
    t = inject(F.col("text"), F.col("doc_id"), F.col("pos"))
    # a label follows from the text's script and the detected language: texts are looked at once, for all targets
    p = p.select(F.explode(F.array(t)).alias("text"), "lang")  # made once
    seen = p.select(T.script_tag("text").alias("tag"), "lang").groupBy("tag", "lang").agg(F.count(F.lit(1)).alias("n"))
    targets = F.array(*[F.struct(F.lit(tgt).alias("target_lang"), T.label_of_script(F.col("tag"), tgt, F.col("lang")).alias("label"))
                        for tgt in ["de", "ru", "ja", "zh-cn", "ko"]])
    return seen.select(F.explode(targets).alias("t"), "n").groupBy("t.target_lang", "t.label").agg(F.sum("n").alias("n_texts"))


# --------------------------------------------------------------- B13-B18: names
@register("language_groups")
def q_language_groups(spark, d):
    docs = C.documents(spark, d)
    lang = clean_lang(F.col("doc_id"), F.col("lang"))
    return (docs.select(lang.alias("lang"), T.language_group(lang).alias("group"))
                .groupBy("lang", "group").agg(F.count(F.lit(1)).alias("n_docs")))


def read_docs_with_source(spark, d):
    return C.read_table(spark, d, "documents").select("doc_id", "lang", "source")


@register("mixture_name_parse")
def q_mixture_name_parse(spark, d):
    docs = read_docs_with_source(spark, d)
    ratios = list(T.RATIOS_UNDERREPRESENTED) + list(T.RATIOS_TOKENIZER_TRAINING)
    r = F.element_at(F.array(*[F.lit(x) for x in ratios]), (F.col("doc_id") % len(ratios) + 1).cast("int"))
    lang = clean_lang(F.col("doc_id"), F.col("lang"))
    name = (F.when(F.col("doc_id") % 5 == 4, F.concat(F.lit("corpus_"), F.col("source"), F.lit(".txt")))
             .otherwise(F.concat(F.lit("data/mixtures/mix_"), T.language_group(lang), F.lit("_"), lang,
                                 F.lit("_"), r, F.lit(".txt"))))
    p = T.parse_mixture_name(name)
    return docs.select("doc_id", p["group"].alias("group"), p["target_lang"].alias("target_lang"),
                       p["ratio"].alias("ratio"), T.ratio_target_percent(p["ratio"]).alias("target_percent"))


@register("ratio_presets")
def q_ratio_presets(spark, d):
    """Presets as a table; 'both' = union with later keys winning. Counted against the
    documents each ratio would be assigned to (doc_id modulo the preset size)."""
    rows = []
    for preset, table in [("underrepresented", T.RATIOS_UNDERREPRESENTED), ("training", T.RATIOS_TOKENIZER_TRAINING)]:
        for r, (e, t) in table.items():
            rows.append((preset, r, e, t))
    both = {**T.RATIOS_UNDERREPRESENTED, **T.RATIOS_TOKENIZER_TRAINING}
    rows += [("both", r, e, t) for r, (e, t) in both.items()]
    presets = spark.createDataFrame(rows, "preset string, ratio string, english_percent double, target_percent double")
    docs = C.documents(spark, d)
    per = []
    for preset in ["underrepresented", "training", "both"]:
        names = [r[1] for r in rows if r[0] == preset]
        pick = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("doc_id") % len(names) + 1).cast("int"))
        per.append(docs.select(F.lit(preset).alias("preset"), pick.alias("ratio")))
    counts = per[0].unionByName(per[1]).unionByName(per[2]).groupBy("preset", "ratio").agg(
        F.count(F.lit(1)).alias("n_docs"))
    return presets.join(counts, ["preset", "ratio"], "left").fillna(0, ["n_docs"])


# -------------------------------------------------------------- C: splits, mixes
@register("random_split")
def q_random_split(spark, d):
    s = S.random_split(cleaned(spark, d), ["doc_id", "pos"], TEST_FRACTION, SEED)
    return s.select("doc_id", "pos", "split")


@register("stratified_split")
def q_stratified_split(spark, d):
    s = S.stratified_split(labelled(spark, d), ["doc_id", "pos"], "label", TEST_FRACTION, SEED)
    return s.select("doc_id", "pos", "label", "split")


@register("split_stats")
def q_split_stats(spark, d):
    s = S.stratified_split(labelled(spark, d), ["doc_id", "pos"], "label", TEST_FRACTION, SEED)
    return S.split_stats(s, "label")


@register("random_split_slices")
def q_random_split_slices(spark, d):
    s = S.random_split(cleaned(spark, d), ["doc_id", "pos"], TEST_FRACTION, SEED)
    s = s.withColumn("label", T.language_label(F.col("text"), TARGET, F.col("lang")))
    return s.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_texts"))


@register("language_sample_head")
def q_language_sample_head(spark, d):
    smp = C.language_samples(cleaned(spark, d), sample_size=100)
    return smp.select("lang", "doc_id", "pos", "lang_ok")


@register("quota_load")
def q_quota_load(spark, d):
    docs = C.documents(spark, d)
    return C.quota_load(docs, max_samples=50).select("lang", "doc_id", "text")


@register("load_manifest")
def q_load_manifest(spark, d):
    _, m = C.load_languages(spark, C.documents(spark, d), ["en", "de", "fr", "es", "ru", "ja"], max_samples=50)
    # the times differ from run to run
    timed = (F.length("started_at") == 19) & (F.col("finished_at") >= F.col("started_at"))
    return m.withColumn("timed", timed).drop("started_at", "finished_at")


def _mixtures(spark, d):
    from glossa.session import cut_lineage
    smp = cut_lineage(C.language_samples(cleaned(spark, d), sample_size=300))
    ratios = {**T.RATIOS_UNDERREPRESENTED, **T.RATIOS_TOKENIZER_TRAINING}
    return S.mixture_grid(smp, ["de", "fr", "es", "ru"], ratios, sample_size=300, seed=SEED)


@register("mixture_draw")
def q_mixture_draw(spark, d):
    mix, _ = _mixtures(spark, d)
    return mix.select("target_lang", "ratio", "lang", "doc_id", "pos", "order_key")


@register("mixture_manifest")
def q_mixture_manifest(spark, d):
    _, man = _mixtures(spark, d)
    return man


@register("corpus_preview")
def q_corpus_preview(spark, d):
    """Raw / cleaned / train / test counts in one aggregate, plus the first 5 cleaned texts."""
    raw = paragraphs(spark, d).agg(F.count(F.lit(1)).alias("raw_texts"))
    c = cleaned(spark, d)
    s = S.random_split(c, ["doc_id", "pos"], TEST_FRACTION, SEED)
    cnt = s.agg(F.count(F.lit(1)).alias("cleaned_texts"), F.count_if(F.col("split") == "train").alias("train_texts"),
                F.count_if(F.col("split") == "test").alias("test_texts"))
    first5 = c.orderBy("doc_id", "pos").limit(5)  # the preview itself is a top-5
    one = F.lit(1).alias("_one")
    return (first5.select("doc_id", "pos", "text", one)
                  .join(raw.select("*", one), "_one").join(cnt.select("*", one), "_one").drop("_one"))


@register("missing_sources")
def q_missing_sources(spark, d):
    """A language has a source if it has a document, whatever cleaning leaves of it: the text is not read."""
    return C.missing_sources(spark, C.read_table(spark, d, "documents"), ["en", "de", "fr", "es", "ru", "ja", "zh-cn"])


# ------------------------------------------------------- D/E: tokenizers, metrics
from glossa.operators import bpe as BPE  # noqa: E402
from glossa.operators import metrics as M  # noqa: E402

GRID_SIZES = [100, 1000]
BPE_SIZES = [150, 300]


def split_corpus(spark, d) -> DataFrame:
    """Labelled corpus with the stratified split (the run's test/train sides)."""
    from glossa.session import cut_lineage
    return cut_lineage(S.stratified_split(labelled(spark, d), ["doc_id", "pos"], "label", TEST_FRACTION, SEED))


@contextmanager
def split_texts(spark, d):
    """As ``split_corpus`` (doc_id, pos, label, text, split), for one reader within the block: texts are written once, compressed."""
    from glossa.session import written
    with written(labels(spark, d).select("doc_id", "pos", "label", "text")) as texts:
        yield S.stratified_split(texts, ["doc_id", "pos"], "label", TEST_FRACTION, SEED)


@register("pretoken_types")
def q_pretoken_types(spark, d):
    return BPE.type_table(split_corpus(spark, d), TARGET)


@register("compression_grid")
def q_compression_grid(spark, d):
    from glossa.session import cut_lineage
    sc = split_corpus(spark, d)
    types = cut_lineage(BPE.type_table(sc, TARGET))
    sums = M.lexical_token_sums(types, GRID_SIZES, "word").unionByName(M.lexical_token_sums(types, GRID_SIZES, "char"))
    return rounded(M.result_rows(M.text_stats(sc, TARGET), sums))


def _bpe(spark, d, method="bpe", sizes=BPE_SIZES):
    from glossa.session import cut_lineage
    sc = split_corpus(spark, d)
    types = cut_lineage(BPE.type_table(sc, TARGET))
    tr = BPE.train_merges(types, sizes, method)
    return sc, types, tr


@register("bpe_merges")
def q_bpe_merges(spark, d):
    _, _, tr = _bpe(spark, d)
    return BPE.merges_frame(spark, tr)


@register("bpe_vocab")
def q_bpe_vocab(spark, d):
    _, _, tr = _bpe(spark, d)
    return BPE.vocab_frame(spark, tr)


@register("compression_by_language")
def q_compression_by_language(spark, d):
    sc, _, tr = _bpe(spark, d)
    sums = None
    for v, snap in tr.snapshots.items():
        row = snap.select(F.lit("bpe").alias("method"), F.lit(v).alias("vocab_size"), "*")
        sums = row if sums is None else sums.unionByName(row)
    return rounded(M.result_rows(M.text_stats(sc, TARGET), sums))


# ------------------------------------------------------------ F: n-gram LM
from glossa.operators import ngram_lm as LM  # noqa: E402

LM_BLOCK = 128
LM_ORDER = 3


@register("lm_blocks")
def q_lm_blocks(spark, d):
    """F1 over word tokens (pre-tokens) of the stratified split."""
    from glossa.functions import words
    sc = split_corpus(spark, d).select("doc_id", "pos", "split", "text")
    b = LM.blocks(words.with_pretokens(sc, ["doc_id", "pos", "split"], "ids"), "ids", LM_BLOCK)
    return b.select("doc_id", "pos", "split", "block_no", F.size("block").alias("n_ids"),
                    F.array_join("block", " ").alias("block_text"))


@register("ngram_lm_eval")
def q_ngram_lm_eval(spark, d):
    """F1-F5 over word tokens (pre-tokens) of the stratified split."""
    from glossa.functions import words
    from glossa.operators import gram_blocks as GB
    n = GB.buckets(spark)
    with split_texts(spark, d) as split:
        kept = GB.kept_grams(GB.sent_grams(split, "text", LM_BLOCK, LM_ORDER, TARGET, n, words.pretokens), LM_ORDER, n)
    return rounded(GB.lm_records(spark, GB.lm_losses(kept, LM_ORDER))[0].drop("cell"))


# ------------------------------------------------------------ G: roll-ups
from glossa.operators import rollup as G  # noqa: E402

from dataclasses import dataclass  # noqa: E402


@dataclass(frozen=True)
class BatchRun:
    """One corpus of the batch: a mixture (C7) and the run's parameters."""
    target: str
    ratio: str
    methods: tuple[str, ...] = ("word", "char")
    sizes: tuple[int, ...] = (100, 1000)
    min_texts: int = 10

    @property
    def corpus_path(self) -> str:
        return f"data/mixtures/mix_{_group(self.target)}_{self.target}_{self.ratio}.txt"

    @property
    def run_path(self) -> str:
        return f"runs/run_{self.target}_{self.ratio}"


# Fixed batch: two complete runs, one with a cell that fails (a Unigram vocabulary smaller than its characters), a mixture
# that could not be drawn (no such language in the tables), and a run with fewer texts than it asks for.
BATCH = [BatchRun("de", "90_10"), BatchRun("fr", "75_25"), BatchRun("es", "50_50", ("word", "char", "unigram"), (30,)),
         BatchRun("ru", "90_10"), BatchRun("de", "50_50", min_texts=100_000)]
NO_CORPUS = "corpus file not found"


_BATCHES: dict[tuple, tuple] = {}
#: Runs of a batch that are under way at the same time.
RUNS_AT_ONCE = 4


def batch_tables(spark, d):
    """(runs, results, errors, split statistics) of the batch, which a session runs once for each state of its input: its tables
    (a row a run or a cell) serve all the reports on it. Files that are added, replaced or removed give a new batch."""
    from glossa.sources import io as IO
    at = (spark.sparkContext.applicationId, d, IO.input_state(spark, f"{d}/documents.parquet"))
    if at not in _BATCHES:
        _BATCHES[at] = _run_batch(spark, d)
    return _BATCHES[at]


def _run_batch(spark, d):
    """One experiment a mixture, with the LM, on all texts that the mixture's ratio allows; the runs share the cluster."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    from glossa.plans.experiment import ExperimentParams, run_experiment
    from glossa.session import cut_lineage, local_frame
    ratios = {**T.RATIOS_UNDERREPRESENTED, **T.RATIOS_TOKENIZER_TRAINING}
    mix, manifest = S.mixture_grid(cleaned(spark, d), sorted({r.target for r in BATCH}), ratios, sample_size=None, seed=SEED,
                                   cells_of=[(r.target, r.ratio) for r in BATCH])
    created = {(r["target_lang"], r["ratio"]) for r in manifest.filter("status = 'created'").collect()}  # the grid's cells
    mix = cut_lineage(mix)
    drawn = {(r["target_lang"], r["ratio"]): r["n"] for r in mix.groupBy("target_lang", "ratio").agg(F.count(F.lit(1)).alias("n")).collect()}  # the grid's cells

    def one(run):
        p = ExperimentParams(run.target, list(run.methods), list(run.sizes), TEST_FRACTION, SEED, min_texts=run.min_texts,
                             run_language_model=True, block_size=LM_BLOCK, lm_order=LM_ORDER)
        problems = p.problems() + ([] if (run.target, run.ratio) in created else [NO_CORPUS])
        if problems:
            return (run.corpus_path, "", "validation_failed", "; ".join(problems)), None
        texts = mix.filter((F.col("target_lang") == run.target) & (F.col("ratio") == run.ratio)).select("doc_id", "lang", "pos", "text")
        try:
            out = run_experiment(spark, texts, p)
        except Exception as e:  # noqa: BLE001 - a run that fails is a row of the summary
            return (run.corpus_path, "", "failed", repr(e)), None
        at = F.lit(run.run_path).alias("run_path")
        raw = F.lit(drawn.get((run.target, run.ratio), 0)).cast("long").alias("raw_texts")
        stats = out.split_stats.select("*", raw, at, F.lit(p.split_strategy).alias("split_strategy"))
        return (run.corpus_path, run.run_path, None, ""), (out.results.select("*", at), out.errors.select("*", at), cut_lineage(stats))

    with ThreadPoolExecutor(RUNS_AT_ONCE) as pool:
        ended = list(pool.map(inheritable_thread_target(spark)(one), BATCH))
    res, err, stats = None, None, None
    for _, tables in ended:
        if tables:
            res, err, stats = (_plus(a, b) for a, b in zip((res, err, stats), tables))
    runs_df = local_frame(spark, [r for r, _ in ended], "corpus_path string, run_path string, failure string, error string")
    return (*(t.coalesce(1) for t in (runs_df, rounded(res), err, stats)),)  # a row a run or a cell: one task reads them


def _plus(a, b):
    return b if a is None else a.unionByName(b)


def _group(lang: str) -> str:
    for g, ls in T.LANGUAGE_GROUPS.items():
        if lang in ls:
            return g
    return "custom"


@register("best_rows")
def q_best_rows(spark, d):
    _, res, _, _ = batch_tables(spark, d)
    return G.best_rows(res, ["run_path"])


def _run_counts(runs, res, err):
    n = res.groupBy("run_path").agg(F.count(F.lit(1)).alias("n_rows"))
    e = err.groupBy("run_path").agg(F.count(F.lit(1)).alias("n_errors"))
    named = runs.filter("run_path <> ''")
    return named.join(n, "run_path", "left").join(e, "run_path", "left").fillna(0, ["n_rows", "n_errors"])


@register("run_status")
def q_run_status(spark, d):
    runs, res, err, _ = batch_tables(spark, d)
    return _run_counts(runs, res, err).select("run_path", "n_rows", "n_errors",
                                              G.run_status(F.col("n_rows"), F.col("n_errors")).alias("status"))


@register("error_table")
def q_error_table(spark, d):
    """The failed cells of every run."""
    return batch_tables(spark, d)[2].select("run_path", "stage", "error")


@register("run_summary")
def q_run_summary(spark, d):
    """G3 for every run of the batch that gave results: corpus and split counts, cell counts, best row."""
    runs, res, err, stats = batch_tables(spark, d)
    cells = _run_counts(runs, res, err).select("run_path", F.col("n_rows").alias("completed_combinations"),
                                               F.col("n_errors").alias("failed_combinations"))
    best = G.best_rows(res, ["run_path"])
    pick = lambda c, name: F.max(F.when(F.col("criterion") == name, F.col(c)))  # noqa: E731 - a row a criterion
    best = best.groupBy("run_path").agg(*[pick(c, name).alias(alias) for name, _, _ in G.BEST_CRITERIA
                                          for c, alias in (("method", f"{name}_method"), ("vocab_size", f"{name}_vocab"), ("value", name))])
    counts = stats.select("run_path", "raw_texts", F.col("total_texts").alias("cleaned_texts"), "train_texts", "test_texts",
                          "test_en_texts", "test_target_texts", "test_unknown_texts", "split_strategy")
    return counts.join(cells, "run_path").join(best, "run_path", "left")


@register("batch_summary")
def q_batch_summary(spark, d):
    runs, res, err, _ = batch_tables(spark, d)
    return G.batch_summary(runs, res, err)


def _rollup(spark, d):
    runs, res, err, _ = batch_tables(spark, d)
    return G.batch_rollup(G.batch_summary(runs, res, err), res, "results/batch_demo")


@register("batch_rollup")
def q_batch_rollup(spark, d):
    return _rollup(spark, d)


def _mean_by(spark, d, dims, coerce=False):
    return rounded(G.mean_by(_rollup(spark, d), dims, coerce=coerce), 8)


@register("mean_by_method_vocab")
def q_mean_by_method_vocab(spark, d):
    return _mean_by(spark, d, ["method", "vocab_size"])


@register("mean_by_method_percent")
def q_mean_by_method_percent(spark, d):
    return _mean_by(spark, d, ["method", "target_percent"])


@register("mean_by_lang_percent")
def q_mean_by_lang_percent(spark, d):
    return _mean_by(spark, d, ["target_lang", "target_percent"])


@register("mean_by_line_vocab")
def q_mean_by_line_vocab(spark, d):
    return _mean_by(spark, d, ["ratio", "vocab_size"], coerce=True)


@register("status_counts")
def q_status_counts(spark, d):
    runs, res, err, _ = batch_tables(spark, d)
    return G.status_counts(G.batch_summary(runs, res, err))


# ------------------------------------------------------------ B12: language id
from glossa.operators import langid as LID  # noqa: E402

HOLDOUT = "33"  # md5 prefix below this marks the ~20% held-out documents


def _langid_sides(spark, d):
    c = cleaned(spark, d).withColumn("_h", S.md5_key(7, "doc_id"))
    return c.filter(F.col("_h") >= HOLDOUT).drop("_h"), c.filter(F.col("_h") < HOLDOUT).drop("_h")


@register("langid_nb")
def q_langid_nb(spark, d):
    train, _ = _langid_sides(spark, d)
    return LID.train(train).select("lang", "gram", "count")


@register("langid_accuracy")
def q_langid_accuracy(spark, d):
    train, held = _langid_sides(spark, d)
    pred = LID.predict(LID.train(train), held, ["lang"])
    return pred.groupBy("lang", "predicted").agg(F.count(F.lit(1)).alias("n_texts"))


@register("label_by_classifier")
def q_label_by_classifier(spark, d):
    """B11 with B12 as its detector: labels of the held-out documents by the classifier trained on the others."""
    train, held = _langid_sides(spark, d)
    held = held.select("lang", T.script_tag("text").alias("tag"), "text")  # a label follows from the tag and the detected language
    pred = LID.predict(LID.train(train), held, ["lang", "tag"])
    lab = pred.select("lang", T.label_of_script(F.col("tag"), TARGET, F.col("predicted")).alias("label"))
    return lab.groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n_texts"))


# ------------------------------------------------------------ S, A6-A15: streams and sinks
def _scratch(spark, name: str) -> str:
    """A fresh folder inside the session's (shared) checkpoint directory."""
    import uuid
    from glossa.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


@register("stream_clean")
def q_stream_clean(spark, d):
    from glossa.streaming import ingest as SI
    root = _scratch(spark, "stream-clean")
    SI.run_clean_stream(spark, d, f"{root}/sink", f"{root}/state", TARGET)
    return spark.read.parquet(f"{root}/sink").select("doc_id", "pos", "lang", "label", "text")


@register("stream_quota")
def q_stream_quota(spark, d):
    from glossa.streaming import ingest as SI
    root = _scratch(spark, "stream-quota")
    SI.run_quota_stream(spark, d, f"{root}/sink", f"{root}/state", 50, ["en", "de", "fr", "es"])
    return spark.read.parquet(f"{root}/sink").select("lang", "doc_id", "pos")


@register("corpus_roundtrip")
def q_corpus_roundtrip(spark, d):
    """A6 export per language, read back through the paragraph scan (A1)."""
    from glossa.sources import io as IO
    root = _scratch(spark, "corpora")
    IO.write_corpus_text(cleaned(spark, d), root, ["lang"])
    p = IO.read_corpus_text(spark, root).withColumn("lang", F.regexp_extract("path", "lang=([^/]+)", 1))
    return p.groupBy("lang").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.length("text")).alias("n_chars"))


@register("corpus_listing")
def q_corpus_listing(spark, d):
    """A12 over an exported corpus: bytes by language (the number of files follows the writer's partitions)."""
    from glossa.sources import io as IO
    root = _scratch(spark, "listing")
    IO.write_corpus_text(cleaned(spark, d), root, ["lang"])
    files = IO.file_listing(spark, root, "*.txt")
    return files.groupBy(F.regexp_extract("path", "lang=([^/]+)", 1).alias("lang")).agg(F.sum("n_bytes").alias("n_bytes"))


@register("run_ledger")
def q_run_ledger(spark, d):
    """A9 + A11: per-run status and config JSON written by the batch, read back as a ledger."""
    from glossa.sources import io as IO
    root = _scratch(spark, "runs")
    runs, res, err, _ = batch_tables(spark, d)
    st = _run_counts(runs, res, err)
    rid = F.regexp_extract("run_path", "([^/]+)$", 1)
    for r in [x["run_path"] for x in st.select("run_path").collect()]:  # one folder per run (a handful)
        one, folder = st.filter(F.col("run_path") == r), f"{root}/{r.split('/')[-1]}"
        IO.write_json(one.select(rid.alias("run_id"), G.run_status(F.col("n_rows"), F.col("n_errors")).alias("status"),
                                 F.concat(F.col("n_rows").cast("string"), F.lit(" cells")).alias("message"),
                                 F.current_timestamp().cast("string").alias("updated_at")), f"{folder}/status.json")
        IO.write_json(one.select(rid.alias("run_id"), F.regexp_extract("run_path", "run_([^_]+)_", 1).alias("language"), "corpus_path"),
                      f"{folder}/config.json")
    # the time and the scratch folder differ from run to run
    return IO.run_ledger(spark, root).select("run_id", "status", "message", "language", (F.length("updated_at") > 0).alias("dated"))


# ------------------------------------------------------------ D3/D4/D6: WordPiece, Unigram
from glossa.operators import subword as W  # noqa: E402

SUBWORD_SIZE = 300  # of the queries that SQL repeats step by step
SUBWORD_SIZES = [1000, 2000]  # the default grid


@register("wordpiece_vocab")
def q_wordpiece_vocab(spark, d):
    _, _, tr = _bpe(spark, d, "wordpiece", [SUBWORD_SIZE])
    return BPE.vocab_frame(spark, tr)


@register("wordpiece_encode")
def q_wordpiece_encode(spark, d):
    _, types, tr = _bpe(spark, d, "wordpiece", [SUBWORD_SIZE])
    return _readable(W.wordpiece_encode(types.filter(F.col("test_all_freq") > 0), tr.vocab))


def _readable(enc: DataFrame) -> DataFrame:
    return enc.select("word", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"),
                      F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@register("merge_vocab_grid")
def q_merge_vocab_grid(spark, d):
    """Merges of BPE and WordPiece at the default sizes, each method in one sweep, with the rank at which a size is reached."""
    from glossa.session import cut_lineage
    types = cut_lineage(BPE.type_table(split_corpus(spark, d), TARGET))
    out = None
    for method in ("bpe", "wordpiece"):
        tr = BPE.train_merges(types, SUBWORD_SIZES, method)
        reached = [v for v in SUBWORD_SIZES]
        size = F.expr("CASE " + " ".join(f"WHEN rank <= {tr.cuts[v][1]} THEN {v}" for v in reached) + " END")
        out = _plus(out, BPE.merges_frame(spark, tr).select(F.lit(method).alias("method"), size.cast("int").alias("vocab_size"), "rank", "left", "right", "merged", "count"))
    return out


def _unigram(spark, d):
    from glossa.session import cut_lineage
    with split_texts(spark, d) as split:
        utypes = cut_lineage(W.unigram_type_table(split, TARGET))
    return utypes, W.train_unigram_grid(utypes, SUBWORD_SIZES)


@register("unigram_vocab")
def q_unigram_vocab(spark, d):
    """The vocabulary at each default size."""
    _, grid = _unigram(spark, d)
    rows = []
    for v, pieces in grid.items():
        if not isinstance(pieces, Exception):
            rows += [(v, i, t, 0.0) for i, t in enumerate(BPE.SPECIAL_TOKENS)]
            rows += [(v, i, p, float(lp)) for i, (p, lp) in enumerate(pieces, start=len(BPE.SPECIAL_TOKENS))]
    return spark.createDataFrame(rows, "vocab_size int, id int, piece string, score double")


@register("unigram_encode")
def q_unigram_encode(spark, d):
    utypes, grid = _unigram(spark, d)
    return _readable(W.unigram_encode(utypes.filter(F.col("test_all_freq") > 0), grid[SUBWORD_SIZES[-1]]))


@register("experiment_methods")
def q_experiment_methods(spark, d):
    """Entry 1 end to end: every method at the default vocabulary sizes, with the LM on each method's tokens."""
    from glossa.plans.experiment import ExperimentParams, run_experiment
    p = ExperimentParams(language=TARGET, tokenizer_methods=["bpe", "wordpiece", "unigram", "word", "char"],
                         vocab_sizes=SUBWORD_SIZES, run_language_model=True, block_size=LM_BLOCK)
    return run_experiment(spark, paragraphs(spark, d), p).results


@register("saved_run")
def q_saved_run(spark, d):
    """What readers see of a folder with a run that ends and one that fails: result rows, with the saved
    tokenizer's pieces in the range of its size, and the lines and fragments that were saved."""
    from glossa.plans import runs as X
    from glossa.plans.experiment import ExperimentParams
    root = _scratch(spark, "saved")
    texts = paragraphs(spark, d)
    p = ExperimentParams(TARGET, ["word", "char"], GRID_SIZES, TEST_FRACTION, SEED)
    X.run_in_folder(spark, texts, p, root, "run_de", "documents")
    try:
        X.run_in_folder(spark, texts, ExperimentParams(TARGET, ["word"], GRID_SIZES, TEST_FRACTION, SEED, min_texts=1 << 60), root, "run_few")
    except RuntimeError:
        pass  # in the ledger
    rows = X.committed_results(spark, root)
    keys = ["run_id", "method", "vocab_size"]
    saved = spark.read.parquet(f"{root}/run_de/tokenizers/vocab").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pieces"))
    one = F.lit(1).alias("_one")
    lines = spark.read.text(f"{root}/run_de/trainer_lines").agg(F.count(F.lit(1)).alias("n_lines"))
    frozen = spark.read.parquet(f"{root}/run_de/corpus").agg(F.count(F.lit(1)).alias("n_fragments"), F.sum(F.length("text")).alias("n_chars"))
    out = rows.join(saved, keys, "left").withColumn("saved", F.col("n_pieces").between(1, F.col("vocab_size"))).drop("n_pieces", "tokenizer_path")
    return rounded(out.select("*", one).join(lines.select("*", one), "_one").join(frozen.select("*", one), "_one").drop("_one"))


@register("result_table")
def q_result_table(spark, d):
    """G1: the batch's result rows in the fixed column order, with the LM's columns."""
    _, res, _, _ = batch_tables(spark, d)
    return G.result_table(res, with_lm=True)


@register("compact_results")
def q_compact_results(spark, d):
    """B19, of a run: preferred columns that exist."""
    _, res, _, _ = batch_tables(spark, d)
    return G.compact(res)


@register("compact_batch")
def q_compact_batch(spark, d):
    """B19, of a batch."""
    return G.compact(_rollup(spark, d), G.COMPACT_BATCH_COLUMNS)


# Fixed derived ratio names for B15, valid and malformed.
RATIO_NAMES = list(T.RATIOS_UNDERREPRESENTED) + list(T.RATIOS_TOKENIZER_TRAINING) + ["unknown", "a_b", "50", "x_7.5"]


@register("ratio_percent")
def q_ratio_percent(spark, d):
    """B15 over a ratio name assigned to every document."""
    docs = C.documents(spark, d)
    r = F.element_at(F.array(*[F.lit(x) for x in RATIO_NAMES]), (F.col("doc_id") % len(RATIO_NAMES) + 1).cast("int"))
    return docs.select("doc_id", r.alias("ratio"), T.ratio_target_percent(r).alias("target_percent"))


@register("bpe_encode")
def q_bpe_encode(spark, d):
    """BPE tokens of every test word at the largest vocabulary size (the training state)."""
    from glossa.session import cut_lineage
    sc = split_corpus(spark, d)
    types = cut_lineage(BPE.type_table(sc, TARGET))
    tr = BPE.train_merges(types, [BPE_SIZES[-1]], "bpe", keep_states=True)
    st = tr.states[BPE_SIZES[-1]].filter(F.col("test_all_freq") > 0)
    toks = F.split(F.trim(F.col("seg")), "  ")
    return st.select("word", F.size(toks).alias("n_tokens"), F.array_join(toks, " ").alias("tokens"))

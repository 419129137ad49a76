"""Result analytics (G1-G14): best rows, run summary and status, batch summary and roll-ups,
mean-by-dimension tables, status counts. All are aggregations and joins over result
tables; ``min_by``/``max_by`` pick best rows in one pass without sorting."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators.metrics import LM_COLUMNS, RESULT_COLUMNS

# The roll-up metrics and the best-row criteria (name, metric, mode).
ROLLUP_METRICS = ["compression_factor_char_target", "compression_penalty_char", "ppl_target", "gap_loss"]
BEST_CRITERIA = [
    ("best_tokens_per_char", "tokens_per_char", "min"),
    ("best_target_compression_factor", "compression_factor_char_target", "max"),
    ("best_compression_penalty_char", "compression_penalty_char", "min_abs"),
    ("best_target_tokens_per_char", "tokens_per_char_target", "min"),
    ("best_compression_gap_tokens_per_char", "compression_gap_tokens_per_char", "min_abs"),
    ("best_ppl", "ppl", "min"),
    ("best_gap_loss", "gap_loss", "min"),
]


# The columns the compact result views prefer, in display order: of one run, and of a batch.
COMPACT_COLUMNS = ["method", "vocab_size", "tokens_per_char_en", "tokens_per_char_target", "compression_factor_char_en",
                   "compression_factor_char_target", "compression_penalty_char", "ppl_en", "ppl_target", "gap_loss"]
COMPACT_BATCH_COLUMNS = ["group", "target_lang", "ratio", "target_percent", "method", "vocab_size", "compression_factor_char_en",
                         "compression_factor_char_target", "compression_penalty_char", "ppl_en", "ppl_target", "gap_loss"]


def compact(df: DataFrame, preferred: Sequence[str] = COMPACT_COLUMNS) -> DataFrame:
    """Keep the preferred columns that exist, else everything."""
    keep = [c for c in preferred if c in df.columns]
    return df.select(*keep) if keep else df


def result_table(rows: DataFrame, with_lm: bool) -> DataFrame:
    """G1: fixed column order; LM columns only when the LM ran."""
    cols = RESULT_COLUMNS + (LM_COLUMNS if with_lm else [])
    return rows.select(*[c for c in cols if c in rows.columns])


def best_rows(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per (keys..., criterion) with the winning method / vocab_size / value.
    Undefined values are skipped, but for tokens_per_char, where they come last (a run with no defined value has a best row
    of value NULL); ties go to the smaller (method, vocab_size)."""
    keys = list(keys)
    out = None
    for name, metric, mode in BEST_CRITERIA:
        if metric not in results.columns:
            continue
        v = F.col(metric)
        key = F.abs(v) if mode == "min_abs" else (-v if mode == "max" else v)
        r = results if metric == "tokens_per_char" else results.filter(v.isNotNull())
        pick = F.min_by(F.struct("method", "vocab_size", v.alias("value")),
                        F.struct(v.isNull().alias("undefined"), key.alias("k"), F.col("method"), F.col("vocab_size")))
        g = (r.groupBy(*keys).agg(pick.alias("b")) if keys else r.agg(pick.alias("b")))
        g = g.filter(F.col("b").isNotNull()).select(*keys, F.lit(name).alias("criterion"), F.col("b.method").alias("method"),
                                                    F.col("b.vocab_size").alias("vocab_size"),
                                                    F.col("b.value").alias("value"))
        out = g if out is None else out.unionByName(g)
    return out


def run_status(n_rows: Column, n_errors: Column) -> Column:
    """G4."""
    return (F.when((n_rows > 0) & (n_errors == 0), "completed")
             .when(n_rows > 0, "partially_completed").otherwise("failed"))


def batch_status(n_errors: Column, failure: Column) -> Column:
    """G6 status of a batch row: why a run gave no result (``failure``, validation_failed or failed), else
    partially_completed with any failed cell, else completed."""
    return F.coalesce(failure, F.when(n_errors > 0, "partially_completed").otherwise("completed"))


def batch_summary(runs: DataFrame, results: DataFrame, errors: DataFrame) -> DataFrame:
    """One row per run (corpus): mixture metadata from the corpus name, counts and the
    best tokens_per_char / ppl rows. ``runs``: (corpus_path, run_path, failure, error), where a run
    that gave no result has a blank run_path and says why; results and errors carry run_path."""
    meta = T.parse_mixture_name(F.col("corpus_path"))
    cnt = results.groupBy("run_path").agg(F.count(F.lit(1)).alias("completed_combinations"))
    err = errors.groupBy("run_path").agg(F.count(F.lit(1)).alias("failed_combinations"))
    best = best_rows(results, ["run_path"])
    b_tpc = best.filter(F.col("criterion") == "best_tokens_per_char").select(
        "run_path", F.col("method").alias("best_tokens_per_char_method"),
        F.col("vocab_size").alias("best_tokens_per_char_vocab"), F.col("value").alias("best_tokens_per_char"))
    b_ppl = best.filter(F.col("criterion") == "best_ppl").select(
        "run_path", F.col("method").alias("best_ppl_method"), F.col("vocab_size").alias("best_ppl_vocab"),
        F.col("value").alias("best_ppl"))
    j = (runs.join(cnt, "run_path", "left").join(err, "run_path", "left")
             .join(b_tpc, "run_path", "left").join(b_ppl, "run_path", "left")
             .fillna(0, ["completed_combinations", "failed_combinations"]))
    status = batch_status(F.col("failed_combinations"), F.col("failure"))
    return j.select("corpus_path", meta["group"].alias("group"), meta["target_lang"].alias("target_lang"),
                    meta["ratio"].alias("ratio"), status.alias("status"), F.coalesce("error", F.lit("")).alias("error"), "run_path",
                    F.col("completed_combinations").cast("int").alias("completed_combinations"),
                    F.col("failed_combinations").cast("int").alias("failed_combinations"),
                    "best_tokens_per_char_method", "best_tokens_per_char_vocab", "best_tokens_per_char",
                    "best_ppl_method", "best_ppl_vocab", "best_ppl")


def batch_rollup(summary: DataFrame, results: DataFrame, batch_dir: str) -> DataFrame:
    """Each summary row x its run's result rows; rows with a blank run path or no results
    vanish (inner join). The summary is one row per run, a small side."""
    s = summary.filter(F.length(F.coalesce(F.col("run_path"), F.lit(""))) > 0).select(
        F.lit(batch_dir).alias("batch_dir"), "run_path", "corpus_path", "group", "target_lang", "ratio",
        T.ratio_target_percent(F.col("ratio")).alias("target_percent"), F.col("status").alias("batch_status"))
    return s.join(results, "run_path", "inner")


def mean_by(df: DataFrame, dims: Sequence[str], metrics: Sequence[str] = ROLLUP_METRICS,
            coerce: bool = False) -> DataFrame:
    """Mean of each metric by ``dims``; undefined values dropped (NULL skipped by avg).
    Missing required columns give an empty table (G13). Long format: (dims..., metric, mean, n)."""
    spark = df.sparkSession
    schema = ", ".join(f"{d} string" for d in dims) + ", metric string, mean double, n long"
    need = set(dims)
    present = [m for m in metrics if m in df.columns]
    if not need <= set(df.columns) or not present:
        return spark.createDataFrame([], schema)
    out = None
    for m in present:
        v = F.col(m).try_cast("double") if coerce else F.col(m).cast("double")
        g = (df.select(*[F.col(d).cast("string").alias(d) for d in dims], v.alias("_v"))
               .filter(reduce(lambda a, b: a & b, [F.col(d).isNotNull() for d in dims], F.col("_v").isNotNull() & ~F.isnan("_v")))
               .groupBy(*dims).agg(
                   F.avg("_v").alias("mean"), F.count(F.lit(1)).alias("n"))
               .select(*dims, F.lit(m).alias("metric"), "mean", "n"))
        out = g if out is None else out.unionByName(g)
    return out


def status_counts(df: DataFrame, col: str = "status") -> DataFrame:
    """G14."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))

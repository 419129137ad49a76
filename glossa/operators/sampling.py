"""Exact-k selection and the splits / mixtures built on it.

exact-k: choose exactly ``k`` rows per stratum in a given total order without putting a
stratum into one task. Rows carry a small integer ``bucket`` that is monotone in the
order (first 16 bits of an md5 key, or an equal-width slice of an id range). Per
(stratum, bucket) counts are a small table; a running sum over it finds, per stratum,
the one bucket that straddles ``k``. Rows below it are taken, rows above are not, and
only that one bucket (~1/65536 of the stratum) is ranked with ``row_number``.
A stratum holding a third of all rows therefore costs the same as any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.session import broadcast_if_small, cut_lineage, local_frame

N_BUCKETS = 65536
_BIG = 1 << 30
#: Rows of a bucket above which it is cut again, and how often 16 bits of a range make a 64-bit id.
EDGE_ROWS = 100_000
ID_LEVELS = 4


def md5_key(seed: int, *cols) -> Column:
    """Deterministic pseudo-random order key: md5 of ``seed:k1:k2...`` (same in DuckDB)."""
    parts = [F.lit(str(seed))]
    for c in cols:
        parts += [F.lit(":"), (F.col(c) if isinstance(c, str) else c).cast("string")]
    return F.md5(F.concat(*parts))


def md5_bucket(h: Column) -> Column:
    return F.conv(F.substring(h, 1, 4), 16, 10).cast("int")


def id_bucket(df: DataFrame, strata: Sequence[str], id_col: str) -> DataFrame:
    """Equal-width id buckets per stratum, monotone in ``id_col``."""
    lo, hi = F.min(id_col).alias("_lo"), F.max(id_col).alias("_hi")
    if strata:
        stats = broadcast_if_small(cut_lineage(df.groupBy(*strata).agg(lo, hi)))
        df = df.join(stats, list(strata), "left")
    else:
        row = df.agg(lo, hi).first()
        df = df.withColumns({"_lo": F.lit(row["_lo"]), "_hi": F.lit(row["_hi"])})
    width = (F.col("_hi").cast("double") - F.col("_lo").cast("double") + 1) / N_BUCKETS
    at = F.floor((F.col(id_col).cast("double") - F.col("_lo").cast("double")) / width).cast("int")
    return df.withColumn("_bucket", F.least(at, F.lit(N_BUCKETS - 1))).drop("_lo", "_hi")


def first_k_by_id(df: DataFrame, strata: Sequence[str], id_col: str, order: Sequence[str], quota: DataFrame | int) -> DataFrame:
    """The first ``quota`` rows of each stratum in ``order``, which starts with ``id_col``."""
    return first_k(id_bucket(df, strata, id_col), strata, order, "_bucket", quota,
                   lambda edge, level: id_bucket(edge, strata, id_col) if level < ID_LEVELS else None).drop("_bucket")


def flag_first_k(df: DataFrame, strata: Sequence[str], order: Sequence[str], bucket: str, quota: DataFrame | int | Callable[[DataFrame], DataFrame],
                 flag: str = "selected", rebucket: Callable[[DataFrame, int], DataFrame | None] | None = None,
                 level: int = 0) -> DataFrame:
    """Add boolean ``flag``: row is among the first ``k`` of its stratum in ``order``.

    ``quota`` is an int, a DataFrame (strata..., k), or makes one from the rows of each stratum and bucket
    (strata..., bucket, _n), as the k of stratified splits depends on each stratum's size. ``bucket`` must be monotone in
    ``order``. Rows of strata missing from ``quota`` get k = 0. ``rebucket(edge, level)`` cuts the rows
    of straddling buckets that are too large to rank again by ``bucket``; None when it can't.
    """
    strata = list(strata)
    if not strata:
        return _flag_first_k_single(df, order, bucket, quota, flag, rebucket, level)
    counts = cut_lineage(df.groupBy(*strata, bucket).agg(F.count(F.lit(1)).alias("_n")))  # a row a stratum and bucket: rows are counted once
    if callable(quota):
        quota = quota(counts)
    if isinstance(quota, int):
        counts = counts.withColumn("_k", F.lit(quota).cast("long"))
    else:
        q = quota.select(*strata, F.col("k").cast("long").alias("_k"))
        counts = counts.join(broadcast_if_small(q), strata, "left").withColumn("_k", F.coalesce("_k", F.lit(0).cast("long")))
    w = Window.partitionBy(*strata).orderBy(bucket)
    cum = counts.withColumn("_incl", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cut = (cum.filter((F.col("_incl") >= F.col("_k")) & (F.col("_k") > 0))
              .groupBy(*strata)
              .agg(F.min_by(F.struct(F.col(bucket).alias("_cut"), (F.col("_k") - F.col("_incl") + F.col("_n")).alias("_need")),
                            F.col(bucket)).alias("_c"))
              .select(*strata, "_c._cut", "_c._need"))
    kk = cum.groupBy(*strata).agg(F.max("_k").alias("_kk"))
    cut = (kk.join(cut, strata, "left")
             .select(*strata,
                     F.when(F.col("_kk") <= 0, F.lit(-1)).otherwise(F.coalesce("_cut", F.lit(_BIG))).alias("_cut"),
                     F.coalesce("_need", F.lit(0)).alias("_need")))
    cut = cut_lineage(cut)  # one row per stratum
    marked = df.join(broadcast_if_small(cut), strata, "left")
    rest = (marked.filter(F.col(bucket) != F.col("_cut"))
                  .withColumn(flag, F.col(bucket) < F.col("_cut")))
    edge = marked.filter(F.col(bucket) == F.col("_cut"))
    if rebucket is not None:
        crowded = counts.join(cut, strata).filter((F.col(bucket) == F.col("_cut")) & (F.col("_n") > EDGE_ROWS)).limit(1)
        again = rebucket(edge.drop(bucket, "_cut", "_need"), level + 1) if crowded.count() else None
        if again is not None:
            need = cut.select(*strata, F.col("_need").alias("k"))
            return rest.drop("_cut", "_need").unionByName(flag_first_k(again, strata, order, bucket, need, flag, rebucket, level + 1))
    wr = Window.partitionBy(*strata, bucket).orderBy(*order)
    edge = edge.withColumn(flag, F.row_number().over(wr) <= F.col("_need"))
    return rest.unionByName(edge).drop("_cut", "_need")


def _flag_first_k_single(df: DataFrame, order: Sequence[str], bucket: str, quota: DataFrame | int, flag: str,
                         rebucket: Callable[[DataFrame, int], DataFrame | None] | None = None, level: int = 0) -> DataFrame:
    """One stratum: the cut (bucket, need) is two scalars, fetched to the driver and used as
    literals -- no join at all."""
    counts = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n"))
    k = quota if isinstance(quota, int) else int(quota.first()["k"])
    if k <= 0:
        return df.withColumn(flag, F.lit(False))
    w = Window.orderBy(bucket)  # over at most N_BUCKETS rows
    cum = counts.withColumn("_incl", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    row = (cum.filter(F.col("_incl") >= k).orderBy(bucket).limit(1)
              .select(F.col(bucket).alias("b"), (F.lit(k) - F.col("_incl") + F.col("_n")).alias("need"), "_n").collect())
    if not row:  # k >= all rows
        return df.withColumn(flag, F.lit(True))
    cut, need = int(row[0]["b"]), int(row[0]["need"])
    rest = df.filter(F.col(bucket) != cut).withColumn(flag, F.col(bucket) < cut)
    if rebucket is not None and row[0]["_n"] > EDGE_ROWS:
        again = rebucket(df.filter(F.col(bucket) == cut).drop(bucket), level + 1)
        if again is not None:
            return rest.unionByName(_flag_first_k_single(again, order, bucket, need, flag, rebucket, level + 1))
    edge = df.filter(F.col(bucket) == cut).withColumn(
        flag, F.row_number().over(Window.partitionBy(bucket).orderBy(*order)) <= need)
    return rest.unionByName(edge)


def first_k(df: DataFrame, strata: Sequence[str], order: Sequence[str], bucket: str, quota: DataFrame | int,
            rebucket: Callable[[DataFrame, int], DataFrame | None] | None = None) -> DataFrame:
    return flag_first_k(df, strata, order, bucket, quota, "_sel", rebucket).filter("_sel").drop("_sel")


# ---------------------------------------------------------------------------
# Splits
# ---------------------------------------------------------------------------

def random_split(df: DataFrame, key_cols: Sequence[str], test_fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Seeded order, ``cut = floor(n*(1-f))``; the first ``cut`` rows are train, the rest test.
    Adds ``split`` ('train'/'test')."""
    h = md5_key(seed, *key_cols)
    d = df.withColumn("_h", h).withColumn("_b", md5_bucket(F.col("_h")))
    n = d.count()  # a scalar for the cut index
    k = int(math.floor(n * (1.0 - float(test_fraction))))
    out = flag_first_k(d, [], ["_h", *key_cols], "_b", k, "_train")
    return (out.withColumn("split", F.when(F.col("_train"), "train").otherwise("test"))
               .drop("_h", "_b", "_train"))


def stratified_split(df: DataFrame, key_cols: Sequence[str], label_col: str = "label",
                     test_fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Per label, 0 -> nothing, 1 -> train, else the first clamp(round_half_even(n*f), 1, n-1)
    rows in seeded order are test. Adds ``split``."""
    d = df.withColumn("_h", md5_key(seed, label_col, *key_cols)).withColumn("_b", md5_bucket(F.col("_h")))
    n = F.col("n")
    k = (F.when(n <= 1, F.lit(0))
          .otherwise(F.least(n - 1, F.greatest(F.lit(1), F.bround(n * F.lit(float(test_fraction)), 0).cast("long")))))

    def quota(counts: DataFrame) -> DataFrame:
        return counts.groupBy(label_col).agg(F.sum("_n").alias("n")).select(label_col, k.alias("k"))

    out = flag_first_k(d, [label_col], ["_h", *key_cols], "_b", quota, "_test")
    return (out.withColumn("split", F.when(F.col("_test"), "test").otherwise("train"))
               .drop("_h", "_b", "_test"))


def split_stats(split_df: DataFrame, label_col: str = "label", target_lang: str = "target") -> DataFrame:
    """C4: the 13 split counters as one row (labels en / target / unknown)."""
    lab = F.col(label_col)
    lab_norm = F.when(lab == "en", "en").when(lab == "unknown", "unknown").otherwise("target")
    sp = F.col("split")
    cols = [F.count(F.lit(1)).alias("total_texts")]
    for l in ["en", "target", "unknown"]:
        cols.append(F.count_if(lab_norm == l).alias(f"total_{l}_texts"))
    cols += [F.count_if(sp == "train").alias("train_texts"), F.count_if(sp == "test").alias("test_texts")]
    for l in ["en", "target", "unknown"]:
        for s in ["train", "test"]:
            cols.append(F.count_if((lab_norm == l) & (sp == s)).alias(f"{s}_{l}_texts"))
    return split_df.agg(*cols)


# ---------------------------------------------------------------------------
# Mixtures
# ---------------------------------------------------------------------------

def mixture_quotas(cells: DataFrame) -> DataFrame:
    """C6 sizes: target = floor(total*pct/100), english = total - target."""
    tgt = F.floor(F.col("total").cast("double") * F.col("target_percent") / F.lit(100.0)).cast("long")
    return cells.withColumn("target_count", tgt).withColumn("english_count", F.col("total") - tgt)


def mixture_grid(samples: DataFrame, languages: Sequence[str], ratios: dict[str, tuple[float, float]],
                 sample_size: int | None = 1000, seed: int = 42, base_lang: str = "en",
                 output_dir: str = "data/mixtures", cells_of: Sequence[tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Every language x ratio cell drawn in one job, or those of ``cells_of``.

    ``samples`` (lang, doc_id, pos, text): per-language samples, already cleaned and
    capped at ``sample_size`` (A5). Without a ``sample_size`` a cell is as large as the texts of its
    two languages allow. They are read several times, so the caller writes them once. Returns (mixtures, manifest). A cell whose side is short
    is a ``failed`` manifest row and draws nothing; other cells are unaffected.
    """
    spark = samples.sparkSession
    counts = samples.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # the grid itself is job parameters: languages x ratios, built on the driver
    grid = local_frame(
        spark, [(l, base_lang, r, float(e), float(t)) for l in languages for r, (e, t) in ratios.items() if cells_of is None or (l, r) in cells_of],
        "target_lang string, base_lang string, ratio string, english_percent double, target_percent double")
    from glossa.functions.text import language_group
    n_target = counts.select(F.col("lang").alias("target_lang"), F.col("n").alias("n_target"))
    n_en = counts.select(F.col("lang").alias("base_lang"), F.col("n").alias("n_en"))
    cells = (grid.join(n_target, "target_lang", "left").join(n_en, "base_lang", "left")
                 .fillna(0, ["n_target", "n_en"]))
    if sample_size is None:
        most = F.least(F.col("n_en") * F.lit(100.0) / F.col("english_percent"), F.col("n_target") * F.lit(100.0) / F.col("target_percent"))
        cells = mixture_quotas(cells.withColumn("total", F.floor(most).cast("long")))  # rounding may ask for one English text too many
        cells = cells.withColumn("total", F.col("total") - F.greatest(F.col("english_count") - F.col("n_en"), F.lit(0)))
    else:
        cells = cells.withColumn("total", F.least(F.lit(sample_size).cast("long"), F.col("n_en"), F.col("n_target") * 100))
    cells = mixture_quotas(cells).withColumn("group", language_group("target_lang"))
    err = (F.when(F.col("n_target") < 2, F.lit("RuntimeError('too few fragments after cleaning')"))
            .when(F.col("total") <= 0, F.lit("ValueError('total_size must be positive')"))
            .when(F.col("english_count") > F.col("n_en"), F.lit("RuntimeError('not enough English fragments')"))
            .when(F.col("target_count") > F.col("n_target"), F.lit("RuntimeError('not enough target fragments')")))
    cells = cells.withColumn("error", err).withColumn("status", F.when(F.col("error").isNull(), "created").otherwise("failed"))
    cells = cut_lineage(cells)  # a row a cell; its counts of all texts are made once
    ok = cells.filter(F.col("status") == "created")
    file_name = F.concat(F.lit("mix_"), F.col("group"), F.lit("_"), F.col("target_lang"), F.lit("_"), F.col("ratio"), F.lit(".txt"))
    # English side: every ok cell draws from the one English sample; target side from its own. Texts are read once for both.
    sides = ok.select(F.col("base_lang").alias("lang"), "target_lang", "ratio", F.lit("en").alias("side")).unionByName(
        ok.select(F.col("target_lang").alias("lang"), "target_lang", "ratio", F.lit("target").alias("side")))
    both = samples.join(F.broadcast(sides), "lang")
    both = both.withColumn("_h", md5_key(seed, "target_lang", "ratio", "side", "lang", "doc_id", "pos"))
    both = both.withColumn("_b", md5_bucket(F.col("_h")))
    quota = ok.select("target_lang", "ratio", F.lit("en").alias("side"), F.col("english_count").alias("k")).unionByName(
        ok.select("target_lang", "ratio", F.lit("target").alias("side"), F.col("target_count").alias("k")))
    drawn = first_k(both, ["target_lang", "ratio", "side"], ["_h", "lang", "doc_id", "pos"], "_b", quota)
    mixtures = (drawn.join(F.broadcast(ok.select("target_lang", "ratio", "group")), ["target_lang", "ratio"])
                     .withColumn("order_key", md5_key(seed, "target_lang", "ratio", "lang", "doc_id", "pos"))
                     .select("group", "target_lang", "ratio", "lang", "doc_id", "pos", "text", "order_key"))
    manifest = cells.select(
        F.when(F.col("status") == "created", file_name).otherwise(F.lit("")).alias("file"),
        F.when(F.col("status") == "created", F.concat(F.lit(f"{output_dir.rstrip('/')}/"), file_name)).otherwise(F.lit("")).alias("path"),
        "group", "target_lang", "ratio", "english_percent", "target_percent",
        F.when(F.col("status") == "created", F.col("total")).otherwise(F.lit(0)).alias("n_texts"),
        "status", F.coalesce("error", F.lit("")).alias("error"))
    return mixtures, manifest


# ---------------------------------------------------------------------------
# Top-k by score
# ---------------------------------------------------------------------------

def prefix_bucket(col: str, level: int = 0) -> Column:
    """The ``level``-th pair of UTF-8 bytes as an int: monotone in Spark's (byte-wise) string order among strings whose
    earlier pairs agree."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(col), "UTF-8"), 2 * level + 1, 2)), 4, "0"), 16, 10).cast("int")


#: Pairs of bytes of a tie that are tried before equal beginnings are ranked as they are.
TIE_LEVELS = 32


def top_k(df: DataFrame, group: Sequence[str], score: str, tie: str, k: int) -> DataFrame:
    """The ``k`` rows with the highest ``score`` per group, ties by ``tie`` ascending -- exactly, without a window over a
    whole group or a k x partitions merge in one task: exact-k in the order (-score, tie), whose straddling
    bucket is cut by ranges of scores and then, within one score, by the beginnings of ``tie``."""
    neg = df.withColumn("_neg", -F.col(score))

    def rebucket(edge: DataFrame, level: int) -> DataFrame | None:
        if level < ID_LEVELS:
            return id_bucket(edge, group, "_neg")
        if level < ID_LEVELS + TIE_LEVELS:
            return edge.withColumn("_bucket", prefix_bucket(tie, level - ID_LEVELS))
        return None

    return first_k(id_bucket(neg, group, "_neg"), group, ["_neg", tie], "_bucket", k, rebucket).drop("_neg", "_bucket")

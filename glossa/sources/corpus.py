"""Corpus scans and loads (A1-A5): documents -> paragraphs -> cleaned paragraphs.

A corpus is a DataFrame ``(lang, doc_id, pos, text)``; ``(doc_id, pos)`` replaces the
reference's list position. All work is row-wise column expressions; nothing is
collected. ``posexplode`` is done per document, so the cost follows the text volume.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators.sampling import first_k_by_id
from glossa.session import broadcast_if_small, cut_lineage, spread

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")


def split_paragraphs(text: Column) -> Column:
    """A1 split: on blank-line pairs when the text has one, else at every line break."""
    return F.when(F.instr(text, "\n\n") > 0, F.split(text, "\n\n")).otherwise(F.split(text, T.LINE_BREAKS))


def paragraph_scan(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id", "lang")) -> DataFrame:
    """A1: one row per stripped, non-empty fragment: (*keep, pos, text)."""
    exploded = spread(docs.select(*keep, F.posexplode(split_paragraphs(F.col(text_col))).alias("pos", "_p")))
    return (exploded.select(*keep, F.col("pos").cast("int").alias("pos"), T.py_strip("_p").alias("text"))
                    .filter(F.length("text") > 0))


def field_fallback(df: DataFrame, fields: Sequence[str] = ("text", "content", "article")) -> Column:
    """A2: first present field whose stripped value is non-empty, else ''."""
    present = [f for f in fields if f in df.columns]
    picks = [F.when(F.length(T.py_strip(F.col(f))) > 0, F.col(f)) for f in present]
    return F.coalesce(*picks, F.lit("")) if picks else F.lit("")


def clean_corpus(paragraphs: DataFrame, lang: Column | str | None = None) -> DataFrame:
    """Clean every fragment (B1-B6) and drop the ones B7 rejects."""
    lang_expr = F.col("lang") if lang is None else lang
    df = paragraphs.withColumn("_clang", lang_expr)
    return T.clean_frame(df, "text", F.col("_clang")).drop("_clang").filter(T.keep_text(F.col("text")))


def language_samples(corpus: DataFrame, sample_size: int, min_texts: int = 2) -> DataFrame:
    """A5: per language the first ``sample_size`` cleaned fragments in (doc_id, pos) order.
    Adds ``lang_ok`` = the language has at least ``min_texts`` cleaned fragments."""
    head = first_k_by_id(corpus, ["lang"], "doc_id", ["doc_id", "pos"], sample_size)
    n = corpus.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    return head.join(broadcast_if_small(n.select("lang", (F.col("_n") >= min_texts).alias("lang_ok"))), "lang")


def quota_load(records: DataFrame, max_samples: int, languages: Sequence[str] | None = None) -> DataFrame:
    """A3 for many languages in one job: scan at most 5*max_samples records per language in
    key order, clean them with their language, keep at most ``max_samples`` accepted ones.
    ``records`` has (lang, doc_id) and any of text/content/article."""
    if languages is not None:
        records = records.filter(F.col("lang").isin(list(languages)))
    rec = records.select("lang", "doc_id", field_fallback(records).alias("raw"))
    # at most 5*max_samples rows per language: small, and read several times below
    scanned = cut_lineage(first_k_by_id(rec, ["lang"], "doc_id", ["doc_id"], 5 * max_samples))
    cleaned = (T.clean_frame(scanned.withColumnRenamed("raw", "text"), "text", F.col("lang"))
                .filter(T.keep_text(F.col("text"))))
    return first_k_by_id(cleaned, ["lang"], "doc_id", ["doc_id"], max_samples)


def load_manifest(spark: SparkSession, loaded: DataFrame, languages: Sequence[str], max_samples: int,
                  output_dir: str = "data/source_corpora", split: str = "train", streaming: bool = True,
                  seed: int = 42, dataset: str = "documents") -> DataFrame:
    """A4: one row per requested language: config, loaded count and status."""
    req = spark.createDataFrame([(l,) for l in languages], "language string")
    got = loaded.groupBy(F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("loaded_samples"))
    m = req.join(got, "language", "left").fillna(0, ["loaded_samples"])
    ok = F.col("loaded_samples") > 0
    return m.select(
        "language", F.lit(output_dir).alias("output_dir"), F.lit(split).alias("split"),
        F.lit(max_samples).alias("max_samples"), F.lit(streaming).alias("streaming"), F.lit(seed).alias("seed"),
        F.lit(dataset).alias("dataset"),
        F.concat(F.lit(output_dir.rstrip("/") + "/"), F.col("language"), F.lit(".txt")).alias("output_path"),
        F.col("loaded_samples").cast("int").alias("loaded_samples"),
        F.when(ok, "completed").otherwise("failed").alias("status"),
        F.when(ok, "").otherwise(F.concat(F.lit("RuntimeError('no text fragments for language "),
                                          F.col("language"), F.lit("')"))).alias("error"))


def load_languages(spark: SparkSession, records: DataFrame, languages: Sequence[str], max_samples: int,
                   **config) -> tuple[DataFrame, DataFrame]:
    """A3 and A4: (loaded fragments, manifest with ``started_at`` and ``finished_at``). All languages load in one job, so they share
    its times (ISO seconds, UTC); ``config`` is ``load_manifest``'s."""
    now = lambda: datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    started = now()
    loaded = cut_lineage(quota_load(records, max_samples, languages))
    finished = now()
    manifest = load_manifest(spark, loaded, languages, max_samples, **config)
    return loaded, manifest.select("*", F.lit(started).alias("started_at"), F.lit(finished).alias("finished_at"))


def missing_sources(spark: SparkSession, available: DataFrame, required: Sequence[str]) -> DataFrame:
    """Required languages with no source corpus (left anti join). ``available`` has a row a source, or many; only its
    ``lang`` is read."""
    req = spark.createDataFrame([(l,) for l in required], "lang string")
    return req.join(available.select("lang").distinct(), "lang", "left_anti")

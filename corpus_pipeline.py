"""The corpus pipeline: five stages from ``documents`` to packed training sequences.

Each stage calls one operator of ``glossa.llm`` on all that its predecessor kept, and is written as Parquet and read
again for the next, so a lost executor costs a stage's tasks at most. All but the last return the columns of ``documents``.

1. toxicity: documents that the multiple-instance model rejects go;
2. line dedup: lines repeated across documents go, ``n_chars`` follows the text;
3. SimHash near-dedup: one document of each linked group stays, that of the smallest ``doc_id``;
4. benchmark decontamination: documents that leak a test item go;
5. best-fit packing: one row per token piece, with its sequence and place.

Rows without a ``doc_id`` can't be rejected by id in stages 3 and 4 and stay; null texts count as empty throughout.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import decontaminate, line_dedup, packing, simhash_trie, toxicity
from glossa.llm.common import read_table, shared_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.classify(docs, read_table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 0").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(docs)
    return cleaned.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_trie.one_of_each(docs, width=3, budget=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: Noisy-or training, XXH64 fingerprints and subword ids have no SQL form; tests/llm holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

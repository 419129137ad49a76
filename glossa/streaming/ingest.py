"""Structured Streaming ingest.

S1: ``readStream`` over document files -> paragraph scan -> clean -> label -> append sink.
Stateless, so it needs no watermark. S2: the reference stops reading once a language has
``max_samples`` accepted fragments; as a stream this is ``foreachBatch`` that reads the
per-language counts already in the sink and admits the remainder in key order. Each batch
writes to its own ``batch_id=`` folder with overwrite, so a replayed batch after a failure
rewrites the same output (idempotent). With the wanted languages given, the stream ends once all have their
samples: later batches are not read, and the query is stopped.
"""

from __future__ import annotations

from collections.abc import Sequence
from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators.sampling import first_k_by_id
from glossa.session import cut_lineage, path_exists
from glossa.sources import corpus as C


def document_stream(spark: SparkSession, folder: str, glob: str = "documents*.parquet",
                    max_files_per_trigger: int = 1) -> DataFrame:
    """The tables of a folder as a stream; each is a file, or a folder of part files."""
    at = f"{folder.rstrip('/')}/{glob}"
    schema = spark.read.parquet(at).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(at)


def clean_stream(docs: DataFrame, target_lang: str) -> DataFrame:
    """S1 transformation: the batch operators, unchanged, on a streaming DataFrame."""
    paras = C.paragraph_scan(docs.select("doc_id", "lang", "text"))
    cleaned = C.clean_corpus(paras)
    return cleaned.withColumn("label", T.language_label(F.col("text"), target_lang, F.col("lang")))


def run_clean_stream(spark: SparkSession, folder: str, sink: str, checkpoint: str, target_lang: str) -> None:
    docs = document_stream(spark, folder, max_files_per_trigger=max(1, spark.sparkContext.defaultParallelism))  # a file a core
    q = (clean_stream(docs, target_lang)
         .writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def _accepted(spark: SparkSession, sink: str) -> DataFrame:
    """Samples in the sink: (lang, batch_id, done)."""
    if path_exists(spark, f"{sink}/batch_id=*"):  # a read that fails must not look like an empty sink
        return spark.read.parquet(sink).groupBy("lang", "batch_id").agg(F.count(F.lit(1)).alias("done"))
    return spark.createDataFrame([], "lang string, batch_id int, done long")


def quota_writer(sink: str, max_samples: int, languages: Sequence[str] | None = None, full: Event | None = None):
    """S2 ``foreachBatch`` body. ``full`` is set when every wanted language has its samples; a batch that comes then is left
    unread."""
    def all_full(spark: SparkSession) -> bool:
        have = {r["lang"]: r["done"] for r in _accepted(spark, sink).filter(F.col("lang").isin(list(languages)))
                .groupBy("lang").agg(F.sum("done").alias("done")).collect()}  # a row a wanted language
        return all(have.get(lang, 0) >= max_samples for lang in languages)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if full is not None and full.is_set():
            return
        batch = cut_lineage(batch)  # read several times below
        done = _accepted(spark, sink).filter(F.col("batch_id") != batch_id).groupBy("lang").agg(F.sum("done").alias("done"))
        quota = (batch.select("lang").distinct().join(done, "lang", "left")
                      .select("lang", F.greatest(F.lit(max_samples) - F.coalesce("done", F.lit(0)), F.lit(0)).alias("k")))
        admitted = first_k_by_id(batch, ["lang"], "doc_id", ["doc_id", "pos"], quota)
        admitted.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        if languages and full is not None and all_full(spark):
            full.set()
    return write


def run_quota_stream(spark: SparkSession, folder: str, sink: str, checkpoint: str, max_samples: int,
                     languages: Sequence[str] | None = None, glob: str = "documents*.parquet") -> None:
    """Without ``languages`` any language may still come, and all files are read."""
    docs = document_stream(spark, folder, glob).select("doc_id", "lang", "text")
    if languages is not None:
        docs = docs.filter(F.col("lang").isin(list(languages)))
    full = Event()
    paras = C.clean_corpus(C.paragraph_scan(docs))
    q = (paras.writeStream.foreachBatch(quota_writer(sink, max_samples, languages, full))
              .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    while not q.awaitTermination(0.2):
        if full.is_set():
            q.stop()
            return

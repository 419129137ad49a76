"""Sinks and small-table sources (A6-A12, A14, A15, G8): corpus text export, CSV/JSON tables,
run ledgers and file listings. All are DataFrame reads/writes; nothing passes through the
driver."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from glossa.functions import text as T
from glossa.session import path_exists

STATUS_SCHEMA = ST.StructType([ST.StructField("run_id", ST.StringType()), ST.StructField("status", ST.StringType()),
                               ST.StructField("message", ST.StringType()), ST.StructField("updated_at", ST.StringType())])
CONFIG_SCHEMA = ST.StructType([ST.StructField("run_id", ST.StringType()), ST.StructField("language", ST.StringType()),
                               ST.StructField("corpus_path", ST.StringType())])


def write_corpus_text(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Each fragment stripped and followed by a blank line (``text + '\\n\\n'``)."""
    out = df.select(*partition_by, T.py_strip(F.col("text")).alias("value"))
    w = out.write.mode("overwrite").option("lineSep", "\n\n")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.text(path)


def _corpus_lines(spark: SparkSession, path: str, sep: str | None = None, only: Column | None = None) -> DataFrame:
    """(value, path, block, pos) of the corpus files below a path, split at ``sep`` (else at line breaks) by many tasks a file.
    ``only`` picks files by ``path`` from the listing; the others aren't read."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt")
    files = (reader.option("lineSep", sep) if sep else reader).text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    return (files if only is None else files.filter(only)).select("*", F.monotonically_increasing_id().alias("pos"))


def files_without_blank_line(spark: SparkSession, path: str) -> list[str]:
    """The corpus files that have no two line breaks in a row: no empty line but, at most, the first. A name a file."""
    lines = _corpus_lines(spark, path).select("path", "block", "pos", (F.octet_length("value") == 0).alias("empty"))
    files = lines.groupBy("path").agg(F.count_if("empty").alias("n"), F.min_by("empty", F.struct("block", "pos")).alias("first"))
    return [r["path"] for r in files.filter(F.col("n") <= F.col("first").cast("int")).select("path").collect()]


def read_corpus_text(spark: SparkSession, path: str) -> DataFrame:
    """Read corpus files back as (path, doc_id, block, pos, text), one stripped, non-empty fragment a row.

    Fragments end at blank lines; a file without one has a fragment a line (A1). A first pass finds the files of the second
    kind, then each kind is read with its own record separator, so that a file of either is split over many tasks (a file whose
    blank lines are all written with carriage returns is one record). Undecodable bytes are dropped, and nothing
    else. ``(block, pos)`` orders the fragments of a file.
    """
    by_line = files_without_blank_line(spark, path)
    text = F.replace(F.make_valid_utf8("value"), F.lit(T.REPLACEMENT_CHAR), F.lit(""))
    text = F.regexp_replace(text, "\r\n?", "\n")

    def fragments(raw: DataFrame, parts) -> DataFrame:
        return raw.select("path", F.xxhash64("path").alias("doc_id"), "block", "pos", F.posexplode(parts).alias("part", "text"))

    mine = F.col("path").isin(by_line)
    # a record holds a blank line only where it was written with carriage returns
    rows = fragments(_corpus_lines(spark, path, "\n\n", ~mine if by_line else None), F.split(text, "\n\n"))
    if by_line:
        rows = rows.unionByName(fragments(_corpus_lines(spark, path, only=mine), F.split(text, T.LINE_BREAKS)))
    return (rows.select("path", "doc_id", "block", F.struct("pos", "part").alias("pos"), T.py_strip("text").alias("text"))
                .filter(F.length("text") > 0))


def write_table_csv(df: DataFrame, path: str) -> None:
    """Header CSV (parquet is the default store elsewhere)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv_safely(spark: SparkSession, path: str, schema: ST.StructType) -> DataFrame:
    """A missing or empty table is an empty DataFrame with the expected schema; other errors rise."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A9 sink."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: ST.StructType) -> DataFrame:
    """A9 source: explicit schema, bad records tolerated (PERMISSIVE); a missing path is empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def snapshot_corpus(df: DataFrame, run_dir: str) -> str:
    """A10: the run's input paragraphs, frozen as parquet inside the run folder."""
    out = f"{run_dir.rstrip('/')}/corpus"
    df.write.mode("overwrite").parquet(out)
    return out


def run_ledger(spark: SparkSession, runs_dir: str) -> DataFrame:
    """Every folder ``run_*``, newest id first; status and config merged by folder; 'unknown' / '' where a file is
    missing or broken. The id is the folder's name, whatever the files say."""
    root = runs_dir.rstrip("/")
    folder = F.regexp_extract("_metadata.file_path", r"/([^/]+)/(?:status|config)\.json(?:/[^/]*)?$", 1)

    def side(name: str, schema: ST.StructType, cols: list[str]) -> DataFrame:
        pattern = f"{root}/run_*/{name}.json"
        if not path_exists(spark, pattern):
            return spark.createDataFrame([], "run_id string, " + ", ".join(f"{c} string" for c in cols))
        df = spark.read.schema(schema).option("mode", "PERMISSIVE").json(pattern).select(folder.alias("run_id"), *cols)
        return df.groupBy("run_id").agg(*[F.max(c).alias(c) for c in cols])

    below = re.escape(re.sub(r"^[\w+.-]+:/+", "/", root)) + "/(run_[^/]+)/"
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
                  .select(F.regexp_extract("path", below, 1).alias("run_id")))  # the listing alone, no content
    ids = files.filter(F.length("run_id") > 0).distinct()
    j = (ids.join(side("status", STATUS_SCHEMA, ["status", "message", "updated_at"]), "run_id", "left")
            .join(side("config", CONFIG_SCHEMA, ["language", "corpus_path"]), "run_id", "left"))
    return (j.select("run_id", F.concat(F.lit(root + "/"), F.col("run_id")).alias("path"),
                     F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("message", F.lit("")).alias("message"),
                     F.coalesce("language", F.lit("")).alias("language"), F.coalesce("updated_at", F.lit("")).alias("updated_at"))
             .orderBy(F.desc("run_id")))


def file_listing(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """Files under ``folder`` matching ``glob`` with size in KB (content is not read)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
                  .load(folder))
    return files.select("path", F.col("length").alias("n_bytes"), F.round(F.col("length") / 1024.0, 2).alias("size_kb"))


def input_state(spark: SparkSession, path: str) -> tuple[int, int]:
    """(number of files, hash of their names, lengths and times) below a path: changes when a file is added, replaced or removed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    each = F.xxhash64("path", "length", F.col("modificationTime").cast("double")) % (1 << 40)  # sums stay in range
    return tuple(files.select(each.alias("h")).agg(F.count(F.lit(1)), F.coalesce(F.sum("h"), F.lit(0))).first())


def trainer_lines(df: DataFrame) -> DataFrame:
    """One training line per fragment, newlines as spaces."""
    return df.select(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")).alias("line"))


def save_tokenizer(vocab: DataFrame, merges: DataFrame | None, path: str, run_id: str, method: str,
                   vocab_size: int) -> str:
    """Vocabulary (and merges) as parquet partitioned by run / method / size. Saving again replaces that
    tokenizer and no other."""
    keys = {"run_id": run_id, "method": method, "vocab_size": int(vocab_size)}
    for name, df in (("vocab", vocab), ("merges", merges)):
        if df is not None:
            (df.select("*", *[F.lit(v).alias(k) for k, v in keys.items()]).write.mode("overwrite")
               .option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{path}/{name}"))
    return f"{path}/vocab/run_id={run_id}/method={method}/vocab_size={vocab_size}"


def tokenizer_path(path: str, run_id: str) -> Column:
    """Where ``save_tokenizer`` puts the vocabulary of each row's (method, vocab_size)."""
    return F.concat(F.lit(f"{path}/vocab/run_id={run_id}/method="), F.col("method"), F.lit("/vocab_size="), F.col("vocab_size").cast("string"))


def write_status(spark: SparkSession, run_dir: str, run_id: str, status: str, message: str = "") -> None:
    """A run's status for the ledger (A11), one row."""
    row = spark.createDataFrame([(run_id, status, message)], "run_id string, status string, message string")
    write_json(row.withColumn("updated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")), f"{run_dir}/status.json")

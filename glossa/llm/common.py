"""Shared helpers of the training-data operators: table access, expression binding, Arrow batches,
and cutting lineage into the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.session import cut_lineage, ensure_checkpoint_dir, ship_package

#: Rows and bytes of an Arrow batch: bound a Python worker's memory (a single longer text is a batch of its own).
#: Each setting replaces Spark's default only, never a session's own choice.
ARROW_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
                 "spark.sql.execution.arrow.maxBytesPerBatch": ("2147483647b", "16777216b")}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Ship the package to Python workers and keep Arrow batches of text small."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    for key, (default, ours) in ARROW_BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared checkpoint folder, readable by every executor."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"


def store(df: DataFrame) -> DataFrame:
    """Compute once and cut lineage: a reliable checkpoint in the shared folder, so later reads
    survive lost executors. Spark's cleaner removes the files with the last reference where the session
    sets ``spark.cleaner.referenceTracking.cleanCheckpoints``."""
    return cut_lineage(df)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it in ``body``: a lambda variable is evaluated a single time,
    where a plain column reference may be inlined into every use by the optimizer."""
    return F.transform(F.array(value), body)[0]


def with_fields(schema: T.StructType, *fields: tuple[str, str]) -> T.StructType:
    """``schema`` with (name, type) fields appended."""
    extra = [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields]
    return T.StructType([*schema.fields, *extra])


def as_bytes(col: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, None for null."""
    return col.cast(pa.large_binary()).to_pylist()


def map_docs(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]],
             schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with the package shipped."""
    prepare(df.sparkSession)
    return df.mapInArrow(fn, schema)


def free_name(df: DataFrame, base: str) -> str:
    """A column name not yet used in ``df`` (case-insensitively)."""
    used = {c.lower() for c in df.columns}
    name = base
    while name.lower() in used:
        name = "_" + name
    return name

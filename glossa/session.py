"""Session helpers: building a session, the checkpoint folder, size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from threading import Lock

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Rows a side may have before we stop hinting a broadcast.
BROADCAST_MAX_ROWS = 1_000_000


def build_session(master: str | None = None, app: str = "glossa", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session with AQE on and the UI off. On a cluster leave ``master`` None."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if (master or "").startswith("local"):  # executors live in the driver there; on a cluster its size is the caller's
        conf["spark.driver.memory"] = "16g"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``; only when the session names
    none and runs locally (tests) take a fresh scratch folder of our own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="glossa-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """The rows as compressed files in the shared checkpoint folder, for steps that read them several times within the block; a checkpoint
    holds rows uncompressed, and until they are collected as garbage."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def local_frame(spark: SparkSession, rows: Sequence[Sequence], schema: StructType | str) -> DataFrame:
    """A small table of the driver as a local relation: a job on it starts no Python worker."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not rows:
        return spark.createDataFrame([], schema)
    fields = to_arrow_schema(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=fields), schema)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, known_rows: int | None = None) -> DataFrame:
    """Broadcast hint only behind a row-count check (which stops reading at the bound); above it
    the planner's shuffle join (with AQE skew splitting) is used instead."""
    n = known_rows if known_rows is not None else df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names anything, in any store Spark reaches. Other errors rise."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin the rows over the cluster when a scan yields fewer partitions than cores
    (one small file is one split). Large inputs already have enough splits and are left alone,
    so no shuffle is added at scale."""
    if df.isStreaming:
        return df
    sc = df.sparkSession.sparkContext
    want = min_partitions or sc.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


_SHIPPED: set[int] = set()
_SHIPPING = Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``glossa`` importable in Python workers (mapInPandas helpers) by shipping the
    package as a zip with ``addPyFile``; once per SparkContext."""
    import shutil
    sc = spark.sparkContext
    key = id(sc._jsc)
    with _SHIPPING:  # runs and methods at the same time ship one file: Spark refuses a second one of its name
        if key in _SHIPPED:
            return
        pkg = os.path.dirname(os.path.abspath(__file__))
        out = tempfile.mkdtemp(prefix="glossa-pyfiles-")
        zpath = shutil.make_archive(os.path.join(out, "glossa"), "zip", os.path.dirname(pkg), os.path.basename(pkg))
        sc.addPyFile(zpath)
        _SHIPPED.add(key)

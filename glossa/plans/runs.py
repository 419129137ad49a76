"""Runs kept in folders (A9-A11, A14, A15, G8): a run's input, tokenizers and tables become visible together.

Everything of a run is written below ``<runs_dir>/<run_id>`` while its status says ``running``; the status that readers go by
is written last, after all the rest. A run that fails or is lost on the way is listed as such and its tables are never read.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.plans.experiment import ExperimentParams, ExperimentResult, run_experiment
from glossa.session import path_exists
from glossa.sources import io as IO

#: Statuses of runs whose tables are whole.
COMMITTED = ("completed", "partially_completed")


def run_in_folder(spark: SparkSession, paragraphs: DataFrame, p: ExperimentParams, runs_dir: str, run_id: str,
                  corpus_path: str = "", detected: str = "lang") -> ExperimentResult:
    """One experiment on a snapshot of its input, with the snapshot (``corpus``), the train side as lines (``trainer_lines``),
    the tokenizers, the parameters (``config.json``) and the tables (``results``, ``errors``, ``split_stats``) in its own folder.

    ``run_id`` begins with ``run_``, as the ledger lists those, and must be new. Errors rise once the status says ``failed``; a run in
    which no cell succeeds has the status ``failed`` too.
    """
    if not run_id.startswith("run_") or "/" in run_id:
        raise ValueError(f"a run's id begins with run_ and is one folder name: {run_id}")
    folder = f"{runs_dir.rstrip('/')}/{run_id}"
    if path_exists(spark, folder):
        raise ValueError(f"there is a run at {folder}")
    IO.write_status(spark, folder, run_id, "running")
    try:
        config = json.dumps({"run_id": run_id, "corpus_path": corpus_path, **asdict(p)})
        spark.createDataFrame([(config,)], "value string").coalesce(1).write.text(f"{folder}/config.json")
        frozen = spark.read.parquet(IO.snapshot_corpus(paragraphs, folder))
        out = run_experiment(spark, frozen, p, f"{folder}/tokenizers", run_id, detected, f"{folder}/trainer_lines")
        if out.status != "failed":
            results = out.results.withColumn("tokenizer_path", IO.tokenizer_path(f"{folder}/tokenizers", run_id))
            results.withColumn("run_id", F.lit(run_id)).write.parquet(f"{folder}/results")
        out.errors.write.parquet(f"{folder}/errors")
        out.split_stats.write.parquet(f"{folder}/split_stats")
    except Exception as e:
        IO.write_status(spark, folder, run_id, "failed", repr(e))
        raise
    IO.write_status(spark, folder, run_id, out.status, f"{out.errors.count()} failed cells")
    return out


def committed_results(spark: SparkSession, runs_dir: str) -> DataFrame:
    """The result rows of all runs that the ledger lists as whole; no column but ``run_id`` where there is none."""
    ledger = IO.run_ledger(spark, runs_dir).filter(F.col("status").isin(*COMMITTED))
    folders = [f"{r['path']}/results" for r in ledger.select("path").collect()]  # a row a run
    if not folders:
        return spark.createDataFrame([], "run_id string")
    return spark.read.option("mergeSchema", "true").parquet(*folders)

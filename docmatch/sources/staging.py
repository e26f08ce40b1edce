"""Shared-storage staging: results that must not be recomputed are written once and read back.

Model calls are expensive and may not be repeatable, so their output is cut from its lineage by a
written table. A lost executor then costs a re-read, not a second model call.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
# The run that a thread stages for. A plain table, since functions of this package travel by value.
_RUNS: dict[int, str | None] = {}


def stage_root(spark: SparkSession) -> str:
    """Shared folder named by the session; a local session without one gets a new folder."""
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="docmatch-"))
    return context.getCheckpointDir()


def _folder(spark: SparkSession, run_id: str | None) -> str:
    # A run's name may hold anything; its folder has letters and digits.
    part = "" if run_id is None else f"/run-{uuid.uuid5(uuid.NAMESPACE_URL, run_id).hex}"
    return f"{stage_root(spark)}/docmatch{part}"


@contextmanager
def staged_by(run_id: str | None) -> Iterator[None]:
    """Tables staged within belong to a run; without one they belong to nobody and stay."""
    outer = _RUNS.get(get_ident())
    _RUNS[get_ident()] = run_id
    try:
        yield
    finally:
        _RUNS[get_ident()] = outer


def remove_run(spark: SparkSession, run_id: str) -> bool:
    """Delete the staged tables of a finished run, by name, wherever the shared folder lies. Its results must have
    been written elsewhere by then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark, run_id))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{_folder(spark, _RUNS.get(get_ident()))}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and return the stored table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

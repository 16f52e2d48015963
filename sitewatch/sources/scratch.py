"""Where jobs put intermediate tables that must outlive an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Paths of the owners that are open, the innermost last.
_owned: list[list[str]] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session.

    The cluster names it in ``spark.checkpoint.dir``. Only a session whose driver runs all tasks
    itself may go without: it gets a temporary folder that goes with the process. Elsewhere a
    folder of one machine would be lost with that machine, so the setting is required.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="sitewatch-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _owned:
        _owned[-1].append(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path of any store that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are dropped at the end, also when it fails.

    Results that are to last must have been written elsewhere by then.
    """
    paths: list[str] = []
    _owned.append(paths)
    try:
        yield
    finally:
        _owned.remove(paths)
        for path in paths:
            drop(spark, path)


def frozen(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder and read back.

    Its lineage ends here: a lost executor costs a read instead of a recomputation, and
    columns with run-dependent values keep them. Being a table of known size with columns to
    choose from, it is pruned and broadcast like any other.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

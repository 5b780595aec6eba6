"""Writes: versions of tables, rejects, audit records, and results that later jobs of a query read again."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_scope = threading.local()


def _hadoop(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def durable(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written to the folder that the cluster shares (``spark.checkpoint.dir``) and read back, so that no job computes it again.

    Only in local mode, where the setting is missing, a temporary folder takes its place. What an application has written goes when it ends,
    what a ``sealed()`` step has written on its way when the step ends. A part of it by columns ``by`` can be read alone.
    """
    return written(df, *by)[0]


def written(df: DataFrame, *by: str) -> tuple[DataFrame, str]:
    """``durable()``, and where it lies, for ``discard()``."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="topspin-")
        spark.conf.set("spark.checkpoint.dir", base)
    own = f"{base.rstrip('/')}/topspin/{spark.sparkContext.applicationId}"
    path = f"{own}/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    folder, files = _hadoop(spark, own)
    files.deleteOnExit(folder)
    if getattr(_scope, "paths", None) is not None:
        _scope.paths.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes what ``written()`` has written, once nothing reads it any more."""
    for path in paths:
        at, files = _hadoop(spark, path)
        files.delete(at, True)


def sealed(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``step`` with its result written; its intermediates go at once, so that they don't add up over the steps of a query."""

    @wraps(step)
    def run(*args: object, **more: object) -> DataFrame:
        outer, own = getattr(_scope, "paths", None), []
        _scope.paths = own
        try:
            out = step(*args, **more)
            _scope.paths = outer
            out = durable(out)
        finally:
            _scope.paths = outer
        discard(out.sparkSession, *own)
        return out

    return run


def split_rejects(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that are valid, and the others: bad records go to an output of their own in place of a retry."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def write_version(df: DataFrame, folder: str, version: int, partition_by: tuple[str, ...] = ()) -> str:
    """A new version of a table beside the old ones; a failed write leaves them as they are."""
    path = f"{folder.rstrip('/')}/v{version:08d}"
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    return path


def append_audit(df: DataFrame, folder: str, kind: str) -> None:
    """Append records with their other columns as JSON (without nulls)."""
    df.select(F.lit(kind).alias("update_type"), F.to_json(F.struct(*df.columns)).alias("details")).write.mode("append").parquet(folder)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))

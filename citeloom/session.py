"""Session helpers: tables of a scale directory, the shared folder, materialised intermediates."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a scale directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a local session (one machine) gets a temporary folder; a cluster gets an error, as a folder of one machine would lose data.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='citeloom-')}"
    if not held.isDefined():
        sc.setCheckpointDir(path)
    return path


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/citeloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for one intermediate table."""
    return f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, *parts: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder, in folders of the columns ``parts``, and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    (df.write.partitionBy(*parts) if parts else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; DataFrames that read them must be done with."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(df: DataFrame) -> None:
    """Delete one intermediate table as ``materialise`` gave it; nothing may read it any more."""
    spark = df.sparkSession
    for folder in {f"{_own_dir(spark)}/{re.search(f'/{spark.sparkContext.applicationId}/([^/]+)/', file)[1]}" for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system of the cluster."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_file(spark: SparkSession, path: str, parts: Iterable[str]) -> None:
    """Write one text file on any file system of the cluster: beside the target first, then renamed, so that a reader never sees half of it."""
    names = spark._jvm.org.apache.hadoop.fs
    target, part = names.Path(path), names.Path(f"{path}.part")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(part, True)
    try:
        for text in parts:
            out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    system.delete(target, False)
    if not system.rename(part, target):
        raise OSError(f"can't rename to {path}")


def open_shared(path: str) -> pa.NativeFile:
    """A file of the shared folder as Spark names it, opened from Python on an executor."""
    if "://" not in path:
        path = path.replace("file:/", "file:///", 1)
    elif path.startswith(("s3a://", "s3n://")):
        path = f"s3://{path.partition('://')[2]}"
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)

"""Cutting lineage: tables written to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for cut lineage (spark.checkpoint.dir).

    Where it is unset, as in tests, a temporary folder will do for a single machine; on a cluster it would lie on one machine only.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


_open: list[list[str]] = []  # of each `staged` block that is running: the paths staged in it and not released


@contextmanager
def staged() -> Iterator[list[str]]:
    """The paths that are staged within the block and still there at its end."""
    paths: list[str] = []
    _open.append(paths)
    try:
        yield paths
    finally:
        _open[:] = [p for p in _open if p is not paths]


def stage(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it again: (table, path). It survives the loss of any executor.

    What is not released before goes when the session ends.
    """
    path = f"{shared_folder(df.sparkSession)}/corvane-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    for paths in _open:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that no later plan reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        for known in _open:
            if path in known:
                known.remove(path)
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        fs.delete(p, True)
        fs.cancelDeleteOnExit(p)

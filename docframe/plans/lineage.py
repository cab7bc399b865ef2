"""Cutting lineage with tables in the cluster's shared folder.

``materialise`` writes a DataFrame as parquet below ``spark.checkpoint.dir`` and reads it back, so that an iterative
plan stays short, a lost executor costs a re-read and not a recomputation, and the optimizer knows the table's real
size.  The folder is read from the session; only where it is unset (tests, a laptop) a temporary one is made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; set for this session only where the cluster names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="docframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame, name: str = "t", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` below the shared folder and return the table read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.mode("error").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_removed(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/docframe/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def release(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialise`` that nothing will read again."""
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        for item in [w for w in _written if path.endswith(w[1].removeprefix("file://").rstrip("/"))]:
            _delete(*item)
            _written.remove(item)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Actions inside delete their shuffle files as they end, which nothing reads again once their result is written or collected."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def _clean() -> None:
    for item in _written:
        try:
            _delete(*item)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            pass

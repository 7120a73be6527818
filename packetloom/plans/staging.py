"""Tables written between steps of one operator.

A staged table cuts the lineage for good: it lies in the folder that all executors share, so a lost executor costs the
tasks it was running and nothing else. Column pruning and filters reach a staged table as any other parquet table, which
a checkpointed RDD does not offer.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one of its own only where that is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="packetloom-"))
    return _LOCAL[0]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hadoop).delete(p, True)
    except Exception:  # the gateway may be gone already when the interpreter ends
        pass


#: Paths of the scopes that are open, the innermost last; those of the first go when the interpreter ends.
_SCOPES: list[list[tuple[SparkSession, str]]] = [[]]


@contextmanager
def scope() -> Iterator[None]:
    """Tables staged inside are removed at its end: results that read them must be written or collected by then.

    A session that lives long runs each query in a scope of its own, so its folder does not fill up.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for spark, path in _SCOPES.pop():
            _remove(spark, path)


@atexit.register
def _end() -> None:
    for spark, path in _SCOPES[0]:
        _remove(spark, path)


def claim(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed with the scope it was claimed in."""
    path = f"{shared_folder(spark)}/staged/{name}-{uuid.uuid4().hex}"
    _SCOPES[-1].append((spark, path))
    return path


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and returns the table read back; removed with the scope it was staged in."""
    spark = df.sparkSession
    path = claim(spark, name)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

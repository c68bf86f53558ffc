"""The shared folder, and tables staged in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a session on this machine alone takes a temporary folder, a cluster gets an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        folder = _own_folder[0]
    return folder.rstrip("/")


def staged(df: DataFrame, folder: str, rows: int = 0) -> DataFrame:
    """``df`` written below ``folder`` and read back, so that what it was read from may be overwritten.  ``rows`` bounds the rows of a file:
    texts are small on disk, and few tasks would read them."""
    path = f"{folder}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, folder: str, by: str, buckets: int) -> DataFrame:
    """``df`` like ``staged``, as a table in buckets of a key: what later joins or groups it by that key shuffles nothing.

    ``df`` comes partitioned by the key into as many parts, or else every task writes to every bucket.
    """
    name = f"staged_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", f"{folder}/staged-{name[7:]}").bucketBy(buckets, by).sortBy(by).saveAsTable(name)
    return df.sparkSession.table(name)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


_made: dict[tuple, DataFrame] = {}


def made_once(spark: SparkSession, key: tuple, make: Callable[[], DataFrame], write: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """What ``make`` gives, written to the shared folder (as ``staged`` does, or ``write``) once for each session and ``key``, and again if
    it is gone from there."""
    key = (spark.sparkContext.applicationId, *key)
    files = _made[key].inputFiles() if key in _made else []
    if not files or not exists(spark, files[0].rsplit("/", 1)[0] + "/_SUCCESS"):
        _made[key] = (write or staged)(make(), f"{shared_folder(spark)}/made")
    return _made[key]

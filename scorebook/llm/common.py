"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by whatever path scheme Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_folder: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Where it is unset, a session on this machine alone
    (master local) takes a temporary folder, and a cluster gets an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        folder = _own_folder[0]
    return folder.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage with a table that survives lost executors, and unlike ``checkpoint()`` computes the
    input once.  The tables stay until the cluster clears its checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def counted(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A staged table of a few numbers in a row, with a hint to broadcast it if it has at most ``most`` rows, so that a join
    doesn't move the texts it picks from."""
    return F.broadcast(df) if df.count() <= most else df


def buckets_for(spark: SparkSession, chars: int, most: int = 32_000_000) -> int:
    """Buckets for what is computed from ``chars`` characters: at most ``most`` of them in each, and two for each shuffle partition at least."""
    return max(2 * partitions(spark), -(-chars // most))


def by_bucket(df: DataFrame, buckets: int):
    """Groups of ``bucket``, each number in a partition of its own, so that none holds several by chance."""
    return df.repartitionById(buckets, "bucket").groupBy("bucket")


def characters(own: DataFrame) -> int:
    return own.agg(F.sum(F.length("_text"))).first()[0] or 0


def release() -> None:
    """Gives memory that a Python worker has freed back to the system, as workers live on for later stages of other operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, which has no such call


def slices(batches: Iterator[pd.DataFrame], column: str = "_text", chars: int = 1_500_000) -> Iterator[pd.DataFrame]:
    """The rows of Arrow batches in parts of about ``chars`` characters, so that what is computed from them stays small."""
    for pdf in batches:
        part = (np.cumsum(pdf[column].str.len().to_numpy()) - 1) // chars
        for _, piece in pdf.groupby(part, sort=False):
            yield piece
    release()


NULL_ID = -(1 << 63)  # stands for a null doc_id inside tasks, where a null would turn a column of ids into floats


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns the operators need, so clashing or extra columns never matter.  Null text is empty, a null doc_id NULL_ID."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def null_back(df: DataFrame, column: str = "doc_id") -> DataFrame:
    return df.withColumn(column, F.nullif(F.col(column), F.lit(NULL_ID)))


def null_column(df: DataFrame) -> DataFrame:
    """Gives doc_id, filled for Python, its nulls back where _null says so."""
    return df.withColumn("doc_id", F.when(~F.col("_null"), F.col("doc_id"))).drop("_null")


def numbered(docs: DataFrame, content: Sequence[str] = ("text",), each: bool = False) -> DataFrame:
    """(_id, row) of every row of ``docs``: the row itself, and a number for its document in the order of doc_id.

    Where every row has a doc_id of its own, that is the number.  Else the numbers follow doc_id (nulls first), then a
    hash of ``content``: rows under one doc_id are one document only if their contents are equal, and every row
    with a null doc_id, or with ``each`` every row at all, is a document of its own.  All columns travel inside ``row``, so no name can clash.
    """
    known = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    ids = known.select(F.col("row.doc_id").cast("long").alias("i"))
    if ids.groupBy("i").count().filter("i IS NULL OR count > 1").isEmpty():
        return known.select(F.col("row.doc_id").cast("long").alias("_id"), "row")
    rows = known.select("row", F.col("row.doc_id").cast("long").alias("_d"), F.xxhash64(*(F.col(f"row.{c}") for c in content)).alias("_h"), F.monotonically_increasing_id().alias("_m"))
    own = F.lit(True) if each else F.col("_d").isNull()
    rows = stage(rows.withColumn("_m", F.when(own, F.col("_m")).otherwise(F.lit(-1))), "rows")
    keys = rows.select("_d", "_h", "_m").distinct()
    # range partitions are in order, and so are the numbers of their sorted rows
    order = [F.col("_d").asc_nulls_first(), F.col("_h"), F.col("_m")]
    ranked = stage(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "numbers").toDF("_e", "_g", "_n", "_id")
    same = F.col("_d").eqNullSafe(F.col("_e")) & (F.col("_h") == F.col("_g")) & (F.col("_m") == F.col("_n"))
    return rows.join(ranked, same).select("_id", "row")


def texts_of(known: DataFrame) -> DataFrame:
    """(_id, _text) of ``numbered`` rows; a null text is empty."""
    return known.select("_id", F.coalesce(F.col("row.text"), F.lit("")).alias("_text"))

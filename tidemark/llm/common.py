"""Shared plumbing: checkpoints in the cluster's shared folder, Arrow text access, grouped batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"


#: Spark's setting that removes the shuffle files of an execution at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir: the cluster's shared one.

    Where it is unset, a temporary one in local mode and an error on a cluster, whose machines would not share it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and drop the lineage, and with it the shuffle files that led there."""
    spark = df.sparkSession
    _checkpoint_dir(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the plan made here takes the setting
    finally:
        spark.conf.set(_CLEANUP, before)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(*frames: DataFrame | None) -> None:
    """Delete the files of frames that came from cut() and that no plan still in use reads."""
    for df in frames:
        if df is not None:
            files = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
            if files.isDefined():
                _delete(df.sparkSession, files.get())


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name within the shared one, for tables that jobs write and read again."""
    return f"{_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table written to a folder of shared_folder()."""
    _delete(spark, path)


def fresh(name: str, taken: list[str]) -> str:
    """The name, or one with more underscores before it, that no column of a table has (in any case of letters)."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name = f"_{name}"
    return name


def as_text(column: str) -> Column:
    """The column as a string that is never null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the rows' offsets into them, without decoding. Null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about most_bytes together, each of one row at least: bounds the memory of vector code."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from concatenated values and each row's number of them."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))

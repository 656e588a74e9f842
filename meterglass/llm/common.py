"""Helpers that several of the text operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text that a task works on at once inside an Arrow batch.
SLICE_BYTES = 1 << 20

#: Maps A-Z to a-z, keeps digits, letters and all bytes of non-ASCII characters, and makes everything else a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plus(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of df with more columns."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns of these names under others, and what to rename back once an operator has added its own."""
    back = {f"_set_aside_{i}": c for i, c in enumerate(df.columns) if c in names}
    return df.withColumnsRenamed({c: own for own, c in back.items()}), back


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset, a temporary folder stands in if all runs on this machine; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and goes on from there, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words: maximal runs of ASCII letters and digits and of anything that isn't ASCII."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split()


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text, one row at least: memory stays bounded."""
    for batch in batches:
        if batch.num_rows:
            yield from parts(batch, np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)), most)


def parts(batch: pa.RecordBatch, ends: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` in size, one row at least; ends: the running sum of the rows' sizes."""
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

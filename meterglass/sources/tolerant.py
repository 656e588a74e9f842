"""Exports with files that fail: what can be read of them is read, and each file that fails is told with what went wrong.

A file fails where it cannot be opened, breaks off or does not decode; rows that were read before stay. Spark's own
readers either stop at such a file or leave it out without a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from .exports import opened

#: Bytes of a plain text file that one task reads, bytes that are read at once, and what opening a file counts for.
BLOCK, CHUNK, OPENING = 128 << 20, 1 << 20, 4 << 20
PACKED = (".gz", ".bz2", ".zst")
FAILURES = (OSError, pa.ArrowInvalid, UnicodeError)


class UnreadableFile(OSError):
    """A file of an export that must be whole cannot be read."""


def listed(spark: SparkSession, *paths: str, pattern: str) -> DataFrame:
    """(path, length) of the files below the paths that have any bytes, as Spark leaves out empty ones; none is opened."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(list(paths))
    return rows.select("path", "length")


def _dealt(files: DataFrame, size: Column) -> DataFrame:
    """(path, start, end) in as many tasks as the bytes are blocks; size: the bytes of a file that stay together."""
    spans = F.sequence(F.lit(0).cast("bigint"), F.greatest("length", F.lit(1)) - 1, size.cast("bigint"))
    blocks = files.select("path", "length", size.alias("size"), F.explode(spans).alias("start"))
    blocks = blocks.select("path", "start", F.least(F.col("start") + F.col("size"), "length").alias("end"), (F.col("length") > F.col("size")).alias("many"))
    tasks = blocks.agg(F.ceil(F.sum(F.col("end") - F.col("start") + OPENING) / BLOCK)).first()[0]
    return blocks.repartition(max(int(tasks or 1), 1), "path", "start")


def starting_within(file: pa.NativeFile, start: int, end: int | None) -> Iterator[bytes]:
    """Lines that start in [start, end) of a file that is open at start, or one byte before it where that isn't 0."""
    at, rest = max(start - 1, 0), b""
    skip = start > 0  # the line that the byte before belongs to is another block's
    while end is None or at < end:
        chunk = file.read(CHUNK)
        if not chunk:
            break
        *whole, last = chunk.split(b"\n")
        if whole:
            whole[0], rest = rest + whole[0], last
        else:
            rest += last
        for line in whole:
            if skip:
                skip = False
            elif end is None or at < end:
                yield line
            at += len(line) + 1
    if rest and not skip and (end is None or at < end):
        yield rest


def _told(one: Callable[[str, int, int, bool], Iterator[pa.RecordBatch]], schema: pa.Schema) -> Callable:
    """For mapInArrow over (path, start, end, many): batches of `one`, and where it fails a row that has only path, start and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for span in batch.to_pylist():
                try:
                    yield from one(span["path"], span["start"], span["end"], span["many"])
                except FAILURES as e:
                    known = {"path": span["path"], "start": span["start"], "error": f"{type(e).__name__}: {e}"[:500]}
                    yield pa.RecordBatch.from_pylist([known], schema=schema)

    return run


LINES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("many", pa.bool_()), ("nth", pa.int64()), ("value", pa.string()), ("error", pa.string())])


def _lines_of(path: str, start: int, end: int, many: bool) -> Iterator[pa.RecordBatch]:
    fs, inside = opened(path)
    packed = path.endswith(PACKED)
    nth, size, held = 0, 0, []

    def batch() -> pa.RecordBatch:
        n = len(held)
        texts = [v.removesuffix(b"\r").decode("utf-8", "replace") for v in held]
        columns = [[path] * n, [start] * n, [many] * n, range(nth - n + 1, nth + 1), texts, [None] * n]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, LINES.types, strict=True)], schema=LINES)

    with fs.open_input_stream(inside, compression="detect") if packed else fs.open_input_file(inside) as file:
        if start:
            file.seek(start - 1)
        try:
            for line in starting_within(file, start, None if packed else end):
                held.append(line)
                nth, size = nth + 1, size + len(line)
                if size >= CHUNK or len(held) == 4096:
                    yield batch()
                    size, held = 0, []
        except FAILURES:
            yield batch()
            raise
        yield batch()


def _document_of(path: str, start: int, end: int, many: bool) -> Iterator[pa.RecordBatch]:
    fs, inside = opened(path)
    with fs.open_input_stream(inside, compression="detect") as file:
        yield pa.RecordBatch.from_pylist([{"path": path, "start": 0, "many": False, "nth": 1, "value": file.read().decode("utf-8", "replace")}], schema=LINES)


def _staged(spans: DataFrame, one: Callable, schema: pa.Schema, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows, failures) of one reading of the spans, written to the folder."""
    rows = spans.mapInArrow(_told(one, schema), from_arrow_schema(schema))
    rows.withColumn("failed", F.col("error").isNotNull()).write.mode("overwrite").partitionBy("failed").parquet(folder)
    held = spans.sparkSession.read.schema(from_arrow_schema(schema).add("failed", "boolean")).parquet(folder)
    return held.where("not failed").drop("failed", "error"), held.where("failed").select("path", "start", "error")


def _files(listed_: DataFrame, failures: DataFrame) -> DataFrame:
    """(path, readable, error) of all files; a file that fails in several blocks is one."""
    failed = failures.groupBy("path").agg(F.min_by("error", "start").alias("error"))
    return listed_.join(failed, "path", "left").select("path", F.col("error").isNull().alias("readable"), "error")


def _listing(spark: SparkSession, folder: str, paths: tuple[str, ...], pattern: str) -> DataFrame:
    """The files as they were when the reading began."""
    listed(spark, *paths, pattern=pattern).write.mode("overwrite").parquet(f"{folder}/files")
    return spark.read.schema("path string, length bigint").parquet(f"{folder}/files")


def lines(spark: SparkSession, folder: str, *paths: str, pattern: str = "*.jsonl{,.gz}") -> tuple[DataFrame, DataFrame]:
    """((path, line, value), (path, readable, error)): what `lines.read` gives, also of packed files, and how each file fared.

    Files are read once, what was read lies in the folder. Lines end at a line feed and are numbered where they are read;
    only files of several blocks meet the numbers of lines before. Of these nothing stays after the first block that fails.
    """
    files = _listing(spark, folder, paths, pattern)
    plain = ~F.lower("path").rlike(r"\.(gz|bz2|zst)$")
    spans = _dealt(files, F.when(plain, F.lit(BLOCK)).otherwise(F.greatest("length", F.lit(1))))
    rows, failures = _staged(spans, _lines_of, LINES, f"{folder}/lines")
    blocks = rows.where("many").groupBy("path", "start").agg(F.max("nth").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    broken = failures.groupBy("path").agg(F.min("start").alias("broken"))
    blocks = blocks.select("path", "start", before.alias("before")).join(broken, "path", "left").where("broken is null or start <= broken")
    parts = rows.where("many").join(blocks, ["path", "start"]).select("path", (F.col("before") + F.col("nth")).alias("line"), "value")
    return rows.where("not many").select("path", F.col("nth").alias("line"), "value").unionByName(parts), _files(files, failures)


def documents(spark: SparkSession, folder: str, *paths: str, pattern: str = "*.json{,.gz}") -> tuple[DataFrame, DataFrame]:
    """((path, value), (path, readable, error)) of whole files; nothing stays of one that fails."""
    files = _listing(spark, folder, paths, pattern)
    rows, failures = _staged(_dealt(files, F.greatest("length", F.lit(1))), _document_of, LINES, f"{folder}/documents")
    return rows.select("path", "value"), _files(files, failures)


def tables(spark: SparkSession, folder: str, schema: str, *paths: str, pattern: str = "*.parquet") -> tuple[DataFrame, DataFrame]:
    """(rows of the schema, (path, readable, error)) of Parquet files; a column that a file lacks is null.

    A task reads the row groups that start in its block. A file without a footer has no rows; of one that breaks off
    later, the batches before stay.
    """
    files = _listing(spark, folder, paths, pattern)
    wanted = to_arrow_schema(spark.createDataFrame([], schema).schema)
    out = pa.schema([("path", pa.string()), ("start", pa.int64()), ("row", pa.struct(list(wanted))), ("error", pa.string())])

    def groups_of(path: str, start: int, end: int, many: bool) -> Iterator[pa.RecordBatch]:
        fs, inside = opened(path)
        with fs.open_input_file(inside) as file:
            parquet = pq.ParquetFile(file)
            chunks = [parquet.metadata.row_group(g).column(0) for g in range(parquet.metadata.num_row_groups)]
            starts = [min(c.data_page_offset, c.dictionary_page_offset or c.data_page_offset) for c in chunks]
            have = [n for n in wanted.names if n in parquet.schema_arrow.names]
            for batch in parquet.iter_batches(1024, row_groups=[g for g, at in enumerate(starts) if start <= at < end], columns=have):
                n = batch.num_rows
                columns = [batch[f.name].cast(f.type) if f.name in have else pa.nulls(n, f.type) for f in wanted]
                row = pa.StructArray.from_arrays(columns, fields=list(wanted))
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([start] * n, pa.int64()), row, pa.nulls(n, pa.string())], schema=out)

    rows, failures = _staged(_dealt(files, F.lit(BLOCK)), groups_of, out, f"{folder}/rows")
    return rows.select("row.*"), _files(files, failures)


def whole(files: DataFrame) -> None:
    """Raises if one of the files (path, readable, error) isn't readable."""
    first = files.where("not readable").orderBy("path").first()
    if first:
        raise UnreadableFile(f"{first['path']}: {first['error']}")

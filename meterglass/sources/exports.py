"""A message export as a streaming source: each batch reads what was updated since the last, and a day before that again.

`spark.dataSource.register(MessageExport)`, then `spark.readStream.format("message_export").load(folder)`. The offset is
the latest update time that was read, so a restarted stream goes on from its checkpoint and reads only the overlap again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Rows are read again if they were updated in this time before the last batch's end: what was written late.
OVERLAP_MS = 86_400_000
COLUMNS = pa.schema([("id", pa.string()), ("session_id", pa.string()), ("time_created", pa.int64()), ("time_updated", pa.int64()), ("data", pa.string())])


def opened(path: str) -> tuple[pf.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[len("file:"):]
    return pf.FileSystem.from_uri(path)


@dataclass
class Block(InputPartition):
    """A row group of a file, and the update times that are wanted of it: from low (None: all) to high."""

    path: str
    group: int
    low: int | None
    high: int


class Updates(DataSourceStreamReader):
    """Offsets are {"cursor": latest update time}, null before the first batch."""

    def __init__(self, path: str, overlap_ms: int):
        self.path, self.overlap_ms = path, overlap_ms
        self.spans: dict[tuple, list[tuple[int, int] | None]] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"cursor": None}

    def latestOffset(self) -> dict:  # noqa: N802
        ends = [s[1] for _, spans in self.files() for s in spans if s]
        return {"cursor": max(ends) if ends else None}

    def files(self) -> Iterator[tuple[str, list[tuple[int, int] | None]]]:
        """(path, first and last update time of each row group; None for groups without rows), from footers alone.

        A footer is read once, as long as its file stays as it is.
        """
        fs, root = opened(self.path)
        listed = fs.get_file_info(pf.FileSelector(root, recursive=True, allow_not_found=True))
        now = {}
        for f in sorted(listed, key=lambda f: f.path):
            if f.is_file and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")):
                key = (f.path, f.size, f.mtime_ns)
                now[key] = self.spans[key] if key in self.spans else self.footer(fs, f.path)
                yield f.path, now[key]
        self.spans = now

    @staticmethod
    def footer(fs: pf.FileSystem, path: str) -> list[tuple[int, int] | None]:
        with fs.open_input_file(path) as file:
            parquet = pq.ParquetFile(file)
            at = parquet.schema_arrow.names.index("time_updated")
            spans = []
            for g in range(parquet.metadata.num_row_groups):
                stats = parquet.metadata.row_group(g).column(at).statistics
                if stats is None or not stats.has_min_max:  # written without statistics: the one column tells
                    seen = pc.min_max(parquet.read_row_group(g, columns=["time_updated"])["time_updated"]).as_py()
                    spans.append(None if seen["min"] is None else (seen["min"], seen["max"]))
                else:
                    spans.append((stats.min, stats.max))
        return spans

    def partitions(self, start: dict, end: dict) -> list[Block]:
        high = end["cursor"]
        if high is None:
            return []
        low = None if start["cursor"] is None else start["cursor"] - self.overlap_ms
        return [Block(path, g, low, high) for path, spans in self.files() for g, s in enumerate(spans) if s and s[0] <= high and (low is None or s[1] >= low)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        with fs.open_input_file(partition.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(1024, row_groups=[partition.group], columns=COLUMNS.names):
                wanted = pc.less_equal(batch["time_updated"], partition.high)
                if partition.low is not None:
                    wanted = pc.and_(wanted, pc.greater_equal(batch["time_updated"], partition.low))
                rows = pa.Table.from_batches([batch]).filter(wanted).select(COLUMNS.names).cast(COLUMNS)
                yield from rows.to_batches()


class MessageExport(DataSource):
    """Options: path, a folder of Parquet files; overlap_ms. Rows without an update time are never read."""

    @classmethod
    def name(cls) -> str:
        return "message_export"

    def schema(self) -> str:
        return "id string, session_id string, time_created bigint, time_updated bigint, data string"

    def streamReader(self, schema) -> Updates:  # noqa: N802
        return Updates(self.options["path"], int(self.options.get("overlap_ms", OVERLAP_MS)))

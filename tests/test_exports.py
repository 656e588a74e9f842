"""Message exports as a stream: what is read again, and the archive that comes of it."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from meterglass.operators import merge
from meterglass.schema import USAGE
from meterglass.sources import exports, messages
from meterglass.streaming import archive, ingest

DAY = 86_400_000


def write(path, *rows, **options):
    """rows: (id, updated, tokens in)."""
    data = [json.dumps({"role": "assistant", "tokens": {"input": n}, "modelID": "m", "providerID": "p"}) for _, _, n in rows]
    columns = [[r[0] for r in rows], ["s"] * len(rows), [1] * len(rows), [r[1] for r in rows], data]
    pq.write_table(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, exports.COLUMNS.types, strict=True)], schema=exports.COLUMNS), path, row_group_size=2, **options)


def run(spark, source, folder, checkpoint):
    spark.dataSource.register(exports.MessageExport)
    rows = spark.readStream.format("message_export").load(str(source))
    query = ingest.stream(messages.records(rows, "h"), folder, checkpoint)
    query.awaitTermination(120)
    return query


def test_stream_of_an_export(spark, tmp_path):
    source, folder, checkpoint = tmp_path / "export", str(tmp_path / "archive"), str(tmp_path / "check")
    source.mkdir()
    write(source / "a.parquet", ("a", 1, 1), ("b", 10 * DAY, 2), ("c", 20 * DAY, 3))
    run(spark, source, folder, checkpoint)
    assert archive.manifest(spark, folder)["changed"] == 3
    # d comes late, within the overlap; e is newer; f is older than the overlap
    write(source / "b.parquet", ("d", 19 * DAY + 5, 4), ("e", 21 * DAY, 5), ("f", 18 * DAY, 6), ("a", 22 * DAY, 7))
    query = run(spark, source, folder, checkpoint)
    assert query.lastProgress["numInputRows"] == 4  # c again, and d, e, a
    got = {r.message_id: r.tok_input for r in archive.archive(spark, folder).collect()}
    assert got == {"a": 7, "b": 2, "c": 3, "d": 4, "e": 5}
    whole = messages.records(merge.within_overlap(spark.read.parquet(str(source)).where("id <> 'f'"), None), "h")
    held = archive.archive(spark, folder).select([f.name for f in USAGE])
    best = merge.winners(whole.selectExpr("*", "source_time_updated as arrival_seq"), "host_id", "source", "message_id").select(held.columns)
    assert held.exceptAll(best).isEmpty() and best.exceptAll(held).isEmpty()


def test_offsets_and_row_groups(tmp_path):
    reader = exports.Updates(str(tmp_path / "nothing"), DAY)
    assert reader.latestOffset() == {"cursor": None} and reader.partitions({"cursor": None}, {"cursor": None}) == []
    write(tmp_path / "a.parquet", ("a", 1, 1), ("b", 2, 1), ("c", 5 * DAY, 1), ("d", 6 * DAY, 1), ("x", None, 1))
    write(tmp_path / "b.parquet", ("e", 7 * DAY, 1), write_statistics=False)
    (tmp_path / "_temporary.parquet").write_text("no file of the export")
    reader = exports.Updates(str(tmp_path), DAY)
    end = reader.latestOffset()
    assert end == {"cursor": 7 * DAY}
    assert [b.group for b in reader.partitions({"cursor": None}, end)] == [0, 1, 0]
    later = reader.partitions({"cursor": 6 * DAY}, end)
    assert [(b.path[-9:], b.group) for b in later] == [("a.parquet", 1), ("b.parquet", 0)]
    assert [r["id"] for b in later for batch in reader.read(b) for r in batch.to_pylist()] == ["c", "d", "e"]
    # the same batch again, after more has come: nothing beyond its end
    write(tmp_path / "c.parquet", ("f", 8 * DAY, 1))
    assert reader.partitions({"cursor": 6 * DAY}, end) == later


def test_a_broken_file_stops_the_stream(tmp_path):
    (tmp_path / "a.parquet").write_text("no parquet")
    with pytest.raises(pa.ArrowInvalid):
        exports.Updates(str(tmp_path), DAY).latestOffset()

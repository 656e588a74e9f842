"""Exports of which some files are unreadable: good rows stay, bad files are told, their sources are not scanned."""

import gzip
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from meterglass.sources import adapters, exports, lines, tolerant
from meterglass.streaming import archive, ingest

LINE = {"type": "assistant", "sessionId": "s", "timestamp": "1970-01-01T00:00:00.005Z", "message": {"model": "m", "usage": {"input_tokens": 3}}}


def transcript(path, *ids):
    rows = [json.dumps(LINE | {"uuid": i, "requestId": i, "message": LINE["message"] | {"id": i}}) for i in ids]
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(rows) + "\n")


def told(files):
    return {r.path.rsplit("/", 1)[1]: r.readable for r in files.collect()}


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("chunk", [1, 5, 1 << 20])
def test_lines_in_blocks(tmp_path, monkeypatch, size, chunk):
    monkeypatch.setattr(tolerant, "CHUNK", chunk)
    for text in (b"", b"\n", b"a", b"ab\n\n\ncdefghijkl\n" * 5, b"x" * 70 + b"\nend"):
        (tmp_path / "f").write_bytes(text)
        got = []
        for start in range(0, len(text), size):
            with pa.OSFile(str(tmp_path / "f")) as file:
                file.seek(max(start - 1, 0))
                got += tolerant.starting_within(file, start, min(start + size, len(text)))
        assert got == text.removesuffix(b"\n").split(b"\n") if text else got == []


def test_lines_of_several_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tolerant, "BLOCK", 40)
    monkeypatch.setattr(tolerant, "OPENING", 40)
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.jsonl").write_bytes(b"".join(b"line %d \xc3\xa0\r\n\n" % i for i in range(30)) + b"last")
    (tmp_path / "in/sub/b.jsonl").write_text("one\n\ntwo\n")
    (tmp_path / "in/none.jsonl").write_text("")
    rows, files = tolerant.lines(spark, str(tmp_path / "staged"), str(tmp_path / "in"))
    want = lines.read(spark, str(tmp_path / "in"))
    assert sorted(r.line for r in rows.where("path like '%a.jsonl'").collect()) == list(range(1, 62))
    got = {(r.path.rsplit("/", 1)[1], r.line, r.value) for r in rows.collect()}
    assert got == {(r.path.rsplit("/", 1)[1], r.line, r.value) for r in want.collect()}
    assert told(files) == {"a.jsonl": True, "b.jsonl": True}


def test_packed_files_that_break_off(spark, tmp_path):
    (tmp_path / "in").mkdir()
    whole = gzip.compress(b"".join(b"%d %d\n" % (i, i * i * 7919 % 10007) for i in range(200_000)))
    (tmp_path / "in/good.jsonl.gz").write_bytes(gzip.compress(b"x\ny\n"))
    (tmp_path / "in/cut.jsonl.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "in/bad.jsonl.gz").write_bytes(b"no archive at all")
    rows, files = tolerant.lines(spark, str(tmp_path / "staged"), str(tmp_path / "in"))
    assert told(files) == {"good.jsonl.gz": True, "cut.jsonl.gz": False, "bad.jsonl.gz": False}
    got = {r.path.rsplit("/", 1)[1]: (r.n, r.last) for r in rows.groupBy("path").agg({"*": "count", "line": "max"}).toDF("path", "n", "last").collect()}
    assert got["good.jsonl.gz"] == (2, 2) and got["cut.jsonl.gz"][0] == got["cut.jsonl.gz"][1] > 1000 and "bad.jsonl.gz" not in got
    assert all(r.error for r in files.where("not readable").collect())
    with pytest.raises(tolerant.UnreadableFile, match="bad.jsonl.gz"):
        tolerant.whole(files)


def message(path, *ids):
    data = json.dumps({"role": "assistant", "tokens": {"input": 4}, "modelID": "m", "providerID": "p"})
    pq.write_table(pa.table([list(ids), ["s"] * len(ids), [1] * len(ids), [2] * len(ids), [data] * len(ids)], schema=exports.COLUMNS), path, row_group_size=2)


def test_tables_by_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tolerant, "BLOCK", 300)
    monkeypatch.setattr(tolerant, "OPENING", 300)
    (tmp_path / "in").mkdir()
    message(tmp_path / "in/a.parquet", *(f"a{i}" for i in range(9)))
    message(tmp_path / "in/cut.parquet", *(f"c{i}" for i in range(9)))
    cut = (tmp_path / "in/cut.parquet").read_bytes()
    (tmp_path / "in/cut.parquet").write_bytes(cut[:-50])
    (tmp_path / "in/empty.parquet").write_bytes(b"")
    pq.write_table(pa.table({"id": ["only"], "more": [1]}), tmp_path / "in/few.parquet")
    rows, files = tolerant.tables(spark, str(tmp_path / "staged"), adapters.MESSAGE, str(tmp_path / "in"))
    assert sorted((r.id, r.time_updated) for r in rows.collect()) == sorted([(f"a{i}", 2) for i in range(9)] + [("only", None)])
    assert told(files) == {"a.parquet": True, "cut.parquet": False, "few.parquet": True}


def test_a_round_with_a_hole(spark, tmp_path):
    transcript(tmp_path / "t/one/a.jsonl", "x", "y")
    (tmp_path / "t/one/b.jsonl.gz").write_bytes(gzip.compress(b"{}\n" * 9)[:-6])
    (tmp_path / "m").mkdir()
    message(tmp_path / "m/a.parquet", "p", "q")
    given = {"transcripts": (str(tmp_path / "t"),), "messages": (str(tmp_path / "m"),)}
    folder = str(tmp_path / "archive")
    with pytest.raises(tolerant.UnreadableFile):
        ingest.ingest_round(spark, folder, 0, "box", given, 1000, strict=True)
    assert archive.manifest(spark, folder) is None
    line = ingest.ingest_round(spark, folder, 0, "box", given, 1000)
    assert line["unreadable"] == 1 and line["changed"] == 4
    assert {r.message_id.split(":")[-1] for r in archive.archive(spark, folder).collect()} >= {"p", "q"}
    spans = lambda: {(r.source, r.interval_start, r.interval_end) for r in archive.covered(spark, folder).collect()}
    assert spans() == {("opencode", 0, 1000)}
    assert ingest.ingest_round(spark, folder, 0, "box", given, 2000)["round"] == 0  # told once
    transcript(tmp_path / "t/one/b.jsonl", "z")
    (tmp_path / "t/one/b.jsonl.gz").unlink()
    line = ingest.ingest_round(spark, folder, 1, "box", given, 3000)
    assert line["unreadable"] == 0 and spans() == {("opencode", 0, 3000), ("claude-code", 0, 3000)}
    assert archive.archive(spark, folder).count() == 5


def test_documents_and_no_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows, files = tolerant.documents(spark, str(tmp_path / "none"), str(tmp_path / "in"))
    assert rows.count() == 0 and files.count() == 0
    tolerant.whole(files)
    (tmp_path / "in/a.json").write_text('{"a":\n1}')
    (tmp_path / "in/b.json.gz").write_bytes(b"broken")
    rows, files = tolerant.documents(spark, str(tmp_path / "staged"), str(tmp_path / "in"))
    assert [r.value for r in rows.collect()] == ['{"a":\n1}'] and told(files) == {"a.json": True, "b.json.gz": False}


def test_sessions_and_legacy_documents(spark, tmp_path):
    for d in ("s", "said", "old"):
        (tmp_path / d).mkdir()
    pq.write_table(pa.table({"id": ["one", "two"], "started_at": [1.0, 2.0], "ended_at": [None, 3.0], "input_tokens": [5, 6]}), tmp_path / "s/a.parquet")
    pq.write_table(pa.table({"session_id": ["one"], "timestamp": [9.0]}), tmp_path / "said/a.parquet")
    (tmp_path / "said/b.parquet").write_text("no parquet")
    facts, _, files = adapters.scanned(spark, "sessions", "box", str(tmp_path / "x"), str(tmp_path / "s"), str(tmp_path / "said"))
    assert {(r.message_id, r.tok_input, r.source_time_updated) for r in facts.collect()} == {("one", 5, 9000), ("two", 6, 2000)}
    assert sorted(r.readable for r in files.collect()) == [False, True, True]
    (tmp_path / "old/a.json").write_text("{")
    facts, skips, files = adapters.scanned(spark, "legacy", "box", str(tmp_path / "y"), str(tmp_path / "old"))
    assert facts.count() == 0 and [r.n for r in skips.collect()] == [1] and told(files) == {"a.json": True}

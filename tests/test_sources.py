"""Adapters, merging and streaming on small hand-made inputs."""

import json
import random
from datetime import date
from itertools import permutations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meterglass.functions import exprs
from meterglass.functions.calendar import LocalRange
from meterglass.operators import coverage, hosts, merge, pricing, reports
from meterglass.schema import USAGE, SchemaMismatch, checked
from meterglass.sources import adapters, applog, lines, messages, prices, rollouts, sessions, transcripts, wire
from meterglass.streaming import archive, ingest


def usage_row(**changed):
    row = {
        "host_id": "h", "source": "s", "granularity": "message", "message_id": "m", "session_id": "x", "time_created_utc": 1, "time_completed_utc": None, "source_time_updated": 5, "origin": "live", "origin_priority": 3, "agent_raw": "", "agent_key": "",
        "provider_id": "p", "model_id": "q", "variant": None, "tok_input": 1, "tok_output": 2, "tok_reasoning": 0, "tok_cache_read": 0, "tok_cache_write": 0, "cost": None, "cost_source": "unavailable", "is_incomplete": False, "project_dir": "",
    }
    return row | changed


def usage(spark, *rows):
    return spark.createDataFrame([tuple(r[f.name] for f in USAGE) for r in rows], USAGE)


def test_line_numbers_count_blank_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(f'{{"n":{i}}}' if i % 3 else "" for i in range(1, 200)) + "\n")
    rows = lines.read(spark, str(tmp_path)).where("value <> ''").collect()
    assert rows and all(json.loads(r.value)["n"] == r.line for r in rows)


def rollout_file(events):
    return "\n".join(json.dumps(e) for e in events)


def counters(*v):
    return dict(zip(("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens"), v, strict=True))


def token_event(total, last=None):
    info = {"total_token_usage": counters(*total)} | ({"last_token_usage": counters(*last)} if last else {})
    return {"timestamp": "2026-07-01T00:00:00Z", "type": "event_msg", "payload": {"type": "token_count", "info": info}}


def test_rollout_counters(spark, tmp_path):
    events = [
        {"timestamp": "2026-07-01T00:00:00Z", "type": "session_meta", "payload": {"id": "sess", "model_provider": "acme"}}, {"timestamp": "2026-07-01T00:00:00Z", "type": "turn_context", "payload": {"model": "ns.big", "cwd": "/w"}},
        token_event((100, 20, 10, 30, 12), (100, 20, 10, 30, 12)), token_event((150, 30, 15, 50, 20), (7, 3, 2, 5, 2)), token_event((150, 30, 15, 50, 20), (7, 3, 2, 5, 2)), token_event((1, 1, 1, 1, 1)),
    ]
    (tmp_path / "good.jsonl").write_text(rollout_file(events))
    (tmp_path / "bad.jsonl").write_text(rollout_file(events) + "\nnot json\n")
    got = rollouts.records(lines.parsed(lines.read(spark, str(tmp_path)))).orderBy("line").collect()
    assert [(r.line, r.tok_input, r.tok_cache_read, r.tok_cache_write, r.tok_output, r.tok_reasoning, r.is_incomplete, r.regressed) for r in got] == [
        (3, 100, 20, 10, 30, 12, False, False), (4, 7, 3, 2, 5, 2, False, False), (5, 0, 0, 0, 0, 0, True, False), (6, 0, 0, 0, 0, 0, True, True),
    ]
    assert {(r.session_id, r.provider_id, r.model_id, r.project_dir) for r in got} == {("sess", "ns", "big", "/w")}


def test_rollout_lines_that_are_skipped(spark, tmp_path):
    good = token_event((5, 0, 0, 1, 0))
    events = [good | {"payload": {"type": "token_count", "info": None}}, good | {"payload": {"type": "token_count", "info": {"total_token_usage": 7}}}, token_event((9, 0, 0, 1, 0)) | {"timestamp": "soon"}, token_event((11, 0, 0, 1, 0)), {"type": "other"}]
    (tmp_path / "a.jsonl").write_text(rollout_file(events))
    (tmp_path / "b.jsonl").write_text("[]\n")
    rows = lines.parsed(lines.read(spark, str(tmp_path)))
    assert {r.skip_reason: r.n for r in rollouts.skips(rows).collect()} == {"total_missing": 1, "total_invalid": 1, "time_invalid": 1, "file_malformed": 1}
    assert [(r.line, r.tok_input) for r in rollouts.records(rows).collect()] == [(4, 2)]  # the total with a bad time counts as previous


def test_transcript_winner_in_any_order(spark):
    def answer(n, out, side=False, speed=None):
        use = {"input_tokens": 1, "output_tokens": out, "cache_creation": {"ephemeral_5m_input_tokens": 2, "ephemeral_1h_input_tokens": 3}} | ({"speed": speed} if speed else {})
        return (f"f{n}", n, json.dumps({"type": "assistant", "timestamp": "2026-07-01T00:00:00Z", "sessionId": "s", "requestId": "r", "isSidechain": side, "message": {"id": "a", "model": "m", "usage": use}}))

    rows = [answer(1, 50, side=True), answer(2, 9), answer(3, 10), answer(4, 10, speed="fast")]
    for order in list(permutations(rows))[::6]:
        df = lines.parsed(spark.createDataFrame([*order, ("f9", 9, "broken")], "path string, line int, value string"))
        got = transcripts.records(df).collect()
        assert [(r.message_id, r.line, r.tok_cache_write) for r in got] == [("a#r", 4, 5)]
    assert transcripts.diagnostics(transcripts.records(df)).first().asDict() == {"missing_request_id": 0, "long_cache_rows": 1, "long_cache_tokens": 3, "mismatch": 1, "placeholder_models": 0, "lower_bound": True}
    assert {r.skip_reason: r.n for r in messages.skips(transcripts.normalised(df)).collect()} == {"not_json": 1}


def test_legacy_documents(spark):
    docs = [("/d/storage/message/s1/m1.json", json.dumps({"role": "assistant", "tokens": {"input": 3}, "time": {"created": 5}, "variant": "x"})), ("/d/storage/message/s1/m2.json", json.dumps({"role": "assistant", "tokens": {}}))]
    got = {r.message_id: r for r in messages.legacy(spark.createDataFrame(docs, "path string, value string")).collect()}
    assert got["m1"].session_id == "s1" and got["m1"].variant is None and got["m1"].source_time_updated == 5 and got["m1"].skip_reason is None
    assert got["m2"].skip_reason == "time_missing"


def test_wire_round_trip(spark, tmp_path):
    rows = usage(spark, usage_row(), usage_row(message_id="n", source="other", cost=0.5, cost_source="actual"), usage_row(message_id="o", source_time_updated=8))
    wire.write(wire.batch(rows, "abc", "box", "1", 3, {"s": "/d", "other": "/e", "none": "/f"}, {"s": 4}), str(tmp_path / "batch"))
    batch = wire.read(spark, str(tmp_path / "batch"))
    records, report = wire.verified(batch, "abc", "s", 9)
    assert sorted(map(tuple, records.collect()), key=str) == sorted(map(tuple, rows.where("source = 's'").collect()), key=str)
    assert report == {"machine_id_hash": "abc", "hostname": "box", "collector_version": "1", "source": "s", "data_dir": "/d", "eligible_count": 2, "skipped_count": 4, "since": 3, "cutoff": 9}
    assert wire.verified(batch, "abc", "none", 0)[1]["eligible_count"] == 0
    for host, source in (("def", "s"), ("abc", "absent")):
        with pytest.raises(wire.RejectedBatch):
            wire.decode(batch, host, source)
    short = batch.where("value not like '%\"messageId\":\"o\"%'")
    late = batch.union(spark.createDataFrame([(99, wire.lines(usage(spark, usage_row(message_id="p", source_time_updated=99))).first().value)], "line long, value string"))
    twice = batch.where("value not like '%\"messageId\":\"o\"%'").union(batch.where("value like '%\"messageId\":\"m\"%'"))
    for bad, why in ((short, "announced"), (late.where("value not like '%\"messageId\":\"o\"%'"), "cutoff"), (twice, "twice")):
        with pytest.raises(wire.RejectedBatch, match=why):
            wire.verified(bad, "abc", "s", 0)
    broken = batch.union(spark.createDataFrame([(7, "{nonsense")], "line long, value string"))
    with pytest.raises(Exception, match="malformed record in line 7"):
        wire.decode(broken, "abc", "s").collect()


def test_large_files_are_numbered_block_by_block(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(str(i) for i in range(1, 30_001)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert lines.read(spark, str(tmp_path)).where("line <> cast(value as bigint)").count() == 0
        assert lines.read(spark, str(tmp_path)).count() == 30_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_documents_at_their_depth_and_first_by_path(spark, tmp_path):
    for name in ("s1/a.json", "s1/b.json", "s2/c.json", "d.json", "s1/deep/e.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}")
    files = lines.documents(spark, str(tmp_path))
    assert sorted(r.path[-6:] for r in messages.in_depth(files, str(tmp_path)).collect()) == ["a.json", "b.json", "c.json"]
    assert [r.path.rsplit("/", 1)[1] for r in lines.documents(spark, str(tmp_path), most=2).orderBy("path").collect()] == ["d.json", "a.json"]


def message(n, data, updated=None):
    return (f"m{n}", "s", n, updated or n, json.dumps(data) if isinstance(data, dict) else data)


def test_messages_and_backups(spark, tmp_path):
    full = {"role": "assistant", "tokens": {"input": 3, "cache": {"read": "4", "write": True}}, "agent": "Build Bot", "model": {"providerID": "p", "modelID": "m", "variant": "high"}, "cost": 0.25, "time": {"completed": 9}, "path": {"cwd": "/w"}}
    rows = [message(1, full), message(2, {"role": "assistant", "tokens": {}}), message(3, {"role": "user"}), message(4, "[1]"), message(5, '{"role": "assistant", "tokens": {"input": 1}'), message(6, {"role": "assistant", "tokens": None}), message(7, {"role": "assistant", "tokens": {"output": 1}, "agent": 5, "providerID": {"x": 1}, "modelID": 7, "cost": "-1"})]
    df = spark.createDataFrame(rows, "id string, session_id string, time_created long, time_updated long, data string")
    why = {r.id: r.skip_reason for r in messages.normalised(df).collect()}
    assert why == {"m1": None, "m2": None, "m3": "not_assistant", "m4": "not_json", "m5": "not_json", "m6": why["m6"], "m7": None} and why["m6"] in ("tokens_missing", "tokens_invalid")
    got = {r.message_id: r for r in checked(messages.records(df, "h")).collect()}
    r = got["m1"]
    assert (r.tok_input, r.tok_cache_read, r.tok_cache_write, r.agent_raw, r.agent_key, r.provider_id, r.model_id, r.variant, r.cost, r.cost_source, r.project_dir, r.origin_priority) == (3, 4, 0, "Build Bot", "build-bot", "p", "m", "high", 0.25, "actual", "/w", 3)
    assert got["m2"].is_incomplete and (got["m7"].agent_raw, got["m7"].provider_id, got["m7"].model_id, got["m7"].cost) == ("unknown", "unknown", "7", None)
    paths = [str(tmp_path / n) for n in "ab"]
    for p in paths:
        df.write.parquet(p)
    assert messages.backups(spark, paths, "h", enabled=False).count() == 0
    back = messages.backups(spark, paths, "h", enabled=True)
    assert back.count() == 6 and {r.origin for r in back.collect()} == {"bak"}
    live = messages.records(df, "h").withColumn("arrival_seq", F.lit(0).cast("bigint"))
    both = live.unionByName(back.withColumn("source_time_updated", F.lit(99).cast("bigint")).withColumn("arrival_seq", F.lit(1).cast("bigint")))
    assert {r.origin for r in merge.winners(both, "host_id", "source", "message_id").collect()} == {"live"}


def test_lists_of_enabled_sources(spark):
    texts = {"opencode": None, " codex , hermes,": None, "": "no source is enabled", " , ": "no source is enabled", "opencode,nope": "unknown source nope", "codex,codex": "a source is named twice"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.why for r in df.select("t", hosts.sources_violation(hosts.decoded(F.col("t"))).alias("why")).collect()}
    assert got == texts
    assert df.where("t like ' codex%'").select(hosts.encoded(hosts.decoded(F.col("t")))).first()[0] == "codex,hermes"
    with pytest.raises(hosts.InvalidSources):
        hosts.checked(spark.createDataFrame([("h", "nope")], "host_id string, enabled_sources string"))


def test_who_bills_a_session(spark):
    cases = {
        ("custom", None, "global.anthropic.claude-x"): ("anthropic", "claude-x"), ("custom", None, "openai.gpt-5.4"): ("openai", "gpt-5.4"), ("custom", None, "amazon.nova"): ("custom", "amazon.nova"), (None, None, "anthropic. "): ("hermes", "anthropic."),
        ("custom", "http://x:11434/v1", "plain"): ("ollama", "plain"), ("My-Ollama", None, "plain"): ("ollama", "plain"), (None, None, "custom:box-ollama:llama3"): ("ollama", "llama3"), (None, None, "qwen3:8b"): ("ollama", "qwen3:8b"), ("p", None, " "): ("p", "unknown"), (" ", "", None): ("hermes", "unknown"),
    }
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, p string, u string, m string")
    got = {r.i: (r.x.provider, r.x.model) for r in df.select("i", exprs.billed_model(F.col("p"), F.col("u"), F.col("m"), "hermes").alias("x")).collect()}
    assert got == dict(enumerate(cases.values()))


def test_sessions_that_are_skipped(spark):
    rows = [("a", 1.5, 3.0, 4.0, 1, None), (" ", 1.0, None, 1.0, 1, None), ("b", -1.0, None, 1.0, 1, None), ("c", 1.0, -2.0, 1.0, 1, None), ("d", 1.0, None, 1.0, -1, None), ("e", 1.0, None, 1.0, 1, "Cli  Tool")]
    df = spark.createDataFrame(rows, "id string, started_at double, ended_at double, active_at double, output_tokens long, source string")
    got = {r.id: r for r in sessions.normalised(df).collect()}
    assert {k: r.skip_reason for k, r in got.items()} == {"a": None, " ": "id_missing", "b": "time_invalid", "c": "time_invalid", "d": "tokens_negative", "e": None}
    assert (got["a"].time_created_utc, got["a"].time_completed_utc, got["a"].source_time_updated, got["a"].agent_key, got["e"].agent_key, got["e"].tok_output) == (1500, 3000, 4000, "unknown", "cli-tool", 1)


def test_cutoffs_extend_coverage(spark):
    ddl = "host_id string, source string, origin string, interval_start long, interval_end long"
    have = spark.createDataFrame([("h", "s", "live", 5, 9), ("h", "s", "bak", 1, 2)], ddl)
    rounds = spark.createDataFrame([("h", "s", 1, 8), ("h", "t", None, 7), ("h", "u", 3, 7)], "host_id string, source string, earliest long, cutoff long")
    got = sorted(tuple(r) for r in coverage.extend_to_cutoff(have, rounds).collect())
    assert got == [("h", "s", "bak", 1, 2), ("h", "s", "live", 5, 9), ("h", "t", "live", 7, 7), ("h", "u", "live", 3, 7)]
    with pytest.raises(coverage.CutoffBeforeRecord):
        coverage.extend_to_cutoff(have, spark.createDataFrame([("h", "s", 9, 8)], rounds.schema))
    new = spark.createDataFrame([("h", "s", "bak", 3, 4)], ddl)
    assert sorted(tuple(r) for r in coverage.replace_origin(have, new).collect()) == [("h", "s", "bak", 3, 4), ("h", "s", "live", 5, 9)]
    assert coverage.selected(have, host_id="h", source="t").count() == 0 and coverage.selected(have).count() == 2


def test_log_entries(spark):
    df = spark.createDataFrame([('{"timestamp":"1","level":"WARN","message":"a"}',), ("noise",), ('{"timestamp":"2","level":"odd"}',), ('{"timestamp":"3","level":"info"}',)], "value string")
    assert [r.timestamp for r in applog.newest(applog.entries(df), 10, "timestamp").collect()] == ["3", "1"]
    assert applog.at_least(applog.entries(df), "warn").count() == 1


def test_prices(spark, tmp_path):
    entry = {"provider_id": "p", "model_id": "m-20250101", "input_per_mtok": 5, "output_per_mtok": 25, "cache_read_per_mtok": 0.5, "cache_write_per_mtok": 6.25, "note": "kept"}
    (tmp_path / "p.json").write_text(json.dumps({"schema_version": 1, "entries": [entry, entry | {"model_id": "m-20250929"}, entry | {"model_id": "m-20251101"}]}))
    catalog = prices.read(spark, str(tmp_path / "p.json"))
    assert "kept" in catalog.first().raw
    pairs = spark.createDataFrame([("p", "m-20251001"), ("P", "m-20250101"), ("x", "m")], "provider_id string, model_id string")
    got = {r.model_id: r.kind for r in pricing.match(pairs, catalog).collect()}
    assert got == {"m-20251001": "family", "m-20250101": "normalized", "m": "crossProvider"}
    head = prices.header(spark, str(tmp_path / "p.json")) | {"currency": "USD", "extra": {"x": [1]}}
    again = prices.write_document(catalog.withColumn("output_per_mtok", F.lit(30.0)), head, str(tmp_path / "docs"), 1)
    assert prices.header(spark, again) == {"schema_version": 1, "currency": "USD", "extra": {"x": [1]}}
    assert {(r.output_per_mtok, json.loads(r.raw)["note"], r.model_id) for r in prices.read(spark, again).collect()} == {(30.0, "kept", m) for m in ("m-20250101", "m-20250929", "m-20251101")}
    path = prices.write(catalog, str(tmp_path / "out"), 2)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(pricing.InvalidPrices):
        pricing.checked_catalog(catalog.withColumn("input_per_mtok", F.lit(-1.0)))
    cost = spark.createDataFrame([(1_000_000, 250_000, 4_000_000, 500_000, 5.0, 25.0, 0.5, 6.25)], "tok_input long, tok_output long, tok_cache_read long, tok_cache_write long, input_per_mtok double, output_per_mtok double, cache_read_per_mtok double, cache_write_per_mtok double")
    assert cost.select(pricing.estimate()).first()[0] == pytest.approx(16.375)


def test_winner_is_the_sequential_fold_in_any_order(spark):
    rows = [(3, 5), (2, 9), (3, 5), (1, 99), (3, 4)]
    for order in list(permutations(range(5)))[::17]:
        arrivals = spark.createDataFrame([("k", *rows[i], n, i) for n, i in enumerate(order)], "k string, origin_priority int, source_time_updated long, arrival_seq long, i int")
        held = None
        for n, i in enumerate(order):
            if held is None or rows[i] >= rows[held]:
                held = i
        assert merge.winners(arrivals, "k").first().i == held
        assert merge.changed(arrivals, "k").where("changed").orderBy(F.desc("arrival_seq")).first().i == held


def at_month(m, **changed):
    return usage_row(time_created_utc=1_700_000_000_000 + m * 30 * 86_400_000, **changed)


def seq(df, n):
    return df.withColumn("arrival_seq", F.lit(n).cast("bigint"))


def test_rounds(spark, tmp_path):
    folder = str(tmp_path / "archive")
    ingest.publish(seq(usage(spark, usage_row(), usage_row(message_id="old")), 0), folder, 0)
    m = ingest.publish(seq(usage(spark, usage_row(tok_input=9, source_time_updated=6), usage_row(message_id="old", origin="bak", origin_priority=2, source_time_updated=99)), 1), folder, 1)
    assert (m["changed"], m["rejected"]) == (1, 0)
    got = {r.message_id: (r.tok_input, r.origin) for r in ingest.archive(spark, folder).collect()}
    assert got == {"m": (9, "live"), "old": (1, "live")}
    ingest.publish(seq(usage(spark, usage_row(tok_input=1, source_time_updated=7)), 1), folder, 1)  # told again: nothing happens
    assert ingest.archive(spark, folder).where("message_id = 'm'").first().tok_input == 9
    with pytest.raises(merge.RejectedRound):
        ingest.publish(seq(usage(spark, usage_row(tok_output=-1)), 2), folder, 2)
    assert ingest.archive(spark, folder).count() == 2
    m = ingest.publish(seq(usage(spark, usage_row(tok_output=-1), usage_row(message_id="new")), 2), folder, 2, strict=False)
    assert m["rejected"] == 1 and ingest.archive(spark, folder).count() == 3
    assert spark.read.parquet(f"{folder}/quarantine/round=2").first().violation == "tok_output is negative or missing"
    assert [tuple(r) for r in ingest.cursors(spark, folder).collect()] == [("h", "s", 6)]
    with pytest.raises(SchemaMismatch):
        checked(spark.range(1))


def test_a_round_rewrites_its_months_only(spark, tmp_path):
    folder = str(tmp_path / "archive")
    paths = lambda n=None: {r.path for r in archive.parts(spark, folder, n).collect()}
    archive.publish(seq(usage(spark, *(at_month(m, message_id=f"m{m}", source=s) for m in range(6) for s in ("s", "a/b"))), 0), folder, 0)
    assert len(paths()) == 12
    second = archive.publish(seq(usage(spark, at_month(5, message_id="m5", tok_input=50, source_time_updated=6), at_month(5, message_id="new")), 1), folder, 1)
    assert second["parts_read"] <= 2 and second["keys_read"] == 0 and len(paths() & paths(0)) >= 11
    # a record that moved by years is there once, and only the part that it left and the one that it came to are read
    third = archive.publish(seq(usage(spark, at_month(40, message_id="m2", tok_input=20, source_time_updated=7)), 2), folder, 2)
    assert third["parts_read"] == 1 and third["keys_read"] == 1
    fourth = archive.publish(seq(usage(spark, at_month(2, message_id="m2", tok_input=21, source_time_updated=8), at_month(41, message_id="other")), 3), folder, 3)
    assert fourth["parts_read"] == 1
    got = sorted((r.source, r.message_id, r.tok_input) for r in archive.archive(spark, folder).collect())
    want = [(s, f"m{m}", {("s", 5): 50, ("s", 2): 21}.get((s, m), 1)) for m in range(6) for s in ("a/b", "s")] + [("s", "new", 1), ("s", "other", 1)]
    assert got == sorted(want)
    assert {tuple(r) for r in archive.cursors(spark, folder).collect()} == {("h", "s", 8), ("h", "a/b", 5)}
    # as of a round, by time and by source
    assert archive.archive(spark, folder, as_of=2).where("message_id = 'm2' and source = 's'").first().tok_input == 20
    start = at_month(40)["time_created_utc"]
    assert {r.message_id for r in archive.archive(spark, folder, start_ms=start).collect()} == {"other"}
    assert archive.archive(spark, folder, end_ms=start, sources=["a/b"]).count() == 6
    assert {r.path for r in archive.out_of_force(spark, folder, 2).collect()} == (paths(0) | paths(1) | paths(2) | paths()) - paths(2) - paths()


def test_any_rounds_give_the_sequential_fold(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "MOST_KEY_LISTS", 2)
    monkeypatch.setattr(archive, "ERA", 2)
    folder, rng, held = str(tmp_path / "archive"), random.Random(3), {}
    for n in range(6):
        rows = []
        for i in range(rng.choice([0, 12, 12])):
            origin = rng.choice(["live", "live", "bak"])
            row = at_month(rng.randint(0, 60), message_id=f"m{rng.randint(0, 9)}", tok_input=100 * n + i, source_time_updated=rng.randint(0, 9), origin=origin, origin_priority={"live": 3, "bak": 2}[origin])
            rows.append(row)
            mark = (row["origin_priority"], row["source_time_updated"])
            if row["message_id"] not in held or mark >= held[row["message_id"]][0]:
                held[row["message_id"]] = (mark, row["tok_input"], row["time_created_utc"])
        table = spark.createDataFrame([], USAGE) if not rows else usage(spark, *rows)
        line = archive.publish(table.coalesce(1).withColumn("arrival_seq", F.col("tok_input")), folder, n)
        assert line["number"] == n and len(line["keys"]) <= 2
    got = {r.message_id: (r.tok_input, r.time_created_utc) for r in archive.archive(spark, folder).collect()}
    assert got == {k: v[1:] for k, v in held.items()} and archive.archive(spark, folder).count() == len(held)
    assert [archive.manifest(spark, folder, n)["round"] for n in range(6)] == list(range(6))


def test_stream_into_the_archive(spark, tmp_path):
    source, folder, told = str(tmp_path / "in"), str(tmp_path / "archive"), []
    pairs = spark.createDataFrame([("h", "s"), ("h", "idle")], "host_id string, source string")
    for n, late in enumerate((usage_row(), usage_row(tok_input=7, source_time_updated=9), usage_row(message_id=" "), usage_row(tok_input=1))):
        usage(spark, late).withColumn("arrival_seq", F.lit(n).cast("bigint")).write.mode("append").parquet(source)
        schema = spark.read.parquet(source).schema
        query = ingest.stream(spark.readStream.schema(schema).parquet(source), folder, str(tmp_path / "check"), pairs=pairs, now=lambda n=n: 100 + n, told=told.append)
        query.awaitTermination(120)
    assert [r.tok_input for r in ingest.archive(spark, folder).collect()] == [7]
    # bad and late rows change nothing, and nobody is told of them
    assert [(m["round"], m["changed"], m["rejected"]) for m in told] == [(0, 1, 0), (1, 1, 0)]
    assert sorted((r.source, r.interval_start, r.interval_end) for r in ingest.covered(spark, folder).collect()) == [("idle", 0, 103), ("s", 0, 103)]


def test_rollouts_streamed_in_any_cut_and_order_are_those_of_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng, rows = random.Random(3), []
    for path in ("x/a.jsonl", "x/b-01234567-89ab-cdef-0123-456789abcdef.jsonl", "c.jsonl"):
        total = [0] * 6
        for line in range(1, 25):
            kind = rng.choice(["count", "count", "count", "meta", "turn", "blank", "other", "no total", "no time"])
            total = [max(0, t + rng.choice((0, 3, 7, 7))) for t in total] if rng.random() < 0.9 else [t // 2 for t in total]
            usage_ = lambda xs: dict(zip(rollouts.STATED.values(), xs, strict=True))
            info = {"total_token_usage": usage_(total), "last_token_usage": usage_([rng.choice((0, 0, 2)) for _ in total])}
            event = {"type": "event_msg", "timestamp": "2026-07-01T00:00:00Z", "payload": {"type": "token_count", "info": info}} | ({"ordinal": line * 10} if rng.random() < 0.3 else {})
            event = {
                "meta": {"type": "session_meta", "payload": {"id": rng.choice([f"s{line}", " "]), "model_provider": rng.choice(["p", None])}}, "turn": {"type": "turn_context", "payload": {"model": rng.choice(["m.n", "q", ""]), "cwd": rng.choice(["/w", None])}},
                "other": {"type": "else"}, "no total": event | {"payload": {"type": "token_count", "info": {}}}, "no time": event | {"timestamp": "?"},
            }.get(kind, event)
            rows.append((path, line, "" if kind == "blank" else json.dumps(event)))
    schema = "path string, line long, value string"
    want = rollouts.records(lines.parsed(spark.createDataFrame(rows, schema))).collect()
    assert len(want) > 20 and any(r.regressed for r in want)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    shuffled = rng.sample(rows, len(rows))
    for part in (shuffled[:30], shuffled[20:31], shuffled[31:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        query = ingest.stream_rollouts(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = spark.read.parquet(out).select(*rollouts.RECORD).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_gains_where_a_counter_falls(spark):
    keys = list(rollouts.STATED)
    case = lambda t, p, l: (*t, *p, *l)  # noqa: E731, E741
    rows = [
        case([9, 0, 0, 5, 0, 14], [5, 0, 0, 5, 0, 10], [3, 0, 0, 0, 0, 3]), case([9, 0, 0, 1, 0, 10], [5, 0, 0, 5, 0, 10], [3, 0, 0, 0, 0, 3]),
        case([5, 0, 0, 5, 0, 10], [5, 0, 0, 5, 0, 10], [3, 0, 0, 0, 0, 3]), case([6, 0, 0, 5, 0, 11], [5, 0, 0, 5, 0, 10], [0] * 6),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{p}_{k} long" for p in "tpl" for k in keys)).withColumns(rollouts.gains())
    assert [(r.tok_input, r.tok_output, r.regressed) for r in df.collect()] == [(3, 0, False), (4, 0, True), (0, 0, False), (1, 0, False)]


def test_exports_become_the_fact(spark, tmp_path):
    tree = tmp_path / "projects" / "-home-me"
    tree.mkdir(parents=True)
    answer = {"type": "assistant", "timestamp": 5, "sessionId": "s", "message": {"id": "a", "model": "m", "usage": {"input_tokens": 3}}}
    (tree / "one.jsonl").write_text(json.dumps(answer) + "\n\nnonsense\n" + json.dumps({"type": "user"}) + "\n")
    old = tmp_path / "old" / "ses"
    old.mkdir(parents=True)
    (old / "msg.json").write_text(json.dumps({"role": "assistant", "tokens": {"input": 4}, "time": {"created": 7}}))
    facts, skips = adapters.adapted({"transcripts": adapters.read(spark, "transcripts", str(tmp_path / "projects")), "legacy": adapters.read(spark, "legacy", str(tmp_path / "old"))}, "box")
    got = {r.message_id: r for r in checked(facts).collect()}
    assert {k: (r.source, r.session_id, r.tok_input, r.origin, r.source_time_updated, r.project_dir, r.cost_source) for k, r in got.items()} == {"a": ("claude-code", "s", 3, "live", 5, "-home-me", "unavailable"), "msg": ("opencode", "ses", 4, "legacy", 7, "", "unavailable")}
    assert {tuple(r) for r in skips.collect()} == {("claude-code", "not_json", 1), ("claude-code", "not_assistant", 1)}
    line = ingest.publish(facts, str(tmp_path / "archive"), 0)
    assert line["changed"] == 2


def test_coverage_by_sweep_is_that_of_all_pairs(spark):
    rng = random.Random(4)
    buckets = spark.createDataFrame([(b, b + rng.choice((5, 10)), f"b{b}") for b in range(0, 200, 10)] + [(300, 300, "empty")], "bucket_start long, bucket_end long, label string")
    rows = [(f"h{rng.randint(0, 3)}", "s", *sorted((rng.randint(-20, 220), rng.randint(-20, 220)))) for _ in range(14)] + [("h9", "s", 5, 5), ("h0", "s", 40, 160), ("h1", "s", 50, 170), ("h2", "s", 30, 120), ("h3", "s", 0, 130)]
    for some in (rows, rows[:14], rows[15:], []):
        intervals = spark.createDataFrame(some, "host_id string, source string, interval_start long, interval_end long")
        pairs = coverage.per_pair(buckets, intervals).groupBy("bucket_start").agg(F.bool_and("covers").alias("all"), F.bool_or("meets").alias("some"))
        want = {r.bucket_start: "none" if not r["some"] else "full" if r["all"] else "partial" for r in buckets.join(pairs, "bucket_start", "left").collect()}
        assert {r.bucket_start: r.coverage for r in coverage.status(buckets, intervals).collect()} == want


def test_running_trend_is_that_of_the_batch(spark, tmp_path):
    span = LocalRange(date(2023, 11, 1), date(2024, 5, 1), "Asia/Kathmandu")  # no whole hours off
    rows = usage(spark, *(at_month(m, message_id=f"m{m}-{k}", tok_input=m + k) for m in range(5) for k in range(3)))
    rows.write.parquet(str(tmp_path / "in"))
    running = ingest.running_trend(spark.readStream.schema(USAGE).parquet(str(tmp_path / "in")), span, "day")
    query = running.writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, reports.trend(reports.filtered(rows, span), span, "day").collect()))


def test_nodes_by_weight(spark):
    rows = usage(spark, *(usage_row(message_id=f"m{i}", source=s, tok_input=n) for i, (s, n) in enumerate((("b", 5), ("a", 5), ("c", 9)))))
    assert [r.source for r in reports.by_weight(reports.drill(rows, "source"), "source").collect()] == ["c", "a", "b"]


def test_made_up_exports(spark):
    from meterglass.sources import fixture

    rows = fixture.messages(spark, 400)
    got = messages.records(rows, "h")
    assert got.count() == fixture.expected(400)["eligible"] and messages.skips(messages.normalised(rows)).agg(F.sum("n")).first()[0] == fixture.expected(400)["skipped"]
    assert rows.groupBy("time_updated").count().agg(F.max("count")).first()[0] == fixture.SAME == fixture.expected(400)["same_time"]
    daily = {str(r.day): (r.tok_input, r.records, r.incomplete) for r in reports.daily(got, "UTC").collect()}
    assert daily == {d: (x["tok_input"], x["records"], x["incomplete"]) for d, x in fixture.expected(400)["daily"].items()}


def test_coverage_none_differs_from_idle(spark):
    buckets = spark.createDataFrame([(0, 10, "a"), (10, 20, "b"), (20, 30, "c"), (30, 30, "d")], "bucket_start long, bucket_end long, label string")
    spans = spark.createDataFrame([("h", "s", "live", 0, 5), ("h", "s", "bak", 5, 12), ("h", "t", "live", 0, 10), ("h", "s", "bak", 50, 40)], "host_id string, source string, origin string, interval_start long, interval_end long")
    got = {r.label: r.coverage for r in coverage.status(buckets, spans).collect()}
    assert got == {"a": "full", "b": "partial", "c": "none", "d": "none"}
    series = coverage.status(buckets, spans).withColumn("n", F.lit(None).cast("long"))
    assert {r.label: r.n for r in coverage.masked(series, "n").collect()} == {"a": 0, "b": 0, "c": None, "d": None}


def test_deltas_across_micro_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "path string, line long, total long"
    for rows in ([("a", 1, 10), ("a", 2, 25), ("b", 1, 4)], [("a", 3, 20), ("a", 4, 30), ("b", 2, 9)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = ingest.stream_deltas(spark.readStream.schema(schema).parquet(source))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = sorted((r.path, r.line, r.delta) for r in spark.read.parquet(out).collect())
    assert got == [("a", 1, 10), ("a", 2, 15), ("a", 3, 0), ("a", 4, 10), ("b", 1, 4), ("b", 2, 5)]

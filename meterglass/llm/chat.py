"""Chat formatting: the cheapest repair of a conversation's roles, and its rendering.

Legal conversations start with at most one system turn, then user and assistant take turns, user first and assistant
last. A turn may be merged into the one before, given another role, or preceded by empty turns; dynamic programming
over the automaton's states finds the repair of least cost. Costs of stretches multiply as (min, +) matrices, so a
conversation that lies in many partitions is repaired in all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROLES = ("", "system", "user", "assistant")
#: State 0 is the start; the others are the role of the last turn.
LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
LAST = 3
MERGE, INSERT, RELABEL = 2, 3, 4
FAR = 1 << 40
ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
OPEN, CLOSE = "<|im_start|>{role}\n", "<|im_end|>\n"


def role_number(role: str | None) -> int:
    """Place of a role in ROLES, 0 for one that isn't known."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES[1:] else 0


@lru_cache(maxsize=None)
def fill(state: int, target: int) -> tuple[int, ...] | None:
    """Roles of the empty turns that make a turn of role target legal after state; None if nothing does."""
    paths = [(state, ())]
    for _ in range(len(ROLES)):
        for at, path in paths:
            if target in LEGAL[at]:
                return path
        paths = [(n, (*path, n)) for at, path in paths for n in LEGAL[at]]
    return None


@lru_cache(maxsize=None)
def moves(role: int, state: int) -> tuple[tuple[int, int, bool], ...]:
    """(cost, state after, merged) of each way to take a turn of this role."""
    out = []
    for target in (1, 2, 3):
        relabel = 0 if role == target else RELABEL
        if state == target:
            out.append((relabel + MERGE, target, True))
        if (path := fill(state, target)) is not None:
            out.append((relabel + INSERT * len(path), target, False))
    return tuple(sorted(out))


@lru_cache(maxsize=None)
def ending(state: int) -> tuple[int, ...]:
    """Roles of the empty turns after the last one."""
    return () if state in (0, LAST) else (*fill(state, LAST), LAST)


def walk(roles: list[int], entry: int, leave: int | None) -> tuple[list[tuple[int, int, bool]], list[int]]:
    """The cheapest moves from state entry to state leave (None: to a legal end), and the cost of each last state."""
    cost = [FAR] * 4
    cost[entry] = 0
    back = []
    for role in roles:
        new, step = [FAR] * 4, [None] * 4
        for state in range(4):
            if cost[state] < FAR:
                for c, target, merged in moves(role, state):
                    if cost[state] + c < new[target]:
                        new[target], step[target] = cost[state] + c, (state, target, merged)
        cost = new
        back.append(step)
    if leave is None:
        leave = min(range(4), key=lambda s: cost[s] + INSERT * len(ending(s)))
    path, state = [], leave
    if cost[leave] < FAR:
        for step in reversed(back):
            path.append(step[state])
            state = step[state][0]
    return path[::-1], cost


def boundaries(runs: pd.DataFrame) -> pd.DataFrame:
    """Entry and exit state of each partition's part of one conversation. runs: part and its matrix of costs."""
    runs = runs.sort_values("part", ignore_index=True)
    matrices = [np.array(c).reshape(4, 4) for c in runs["costs"]]
    best = [np.array([0, FAR, FAR, FAR])]
    for m in matrices:
        best.append((best[-1][:, None] + m).min(axis=0))
    states = [int(np.argmin(best[-1] + [INSERT * len(ending(s)) for s in range(4)]))]
    for b, m in zip(best[-2::-1], matrices[::-1], strict=True):
        states.append(int(np.argmin(b + m[:, states[-1]])))
    states.reverse()
    last = len(runs) - 1
    return pd.DataFrame({"part": runs["part"], "entry": states[:-1], "leave": [None if i == last else s for i, s in enumerate(states[1:])]})


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Runs of rows of one conversation, in the order they come in."""
    run: list[dict] = []
    for batch in common.slices(batches, "text"):
        for row in batch.to_pylist():
            if run and run[-1]["conv"] != row["conv"]:
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def repair(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, turn, role, action, inserted, rendered): one row for each turn, after repair.

    action: keep, merge, relabel or relabel+merge; inserted: roles of the empty turns put before it (and after it, if
    it is the last); rendered: the turn's part of the rendered conversation, so that the parts in the order of turns
    make up the whole, however long it is. Turns of a conversation are taken by turn number, equal ones by role and
    text; null numbers come first. Roles are compared without case; unknown and null ones get a legal role. Null texts
    are empty. Rows without a conversation make up one. Repeated rows are repeated turns.
    """
    spark = turns.sparkSession
    rows = turns.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    keys = ["conv", "turn", "role", F.xxhash64("text")]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    # a range of (conversation, turn) a partition: a long conversation lies in several, in order
    rows = common.cut(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))
    kind = dict(rows.dtypes)

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in stretches(batches):
            roles = [role_number(r["role"]) for r in run]
            matrix = [c for s in range(4) for c in walk(roles, s, None)[1]]
            yield pa.RecordBatch.from_pylist([{"conv": run[0]["conv"], "part": run[0]["part"], "costs": matrix}], pa.schema([("conv", rows_type), ("part", pa.int32()), ("costs", pa.list_(pa.int64()))]))

    from pyspark.sql.pandas.types import to_arrow_type

    rows_type = to_arrow_type(rows.schema["conv"].dataType)
    # only conversations at the edge of a partition can lie in two: two rows a partition at most
    edge = rows.groupBy("part").agg(F.min("conv").alias("low"), F.max("conv").alias("high"), F.max(F.col("conv").isNull()).alias("none"))
    edge = edge.select("part", F.explode(F.array_distinct(F.concat(F.array("low", "high"), F.when(F.col("none"), F.array(F.lit(None).cast(kind["conv"]))).otherwise(F.array("low"))))).alias("conv"))
    shared = edge.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1")
    split = rows.join(F.broadcast(shared.select(F.col("conv").alias("c"))), F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    runs = split.mapInArrow(costs, f"conv {kind['conv']}, part int, costs array<long>")
    known = runs.groupBy("conv").applyInPandas(lambda k, g: boundaries(g).assign(conv=k[0])[["conv", "part", "entry", "leave"]], f"conv {kind['conv']}, part int, entry int, leave int").collect()
    between = spark.sparkContext.broadcast({(r["conv"], r["part"]): (r["entry"], r["leave"], r["leave"] is None) for r in known})
    out_schema = f"{conversation} {kind['conv']}, {turn} {kind['turn']}, role string, action string, inserted array<string>, rendered string"
    arrow = pa.schema([(conversation, rows_type), (turn, to_arrow_type(rows.schema["turn"].dataType)), ("role", pa.string()), ("action", pa.string()), ("inserted", pa.list_(pa.string())), ("rendered", pa.string())])

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        size = 0
        for run in stretches(batches):
            entry, leave, last = between.value.get((run[0]["conv"], run[0]["part"]), (0, None, True))
            path, _ = walk([role_number(r["role"]) for r in run], entry, leave)
            for i, (row, (state, target, merged)) in enumerate(zip(run, path, strict=True)):
                empty = () if merged else fill(state, target)
                text_ = "\n" if merged else (CLOSE if state else "") + "".join(OPEN.format(role=ROLES[e]) + CLOSE for e in empty) + OPEN.format(role=ROLES[target])
                text_ += row["text"]
                if last and i == len(run) - 1:
                    empty = (*empty, *ending(target))
                    text_ += CLOSE + "".join(OPEN.format(role=ROLES[e]) + CLOSE for e in ending(target))
                action = "+".join(["relabel"] * (role_number(row["role"]) != target) + ["merge"] * merged) or "keep"
                out.append({conversation: row["conv"], turn: row["turn"], "role": ROLES[target], "action": action, "inserted": [ROLES[e] for e in empty], "rendered": text_})
                size += len(text_)
            if size > common.SLICE_BYTES:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.mapInArrow(repaired, out_schema)

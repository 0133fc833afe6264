"""Chat formatting with minimum-cost role repair.

A legal conversation has at most one system turn, at its start, then user and assistant in turns,
beginning with user and ending with assistant. Dynamic programming over that automaton chooses, for
every turn, to place it as the next turn or to merge it into the current one, with or without a new
label, and to insert empty turns before it, at least total cost. The repaired sequence is rendered
with a marker before and after each turn.

Costs: relabel 2, merge 1, insert 3. Of equal costs, fewer insertions, then placing over merging, then
the earlier role count. Roles are trimmed and lower-cased, and common aliases count as their role; any other or null
role has to be relabelled. Null texts count as empty. Turns go by their number, null last, then role
and text; repeated rows are turns each. A null conv_id is a conversation like others. Other columns
don't matter; an empty table gives an empty result.

All turns are range-sorted by conversation and that order, repeated rows by a number of their own, so
no conversation, turn number or repeated row has to fit in a task. The sorted stream is cut into
segments: where the conversation or the task's share changes, and after ``SEGMENT`` turns or ``BYTES``
of text. Each segment gives its least cost from every state to every state, those are chained per
conversation (four numbers per segment), and each segment is rendered on its own. The result has a row per
segment; the rendered pieces join, by segment, without anything between them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnwork.llm import common

RELABEL, MERGE, INSERT = 2, 1, 3
SEGMENT = 4096
BYTES = 4 << 20
#: Turns and bytes of text that a call works on, about.
LOT, LOT_BYTES = 10_000, 16 << 20
ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: States: 0 before any turn, else 1 + the number of the current turn's role; and the roles that may follow.
NEXT = {0: (0, 1), 1: (1,), 2: (2,), 3: (1,)}
FINAL = 3
#: Bits of a segment's number within its task.
_BITS = 33


def _insertions() -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest run of inserted roles from one state to another."""
    paths = {(s, s): () for s in NEXT}
    for _ in range(3):
        for (a, b), path in list(paths.items()):
            for role in NEXT[b]:
                if (a, role + 1) not in paths:
                    paths[a, role + 1] = (*path, role)
    return paths


INSERTIONS = _insertions()


def _steps():
    """For each role of a turn (3: none of the legal ones) and states before and after: cost and (inserted, merged, role)."""
    table = [[[None] * 4 for _ in range(4)] for _ in range(4)]
    for r in range(4):
        for (a, b), inserted in INSERTIONS.items():
            ways = [(role + 1, False, role) for role in NEXT[b]] + ([(b, True, b - 1)] if b else [])
            for to, merged, role in ways:
                cost = INSERT * len(inserted) + MERGE * merged + RELABEL * (r != role)
                key = (cost, len(inserted), merged, inserted)
                if table[r][a][to] is None or key < table[r][a][to][0]:
                    table[r][a][to] = key, (inserted, merged, role)
    return [[[(x[0][0], x[1]) if x else None for x in row] for row in rows] for rows in table]


STEPS = _steps()
_INF = float("inf")
#: For each role and state after, the states before with what the step costs.
_into = [[[(a, STEPS[r][a][b][0]) for a in range(4) if STEPS[r][a][b]] for b in range(4)] for r in range(4)]


def role_number(role) -> int:
    name = str(role).strip().lower() if role is not None else ""
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else 3


def forward(roles: list[int], start: int) -> tuple[list[float], list[list[int]]]:
    """Least cost to each state after all turns, and for each turn the state before on the way to each state; of equal ones the first."""
    cost, back = [_INF] * 4, []
    cost[start] = 0
    for r in roles:
        ways = [min(((cost[a] + c, a) for a, c in into), default=(_INF, 0)) for into in _into[r]]
        cost = [c for c, _ in ways]
        back.append([a for _, a in ways])
    return cost, back


def way(roles: list[int], start: int, end: int) -> list[tuple]:
    """The action for each turn from state ``start`` to state ``end``."""
    _, back = forward(roles, start)
    out = []
    for r, before in zip(reversed(roles), reversed(back)):
        out.append(STEPS[r][before[end]][end][1])
        end = before[end]
    return out[::-1]


def closing(state: int) -> int:
    """Cost of the empty turns that end a conversation in a state."""
    return INSERT * len(INSERTIONS[state, FINAL])


def render(roles: list[int], texts: list[str], start: int, end: int, last: bool) -> tuple[str, str, int, int]:
    """The rendered turns, actions, turns opened, and cost. A turn stays open at the end unless ``last``."""
    out, names, opened, cost, state = [], [], 0, 0, start

    def turn(role: int):
        nonlocal state, opened
        out.append((CLOSE if state else "") + OPEN + ROLES[role] + "\n")
        state, opened = role + 1, opened + 1

    for r, text, (inserted, merged, role) in zip(roles, texts, way(roles, start, end)):
        for x in inserted:
            turn(x)
            names.append(f"insert {ROLES[x]}")
        if merged:
            out.append("\n")
        else:
            turn(role)
        out.append(text)
        names.append(("merge" if merged else "keep") + (f" as {ROLES[role]}" if r != role else ""))
        cost += INSERT * len(inserted) + MERGE * merged + RELABEL * (r != role)
    if last and state:
        for x in INSERTIONS[state, FINAL]:
            turn(x)
            names.append(f"insert {ROLES[x]}")
            cost += INSERT
        out.append(CLOSE)
    return "".join(out), "; ".join(names), opened, cost


def segmented(turns: DataFrame) -> DataFrame:
    """conv, segment, place, role (a number) and text of all turns, and at each segment's last turn its costs. Written to the shared folder."""
    # As text: Arrow and pandas would turn numbers beside nulls into floats.
    rows = turns.select(F.col("conv_id").cast("string").alias("conv"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("uid"))
    rows = rows.orderBy("conv", F.col("turn").isNull(), "turn", "role", "text", "uid").select("conv", "role", "text")

    def cut(batches):
        segment, conv, roles, size, place = TaskContext.get().partitionId() << _BITS, None, [], 0, 0
        held = None  # the last row, whose costs depend on whether the segment goes on

        def costs():
            return [x for s in range(4) for x in forward(roles, s)[0]]

        for batch in batches:
            out = [] if held is None else [held]
            for i, (own, role) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                text = batch.column(2)[i].as_py()
                if held is not None and (own != conv or len(roles) >= SEGMENT or size >= BYTES):
                    out[-1][5] = costs()
                    segment, roles, size, place = segment + 1, [], 0, 0
                conv, size, place = own, size + len(text), place + 1
                roles.append(role_number(role))
                held = [own, segment, place, roles[-1], text, None]
                out.append(held)
            if len(out) > 1:
                yield rows_of(out[:-1])
        if held is not None:
            held[5] = costs()
            yield rows_of([held])

    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64()))

    def rows_of(out):
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], ["conv", "segment", "place", "role", "text", "costs"])

    return common.written(rows.mapInArrow(cut, "conv string, segment long, place int, role int, text string, costs array<double>"), "turns")


def chained(found: DataFrame, lots: int) -> DataFrame:
    """segment, begin, end and last from conv, segment and costs: the states that the cheapest way passes between segments."""

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment", ignore_index=True)
        by_conv: dict = {}
        for conv, segment, costs in zip(pdf["conv"], pdf["segment"], pdf["costs"]):
            by_conv.setdefault(conv if isinstance(conv, str) else None, []).append((segment, costs))
        out = []
        for segments in by_conv.values():
            cost, back = [0, _INF, _INF, _INF], []
            for _, flat in segments:
                ways = [min((cost[a] + flat[4 * a + b], a) for a in range(4)) for b in range(4)]
                cost = [c for c, _ in ways]
                back.append([a for _, a in ways])
            state = min(range(1, 4), key=lambda s: (cost[s] + closing(s), s))
            for i in range(len(segments) - 1, -1, -1):
                out.append((segments[i][0], back[i][state], state, i == len(segments) - 1))
                state = back[i][state]
        return pd.DataFrame(out, columns=["segment", "begin", "end", "last"])

    lot = F.pmod(F.xxhash64("conv"), F.lit(lots)).alias("lot")
    plans = found.select("conv", "segment", "costs", lot).groupBy("lot").applyInPandas(chain, "segment long, begin int, end int, last boolean")
    return common.written(plans, "chat-plans")


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, segment, n_turns, n_out, cost, actions and rendered."""
    id_type = turns.schema["conv_id"].dataType.simpleString()
    rows = segmented(turns)
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # Many segments share a call: a call for each costs more than the work in it.
    lots = 1 + max(n // LOT, size // LOT_BYTES)
    plans = chained(rows.where("costs IS NOT NULL").select("conv", "segment", "costs"), 1 + n // LOT)

    def write(own: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["segment", "place"], ignore_index=True)
        ways = {s: (b, e, z) for s, b, e, z in zip(plan["segment"], plan["begin"], plan["end"], plan["last"])}
        segments, roles, texts, convs = own["segment"].to_numpy(), own["role"].tolist(), own["text"].tolist(), own["conv"].tolist()
        starts = np.flatnonzero(np.append(True, segments[1:] != segments[:-1])) if len(own) else []
        out = []
        for a, b in zip(starts, [*starts[1:], len(own)]):
            begin, end, last = ways[segments[a]]
            text, actions, opened, cost = render(roles[a:b], texts[a:b], int(begin), int(end), bool(last))
            out.append((convs[a], segments[a], b - a, opened, cost, actions, text))
        return pd.DataFrame(out, columns=["conv_id", "segment", "n_turns", "n_out", "cost", "actions", "rendered"])

    lot = F.pmod(F.xxhash64("segment"), F.lit(lots)).alias("lot")
    texts = rows.select("conv", "segment", "place", "role", "text", lot).groupBy("lot")
    schema = "conv_id string, segment long, n_turns long, n_out long, cost long, actions string, rendered string"
    out = texts.cogroup(plans.select("*", lot).groupBy("lot")).applyInPandas(write, schema)
    return out.withColumn("conv_id", F.col("conv_id").cast(id_type))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(common.table(spark, sf_dir, "conversations"))

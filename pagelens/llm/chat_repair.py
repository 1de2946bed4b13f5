"""Chat formatting by minimum-cost role repair over a legal-turn automaton.

Legal: an optional system turn, then user and assistant in turn, the assistant last. Each input turn is kept,
relabelled, or merged into the turn before it; empty turns may be inserted. The cheapest repair is a shortest
path through the automaton, found with (min, +) matrices: one per turn, multiplied within blocks of
sorted rows, bounded in rows and bytes, then stitched along each conversation, so that a conversation of any length spans many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.storage import discard, stored

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the last turn so far. NEXT holds the legal successors of each.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs of a repair; keeping a turn is free. Ties go to fewer resulting turns, then to the order of `moves`.
MERGE, RELABEL, RELABEL_SYSTEM, INSERT, UNKNOWN_ROLE = 1, 2, 3, 2, 1
#: A block, which one task holds at once, ends at so many rows or bytes of text; a longer row is a block of its own.
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20

_COUNT = 1 << 32
_FAR = 1 << 60


def _relabel(role: int, to: int) -> int:
    if role == to:
        return 0
    return UNKNOWN_ROLE if role == 0 else RELABEL_SYSTEM if SYSTEM in (role, to) else RELABEL


@cache
def moves(role: int) -> dict[tuple[int, int], tuple[int, tuple[int, ...], bool]]:
    """For a turn of `role` (0: unknown): (state, next state) -> (weight, empty turns inserted before, merged).

    A weight is cost * 2**32 + turns made, so that sums compare by cost and then by turns.
    """
    found: dict[tuple[int, int], tuple[int, tuple[int, ...], bool]] = {}

    def offer(pair: tuple[int, int], weight: int, inserted: tuple[int, ...], merged: bool) -> None:
        if pair not in found or weight < found[pair][0]:
            found[pair] = (weight, inserted, merged)

    for state in range(4):
        paths: list[tuple[int, ...]] = [()]
        for _ in range(3):
            for path in paths:
                last, price = path[-1] if path else state, len(path) * (INSERT * _COUNT + 1)
                for to in NEXT[last]:
                    offer((state, to), price + _relabel(role, to) * _COUNT + 1, path, False)
                if not path and last != START:
                    offer((state, last), (MERGE + _relabel(role, last)) * _COUNT, path, True)
            paths = [(*p, to) for p in paths for to in NEXT[p[-1] if p else state]]
    return found


@cache
def ending(state: int) -> tuple[int, tuple[int, ...]]:
    """Weight and empty turns that take a conversation from `state` to its legal end."""
    needed = {START: (USER, ASSISTANT), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}[state]
    return len(needed) * (INSERT * _COUNT + 1), needed


def _number(role: object) -> int:
    return {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}.get(role, 0)


_UNIT = [0 if a == b else _FAR for a in range(4) for b in range(4)]


def _product(matrix: list[int], role: int) -> list[int]:
    out = [_FAR] * 16
    for (s, t), (weight, _, _) in moves(role).items():
        for a in range(4):
            if matrix[a * 4 + s] + weight < out[a * 4 + t]:
                out[a * 4 + t] = matrix[a * 4 + s] + weight
    return out


def _blocks(rows: int, size: int):
    """Sorted rows with `at`, their place, and `block`, the place of the first row of their run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = at = held = None
        for batch in batches:
            if first is None:
                first = at = TaskContext.get().partitionId() << 40
                held = 0
            blocks = []
            weights = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_pylist()
            for k, n in enumerate(weights):
                if at + k > first and (at + k - first >= rows or held + n > size):
                    first, held = at + k, 0
                held += n
                blocks.append(first)
            places = pa.array(range(at, at + len(blocks)), pa.int64())
            at += len(blocks)
            yield pa.RecordBatch.from_arrays([*batch.columns, places, pa.array(blocks, pa.int64())], names=[*batch.schema.names, "at", "block"])

    return run


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A (min, +) matrix for each run of rows of one conversation and block in a batch, with the place of its first row."""
    for batch in batches:
        rows = []
        for (conv, block), part in batch.sort_values("at", kind="stable").groupby(["conv", "block"], sort=False):
            matrix = _UNIT
            for role in part["role"]:
                matrix = _product(matrix, _number(role))
            rows.append((conv, block, part["at"].iloc[0], matrix))
        yield pd.DataFrame(rows, columns=["conv", "block", "at", "matrix"])


def _joined(x: list[int], y: list[int]) -> list[int]:
    """The (min, +) product of two matrices."""
    return [min(x[a * 4 + s] + y[s * 4 + b] for s in range(4)) for a in range(4) for b in range(4)]


def _stitch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entry and exit state and first turn number of every conversation in every block; rows come in order."""

    def solved(conv: int, parts: list[tuple[int, list[int]]]) -> list[tuple]:
        best = [[0, _FAR, _FAR, _FAR]]
        for _, m in parts:
            best.append([min(best[-1][a] + m[a * 4 + b] for a in range(4)) for b in range(4)])
        state = min(range(4), key=lambda s: (best[-1][s] + ending(s)[0], s))
        total, states = best[-1][state] + ending(state)[0], [state]
        for k in range(len(parts) - 1, -1, -1):
            m = parts[k][1]
            state = min(range(4), key=lambda a: (best[k][a] + m[a * 4 + states[-1]], a))
            states.append(state)
        states.reverse()
        rows, turns = [], 0
        for k, (block, m) in enumerate(parts):
            rows.append((block, conv, states[k], states[k + 1], turns, total // _COUNT, k == len(parts) - 1))
            turns += m[states[k] * 4 + states[k + 1]] % _COUNT
        return rows

    names = ["block", "conv", "entry", "leave", "first_turn", "cost", "closes"]
    conv, parts = None, []
    for batch in batches:
        found = []
        for c, block, matrix in zip(batch["conv"], batch["block"], batch["matrix"], strict=True):
            if parts and c != conv:
                found += solved(conv, parts)
                parts = []
            conv, m = c, [int(x) for x in matrix]
            if parts and parts[-1][0] == block:  # a block that was read in several pieces
                parts[-1] = (block, [min(x, _FAR) for x in _joined(parts[-1][1], m)])
            else:
                parts.append((block, m))
        yield pd.DataFrame(found, columns=names)
    if parts:
        yield pd.DataFrame(solved(conv, parts), columns=names)


def _opening(state: int) -> str:
    return f"<|im_start|>{ROLES[state - 1]}\n"


_CLOSE = "<|im_end|>\n"


def _path(roles: list[int], entry: int, leave: int) -> list[tuple[int, tuple[int, ...], bool]]:
    """The best (state, inserted, merged) for each turn between two states."""
    best, back = [0 if s == entry else _FAR for s in range(4)], []
    for role in roles:
        now, come = [_FAR] * 4, [0] * 4
        for (s, t), (weight, _, _) in sorted(moves(role).items()):
            if best[s] + weight < now[t]:
                now[t], come[t] = best[s] + weight, s
        best = now
        back.append(come)
    states = [leave]
    for come in reversed(back):
        states.append(come[states[-1]])
    states.reverse()
    return [(t, *moves(r)[s, t][1:]) for r, s, t in zip(roles, states, states[1:])]


def _render(rows: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
    plans = {p.conv: p for p in plan.itertuples()}
    found = []
    for conv, part in rows.sort_values("at", kind="stable").groupby("conv", sort=False):
        p = plans[conv]
        chosen = _path([_number(r) for r in part["role"]], p.entry, p.leave)
        turn, before = p.first_turn, p.entry
        for k, (row, (state, inserted, merged)) in enumerate(zip(part.itertuples(), chosen, strict=True)):
            text = row.text if isinstance(row.text, str) else ""
            if merged:
                piece = "\n" + text
            else:
                piece = _CLOSE if before != START else ""
                piece += "".join(_opening(s) + _CLOSE for s in inserted) + _opening(state) + text
                turn += 1 + len(inserted)
            if p.closes and k == len(chosen) - 1:
                piece += _CLOSE + "".join(_opening(s) + _CLOSE for s in ending(state)[1])
            kept = not merged and not inserted and _number(row.role) == state
            action = "merge" if merged else "insert" if inserted else "keep" if kept else "relabel"
            found.append((row.conv_id, row.turn, row.role, ROLES[state - 1], int(turn), action, int(p.cost), piece))
            before = state
    names = ["conv_id", "turn", "role", "repaired_role", "repaired_turn", "action", "conversation_cost", "rendered"]
    return pd.DataFrame(found, columns=names)


def repair_roles(conversations: DataFrame) -> DataFrame:
    """One row per input turn: how it was repaired, and its piece of the rendered conversation.

    `conversations` has conv_id, turn, role, text; other columns are ignored. Turns are ordered by turn (null first),
    then role and a hash of text. Pieces of a conversation joined in the order of repaired_turn and turn are the whole
    rendering: they open and close turns, and hold inserted empty turns. Unknown and null roles are relabelled, a
    null text is empty, rows with a null conv_id are one conversation, repeated rows are merged. A text of any length
    is rendered whole.
    conversation_cost is the whole conversation's; an empty table gives none.
    """
    spark = conversations.sparkSession
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text"
    )
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    spread = spread.withColumn("conv", F.coalesce("conv_id", F.lit(-(1 << 63)).cast("bigint")))
    schema = "conv_id bigint, turn bigint, role string, text string, conv bigint, at bigint, block bigint"
    placed = stored(spread.mapInArrow(_blocks(BLOCK_ROWS, BLOCK_BYTES), schema))
    # pieces of a conversation are summed up where they lie; only their matrices are shuffled
    parts = stored(placed.select("conv", "role", "at", "block").mapInPandas(_summaries, "conv bigint, block bigint, at bigint, matrix array<bigint>"))
    ordered = parts.repartition("conv").sortWithinPartitions("conv", "at")
    plan = stored(
        ordered.mapInPandas(
            _stitch, "block bigint, conv bigint, entry int, leave int, first_turn bigint, cost bigint, closes boolean"
        )
    )
    discard(parts)
    schema = "conv_id bigint, turn bigint, role string, repaired_role string, repaired_turn bigint, action string, conversation_cost bigint, rendered string"
    return placed.groupBy("block").cogroup(plan.groupBy("block")).applyInPandas(_render, schema)

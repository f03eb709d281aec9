"""Chat formatting by minimum-cost role repair.

Legal conversations are an optional system turn and then user and assistant turns by turns, the last an assistant's. The
automaton has a state for what came last. A turn may be kept, relabelled or merged into the one before, and empty
turns may be inserted before it, each at its price; dynamic programming finds the cheapest repair. The costs of any
stretch of turns are a matrix between states, so that a conversation that lies in several tasks is repaired from the
matrices of its stretches: no conversation has to fit in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsieve.session import checkpointed, ship

ROLES = ("", "system", "user", "assistant")  # by state: what came last
LEGAL = {1: (0,), 2: (0, 1, 3), 3: (2,)}  # the states from which each state's turn may come
INF = 1 << 60
SLICE = 2048


@dataclass(frozen=True)
class Prices:
    merge: int = 2
    relabel: int = 3
    insert: int = 4


@lru_cache
def inserted(state: int, target: int) -> tuple[int, ...] | None:
    """The fewest empty turns that lead from a state to one from which the target's turn is legal."""
    queue = [(state, ())]
    seen = {state}
    for at, path in queue:
        if at in LEGAL[target]:
            return path
        for to, froms in LEGAL.items():
            if at in froms and to not in seen:
                seen.add(to)
                queue.append((to, (*path, to)))
    return None


@lru_cache
def steps(role: str, prices: Prices) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """For each state before and after a turn of that role, the price and the action, or None."""
    out = []
    for state in range(4):
        row: list[tuple[int, str] | None] = [None]
        for to in (1, 2, 3):
            wrong = 0 if ROLES[to] == role else prices.relabel
            options = []
            if (path := inserted(state, to)) is not None:
                options.append((wrong + prices.insert * len(path), "relabel" if wrong else "keep"))
            if to == state:
                options.append((wrong + prices.merge, "merge"))
            row.append(min(options, key=lambda o: o[0]) if options else None)
        out.append(tuple(row))
    return tuple(out)


def closing(state: int) -> tuple[int, ...]:
    """The empty turns that end a conversation legally."""
    return {0: (), 1: (2, 3), 2: (3,), 3: ()}[state]


def normal(role: str | None) -> str:
    return (role or "").strip().lower()


def costs(roles: list[str], prices: Prices) -> list[list[int]]:
    """The least costs from each state to each state over the turns."""
    rows = []
    for start in range(4):
        now = [0 if s == start else INF for s in range(4)]
        for role in roles:
            table = steps(role, prices)
            now = [min((now[s] + table[s][t][0] for s in range(4) if table[s][t]), default=INF) for t in range(4)]
        rows.append(now)
    return rows


def repair(roles: list[str], prices: Prices, start: int = 0, end: int | None = None) -> list[tuple[int, int, str]]:
    """For each turn the states before and after it, and the action, of the cheapest repair; equal ones by least state.

    end: the state after the last turn; None for the end of the conversation.
    """
    now = [0 if s == start else INF for s in range(4)]
    back = []
    for role in roles:
        table = steps(role, prices)
        best = [min(((now[s] + table[s][t][0], s) for s in range(4) if table[s][t]), default=(INF, 0)) for t in range(4)]
        back.append([s for _, s in best])
        now = [c for c, _ in best]
    state = min(range(4), key=lambda s: (now[s] + prices.insert * len(closing(s)), s)) if end is None else end
    out = []
    for role, froms in zip(reversed(roles), reversed(back)):
        before = froms[state]
        out.append((before, state, steps(role, prices)[before][state][1]))
        state = before
    return out[::-1]


def _open(state: int) -> str:
    return f"<|{ROLES[state]}|>\n"


END = "<|end|>\n"


def pieces(turns: list[tuple[str, str]], prices: Prices, start: int = 0, end: int | None = None) -> list[tuple[str, str, str]]:
    """(role, action, piece) of each turn (role, text): the pieces one after the other are the rendered conversation."""
    path = repair([r for r, _ in turns], prices, start, end)
    out = []
    for (_, text), (before, state, action) in zip(turns, path):
        if action == "merge":
            piece = "\n\n"
        else:
            piece = (END if before else "") + "".join(_open(s) + END for s in inserted(before, state)) + _open(state)
        out.append([ROLES[state], action, piece + text.replace("<|", "< |")])
    if end is None and out:
        out[-1][2] += END + "".join(_open(s) + END for s in closing(path[-1][1]))
    return [tuple(x) for x in out]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, list[tuple]]]:
    """(part, conv_id, rows) of each run of one conversation in a task's rows."""
    own: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if own and own[0][:2] != row[:2]:
                yield own[0][0], own[0][1], own
                own = []
            own.append(row)
    if own:
        yield own[0][0], own[0][1], own


def format_chats(turns: DataFrame, prices: Prices = Prices()) -> DataFrame:
    """Rows (conv_id, seq, turn, role, action, piece) for each row of turns (conv_id, turn, role, text).

    The pieces of a conversation in the order of seq, one after the other, are the whole rendered conversation. Turns
    are ordered by turn, then role and text; repeated rows are turns of their own, which merge. Unknown and null roles
    are relabelled, a null text is empty, rows without conv_id are one conversation; "<|" in a text becomes "< |". An
    empty table gives no rows, further columns are left out.
    """
    spark = turns.sparkSession
    ship(spark)
    order = ["conv_id", "turn", "role", "text", "tie"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", F.monotonically_increasing_id().alias("tie"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = checkpointed(placed.select(F.spark_partition_id().alias("part"), "conv_id", "turn", "role", "text"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and the last conversation of a task: those that others may hold parts of."""
        first = last = None
        for part, conv, run in _runs(batches):
            if first is None:
                first = (part, conv, len(run), sum(costs([normal(r[3]) for r in run], prices), []))
            else:
                last = (part, conv, run)
        found = [first] if first else []
        if last:
            found.append((*last[:2], len(last[2]), sum(costs([normal(r[3]) for r in last[2]], prices), [])))
        columns = [*zip(*found)] or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["part", "conv_id", "n", "costs"])

    stretches = defaultdict(list)
    for r in placed.mapInArrow(edges, "part int, conv_id long, n long, costs array<long>").collect():  # two rows for each task
        stretches[r.conv_id].append(r)
    known: dict[tuple[int, int | None], tuple[int, int | None, int]] = {}
    for conv, own in stretches.items():
        if len(own) < 2:
            continue
        own.sort(key=lambda r: r.part)
        now, back = [0, INF, INF, INF], []
        for r in own:
            best = [min((min(INF, now[s] + r.costs[4 * s + t]), s) for s in range(4)) for t in range(4)]
            back.append([s for _, s in best])
            now = [c for c, _ in best]
        state = min(range(4), key=lambda s: (now[s] + prices.insert * len(closing(s)), s))
        at = sum(r.n for r in own)
        for k in range(len(own) - 1, -1, -1):
            before = back[k][state]
            at -= own[k].n
            known[own[k].part, conv] = (before, None if k == len(own) - 1 else state, at)
            state = before
    shared = spark.sparkContext.broadcast(known)  # two entries for each task at most
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    names = ["conv_id", "seq", "turn", "role", "action", "piece"]

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        for part, conv, run in _runs(batches):
            start, end, at = shared.value.get((part, conv), (0, None, 0))
            for k, (row, piece) in enumerate(zip(run, pieces([(normal(r[3]), r[4] or "") for r in run], prices, start, end))):
                ready.append((conv, at + k, row[2], *piece))
            if len(ready) >= SLICE:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready), kinds)], names)
                ready = []
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*ready)] or [[]] * 6, kinds)], names)

    return placed.mapInArrow(repaired, "conv_id long, seq long, turn long, role string, action string, piece string")

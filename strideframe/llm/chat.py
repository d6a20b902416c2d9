"""Chat formatting with the cheapest repair of roles.

Legal conversations are the words of an automaton: perhaps a system turn, then
user and assistant in turn, user first, at least one user after a system turn.
A turn can be kept (0), merged into the one before it (2), relabelled (4, as
system 6; with a merge both), and empty turns can be put before it (3 each) or
at the end.
For each role these choices make a table: from each state to each state, the
cheapest choice. Dynamic programming over the tables finds the cheapest
repair; of equal ones, at each turn the first in the order of states.

A conversation may be longer than a task holds: rows are range-partitioned by
(conversation, turn), and a conversation cut by a partition's edge goes through
a scan over partitions: least-cost tables (min-plus products) give the cost
that follows each edge, then state maps give the state that enters it. So the
result does not depend on the cuts. What reaches the driver is 16 numbers for
each cut conversation and partition.

Defined results: rows are ordered by turn (null first), role, hash of the text; an unknown
or null role cannot be kept; a null text is empty; a null conversation id is a
conversation of its own; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.session import settle

ROLES = ("system", "user", "assistant")
MERGE, INSERT = 2, 3
#: Cost of making a turn one of each role, if it was another.
RELABEL = (6, 4, 4)
#: States: nothing yet, after a system, user or assistant turn. Legal next roles of each, and what may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({0, 1}, {1}, {2}, {1})
ENDS = (True, False, True, True)
INFINITE = 1 << 60
#: Rows of a partition, about.
ROWS = 200_000


def inserts(state: int) -> dict[int, tuple[int, tuple[str, ...]]]:
    """States reached by up to two empty turns: cost and their roles."""
    out = {state: (0, ())}
    edge = {state: ()}
    for n in (1, 2):
        edge = {r + 1: (*roles, ROLES[r]) for s, roles in edge.items() for r in sorted(NEXT[s])}
        for s, roles in edge.items():
            out.setdefault(s, (n * INSERT, roles))
    return out


def choices(role: int) -> list[list[tuple[int, str, tuple[str, ...]]]]:
    """From each state to each state: (cost, action, roles put before) of the cheapest choice for a turn of this role (3: unknown)."""
    table = [[(INFINITE, "", ())] * 4 for _ in range(4)]
    for s in range(4):
        if s != START:
            same = s - 1 == role
            table[s][s] = min(table[s][s], (MERGE + (0 if same else RELABEL[s - 1]), "merge" if same else "merge relabelled", ()))
        for via, (cost, roles) in inserts(s).items():
            for r in sorted(NEXT[via]):
                mine = (cost + (0 if r == role else RELABEL[r]), "keep" if r == role else "relabel", roles)
                table[s][r + 1] = min(table[s][r + 1], mine)
    return table


TABLES = [choices(r) for r in range(4)]
COSTS = [[[c[0] for c in row] for row in t] for t in TABLES]
CLOSING = [min((cost, roles) for via, (cost, roles) in inserts(s).items() if ENDS[via]) for s in range(4)]
END = tuple(c[0] for c in CLOSING)


def before(role: int, after: tuple) -> tuple[tuple, tuple]:
    """Least cost from each state when ``after`` follows the turn, and the state it leads to."""
    cost, move = [], []
    for row in COSTS[role]:
        sums = [c + a for c, a in zip(row, after, strict=True)]
        cost.append(min(sums))
        move.append(sums.index(cost[-1]))
    return tuple(cost), tuple(move)


class Steps:
    """``before`` on vectors less their least entry, of which there are few, remembered."""

    def __init__(self):
        self.known: dict = {}

    def back(self, roles: list[int], after: tuple) -> tuple[list[tuple], tuple]:
        """The move of every turn of a stretch, and the cost that leads into it (up to a constant)."""
        moves = [()] * len(roles)
        for k in range(len(roles) - 1, -1, -1):
            key = (roles[k], after)
            if key not in self.known:
                cost, move = before(*key)
                self.known[key] = (tuple(c - min(cost) for c in cost), move)
            after, moves[k] = self.known[key]
        return moves, after


def product(roles: list[int]) -> list[list[int]]:
    """Least cost from each state to each state over a stretch."""
    out = np.full((4, 4), INFINITE, np.int64)
    out[np.arange(4), np.arange(4)] = 0
    tables = [np.minimum(np.array(c, np.int64), INFINITE) for c in COSTS]
    for r in roles:
        out = np.minimum((out[:, :, None] + tables[r][None]).min(1), INFINITE)
    return out.tolist()


def ordered(turns: DataFrame, rows: int = ROWS) -> DataFrame:
    role = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int"), F.lit(0))
    named = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.when(role > 0, role - 1).otherwise(3).cast("int").alias("code"), F.monotonically_increasing_id().alias("row"),
    )
    parts = max(1, -(-turns.count() // rows))
    order = ["conv_id", "turn", "role", F.xxhash64("text"), "row"]
    return settle(named.repartitionByRange(parts, *order).sortWithinPartitions(*order))


def _fragments(conv: list) -> list[tuple[int, int]]:
    """First and last row of each conversation of a partition."""
    cuts = [k for k in range(1, len(conv)) if conv[k] != conv[k - 1]]
    return list(zip([0, *cuts], [*cuts, len(conv)], strict=True))


def _edges(rows: DataFrame) -> list[dict]:
    """The first and last conversation of every partition, in order of partition, with its least-cost table."""

    def run(batches):
        from pyspark import TaskContext

        conv, code = [], []
        for batch in batches:
            conv += batch.column(0).to_pylist()
            code += batch.column(1).to_pylist()
        if conv:
            parts = _fragments(conv)
            picked = sorted({0, len(parts) - 1})
            at = [parts[k] for k in picked]
            columns = [[TaskContext.get().partitionId()] * len(at), picked, [conv[a] for a, _ in at], [sum(product(code[a:b]), []) for a, b in at], [len(parts)] * len(at)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "place", "conv", "costs", "parts"])

    found = rows.select("conv_id", "code").mapInArrow(run, "part int, place int, conv long, costs array<long>, parts int").collect()
    return sorted((r.asDict() for r in found), key=lambda r: (r["part"], r["place"]))


def _after(edges: list[dict]) -> dict[tuple[int, int], tuple[tuple, bool]]:
    """(partition, place) -> cost that follows that fragment, and whether its conversation goes on."""
    out: dict[tuple[int, int], tuple[tuple, bool]] = {}
    follow, conv = END, object()
    for e in reversed(edges):
        last = e["place"] == e["parts"] - 1
        goes_on = last and conv == e["conv"]
        after = follow if goes_on else END
        out[e["part"], e["place"]] = (after, goes_on)
        costs = np.array(e["costs"], np.int64).reshape(4, 4)
        into = (costs + np.minimum(np.array(after, np.int64), INFINITE)[None]).min(1)
        follow, conv = (tuple(int(x) for x in into - into.min()), e["conv"]) if e["place"] == 0 else (END, object())
    return out


def _entries(rows: DataFrame, edges: list[dict], after: dict) -> dict[int, int]:
    """partition -> state in which its first conversation is entered."""
    ends = {k: v[0] for k, v in after.items()}

    def run(batches):
        from pyspark import TaskContext

        part, conv, code = TaskContext.get().partitionId(), [], []
        for batch in batches:
            conv += batch.column(0).to_pylist()
            code += batch.column(1).to_pylist()
        if conv:
            parts = _fragments(conv)
            steps, picked, maps = Steps(), sorted({0, len(parts) - 1}), []
            for k in picked:
                moves, _ = steps.back(code[slice(*parts[k])], ends[part, k])
                state = list(range(4))
                for move in moves:
                    state = [move[s] for s in state]
                maps.append(state)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(picked), pa.int32()), pa.array(picked, pa.int32()), pa.array(maps, pa.list_(pa.int32()))], names=["part", "place", "map"])

    maps = {(r["part"], r["place"]): r["map"] for r in rows.select("conv_id", "code").mapInArrow(run, "part int, place int, map array<int>").collect()}
    out, state, open_ = {}, START, False
    for e in edges:
        if e["place"] == 0:
            out[e["part"]] = state if open_ else START
        state = maps[e["part"], e["place"]][out[e["part"]] if e["place"] == 0 else START]
        open_ = after[e["part"], e["place"]][1]
    return out


def repair(turns: DataFrame, rows: int = ROWS) -> DataFrame:
    """A row for each turn: what becomes of it, at which cost, and its piece of the rendered conversation.

    The pieces of a conversation, in order of ``position`` within ``part``, joined make its rendering.
    """
    table = ordered(turns, rows)
    edges = _edges(table)
    after = _after(edges)
    entry = _entries(table, edges, after)

    def run(batches):
        from pyspark import TaskContext

        part, steps, held = TaskContext.get().partitionId(), Steps(), list(batches)
        conv = [c for b in held for c in b.column(0).to_pylist()]
        code = [c for b in held for c in b.column(1).to_pylist()]
        done: list[tuple] = []
        parts = _fragments(conv) if conv else []
        for k, (a, b) in enumerate(parts):
            follow, goes_on = after.get((part, k), (END, False))
            moves, _ = steps.back(code[a:b], follow)
            state = entry[part] if k == 0 else START
            for at, move in zip(range(a, b), moves, strict=True):
                new = move[state]
                cost, action, put = TABLES[code[at]][state][new]
                close = "" if goes_on or at < b - 1 else "".join(["<|end|>\n", *[f"<|{r}|>\n<|end|>\n" for r in CLOSING[new][1]]])
                cost += CLOSING[new][0] if close else 0
                if action.startswith("merge"):
                    head = "\n"
                else:
                    head = ("<|end|>\n" if state != START else "") + "".join([f"<|{r}|>\n<|end|>\n" for r in put]) + f"<|{ROLES[new - 1]}|>\n"
                done.append((ROLES[new - 1], action, ",".join(put), cost, head, close))
                state = new
        start = 0
        for b in held:
            rows = done[start : start + b.num_rows]
            texts = b.column(4).to_pylist()
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            pieces = [h + t + c for h, t, c in zip(columns[4], texts, columns[5], strict=True)]
            arrays = [b.column(0), b.column(2), b.column(3), *[pa.array(columns[k], pa.string()) for k in range(3)], pa.array(columns[3], pa.int32())]
            arrays += [pa.array([part] * len(rows), pa.int32()), pa.array(range(start, start + len(rows)), pa.int64()), pa.array(pieces, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "turn", "role", "new_role", "action", "put_before", "cost", "part", "position", "piece"])
            start += b.num_rows

    schema = "conv_id long, turn long, role string, new_role string, action string, put_before string, cost int, part int, position long, piece string"
    return table.select("conv_id", "code", "turn", "role", "text").mapInArrow(run, schema)


def render(repaired: DataFrame) -> DataFrame:
    """One row for each conversation, for conversations that fit a row."""
    pieces = F.sort_array(F.collect_list(F.struct("part", "position", "piece")))
    return repaired.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.concat_ws("", F.transform(pieces, lambda p: p["piece"])).alias("rendered"))

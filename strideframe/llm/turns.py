"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation is a sequence of turns, whole ones being empty or an optional
system turn and then one or more pairs of user and assistant. Faulty turns are
blank, duplicates (role and text seen earlier) or truncated (no full stop).
Edits: a turn is kept, reroled to user or assistant, or deleted, and empty turns
are inserted; blank and duplicate turns have to be deleted, a truncated one that
stays costs more. The cheapest edits are taken, of equal ones those whose
initials (D, I, K, R) come first.

The edits walk through four states: nothing yet, after a system, a user, an
assistant turn. Forward vectors hold for each state the least cost of reaching
it and the order of the initials on the way there, backward vectors the least
cost of what follows. Where they meet, in the middle of a conversation, the
crossing is the cheapest state and of equal ones the one whose way there comes
first: ways to different states end with different turns' edits, so none begins
another and what follows cannot change their order. Both halves are solved in
the same way, between their crossings; what is held is a state for each turn.

Conversations may be longer than a task holds. Rows are range-partitioned by
conversation and turn; a conversation that lies in several partitions is first
crossed at their edges: each part gives its vectors from every state, the
driver composes them (32 small numbers for each part of a cut conversation,
two parts for a partition at most), and each part is then solved on its own.
Equal rows are one row with a number of copies, all but the first duplicates.

Defined results: null turns come first; equal turns are ordered by role, then
text; a null conversation id is a conversation; null roles and texts are one
space; a role counts by its first letter, an empty role cannot be kept; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import keep
from strideframe.session import settle

START, SYSTEM, USER, ASSISTANT = range(4)
#: Initials of the roles that each state follows, and the state after each state's turn of a pair.
INITIALS = "sua"
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = ("", "", "user", "assistant")
INFINITE = 1 << 40
#: Bytes and rows of a partition, about, and bytes of the pieces that a cut conversation is hashed in.
BYTES, ROWS, PIECE = 1 << 24, 1 << 16, 1 << 18
FAULTS = ("", "truncated", "duplicate", "blank")
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Costs:
    """What edits cost; inserting has to cost something."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def options(code: int, costs: Costs) -> list[list[tuple[int, str] | None]]:
    """From each state to each state, the first of the cheapest edits that pass a turn: cost and initials.

    ``code`` is 4 times the fault (0 none, 1 truncated, 2 must go) plus the role (3: another one).
    Inserts stand directly before a turn that stays, so that edits have one form only.
    """
    fault, role = divmod(code, 4)
    table: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for s in range(4):
        table[s][s] = (costs.delete, "D")
        via, edits, cost = s, "", costs.truncated if fault == 1 else 0
        for _ in range(3 if fault < 2 else 0):
            found = [(NEXT[via], cost + costs.rerole, edits + "R")]
            if (role == 0 and via == START) or role == NEXT[via] - 1:
                found.append((role + 1, cost, edits + "K"))
            for to, price, text in found:
                table[s][to] = min(x for x in (table[s][to], (price, text)) if x)
            via, edits, cost = NEXT[via], edits + "I", cost + costs.insert
    return table


def closings(costs: Costs) -> list[tuple[int, str]]:
    """Cheapest way to end from each state."""
    return [(0, ""), (2 * costs.insert, "II"), (costs.insert, "I"), (0, "")]


class Vectors:
    """Forward and backward steps over four states, each computed once: their number is small.

    A vector holds costs less their least, so that few differ: what lies further
    apart than two inserts and a deletion cannot be on a cheapest way.
    """

    def __init__(self, costs: Costs):
        self.tables = [options(c, costs) for c in range(12)]
        self.closing = closings(costs)
        self.bound = 2 * costs.insert + costs.delete
        self.names: dict[tuple, int] = {}
        self.values: list[tuple] = []
        self.ahead: list[list[int]] = []
        self.taken: list[list[int]] = []
        self.back: list[list[int]] = []
        self.starts = [self.number(tuple((0, 0) if q == s else (INFINITE, 0) for q in range(4))) for s in range(4)]
        self.stops = [self.number(tuple(0 if q == s else INFINITE for q in range(4))) for s in range(4)]

    def number(self, value: tuple) -> int:
        if value not in self.names:
            self.names[value] = len(self.values)
            self.values.append(value)
            self.ahead.append([-1] * 12)
            self.taken.append([0] * 12)
            self.back.append([-1] * 12)
        return self.names[value]

    def compose(self, vector: tuple, table: list[list[tuple | None]]) -> tuple[int, tuple]:
        """The least cost after a table of (cost, anything with an order), and (cost above it, order) of each state."""
        best: list[tuple | None] = [None] * 4
        for s, (cost, order) in enumerate(vector):
            for q, step in enumerate(table[s]) if cost < INFINITE else ():
                if step and step[0] < INFINITE:
                    way = (cost + step[0], order, step[1])
                    best[q] = min(x for x in (best[q], way) if x)
        least = min(b[0] for b in best if b)
        ways = sorted({b[1:] for b in best if b and b[0] - least <= self.bound})
        return least, tuple((b[0] - least, ways.index(b[1:])) if b and b[0] - least <= self.bound else (INFINITE, 0) for b in best)

    def step(self, at: int, code: int) -> int:
        self.taken[at][code], value = self.compose(self.values[at], self.tables[code])
        to = self.ahead[at][code] = self.number(value)
        return to

    def forward(self, at: int, codes: bytes, low: int, high: int) -> int:
        ahead = self.ahead
        for c in codes[low:high]:
            to = ahead[at][c]
            at = to if to >= 0 else self.step(at, c)
        return at

    def before(self, follow: tuple, table: list[list[tuple | None]]) -> tuple:
        sums = [min((step[0] + follow[q] for q, step in enumerate(row) if step), default=INFINITE) for row in table]
        least = min(sums)
        return tuple(min(x - least, INFINITE) for x in sums)

    def backward(self, at: int, codes: bytes, low: int, high: int) -> int:
        back = self.back
        for c in reversed(codes[low:high]):
            to = back[at][c]
            if to < 0:
                to = back[at][c] = self.number(self.before(self.values[at], self.tables[c]))
            at = to
        return at

    @staticmethod
    def meet(ways: tuple, follow: tuple) -> int:
        """The cheapest crossing, of equal ones the one whose way comes first."""
        return min((cost + follow[q], order, q) for q, (cost, order) in enumerate(ways))[2]

    def last(self, start: int, codes: bytes) -> int:
        """State after the last turn, if the conversation ends there."""
        return self.meet(self.values[self.forward(self.starts[start], codes, 0, len(codes))], tuple(c for c, _ in self.closing))

    def solve(self, codes: bytes, start: int, stop: int) -> list[str]:
        """Initials of the edits that pass each turn, from state ``start`` to ``stop``."""
        state = bytearray(len(codes) + 1)
        state[0], state[-1] = start, stop
        todo = [(0, len(codes))]
        while todo:
            low, high = todo.pop()
            if high - low < 2:
                continue
            mid = (low + high) // 2
            ways = self.forward(self.starts[state[low]], codes, low, mid)
            follow = self.backward(self.stops[state[high]], codes, mid, high)
            state[mid] = self.meet(self.values[ways], self.values[follow])
            todo += [(low, mid), (mid, high)]
        return [self.tables[c][a][b][1] for c, a, b in zip(codes, state, state[1:], strict=False)]

    def summary(self, codes: bytes) -> list[int]:
        """Costs and orders of the states after a part, from each state before it."""
        out = []
        for at in self.starts:
            total = 0
            for c in codes:
                to = self.ahead[at][c] if self.ahead[at][c] >= 0 else self.step(at, c)
                total, at = total + self.taken[at][c], to
            out += [x for cost, order in self.values[at] for x in (min(total + cost, INFINITE), order)]
        return out


def ordered(turns: DataFrame, copies: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, copies, fault (number) in order of conversation and turn, equal rows as one.

    ``copies`` names a column with how often each row counts.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    many = (F.col(copies) if copies else F.lit(1)).cast("long").alias("copies")
    named = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role").alias("role"), space("text").alias("text"), many)
    rows = named.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    # of a text that a role says in several turns, the first: null comes first
    key = {"no": F.col("conv_id").isNull(), "c": F.coalesce("conv_id", F.lit(0)), "h": F.xxhash64("text"), "g": F.xxhash64(F.lit(1), "text")}
    rows = rows.withColumns(key)
    said = rows.groupBy(*key, "role").agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("none"), F.count(F.lit(1)).alias("times"))
    rows = rows.join(said.where("times > 1").drop("times"), [*key, "role"], "left")
    again = F.coalesce((F.col("turn") > F.col("first")) | (F.col("none") & F.col("turn").isNotNull()), F.lit(False))
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(last == "", 3).when(again, 2).when(~last.isin(".", "!", "?"), 1).otherwise(0).cast("int")
    rows = rows.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))
    size = named.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0]
    parts = max(1, -(-size[0] // ROWS), -(-size[1] // BYTES))
    # edges are drawn by the beginnings of long texts
    dealt = rows.repartitionByRange(parts, "conv_id", "turn", "role", F.substring("text", 1, 100))
    return settle(dealt.sortWithinPartitions("conv_id", "turn", "role", "text"))


def _codes(role: list[str], fault: list[int]) -> bytes:
    """A code for the first of each row's copies; the others are deleted on every way."""
    return bytes(4 * min(f, 2) + (INITIALS.find(r[:1]) if r else 3) % 4 for r, f in zip(role, fault, strict=True))


def _fragments(batches):
    """(place, rows) of each stretch of a conversation in a partition; rows as lists by column, the conversation first."""
    held, conv, place = None, None, 0
    for batch in batches:
        table = [c.to_pylist() for c in batch.columns]
        start = 0
        for k in range(batch.num_rows + 1):
            if k < batch.num_rows and held is not None and table[0][k] == conv:
                continue
            if held is not None:
                for own, column in zip(held, table, strict=True):
                    own += column[start:k]
                if k < batch.num_rows:
                    yield place, held
                    place += 1
            if k < batch.num_rows:
                held, conv, start = [[] for _ in table], table[0][k], k
    if held is not None:
        yield place, held


def _parts(rows: DataFrame, costs: Costs) -> list[dict]:
    """The first and last conversation of every partition, in order, with what passes through them."""

    def run(batches):
        from pyspark import TaskContext

        vectors, part, kept = Vectors(costs), TaskContext.get().partitionId(), []
        for place, (conv, role, fault) in _fragments(batches):
            kept = [*kept[:1], (place, conv[0], _codes(role, fault))]
        kept = [(place, conv, vectors.summary(codes)) for place, conv, codes in kept]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        columns = [[part] * len(kept), *[[k[j] for k in kept] for j in range(3)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "place", "conv", "ways"])

    found = rows.select("conv_id", "role", "fault").mapInArrow(run, "part int, place int, conv long, ways array<long>").collect()
    return sorted((r.asDict() for r in found), key=lambda r: (r["part"], r["place"]))


def _crossings(parts: list[dict], costs: Costs) -> dict[tuple[int, int], tuple[int, int | None]]:
    """(partition, place) -> state before and after that part of a cut conversation; None: it ends there."""
    vectors, out = Vectors(costs), {}
    chains: list[list[dict]] = []
    for p in parts:
        goes_on = chains and p["place"] == 0 and chains[-1][-1]["conv"] == p["conv"] and chains[-1][-1]["part"] != p["part"]
        chains[-1].append(p) if goes_on else chains.append([p])
    for chain in chains:
        if len(chain) == 1:
            continue
        tables = [[[(p["ways"][8 * s + 2 * q], p["ways"][8 * s + 2 * q + 1]) for q in range(4)] for s in range(4)] for p in chain]
        # a vector is less its least cost, which differs from state to state before it
        after = [tuple(c for c, _ in vectors.closing)]
        for t in reversed(tables[1:]):
            after.append(vectors.before(after[-1], t))
        after.reverse()
        way, state = tuple((0, 0) if q == START else (INFINITE, 0) for q in range(4)), START
        for p, t, follow in zip(chain, tables, after, strict=True):
            _, way = vectors.compose(way, t)
            to = vectors.meet(way, follow)
            out[p["part"], p["place"]] = (state, None if p is chain[-1] else to)
            state = to
    return out


EDITS = "conv_id long, part int, position long, turn long, edit string, role string, new_role string, text string, fault string, times long, cost long"


def repair(turns: DataFrame, costs: Costs | None = None, copies: str | None = None) -> DataFrame:
    """A row for each edit, in order of ``part`` and ``position``.

    role and text are those of the turn (an inserted one has a new role and an
    empty text only), new_role is null if it is deleted. Copies of a row are
    deleted together: ``times`` says how many turns the edit is for.
    """
    costs = costs or Costs()
    rows = ordered(turns, copies)
    crossings = _crossings(_parts(rows, costs), costs)
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.int64()]
    names = [c.split()[0] for c in EDITS.split(", ")]

    def table(found):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    def run(batches):
        from pyspark import TaskContext

        vectors, part, out, size, position = Vectors(costs), TaskContext.get().partitionId(), [], 0, 0
        for place, (convs, role, fault, turn, text, many) in _fragments(batches):
            codes = _codes(role, fault)
            state, stop = crossings.get((part, place), (START, None))
            ends = stop is None
            edits = vectors.solve(codes, state, vectors.last(state, codes) if ends else stop)
            for conv, r, f, t, x, n, edit in zip(convs, role, fault, turn, text, many, edits, strict=True):
                for e in edit:
                    new, cost = None, costs.delete
                    if e != "D":
                        state = SYSTEM if e == "K" and r[0] == "s" else NEXT[state]
                        new = r if e == "K" else NAMES[state]
                        cost = costs.insert if e == "I" else costs.rerole * (e == "R") + costs.truncated * (f == 1)
                    out.append((conv, part, position, *((None, e, None, new, "", "") if e == "I" else (t, e, r, new, x, FAULTS[f])), 1, cost))
                    position += 1
                if n > 1:
                    out.append((conv, part, position, t, "D", r, None, x, FAULTS[max(f, 2)], n - 1, (n - 1) * costs.delete))
                    position += 1
                size += len(x)
                if len(out) > 5000 or size > BYTES:
                    yield table(out)
                    out, size = [], 0
            for e in vectors.closing[state][1] if ends else "":
                state = NEXT[state]
                out.append((convs[0], part, position, None, e, None, NAMES[state], "", "", 1, costs.insert))
                position += 1
        if out:
            yield table(out)

    return rows.select("conv_id", "role", "fault", "turn", "text", "copies").mapInArrow(run, EDITS)


COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


class Tally:
    """What is known of a stretch of a conversation's edits."""

    def __init__(self):
        self.counts = dict.fromkeys(COUNTS, 0)
        self.distinct, self.low, self.high = 0, None, None
        self.first = self.last = None
        self.audit: list[str] = []

    def add(self, turn, edit, role, fault, times, cost):
        self.audit.append(edit * times)
        self.counts["cost"] += cost
        if edit == "I":
            return
        if fault:
            self.counts[fault] += times
        initial = role[:1]
        self.counts["illegal"] += (times - 1) + (self.last is not None and self.last + initial not in ("su", "ua", "au"))
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None and turn != self.high:  # turns come in order
            self.distinct, self.low, self.high = self.distinct + 1, turn if self.low is None else self.low, turn

    def join(self, other: dict):
        """Go on with the next stretch."""
        for c in COUNTS:
            self.counts[c] += other[c]
        if other["first"] is not None:
            self.counts["illegal"] += self.last is not None and self.last + other["first"] not in ("su", "ua", "au")
            self.first, self.last = other["first"] if self.first is None else self.first, other["last"]
        if other["low"] is not None:
            self.distinct += other["distinct"] - (self.high == other["low"])
            self.low, self.high = other["low"] if self.low is None else self.low, other["high"]
        self.audit.append(other["audit"])

    def row(self) -> dict:
        return {**self.counts, "distinct": self.distinct, "low": self.low, "high": self.high, "first": self.first, "last": self.last, "audit": "".join(self.audit)}

    def told(self, conv, sha: str) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        c = self.counts
        return conv, gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], c["cost"], "".join(self.audit), sha


DIGESTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
STRETCH = "conv_id long, part int, seq long, blank long, duplicate long, truncated long, illegal long, cost long, distinct long, low long, high long, first string, last string, audit string, piece binary"


def _typed(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*[c.split() for c in schema.split(", ")], strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def digests(edits: DataFrame) -> DataFrame:
    """Counts, audit and hash of the repaired turns of every conversation. ``edits`` come as ``repair`` gives them.

    A conversation inside a partition is done there; of the first and the last
    one of each partition the parts go on, in pieces, to one stream each.
    """
    done = [c.split()[0] for c in DIGESTS.split(", ")]
    parts = [c.split()[0] for c in STRETCH.split(", ")]
    both = ", ".join([STRETCH, "gaps long, repaired_sha256 string"])

    def run(batches):
        from pyspark import TaskContext

        part, out, size = TaskContext.get().partitionId(), [], 0
        waiting = None  # the stretch before this one: is it the last?

        def finish(stretch, edge):
            conv, tally, lines = stretch
            if not edge:
                told = dict(zip(done, tally.told(conv, hashlib.sha256(bytes(lines[1:])).hexdigest()), strict=True))
                yield tuple({**dict.fromkeys(parts), **told}[c] for c in names)
                return
            pieces = [bytes(lines[k : k + PIECE]) for k in range(0, len(lines), PIECE)] or [b""]
            for seq, piece in enumerate(pieces):
                row = (tally if seq == 0 else Tally()).row()
                yield tuple({"conv_id": conv, "part": part, "seq": seq, "piece": piece, "gaps": None, "repaired_sha256": None, **row}[c] for c in names)

        names = [c.split()[0] for c in both.split(", ")]
        now, place = None, -1
        for batch in batches:
            for conv, turn, edit, role, new, text, fault, times, cost in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or conv != now[0]:
                    if waiting is not None:
                        out += finish(waiting, place == 1)
                    waiting, now, place = now, (conv, Tally(), bytearray()), place + 1
                now[1].add(turn, edit, role, fault, times, cost)
                if new is not None:
                    now[2].extend(f"\n{new}:{text}".encode("utf-8", "surrogatepass"))
                if len(out) >= 1000:
                    yield _typed(out, both)
                    out = []
        if waiting is not None:
            out += finish(waiting, place == 1)
        if now is not None:
            out += finish(now, True)
        for k in range(0, len(out), 100):
            yield _typed(out[k : k + 100], both)

    def stream(batches):
        now, tally, sha, begun = None, None, None, False
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != now[0]:
                    if now is not None:
                        yield _typed([tally.told(now[0], sha.hexdigest())], DIGESTS)
                    now, tally, sha, begun = (row["conv_id"],), Tally(), hashlib.sha256(), False
                if row["seq"] == 0:
                    tally.join(row)
                piece = row["piece"]
                sha.update(piece if begun else piece[1:])
                begun = begun or bool(piece)
        if now is not None:
            yield _typed([tally.told(now[0], sha.hexdigest())], DIGESTS)

    columns = ["conv_id", "turn", "edit", "role", "new_role", "text", "fault", "times", "cost"]
    found = keep(edits.select(*columns).mapInArrow(run, both), "stretches")
    open_ones = found.where("part is not null").select(*parts).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return found.where("part is null").select(*done).unionByName(open_ones.mapInArrow(stream, DIGESTS))


def damage(turns: DataFrame) -> DataFrame:
    """Rows of conversations with planted faults, told by a hash of conversation and turn; ``copies`` of each row."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    copies = F.when(kind == 3, 2).otherwise(1)
    return turns.where(kind != 0).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), copies.alias("copies"))


def audit_damaged(turns: DataFrame) -> DataFrame:
    """``digests`` of the repaired conversations after ``damage``, also of those that lost every turn."""
    found = digests(repair(damage(turns), copies="copies"))
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    every = turns.select(F.col("conv_id").cast("long").alias("own")).distinct()
    joined = every.join(found, F.col("own").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("own", "conv_id")
    empty = {c: F.lit(0) for c in names} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return joined.select("conv_id", *[F.coalesce(c, empty[c]).alias(c) for c in names[1:]])

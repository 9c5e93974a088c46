"""Conversation structure repair by survivor-coalescence Viterbi.

The cheapest edits that turn a conversation's roles into ``(s?(ua)+)?`` are a shortest path through four states:
nothing written, system, user, assistant. Each state keeps one survivor, the cheapest path that ends in it (of equal
cost the one whose edits read ASCII-least); survivors share a tree of back-pointers with reference counts. As soon
as all survivors descend from one node, everything above it is decided: its edits are written out and forgotten,
so memory holds the undecided suffix only.

Faults are found by joins and aggregations; then every conversation is read once, in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Costs of the edits, and white space.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = r"\x20\x09-\x0D"
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = (EMPTY, SYSTEM, USER, ASSISTANT)
ACCEPTED = (EMPTY, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
FAULTS = ("blank", "duplicate", "truncated")


# --- faults, in SQL -------------------------------------------------------------------------------

def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after deterministic damage by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (it stays without role and text, so that its conversation is not forgotten), 1 empties its text, 2 removes sentence ends, 3 repeats the row, 4 makes the role ``user``.
    Nulls count as one space in role, text and the hashed key; a null ``turn`` stays null.
    """
    kind = F.crc32(F.concat(_shown(F.col("conv_id")), F.lit(":"), _shown(F.col("turn"))).cast("binary")) % 20
    text, role = _shown(F.col("text")), _shown(F.col("role"))
    damaged = rows.select("conv_id", "turn", kind.alias("__kind"), role.alias("role"), text.alias("text"))
    copies = F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return damaged.select(
        "conv_id", "turn", F.when(F.col("__kind") == 4, "user").when(F.col("__kind") != 0, F.col("role")).alias("role"),
        F.when(F.col("__kind") == 0, None).when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"), F.explode(copies).alias("__copy")).drop("__copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Add ``fault``: blank, duplicate, truncated or null, the first that holds.

    A duplicate has role and text of an earlier row of its conversation. Rows are ordered by turn (nulls first), role
    and text, so a row repeats an earlier one if the same role and text stand at a smaller turn (``repeats``), or
    if the row just before it is equal; the second is left to the reader of the sorted rows. Smallest turns are
    aggregated before the shuffle and kept only where they differ, so a hot text is one side of a plain join.
    """
    order = F.struct(F.col("turn").isNotNull().alias("set"), "turn")
    rows = rows.withColumn("__text", F.sha2(F.col("text"), 256))
    same = ["conv_id", "role", "__text"]
    first = (rows.filter("role IS NOT NULL").groupBy(*same).agg(F.min(order).alias("__first"), F.max(order).alias("__last"))
             .filter("__first <> __last").drop("__last"))
    keys = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in same]
    joined = rows.alias("r").join(first.alias("f"), keys, "left").select(
        "r.conv_id", "r.turn", "r.role", "r.text",
        F.coalesce(F.struct(F.col("r.turn").isNotNull().alias("set"), F.col("r.turn")) > F.col("f.__first"), F.lit(False)).alias("repeats"))
    last = F.regexp_extract("text", rf"([^{BLANKS}])[{BLANKS}]*+\z", 1)
    return joined.withColumn("fault", F.when(last == "", "blank").when(F.col("repeats"), "duplicate")
                             .when(~last.isin(".", "!", "?"), "truncated"))


# --- survivors ------------------------------------------------------------------------------------

class Survivors:
    """Cheapest paths into each state, as a tree of back-pointers with reference counts.

    ``emit(edit, state, row)`` gets decided edits in order: the letter, the state after it, the row (None for Insert).
    """

    def __init__(self, entry: int, emit: Callable[[str, int, object], None]):
        self.emit, self.next = emit, 1
        self.up: dict[int, int] = {0: -1}
        self.what: dict[int, tuple[str, int, object]] = {0: ("", entry, None)}
        self.refs = {0: 1}
        self.depth = {0: 0}
        self.kids = {0: 0}  # sum of the children's numbers: of an only child, its number
        self.root = 0
        self.cost: dict[int, int] = {entry: 0}
        self.head: dict[int, int] = {entry: 0}

    def _less(self, a: int, b: int) -> bool:
        """Whether path ``a`` reads ASCII-less than ``b``; both complete unresolved suffixes are compared.

        Two paths over the same rows at equal cost never differ by a prefix: the longer one has more Inserts.
        """
        x = y = ""  # the letters just below the common ancestor, in the end
        while a != b:
            if self.depth[a] >= self.depth[b]:
                x, a = self.what[a][0], self.up[a]
            else:
                y, b = self.what[b][0], self.up[b]
        return x < y

    def _node(self, parent: int, letter: str, state: int, row: object) -> int:
        n = self.next
        self.next += 1
        self.up[n], self.what[n], self.refs[n], self.depth[n] = parent, (letter, state, row), 0, self.depth[parent] + 1
        self.kids[n] = 0
        self.refs[parent] += 1
        self.kids[parent] += n
        return n

    def _drop(self, n: int) -> None:
        while n >= 0 and not self.refs[n]:
            up = self.up.pop(n)
            del self.what[n], self.refs[n], self.depth[n], self.kids[n]
            if up >= 0:
                self.refs[up] -= 1
                self.kids[up] -= n
            n = up

    def _offer(self, cost: dict, head: dict, state: int, total: int, parent: int, letter: str, row: object) -> None:
        known = cost.get(state)
        if known is not None and known < total:
            return
        n = self._node(parent, letter, state, row)
        if known is not None:
            old = head[state]
            if known == total and not self._less(n, old):
                self._drop(n)
                return
            self.refs[old] -= 1
            self._drop(old)
        cost[state], head[state] = total, n
        self.refs[n] += 1

    def inserts(self, cost: dict | None = None, head: dict | None = None) -> None:
        """Insert edges: to user from anywhere but user, then to assistant from user. Longer chains never pay."""
        cost, head = (self.cost, self.head) if cost is None else (cost, head)
        for source in (EMPTY, SYSTEM, ASSISTANT):
            if source in cost:
                self._offer(cost, head, USER, cost[source] + INSERT, head[source], "I", None)
        if USER in cost:
            self._offer(cost, head, ASSISTANT, cost[USER] + INSERT, head[USER], "I", None)

    def row(self, initial: str, must_delete: bool, truncated: bool, row: object) -> None:
        """One more row, and the inserts after it."""
        cost: dict[int, int] = {}
        head: dict[int, int] = {}
        extra = TRUNCATED if truncated else 0
        for state in STATES:
            if state not in self.cost:
                continue
            had, at = self.cost[state], self.head[state]
            self._offer(cost, head, state, had + DELETE, at, "D", row)
            if must_delete:
                continue
            if state == EMPTY and initial == "s":
                self._offer(cost, head, SYSTEM, had + extra, at, "K", row)
            to, mine = (ASSISTANT, "a") if state == USER else (USER, "u")
            if initial == mine:
                self._offer(cost, head, to, had + extra, at, "K", row)
            self._offer(cost, head, to, had + extra + REROLE, at, "R", row)
        self.inserts(cost, head)
        old, self.cost, self.head = self.head, cost, head
        for n in old.values():
            self._leave(n)
        self._prune()
        self._decide()

    def _leave(self, n: int) -> None:
        self.refs[n] -= 1
        self._drop(n)

    def _prune(self) -> None:
        """Survivors that can no longer win or tie: whatever follows SYSTEM may follow ASSISTANT, and whatever follows
        EMPTY too, if a system row that would be kept is deleted instead."""
        for state, more in ((EMPTY, DELETE), (SYSTEM, 0)):
            if state in self.cost and ASSISTANT in self.cost and self.cost[ASSISTANT] + more < self.cost[state]:
                del self.cost[state]
                self._leave(self.head.pop(state))

    def _decide(self) -> None:
        """Write out what all survivors share: the root goes on while it has one child and is no survivor itself."""
        while self.refs[self.root] == 1 and self.kids[self.root]:
            old, child = self.root, self.kids[self.root]
            del self.up[old], self.what[old], self.refs[old], self.depth[old], self.kids[old]
            self.root, self.up[child] = child, -1
            self.emit(*self.what[child])

    def finish(self, state: int) -> None:
        """Write out the rest of the survivor in ``state``."""
        n, way = self.head[state], []
        while n != self.root:
            way.append(n)
            n = self.up[n]
        for x in reversed(way):
            self.emit(*self.what[x])

    def best(self, states=ACCEPTED) -> int | None:
        """The cheapest of these states; of equal ones the path that reads least."""
        found = None
        for s in states:
            if s in self.cost and (found is None or self.cost[s] < self.cost[found]
                                   or (self.cost[s] == self.cost[found] and self._less(self.head[s], self.head[found]))):
                found = s
        return found


def _line(edit: str, state: int, row: object) -> str | None:
    if edit == "D":
        return None
    if edit == "I":
        return f"{ROLES[state]}:"
    role, text = row
    return f"{role if edit == 'K' else ROLES[state]}:{text}"


class _Sink:
    """Collects the edits and hashes the repaired lines as they are decided."""

    def __init__(self):
        self.audit: list[str] = []
        self.digest, self.first = hashlib.sha256(), True

    def __call__(self, edit: str, state: int, row: object) -> None:
        self.audit.append(edit)
        line = _line(edit, state, row)
        if line is not None:
            self.digest.update(line.encode("utf-8", "surrogatepass") if self.first else b"\n" + line.encode("utf-8", "surrogatepass"))
            self.first = False


def repaired(rows: list[tuple[str, bool, bool, tuple[str, str]]]) -> tuple[int, str, str]:
    """(cost, edits, sha256 of the repaired lines) of one conversation's rows (initial, must_delete, truncated, (role, text))."""
    sink = _Sink()
    paths = Survivors(EMPTY, sink)
    paths.inserts()
    for r in rows:
        paths.row(*r)
    end = paths.best()
    cost = paths.cost[end]
    paths.finish(end)
    return cost, "".join(sink.audit), sink.digest.hexdigest()


# --- sorted rows in, one row per conversation out --------------------------------------------------

RESULT = ("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
          "repaired_sha256 string")


class _Conversation:
    """Counters and survivors of the conversation that is being read."""

    def __init__(self):
        self.sink = _Sink()
        self.paths = Survivors(EMPTY, self.sink)
        self.paths.inserts()
        self.count = dict.fromkeys(FAULTS, 0)
        self.illegal = self.turns = 0
        self.low = self.high = self.initial = self.before = None

    def add(self, turn, role: str, text: str, fault: str | None) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if fault != "blank" and (turn, role, text) == self.before:
            fault = "duplicate"
        if fault:
            self.count[fault] += 1
        initial = role[:1]
        if self.before is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before, self.initial = (turn, role, text), initial
        self.paths.row(initial, fault in ("blank", "duplicate"), fault == "truncated", (role, text))

    def result(self) -> tuple:
        end = self.paths.best()
        cost = self.paths.cost[end]
        self.paths.finish(end)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (gaps, *self.count.values(), self.illegal, cost, "".join(self.sink.audit), self.sink.digest.hexdigest())


def _repair(schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []  # the conversation's id and its state
        out: list[tuple] = []

        def written() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")]
            for conv, turn, role, text, fault in zip(*columns):
                if not now or now[0] != conv:
                    if now:
                        out.append((now[0], *now[1].result()))
                    now[:] = [conv, _Conversation()]
                if role is not None:
                    now[1].add(turn, role, text, fault)
            if out:
                yield written()
        if now:
            out.append((now[0], *now[1].result()))
            yield written()

    return run


def repair(rows: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of (conv_id, turn, role, text): faults and the cheapest repair, after ``damage``.

    Null ids are one conversation, null turns come first, null roles and texts are one space. Equal rows are kept, the
    later ones being duplicates; ties of turn are ordered by role, then text. An empty role fits no place, so its row is
    reroled or deleted. Conversations without rows after
    damage have zeros, no edits and the hash of nothing; no rows give no rows. Other columns are ignored.

    Faults are found by joins and aggregations. Then each conversation's rows are read once in order, from Spark's
    sort, with the undecided edits in memory: the repaired text's hash is one chain over the whole conversation,
    so its rows pass one task, but never lie in it together.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    marked = with_faults(damage(rows.select("conv_id", "turn", "role", "text")))
    result = StructType([rows.schema["conv_id"], *StructType.fromDDL(RESULT)])
    ordered = marked.repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "text")
    return ordered.select("conv_id", "turn", "role", "text", "fault").mapInArrow(
        _repair(to_arrow_schema(result)), result)

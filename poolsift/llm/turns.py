"""Repair of conversation structure by a Viterbi search with coalescing survivors.

A repaired conversation is empty, or pairs of user and assistant turns behind at most one system turn. The
cheapest edits that lead there are a shortest path over four states (nothing yet, after the system turn, after a
user turn, after an assistant turn); of equally cheap ones the least edit string counts. Every state keeps
its best path as a leaf of one tree of back pointers. Nodes count their children; what no survivor uses is
dropped, and as soon as all survivors share their first edges these are final and leave the tree. So a path of any
length takes the memory of its unresolved part. Ties are settled by comparing the whole unresolved parts of both
paths up to the node where they meet.

Inserted turns are charged to the row they stand before (or to the end), which makes every row's part of an edit string
end with the letter of that row: two parts never continue one another, so comparing parts in order compares strings.

At scale rows are ordered by ranges of (conversation, turn), so a conversation with a third of all rows lies in many
tasks. Each task finishes the conversations that begin and end inside of it. Of the first and the last one it cuts
segments of at most :data:`SEGMENT` rows and works out the best path between every two states of a segment; the same
search over segments picks the states at their borders, then all segments are written out at once. Only the
digest of a text is sequential by nature: it reads written segments, in order, one at a time.

Null ids, turns, roles and texts count as one space where damage and roles are concerned; a null ``conv_id`` is a
conversation of its own, null turns come first. Rows of one turn are ordered by role, then text; rows equal in
everything are counted, not repeated. Empty texts are blank; very long ones are read by the task that holds them
and hashed for comparison. Other columns, whatever their names, are left out; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from poolsift.llm.common import saved, tasks

#: States of a repaired conversation: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: What each edit costs, and what a turn that breaks off adds unless it is deleted.
REROLE, DELETE, INSERT, BROKEN = 3, 4, 3, 3
#: Rows and bytes of one segment of a conversation that lies in several tasks.
SEGMENT = 4_096
SEGMENT_BYTES = 1_000_000
#: Initials that may follow one another.
LAWFUL = ("su", "ua", "au")
#: Roles by their state, as inserted and as rewritten.
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Faults of a row, the first one counts.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Characters that do not make a text (fixed values), and the ends of a sentence.
GAPS = r"\x20\x09-\x0D"
FINAL = ".!?"


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of ``rows`` with one fault for about a fourth of them, by a checksum of their place."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), copies.alias("copies")).where("copies > 0").select(
        "conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")
    ).drop("copy")


def faulty(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number (``copies``), the fault of the first copy and the role's initial."""
    kept = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    saying = F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"), 256)
    # one space up, so that rows without a turn are the least
    order = F.when(F.col("turn").isNull(), F.lit(0)).otherwise(F.lit(1))
    kept = saved(kept.select("*", saying.alias("saying"), order.alias("known")), "turns")
    # only what a conversation says in several turns needs its first one; a frequent saying is one row here
    seen = kept.groupBy("conv_id", "saying").agg(F.min(F.struct("known", "turn")).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    seen = saved(seen.select(F.col("conv_id").alias("of"), F.col("saying").alias("said"), "first"), "repeated-turns")
    joined = kept.join(seen, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("saying") == F.col("said")), "left")
    blank = ~F.col("text").rlike(f"[^{GAPS}]")
    again = F.col("first").isNotNull() & ~F.struct("known", "turn").eqNullSafe(F.col("first"))
    broken = ~F.col("text").rlike(f"[{FINAL}][{GAPS}]*\\z")
    fault = F.when(blank, BLANK).when(again, DUPLICATE).when(broken, TRUNCATED).otherwise(SOUND)
    return joined.select("conv_id", "turn", "role", "text", "copies", fault.cast("int").alias("fault"), F.substring("role", 1, 1).alias("initial"))


# ---------------------------------------------------------------- the search


def _reach(state: int) -> list[tuple[int, int]]:
    """States that inserted turns lead to, with their number; more than two never pay."""
    first = ASSISTANT if state == USER else USER
    second = USER if first == ASSISTANT else ASSISTANT
    return [(state, 0), (first, 1), *([(second, 2)] if second != state else [])]


def _moves(initial: str, fault: int) -> list[list[tuple[int, str, int]]]:
    """Per state the ways to pass a row: (cost, edits, next state), the least for each next state."""
    out = []
    for state in range(4):
        best: dict[int, tuple[int, str]] = {}
        for at, inserts in _reach(state):
            ways = [(DELETE, "D", at)]
            if fault not in (BLANK, DUPLICATE):
                extra = BROKEN if fault == TRUNCATED else 0
                following = ASSISTANT if at == USER else USER
                ways.append((REROLE + extra, "R", following))
                if initial == ("a" if following == ASSISTANT else "u"):
                    ways.append((extra, "K", following))
                if initial == "s" and at == START:
                    ways.append((extra, "K", SYSTEM))
            for cost, letter, to in ways:
                found = (cost + INSERT * inserts, "I" * inserts + letter)
                if to not in best or found < best[to]:
                    best[to] = found
        out.append([(cost, edits, to) for to, (cost, edits) in best.items()])
    return out


#: Ways to pass a row, by initial (s, u, a or another) and fault.
MOVES = {(initial, fault): _moves(initial, fault) for initial in "sua?" for fault in range(4)}
#: Ways to end a conversation: (cost, edits, state).
CLOSING = [[(INSERT * n, "I" * n, to) for to, n in _reach(state) if to in ENDS] for state in range(4)]


#: What it takes at most to go on from the first state as one could from the second one (inserted turns, or a system turn
#: deleted instead of kept). A path that costs more than another one plus this can never be part of the least one.
DETOUR = {
    (START, SYSTEM): 0, (START, USER): INSERT, (START, ASSISTANT): 0,
    (SYSTEM, START): 2 * INSERT, (SYSTEM, USER): INSERT, (SYSTEM, ASSISTANT): 2 * INSERT,
    (USER, START): INSERT + DELETE, (USER, SYSTEM): INSERT, (USER, ASSISTANT): INSERT,
    (ASSISTANT, START): DELETE, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): INSERT,
}


class Node:
    """An edge of the tree of survivors: what was done, and where it goes back to."""

    __slots__ = ("back", "label", "depth", "children")

    def __init__(self, back: Node | None, label, depth: int) -> None:
        self.back, self.label, self.depth, self.children = back, label, depth, 0
        if back is not None:
            back.children += 1


def _before(a: Node, b: Node) -> bool:
    """Whether the path to ``a`` is less than the one to ``b``, of as many edges."""
    less = False
    while a is not b:
        if a.label != b.label:
            less = a.label < b.label
        a, b = a.back, b.back
    return less


class Survivors:
    """The best path to every state, each with its cost, in one tree of back pointers.

    :meth:`step` takes, per state, the ways on as (cost, label, next state); labels of one step that leave one state
    differ, and none continues another. It returns the labels that have become final. ``free`` paths may end where a
    conversation may: those that cannot win any more are given up. Others are wanted up to every state.
    """

    def __init__(self, state: int, free: bool = False) -> None:
        self.root, self.free = Node(None, None, 0), free
        self.paths: dict[int, tuple[int, Node]] = {state: (0, self.root)}

    def step(self, moves) -> list:
        best: dict[int, tuple[int, Node, object]] = {}
        for state, (cost, node) in self.paths.items():
            for more, label, to in moves[state]:
                held = best.get(to)
                if held is None or cost + more < held[0]:
                    best[to] = (cost + more, node, label)
                elif cost + more == held[0]:
                    # the parts before differ, or (from one state) the labels do
                    if _before(node, held[1]) if node is not held[1] else label < held[2]:
                        best[to] = (cost + more, node, label)
        if self.free:
            best = {to: b for to, b in best.items() if all(b[0] <= c + DETOUR[other, to] for other, (c, _, _) in best.items() if other != to)}
        old = self.paths
        self.paths = {to: (cost, Node(node, label, node.depth + 1)) for to, (cost, node, label) in best.items()}
        for _, node in old.values():
            self._release(node)
        return self._settled()

    def _release(self, node: Node) -> None:
        """Drop a leaf that no survivor goes back to, and what only it used."""
        while node is not self.root and not node.children and node.back is not None:
            back = node.back
            back.children -= 1
            node.back = None
            node = back

    def _settled(self) -> list:
        """Labels up to the last node that all survivors share, which becomes the root."""
        nodes = [node for _, node in self.paths.values()]
        if self.root.children > 1:
            return []
        while any(n is not nodes[0] for n in nodes):
            deepest = max(nodes, key=lambda n: n.depth).depth
            nodes = [n.back if n.depth == deepest else n for n in nodes]
        meet, labels = nodes[0], []
        node = meet
        while node is not self.root:
            labels.append(node.label)
            node = node.back
        meet.back, meet.label, self.root = None, None, meet
        return labels[::-1]

    def best(self, closing) -> tuple[int, list]:
        """Cost and the labels left of the least path, behind one more step; nothing can follow."""
        labels = self.step(closing)
        cost = min(c for c, _ in self.paths.values())
        least = None
        for c, node in self.paths.values():
            if c == cost and (least is None or _before(node, least)):
                least = node
        rest = []
        while least is not self.root:
            rest.append(least.label)
            least = least.back
        return cost, labels + rest[::-1]

    def ranked(self) -> list[tuple[int, int]]:
        """(state, cost) of all survivors, by their paths."""
        order = functools.cmp_to_key(lambda a, b: 0 if a is b else -1 if _before(a, b) else 1)
        return [(s, c) for s, (c, n) in sorted(self.paths.items(), key=lambda x: order(x[1][1]))]


class Writer:
    """Puts edits into effect, row by row: the repaired turns, and the state they lead to."""

    def __init__(self, state: int) -> None:
        self.state = state

    def _next(self, name: str | None = None) -> str:
        if name is not None and name[:1] == "s" and self.state == START:
            self.state = SYSTEM
        else:
            self.state = ASSISTANT if self.state == USER else USER
        return NAMES.get(self.state, "")

    def turns(self, edits: str, row: tuple[str, str] | None) -> Iterator[str]:
        """Turns that ``edits`` make of a row (role, text)."""
        for letter in edits:
            if letter == "I":
                yield self._next() + ":"
            elif letter == "R":
                yield self._next() + ":" + row[1]
            elif letter == "K":
                self._next(row[0])
                yield row[0] + ":" + row[1]


def row_moves(initial: str, fault: int, copies: int) -> list[list[tuple[int, str, int]]]:
    """Ways to pass equal rows: the first one by its fault; the others are duplicates (or as blank) and can only go."""
    moves = MOVES[initial if initial in ("s", "u", "a") else "?", fault]
    if copies == 1:
        return moves
    return [[(cost + DELETE * (copies - 1), edits, to) for cost, edits, to in ways] for ways in moves]


class Turn(NamedTuple):
    turn: int | None
    role: str
    text: str
    copies: int
    fault: int

    @property
    def initial(self) -> str:
        return self.role[:1]


class Repair:
    """Edits and repaired turns of rows in order, from one state on; :attr:`cost` is known at the end."""

    def __init__(self, state: int = START, free: bool = True) -> None:
        self.survivors, self.writer = Survivors(state, free), Writer(state)
        self.waiting: deque[Turn] = deque()
        self.cost = 0

    def add(self, row: Turn) -> Iterator[tuple[str, list[str]]]:
        self.waiting.append(row)
        return self._written(self.survivors.step(row_moves(row.initial, row.fault, row.copies)))

    def end(self, state: int | None = None) -> Iterator[tuple[str, list[str]]]:
        """The rest, up to a state; by default up to where a conversation may end, with turns inserted there."""
        closing = CLOSING if state is None else [[(0, "", s)] if s == state else [] for s in range(4)]
        self.cost, labels = self.survivors.best(closing)
        return self._written(labels)

    def _written(self, labels: list[str]) -> Iterator[tuple[str, list[str]]]:
        for label in labels:
            row = self.waiting.popleft() if self.waiting else None
            turns = list(self.writer.turns(label, (row.role, row.text) if row else None))
            yield label + "D" * (row.copies - 1 if row else 0), turns


class Tally:
    """What is counted of rows in order, and how the counts of neighbouring segments add up."""

    FIELDS = ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first", "last")

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first = self.last = None

    @classmethod
    def of(cls, row: Turn) -> Tally:
        out = cls()
        out.blank = row.copies if row.fault == BLANK else 0
        out.duplicate = {BLANK: 0, DUPLICATE: row.copies}.get(row.fault, row.copies - 1)
        out.truncated = int(row.fault == TRUNCATED)
        out.illegal = row.copies - 1
        out.turns = int(row.turn is not None)
        out.first_turn = out.last_turn = row.turn
        out.first = out.last = row.initial
        return out

    def add(self, behind: Tally) -> None:
        if self.first is not None and self.last + behind.first not in LAWFUL:
            self.illegal += 1
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(behind, name))
        if behind.first_turn is not None:
            if self.last_turn == behind.first_turn:
                self.turns -= 1  # the turn that both hold
            if self.first_turn is None:
                self.first_turn = behind.first_turn
            self.last_turn = behind.last_turn
        if self.first is None:
            self.first = behind.first
        self.last = behind.last

    @property
    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns

    def values(self) -> dict:
        return {name: getattr(self, name) for name in self.FIELDS}

    @classmethod
    def read(cls, row: dict) -> Tally:
        out = cls()
        for name in cls.FIELDS:
            setattr(out, name, row[name])
        return out


class Page:
    """Edits and repaired text, as they come."""

    def __init__(self) -> None:
        self.edits: list[str] = []
        self.sha = hashlib.sha256()
        self.any = False

    def take(self, pairs: Iterator[tuple[str, list[str]]]) -> None:
        for edits, turns in pairs:
            self.edits.append(edits)
            for turn in turns:
                self.put(turn.encode("utf-8", "surrogatepass"))

    def put(self, turns: bytes) -> None:
        self.sha.update(b"\n" + turns if self.any else turns)
        self.any = True

    def result(self) -> dict:
        return {"audit": "".join(self.edits), "repaired_sha256": self.sha.hexdigest()}


# ---------------------------------------------------------------- segments

SEGMENT_FIELDS = (
    "part int, no bigint, costs array<bigint>, ranks array<int>, first_turn bigint, last_turn bigint, turns bigint, first string, last string,"
    " rows array<struct<turn:bigint,role:string,text:string,copies:bigint,fault:int>>"
)
RESULT_FIELDS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _rows(batches: Iterator[pa.RecordBatch], most: int = 1_024) -> Iterator[dict]:
    for batch in batches:
        for low in range(0, batch.num_rows, most):
            yield from batch.slice(low, most).to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 256, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(t["text"]) for t in row.get("rows") or ()) + len(row.get("audit") or "") + len(row.get("repaired") or "")
        if len(held) >= most or size > most_bytes:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _mapped(frame: DataFrame, schema: str, of: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """``frame`` through a function from rows to rows, both as dicts, in the order of each task."""
    kind = to_arrow_schema(frame.sparkSession.createDataFrame([], schema).schema)
    return frame.mapInArrow(lambda batches: _batches(of(_rows(batches)), kind), schema)


def finished_or_cut(rows: Iterator[dict], most: int) -> Iterator[dict]:
    """Ordered rows of a task: results of conversations that lie inside of it, segments of the others."""
    part, no = TaskContext.get().partitionId(), 0
    current, held, size, begun, whole_here = None, [], 0, False, False

    def segment() -> dict:
        nonlocal no
        costs, ranks, tally = [-1] * 16, [-1] * 16, Tally()
        for row in held:
            tally.add(Tally.of(row))
        for begin in range(4):
            survivors = Survivors(begin)
            for row in held:
                survivors.step(row_moves(row.initial, row.fault, row.copies))
            for rank, (end, cost) in enumerate(survivors.ranked()):
                costs[4 * begin + end], ranks[4 * begin + end] = cost, rank
        no += 1
        return {"conv_id": current, "part": part, "no": no, "costs": costs, "ranks": ranks, "rows": [t._asdict() for t in held]} | tally.values()

    def result() -> dict:
        repair, page, tally = Repair(), Page(), Tally()
        for row in held:
            tally.add(Tally.of(row))
            page.take(repair.add(row))
        page.take(repair.end())
        return {"conv_id": current, "cost": repair.cost, "gaps": tally.gaps} | tally.values() | page.result()

    for row in rows:
        if begun and row["conv_id"] != current:
            yield result() if whole_here else segment()
            held, size, whole_here = [], 0, True
        elif len(held) >= most or size > SEGMENT_BYTES:
            yield segment()
            held, size, whole_here = [], 0, False
        begun, current = True, row["conv_id"]
        held.append(Turn(*(row[f] for f in Turn._fields)))
        size += len(row["text"])
    if held:
        yield segment()


def chosen(rows: Iterator[dict]) -> Iterator[dict]:
    """Ordered segments: the states each begins and ends in (the last one of a conversation ends freely), and its cost and counts."""
    for conv_id, group in groupby(rows, key=lambda row: row["conv_id"]):
        survivors, tally, waiting, ready = Survivors(START, free=True), Tally(), deque(), None

        def picked(labels: list) -> Iterator[dict]:
            nonlocal ready
            for _, begin, end in labels:
                if ready:
                    yield ready
                at = waiting.popleft()
                ready = {"conv_id": conv_id, "part": at[0], "no": at[1], "begin": begin, "end": end}

        for row in group:
            tally.add(Tally.read(row))
            waiting.append((row["part"], row["no"]))
            costs, ranks = row["costs"], row["ranks"]
            moves = [[(costs[4 * b + e], (ranks[4 * b + e], b, e), e) for e in range(4) if costs[4 * b + e] >= 0] for b in range(4)]
            yield from picked(survivors.step(moves))
        cost, labels = survivors.best(CLOSING)
        # the last label stands for the turns inserted at the end, which come with the last segment
        yield from picked([label for label in labels if not isinstance(label, str)])
        yield ready | {"end": None}
        yield {"conv_id": conv_id, "cost": cost, "gaps": tally.gaps} | tally.values()


def written_out(rows: Iterator[dict]) -> Iterator[dict]:
    """Segments with their states: the edits and the repaired turns of each."""
    for row in rows:
        repair, edits, turns = Repair(row["begin"], row["end"] is None), [], []
        for turn in row["rows"]:
            for more, repaired in repair.add(Turn(**turn)):
                edits.append(more)
                turns += repaired
        for more, repaired in repair.end(row["end"]):
            edits.append(more)
            turns += repaired
        yield {"conv_id": row["conv_id"], "part": row["part"], "no": row["no"], "audit": "".join(edits), "repaired": "\n".join(turns) if turns else None}


def read_through(rows: Iterator[dict]) -> Iterator[dict]:
    """Ordered segments written out: edits and digest of each conversation."""
    for conv_id, group in groupby(rows, key=lambda row: row["conv_id"]):
        page = Page()
        for row in group:
            page.edits.append(row["audit"])
            if row["repaired"] is not None:
                page.put(row["repaired"].encode("utf-8", "surrogatepass"))
        yield {"conv_id": conv_id} | page.result()


def _by_conversation(frame: DataFrame) -> DataFrame:
    return frame.repartition(tasks(frame.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "no")


def repaired(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """Counts of faults, cost, edits and digest per conversation of the rows of :func:`faulty`.

    ``most`` are the rows of a segment; it does not change the result.
    """
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType.simpleString()
    # a hot turn is told apart by role and text, of which a part is enough to cut ranges
    keys = ["conv_id", "turn", "role", F.substring("text", 1, 64)]
    ordered = rows.repartitionByRange(tasks(spark), *keys).sortWithinPartitions("conv_id", "turn", "role", "text")
    cut = saved(_mapped(ordered, f"conv_id {kind}, {RESULT_FIELDS}, {SEGMENT_FIELDS}", lambda r: finished_or_cut(r, most)), "conversations")
    segments = cut.where("part IS NOT NULL")
    counts = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
    picks = saved(
        _mapped(_by_conversation(segments.drop("rows", "audit", "repaired_sha256")), f"conv_id {kind}, part int, no bigint, `begin` int, `end` int, {counts}", chosen), "border-states"
    )
    states = picks.where("part IS NOT NULL").select("part", "no", "begin", "end")
    pages = saved(
        _mapped(segments.select("conv_id", "part", "no", "rows").join(states, ["part", "no"]), f"conv_id {kind}, part int, no bigint, audit string, repaired string", written_out),
        "repaired-segments",
    )
    read = _mapped(_by_conversation(pages), f"conv_id {kind}, audit string, repaired_sha256 string", read_through)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = cut.where("part IS NULL").select("conv_id", *names, "audit", "repaired_sha256")
    found = found.unionByName(picks.where("part IS NULL").select("conv_id", *names), allowMissingColumns=True)
    found = found.unionByName(read, allowMissingColumns=True)
    return found.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in (*names, "audit", "repaired_sha256")])


def repair_report(conversations: DataFrame, most: int = SEGMENT) -> DataFrame:
    """Every ``conv_id`` of ``conversations`` (conv_id, turn, role, text) after damage and repair.

    Conversations without a row after damage have zeros, no edits and the digest of an empty text.
    """
    source = conversations.select("conv_id", "turn", "role", "text")
    found = repaired(faulty(damaged(source)), most)
    names = [c for c in found.columns if c != "conv_id"]
    every = source.select("conv_id").distinct().unionByName(found, allowMissingColumns=True)
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return every.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(empty.get(c, 0))).alias(c) for c in names])

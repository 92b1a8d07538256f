"""Conversation structure repair by Viterbi with survivor coalescence (operator 13).

A conversation should read: at most one system turn, then user and assistant in turns, or nothing at all. Rows are kept
(K), given another role (R) or deleted (D), and empty turns are inserted (I), as cheaply as possible; of equally cheap
edits the smallest string of initials wins.

The search is a Viterbi pass over four states. Survivors are leaves of a backpointer tree whose nodes count their
references; as soon as all survivors share an ancestor, the edits up to it are final, are written out and freed. A survivor that another one beats whatever
follows is dropped. Of two
paths with equal cost the complete unresolved suffixes are compared: every path up to a row ends in the edit of that
row and has as many such edits as any other, so no suffix is the beginning of another, their order stays whatever is
added, and it is kept as a rank of each survivor.

No conversation has to fit in a task. Rows are range-partitioned by conversation and turn. What a stretch of a
conversation does to any survivor is a 4 x 4 table of costs and ranks; these few numbers are folded along conversations
that span partitions, and then every stretch is repaired on its own from a known state to a known state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import reliable
from .common import saved, small

#: Rows of a range partition, on average, where there are more than the shuffle partitions make of them.
CHUNK_ROWS = 200_000
#: What the contract of the operator calls white space.
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: What an undeleted truncated row adds.
CUT_OFF = 1
#: States: nothing yet, a system turn, a user turn, an assistant turn. A conversation may end in the first and last.
STATES = EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a turn which is not kept leads to, by state.
NEXT = (USER, USER, ASSISTANT, USER)
#: Inserted turns that lead from a state to an end.
CLOSING = (0, 2, 1, 0)
ROLES = ("", "system", "user", "assistant")
#: What the future can cost more, at most, after the state of the row than after that of the column: a turn is inserted,
#: a system turn that could have been kept is deleted, or a system turn that is left alone is closed.
REGRET = ((0, 0, 2, 0), (4, 0, 2, 4), (5, 2, 0, 2), (3, 0, 2, 0))
#: Row kinds: initial of the role (s, u, a, other), then fault (none, must go, truncated).
SOUND, MUST_GO, TRUNCATED = range(3)
_INITIALS = "sua"


@cache
def moves(kind: int) -> tuple[tuple[int, int, int, str], ...]:
    """(from, to, cost, edits) of a row of this kind, the best for each from and to; edits end in that of the row."""
    initial, fault = divmod(kind, 3)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in STATES:
        state, inserted = start, 0
        while inserted < len(STATES):  # more insertions come back to a state they have left
            steps = [(state, COST[DELETE], DELETE)]
            if fault != MUST_GO:
                more = CUT_OFF if fault == TRUNCATED else 0
                steps.append((NEXT[state], COST[REROLE] + more, REROLE))
                if initial == 0 and state == EMPTY or 0 < initial < 3 and NEXT[state] == initial + 1:
                    steps.append((initial + 1, COST[KEEP] + more, KEEP))
            for end, cost, edit in steps:
                found = (cost + inserted * COST[INSERT], INSERT * inserted + edit)
                best[start, end] = min(best.get((start, end), found), found)
            state, inserted = NEXT[state], inserted + 1
    return tuple((a, b, cost, edits) for (a, b), (cost, edits) in sorted(best.items()))


def _advance(cost: list, rank: list, kind: int) -> tuple[list, list, list]:
    """Costs and ranks after a row, and where each survivor comes from: (state, edits), None without one."""
    won: list = [None] * len(STATES)
    for a, b, more, edits in moves(kind):
        if cost[a] is not None:
            candidate = (cost[a] + more, rank[a], edits, a)
            if won[b] is None or candidate < won[b]:
                won[b] = candidate
    order = sorted(w[1:3] for w in won if w)
    return ([w and w[0] for w in won], [w and order.index(w[1:3]) for w in won], [w and (w[3], w[2]) for w in won])


def transfer(kinds: bytes) -> tuple[list[int], list[int]]:
    """What a stretch of rows does, from every state to every state: costs (-1: impossible) and ranks, 16 each."""
    costs, ranks = [], []
    for start in STATES:
        cost, rank = ([value if s == start else None for s in STATES] for value in (0, 0))
        for kind in kinds:
            cost, rank, _ = _advance(cost, rank, kind)
        costs += [-1 if c is None else c for c in cost]
        ranks += [-1 if r is None else r for r in rank]
    return costs, ranks


def folded(tables: list[tuple[list[int], list[int]]]) -> list[tuple[int, int]]:
    """The state in which each of a conversation's stretches begins and ends, from their ``transfer`` tables."""
    cost, rank, back = [0, None, None, None], [0, None, None, None], []
    for costs, ranks in tables:
        won: list = [None] * len(STATES)
        for a in STATES:
            for b in STATES:
                if cost[a] is not None and costs[4 * a + b] >= 0:
                    candidate = (cost[a] + costs[4 * a + b], rank[a], ranks[4 * a + b], a)
                    if won[b] is None or candidate < won[b]:
                        won[b] = candidate
        order = sorted(w[1:3] for w in won if w)
        cost, rank = [w and w[0] for w in won], [w and order.index(w[1:3]) for w in won]
        back.append([w and w[3] for w in won])
    state, out = ending(cost, rank), []
    for came in reversed(back):
        out.append((came[state], state))
        state = came[state]
    return out[::-1]


def ending(cost: list, rank: list) -> int:
    """The state whose survivor, closed by insertions, is the cheapest; ranks decide between equal costs."""
    return min((cost[s] + CLOSING[s] * COST[INSERT], rank[s], s) for s in STATES if cost[s] is not None)[2]


class _Node:
    """A stretch of edits between two branchings; ``users`` counts the children and survivors that refer to it."""

    __slots__ = ("parent", "edits", "users")

    def __init__(self, parent: _Node | None, edits: list[str]):
        self.parent, self.edits, self.users = parent, edits, 0
        if parent is not None:
            parent.users += 1


class Survivors:
    """Viterbi over the rows of one stretch; ``step`` returns the edits that have become final."""

    def __init__(self, start: int = EMPTY):
        self.cost, self.rank = ([0 if s == start else None for s in STATES] for _ in range(2))
        self.root = _Node(None, [])
        self.leaf: list = [self.root if s == start else None for s in STATES]
        self.root.users = 1

    def step(self, kind: int) -> list[str]:
        """Take a row; returns the edits of rows, insertions before them included, that are final now."""
        self.cost, self.rank, came = _advance(self.cost, self.rank, kind)
        for s in STATES:  # what cannot win any more does not survive, else the path of mere deletions would for ever
            if self.cost[s] is not None and any(
                    c is not None and c + REGRET[t][s] < self.cost[s] for t, c in enumerate(self.cost)):
                self.cost[s] = self.rank[s] = came[s] = None
        old, self.leaf = self.leaf, [None] * len(STATES)
        heirs = [c[0] for c in came if c]
        for state, c in enumerate(came):
            if c:
                node = old[c[0]]
                if heirs.count(c[0]) == 1:  # the path does not branch here
                    node.edits.append(c[1])
                else:
                    node = _Node(node, [c[1]])
                    node.users = 1
                self.leaf[state] = node
        for state, node in enumerate(old):
            if node is not None and heirs.count(state) != 1:
                self._release(node)
        return self._final()

    def _release(self, node: _Node) -> None:
        node.users -= 1
        while not node.users and node.parent is not None:
            node = node.parent
            node.users -= 1

    def _final(self) -> list[str]:
        """Edits above the last node that all survivors share; they are no longer held."""
        tops, out = [n for n in self.leaf if n is not None], []
        while self.root.users == 1 and not any(n is self.root for n in tops):  # one child only: it becomes the root
            out += self.root.edits
            node = tops[0]
            while node.parent is not self.root:
                node = node.parent
            node.parent, self.root = None, node
        out += self.root.edits
        self.root.edits = []
        return out

    def finish(self, state: int | None = None) -> list[str]:
        """The remaining edits of the survivor in ``state``; without one, of the best, with the insertions that close it."""
        closing = ""
        if state is None:
            state = ending(self.cost, self.rank)
            closing = INSERT * CLOSING[state]
        parts, node = [], self.leaf[state]
        while node is not None:
            parts.append(node.edits)
            node = node.parent
        return [e for part in reversed(parts) for e in part] + ([closing] if closing else [])


@dataclass
class Repair:
    """``rows``: conv_id, at (rising within a conversation), edit, cost, role, text; a deleted row has neither role nor
    text. ``faults``: conv_id, gaps, blank, duplicate, truncated, illegal, one row for each conversation with rows."""

    rows: DataFrame
    faults: DataFrame


def _prepared(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows in range partitions, ordered by conversation and turn: g, conv, turn, role, text, kind, fault, chunk, at."""
    spark = turns.sparkSession
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("g"),
                        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), said(role).alias("role"),
                        said(text).alias("text"), F.monotonically_increasing_id().alias("id"))
    rows = saved(rows.select("*", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2")))
    place = F.struct("turn", "id")
    repeats = rows.groupBy("g", "h1", "h2").agg(F.count("*").alias("c"), F.min(place).alias("first"))
    repeats = saved(repeats.where("c > 1").drop("c"))
    joined = rows.join(small(repeats, 80), ["g", "h1", "h2"], "left")
    stripped = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (F.when(stripped == "", "blank").when(~place.eqNullSafe(F.coalesce("first", place)), "duplicate")
             .when(~F.substring(stripped, -1, 1).isin(".", "!", "?"), "truncated").otherwise(""))
    initial = F.substring("role", 1, 1)
    kind = (F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) * 3
            + F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", TRUNCATED)
            .otherwise(SOUND))
    faulty = joined.withColumn("fault", fault).withColumn("kind", kind)
    faulty = faulty.select("g", "conv", "turn", "role", "text", "id", "fault", "kind")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // CHUNK_ROWS)
    order = ["g", "turn", "role", "text", "id"]
    # a checkpoint keeps its partitions, so a stretch stays in one task whenever it is read
    return reliable(faulty.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("id").select(
        "*", F.spark_partition_id().alias("chunk"), F.monotonically_increasing_id().alias("at")))


_STRETCH = """g string, chunk int, edge boolean, blank long, duplicate long, truncated long, illegal long, turns long,
    first_turn long, last_turn long, opening int, closing int, costs array<long>, ranks array<int>"""


class _Stretch:
    """Counts over the rows of one conversation in one partition."""

    def __init__(self, g: str, chunk: int):
        self.g, self.chunk, self.kinds = g, chunk, bytearray()
        self.faults, self.illegal, self.turns = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0
        self.first_turn = self.last_turn = None

    def add(self, kind: int, fault: str, turn: int | None) -> None:
        if self.kinds:
            self.illegal += _illegal(self.kinds[-1] // 3, kind // 3)
        self.kinds.append(kind)
        if fault:
            self.faults[fault] += 1
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def row(self, edge: bool) -> tuple:
        costs, ranks = transfer(bytes(self.kinds)) if edge else (None, None)
        return (self.g, self.chunk, edge, *self.faults.values(), self.illegal, self.turns, self.first_turn,
                self.last_turn, self.kinds[0] // 3, self.kinds[-1] // 3, costs, ranks)


def _illegal(left: int, right: int) -> bool:
    """Whether initials, as numbers of kinds, are none of su, ua, au."""
    return (left, right) not in ((0, 1), (1, 2), (2, 1))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of every stretch; the first and the last one of a partition may go on elsewhere and tell their transfer."""
    names = [c.split()[0] for c in _STRETCH.split(",")]
    types = [pa.string(), pa.int32(), pa.bool_(), *[pa.int64()] * 7, pa.int32(), pa.int32(),
             pa.list_(pa.int64()), pa.list_(pa.int32())]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    now, first, out = None, True, []
    for batch in batches:
        for g, chunk, turn, kind, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.g != g or now.chunk != chunk:
                if now is not None:
                    out.append(now.row(first))
                    first = False
                now = _Stretch(g, chunk)
            now.add(kind, fault, turn)
        if out:
            yield batch_of(out)
            out = []
    if now is not None:
        yield batch_of([now.row(True)])


def _along(rows: pd.DataFrame) -> pd.DataFrame:
    """Begin and end of each stretch of one conversation, and its counts taken together on the first."""
    rows = rows.sort_values("chunk")
    ways = folded([(list(c), list(r)) for c, r in zip(rows["costs"], rows["ranks"], strict=True)])
    illegal = int(rows["illegal"].sum())
    turns, last = 0, None
    for opening, closing in zip(rows["opening"].iloc[1:], rows["closing"].iloc[:-1], strict=True):
        illegal += _illegal(closing, opening)
    for n, first, final in zip(rows["turns"], rows["first_turn"], rows["last_turn"], strict=True):
        if n:
            turns += int(n) - (first == last)
            last = final
    sums = {c: rows[c].sum() for c in ("blank", "duplicate", "truncated")}
    return pd.DataFrame({"g": rows["g"], "chunk": rows["chunk"], "begin": [b for b, _ in ways],
                         "end": [e for _, e in ways[:-1]] + [None], **sums, "illegal": illegal,
                         "gaps": int(rows["last_turn"].max() - rows["first_turn"].min() + 1 - turns) if turns else 0,
                         "leads": [True] + [False] * (len(rows) - 1)}).astype({"end": "Int32"})


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and turns of every stretch; rows are held only until their edit is final."""
    names = ["conv_id", "at", "edit", "cost", "role", "text"]
    out: list[tuple] = []
    waiting: list[tuple] = []
    key, conv, way, state, count, search, conv_type = None, None, (None, None), EMPTY, 0, None, None

    def emit(edits: list[str]) -> None:
        nonlocal state, count
        done = 0
        for edit in "".join(edits):
            count += 1
            # the place of an edit: rising along the conversation, over partitions too
            at = (key[1] << 40) + count
            if edit == INSERT:
                state = NEXT[state]
                out.append((conv, at, edit, COST[edit], ROLES[state], ""))
                continue
            role, text, kind = waiting[done]
            done += 1
            if edit == DELETE:
                out.append((conv, at, edit, COST[edit], None, None))
                continue
            state = NEXT[state] if edit == REROLE else kind // 3 + 1
            cost = COST[edit] + (CUT_OFF if kind % 3 == TRUNCATED else 0)
            out.append((conv, at, edit, cost, ROLES[state] if edit == REROLE else role, text))
        del waiting[:done]

    def written() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        out.clear()
        return batch

    for batch in batches:
        conv_type = batch.schema.field("conv").type
        for g, owner, chunk, role, text, kind, begin, end in zip(*(batch.column(c).to_pylist() for c in (
                "g", "conv", "chunk", "role", "text", "kind", "begin", "end")), strict=True):
            if key != (g, chunk):
                if search is not None:
                    emit(search.finish(way[1]))
                key, conv, way, state, count = (g, chunk), owner, (begin, end), begin or EMPTY, 0
                search = Survivors(state)
            waiting.append((role, text, kind))
            emit(search.step(kind))
        if out:
            yield written()
    if search is not None:
        emit(search.finish(way[1]))
        if out:
            yield written()


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> Repair:
    """Repaired turns, the edits that lead to them, and the faults of every conversation.

    Rows stand in order of ``turn`` (nulls first), then role and text. A null role or text is one space. The first fault
    of a row counts: ``blank`` (nothing but white space), ``duplicate`` (role and text as in an earlier row), ``truncated``
    (the last character that is no white space is none of . ! ?). ``illegal`` counts neighbours whose initials are none
    of su, ua, au, ``gaps`` the turn numbers between the least and the largest that no row has. Rows without conv_id are
    one conversation; its rows, as those of any long one, are spread over tasks. Repeated rows are duplicates. Other
    columns are not read; an empty table gives empty results.
    """
    rows = _prepared(turns, conv, turn, role, text)
    found = saved(rows.select("g", "chunk", "turn", "kind", "fault").mapInArrow(_stretches, _STRETCH))
    edges = found.where("edge")
    spanning = edges.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g")
    # at most two stretches of each partition
    ways = saved(edges.join(spanning, "g").groupBy("g").applyInPandas(
        _along, "g string, chunk int, begin int, end int, blank long, duplicate long, truncated long, illegal long, "
                "gaps long, leads boolean"))
    counts = ["blank", "duplicate", "truncated", "illegal"]
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps")
    whole = found.join(small(ways.select("g").distinct(), 32), "g", "left_anti").select("g", gaps, *counts)
    faults = whole.unionByName(ways.where("leads").select("g", "gaps", *counts))
    own = F.expr("substring(g, 2)").cast(turns.schema[conv].dataType)
    faults = faults.select(F.when(F.col("g") != "", own).alias("conv_id"), "gaps", *counts)
    led = rows.join(small(ways.select("g", "chunk", "begin", "end"), 48), ["g", "chunk"], "left").sortWithinPartitions("at")
    kind = turns.schema[conv].dataType.simpleString()
    fixed = led.select("g", "conv", "chunk", "role", "text", "kind", "begin", "end").mapInArrow(
        _repaired, f"conv_id {kind}, at long, edit string, cost long, role string, text string")
    return Repair(fixed, faults)


def read_out(rows: DataFrame) -> DataFrame:
    """conv_id, cost, audit (initials of the edits) and repaired_sha256 (of ``role:text`` of the turns, one to a line)
    of repaired ``rows``. A digest takes a conversation's text in order, so one task reads it, piece by piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, cost, audit, opened, out, kind = None, None, 0, [], False, [], None

        def close() -> None:
            out.append((key, cost, "".join(audit), digest.hexdigest()))

        def written() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True),
                                                     (kind, pa.int64(), pa.string(), pa.string()), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "cost", "audit", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, edit, more, role, text in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "edit", "cost", "role", "text")), strict=True):
                if digest is None or conv != key:
                    if digest is not None:
                        close()
                    key, digest, cost, audit, opened = conv, sha256(), 0, [], False
                cost += more
                audit.append(edit)
                if edit != DELETE:
                    digest.update(f"{chr(10) * opened}{role}:{text}".encode())
                    opened = True
            if out:
                yield written()
        if digest is not None:
            close()
            yield written()

    kind = rows.schema["conv_id"].dataType.simpleString()
    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return sorted_rows.mapInArrow(run, f"conv_id {kind}, cost long, audit string, repaired_sha256 string")

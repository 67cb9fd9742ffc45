"""Conversation structure repair by survivor-coalescence Viterbi (operator 11).

A conversation should read as turns of an optional system message followed by
pairs of user and assistant.  The cheapest edits that make it so are a shortest
path over four states (nothing yet, after system, after user, after assistant):
a row is kept, given another role or deleted, and an empty turn may be inserted
before any row and at the end.

The rows of a conversation are streamed in turn order.  Every state has a
survivor, the cheapest edits that end there.  Survivors are leaves of a tree of
back pointers whose nodes count their references: a node that no survivor leads
to is freed, a chain without a branch is one node.  Once all survivors share an
ancestor, the edits up to it are settled: they are emitted and their rows
leave memory.  Survivors of equal cost are compared over their complete
unresolved edits, from the node where they part.  A state that is dearer than
another one plus the edits that bridge the two is given up, so survivors meet
after a few rows, and a task holds a few rows of a conversation of any
length.  Only in a run where two phases stay exactly as dear (say, user
rows only) is nothing settled before its end; its undeleted rows are held so long.

A conversation is one ordered stream (its digest alone forces that), so
it is one task's work; copies within it are found by a native window in the same
shuffle, and a deleted row's text is never held.

Defined results: a null role or text is one space; a null conversation id is a
conversation of its own; null turns come first; rows of one turn are ordered by
role and text, so equal rows are adjacent and all but the first of them are
duplicates; an empty role has no initial, is never legal and has to be given a role or
deleted; very long texts are streamed like others; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from precis.llm.common import batch

__all__ = ["damaged", "faulty", "Survivors", "repairs", "digests"]

SPACE = r"\x20\x09-\x0D"
RECOLOUR, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
#: Edits of one batch of output, and characters of text in it.
ROWS, CHARS = 8192, 1 << 22


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows damaged by crc32(``conv_id:turn``) % 20; a dropped row stays, marked ``absent``, to name its conversation."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_id, turn)])
    d = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                             F.coalesce(F.col(text), F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("_kind"))
    d = d.withColumn("_copies", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return d.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                    (F.col("_kind") == 0).alias("absent"))


def faulty(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, absent, fault), each conversation whole in one partition and in order."""
    blank = F.lit(" ")
    whole = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
                        F.coalesce("absent", F.lit(False)).alias("absent"))
    near = whole.repartition("conv_id")
    # the rows of a conversation are together already: the window only sorts
    seen = Window.partitionBy("conv_id", "absent", "role", "text").orderBy("turn")
    again = near.withColumn("_n", F.row_number().over(seen))
    fault = (F.when(F.col("absent"), None).when(~F.col("text").rlike(f"[^{SPACE}]"), "blank").when(F.col("_n") > 1, "duplicate")
             .when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), "truncated"))
    kept = F.when(~F.col("absent") & (fault.isNull() | (fault == "truncated")), F.col("text"))
    return again.sortWithinPartitions("conv_id", "turn", "role", "text", "_n").select(
        "conv_id", "turn", "role", kept.alias("text"), "absent", fault.alias("fault"))


# ---------------------------------------------------------------- the path
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)


def _next(state: int) -> int:
    """The state after a user or assistant turn that fits: an assistant's after a user's, a user's otherwise."""
    return ASSISTANT if state == USER else USER


def _moves(initial: str, unfinished: bool, forced: bool) -> list[list[tuple[int, bytes, int]]]:
    """By state reached: (state before, edits, cost) of the cheapest way over one row from every state."""
    best: dict[tuple[int, int], tuple[int, bytes]] = {}

    def offer(source: int, target: int, cost: int, edits: bytes):
        best[source, target] = min(best.get((source, target), (cost, edits)), (cost, edits))

    for source in STATES:
        offer(source, source, DELETE, b"D")
        at, cost, edits = source, 3 * unfinished, b""
        for _ in range(0 if forced else 3):  # two insertions lead to every state that a row can follow
            fits = {"s": at == START, "u": at != USER, "a": at == USER}.get(initial, False)
            if fits:
                offer(source, SYSTEM if initial == "s" else _next(at), cost, edits + b"K")
            offer(source, _next(at), cost + RECOLOUR, edits + b"R")
            at, cost, edits = _next(at), cost + INSERT, edits + b"I"
    return [[(s, *reversed(best[s, t])) for s in STATES if (s, t) in best] for t in STATES]


_MOVES = {(i, u, f): _moves(i, u, f) for i in ("s", "u", "a", "") for u in (False, True) for f in (False, True)}
#: What more it can cost, at most, to go on from one state as from another (insertions, and deleting a system message).
_BRIDGE = {(SYSTEM, START): DELETE + 2 * INSERT, (USER, START): DELETE + INSERT, (ASSISTANT, START): DELETE, (START, SYSTEM): 0,
           (USER, SYSTEM): INSERT, (ASSISTANT, SYSTEM): 0, (START, USER): INSERT, (SYSTEM, USER): INSERT, (ASSISTANT, USER): INSERT,
           (START, ASSISTANT): 0, (SYSTEM, ASSISTANT): 2 * INSERT, (USER, ASSISTANT): INSERT}
#: Insertions that end a conversation in each state.
_ENDING = {START: b"", SYSTEM: b"II", USER: b"I", ASSISTANT: b""}


class _Node:
    """Edits since the parent node; ``refs`` counts the children and survivors that lead here."""

    __slots__ = ("edits", "parent", "refs")

    def __init__(self, edits: bytes, parent: "_Node | None"):
        self.edits, self.parent, self.refs = bytearray(edits), parent, 0
        if parent is not None:
            parent.refs += 1


def _path(node: _Node) -> list[_Node]:
    """From the root to ``node``."""
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out[::-1]


def _before(a: _Node, more_a: bytes, b: _Node, more_b: bytes) -> bool:
    """Whether the complete edits of ``a`` sort before those of ``b``; what both share is skipped."""
    left, right = _path(a), _path(b)
    i = 0
    while i < min(len(left), len(right)) and left[i] is right[i]:
        i += 1
    rest = [[n.edits for n in p[i:]] + [more] for p, more in ((left, more_a), (right, more_b))]
    one, two = rest[0][0], rest[1][0]
    n = min(len(one), len(two))
    if n and one[:8] != two[:8] and min(n, 8) == 8:  # they differ at once, as a rule
        return one < two
    return b"".join(rest[0]) < b"".join(rest[1])


class Survivors:
    """The tree of one conversation.  ``step`` takes a row and returns the edits settled by it, ``finish`` the rest."""

    def __init__(self):
        self.root = _Node(b"", None)
        self.root.refs = 1
        self.leaf = {START: self.root}  # state -> node
        self.cost = {START: 0}

    def step(self, initial: str, fault: str | None) -> bytes:
        moves = _MOVES[initial if initial in ("s", "u", "a") else "", fault == "truncated", fault in ("blank", "duplicate")]
        chosen: dict[int, tuple[int, bytes, int]] = {}
        for target, ways in enumerate(moves):
            best = None
            for source, edits, price in ways:
                if source not in self.cost:
                    continue
                cost = self.cost[source] + price
                if best is None or cost < best[0] or cost == best[0] and _before(self.leaf[source], edits, self.leaf[best[2]], best[1]):
                    best = (cost, edits, source)
            if best is not None:
                chosen[target] = best
        dear = {q for q, (c, _, _) in chosen.items() if any(p in chosen and chosen[p][0] + more < c for (p, t), more in _BRIDGE.items() if t == q)}
        followers: dict[int, int] = {}
        for q in [q for q in chosen if q not in dear]:
            followers[chosen[q][2]] = followers.get(chosen[q][2], 0) + 1
        leaf, cost = {}, {}
        for q, (c, edits, source) in chosen.items():
            if q in dear:
                continue
            old = self.leaf[source]
            if followers[source] == 1 and old.refs == 1 and old is not self.root:
                old.edits += edits  # the only way on: the node grows
                leaf[q] = old
            else:
                leaf[q] = _Node(edits, old)
                leaf[q].refs = 1
            cost[q] = c
        grown = {id(n) for n in leaf.values()}
        for node in self.leaf.values():
            if id(node) not in grown:
                self._release(node)
        self.leaf, self.cost = leaf, cost
        return self._settle()

    def _release(self, node: _Node | None):
        while node is not None:
            node.refs -= 1
            if node.refs or node is self.root:
                return
            node = node.parent

    def _settle(self) -> bytes:
        """Join chains without a branch; emit what all survivors share."""
        for node in self.leaf.values():
            while node.parent is not None and node.parent is not self.root:
                up = node.parent
                if up.refs == 1:
                    up.edits += node.edits
                    node.edits, node.parent = up.edits, up.parent
                else:
                    node = up
        if self.root.refs != 1 or self.root in self.leaf.values():
            return b""
        node = next(iter(self.leaf.values()))
        while node.parent is not self.root:
            node = node.parent
        out = bytes(node.edits)
        node.edits, node.parent = bytearray(), None
        if node in self.leaf.values():  # one survivor
            node.refs = 1
        self.root = node
        return out

    def finish(self) -> bytes:
        best = None
        for q, node in self.leaf.items():
            way = (self.cost[q] + INSERT * len(_ENDING[q]), node, _ENDING[q])
            if best is None or way[0] < best[0] or way[0] == best[0] and _before(node, way[2], best[1], best[2]):
                best = way
        return b"".join(bytes(n.edits) for n in _path(best[1])) + best[2]

    def unresolved(self) -> int:
        """Edits held in the tree."""
        nodes = {id(n): n for leaf in self.leaf.values() for n in _path(leaf)}
        return sum(len(n.edits) for n in nodes.values())


# ---------------------------------------------------------------- streams
_EDITS = ("conv_id {id}, n bigint, edit string, turn {turn}, was_role string, role string, text string, fault string, cost bigint")


def _lists(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in b.columns], strict=True)


class _Conversation:
    """Rows that wait for their edits, and what was emitted so far."""

    def __init__(self, conv_id):
        self.conv_id, self.tree, self.rows, self.state, self.n = conv_id, Survivors(), deque(), START, 0

    def row(self, turn, role, text, fault) -> Iterator[tuple]:
        self.rows.append((turn, role, text, fault))
        return self._emit(self.tree.step(role[:1], fault))

    def end(self) -> Iterator[tuple]:
        yield from self._emit(self.tree.finish())
        if not self.n:
            yield (self.conv_id, 0, None, None, None, None, None, None, 0)

    def _emit(self, edits: bytes) -> Iterator[tuple]:
        for edit in edits.decode("ascii"):
            self.n += 1
            if edit == "I":
                self.state = _next(self.state)
                yield (self.conv_id, self.n, edit, None, None, "user" if self.state == USER else "assistant", "", None, INSERT)
                continue
            turn, role, text, fault = self.rows.popleft()
            if edit == "D":
                yield (self.conv_id, self.n, edit, turn, role, None, None, fault, DELETE)
                continue
            self.state = SYSTEM if edit == "K" and role[:1] == "s" else _next(self.state)
            new = role if edit == "K" else "user" if self.state == USER else "assistant"
            yield (self.conv_id, self.n, edit, turn, role, new, text, fault, RECOLOUR * (edit == "R") + UNFINISHED * (fault == "truncated"))


def _batched(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += size(r)
        if len(held) >= ROWS or chars >= CHARS:
            yield batch(schema, *map(list, zip(*held, strict=True)))
            held, chars = [], 0
    if held:
        yield batch(schema, *map(list, zip(*held, strict=True)))


def repairs(rows: DataFrame) -> DataFrame:
    """The cheapest edits of every conversation of ``rows`` (conv_id, turn, role, text, absent).

    Per edit, in order within its conversation and partition: conv_id, n (from 1), edit (K, R, D or I), turn, was_role,
    role and text of the repaired row (null if deleted), fault, cost.  A conversation without rows has one row with n 0."""
    ordered = faulty(rows)
    kinds = dict(rows.dtypes)
    out = _EDITS.format(id=kinds["conv_id"], turn=kinds["turn"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edits():
            now = None
            for b in batches:
                for conv_id, turn, role, text, absent, fault in _lists(b):
                    if now is None or now.conv_id != conv_id:
                        if now is not None:
                            yield from now.end()
                        now = _Conversation(conv_id)
                    if not absent:
                        yield from now.row(turn, role, text, fault)
            if now is not None:
                yield from now.end()
        return _batched(edits(), schema, lambda r: len(r[6] or ""))

    schema = to_arrow_schema(_struct(out))
    return ordered.mapInArrow(run, out)


def _struct(ddl: str):
    from pyspark.sql.types import StructType
    return StructType.fromDDL(ddl)


_DIGEST = ("conv_id {id}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
           "repaired_sha256 string")


def digests(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``repairs``'s result, read in its order: counts of what was wrong, the edits' initials
    and cost, and the digest of the repaired ``role:text`` lines."""
    out = _DIGEST.format(id=dict(edits.dtypes)["conv_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            conv, started = None, False
            for b in batches:
                for conv_id, n, edit, turn, was, role, text, fault, cost in _lists(b):
                    if not started or n < 2:  # every conversation begins with its edit 1, or 0
                        if started:
                            yield summary()
                        conv, started = conv_id, True
                        count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns", "lines"), 0)
                        audit, sha, first, last, before = bytearray(), hashlib.sha256(), None, None, None

                        def summary(conv=conv, count=count, audit=audit, sha=sha):
                            span = 0 if count["turns"] == 0 else last - first + 1 - count["turns"]
                            return (conv, min(span, 2 ** 63 - 1), count["blank"], count["duplicate"], count["truncated"], count["illegal"],
                                    count["cost"], audit.decode("ascii"), sha.hexdigest())
                    if edit is None:
                        continue
                    audit += edit.encode("ascii")
                    count["cost"] += cost
                    if edit != "I":
                        if fault:
                            count[fault] += 1
                        if before is not None and before + was[:1] not in ("su", "ua", "au"):
                            count["illegal"] += 1
                        before = was[:1]
                        if turn is not None and turn != last:
                            count["turns"] += 1
                            first, last = turn if first is None else first, turn
                    if role is not None:
                        sha.update((("\n" if count["lines"] else "") + f"{role}:{text}").encode())
                        count["lines"] += 1
            if started:
                yield summary()
        return _batched(rows(), schema, lambda r: len(r[7]))

    schema = to_arrow_schema(_struct(out))
    return edits.mapInArrow(run, out)

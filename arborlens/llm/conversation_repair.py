"""Conversation structure repair: cheapest edits to a legal order of turns, by a Viterbi pass that lets go of what is settled.

A conversation is legal if its roles' initials read `(s?(ua)+)?`. Edits in the order of turns: Keep (0), Rerole to user or assistant (3),
Delete (4; required for blank and duplicate turns), Insert an empty user or assistant turn (3); truncated turns that stay cost 3
more. The automaton has four states (nothing yet, after system, after user, after assistant), so four survivors at
most. Their histories form a tree of backpointers with reference counts: a dropped survivor frees its branch, and once all survivors share an
ancestor the edits up to it are final and leave the tree. Memory holds the unsettled turns only.

Ties are broken by the least string of edits. At one turn no survivor's string begins another's (every string has one letter
that is no insert for each turn, and inserts cost), so their order never changes once they differ: each survivor carries its place
among the survivors, which compares complete unsettled suffixes without reading them. A step depends on the
survivors' relative costs and places and on the kind of turn alone; steps seen before are looked up. Survivors that another state beats whatever
follows are dropped; without this, the history that deletes everything would never settle.

Spark damages, orders and marks the turns: duplicates by one grouped least turn per text, with frequent texts spread; turns
reach the pass sorted, as a stream. One conversation's pass and digest are sequential by definition: a very long one is one sorted
stream through one task, in bounded memory but for its own string of edits.

Defined results: null roles and texts are one space (a blank turn of no legal role); null ids form one conversation, null turns
come first; turns of equal number are ordered by role and text, so repeated rows are adjacent; roles count by their
first character, a role without any is illegal; conversations of no rows after damage have zeros, no edits and the digest
of nothing; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_spread, materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Letter of a role → state that follows, and the only role that may be put in, by state.
FOLLOWS = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
PUT_IN = {"": ("u", "user"), "s": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}
ENDS = ("", "a")
#: What it costs at most to do from the first state all that the second could do from then on.
STANDS_IN = {("a", ""): 4, ("s", ""): 6, ("u", ""): 7, ("", "s"): 0, ("a", "s"): 0, ("u", "s"): 3, ("", "u"): 3, ("s", "u"): 3, ("a", "u"): 3, ("", "a"): 0, ("s", "a"): 6, ("u", "a"): 3}
LEGAL = ("su", "ua", "au")


def step(survivors: tuple[tuple[str, int], ...], kind: tuple[str, bool, bool]) -> tuple[tuple[str, int, int, str], ...]:
    """New survivors (state, cost, number of the one before, edits) after a turn of kind (initial, must go, truncated).
    Survivors are (state, cost) in the order of their edits, and so are the new ones."""
    initial, must_go, truncated = kind
    best: dict[str, tuple[int, int, str]] = {}
    more = TRUNCATED if truncated else 0
    for number, (state, cost) in enumerate(survivors):
        edits = ""
        for _ in range(3):  # after two inserts a third only leads back
            moves = [("D", state, DELETE)]
            if not must_go:
                if initial in FOLLOWS[state]:
                    moves.append(("K", FOLLOWS[state][initial], KEEP + more))
                moves.append(("R", PUT_IN[state][0], REROLE + more))
            for letter, to, price in moves:
                new = (cost + price, number, edits + letter)
                if to not in best or new < best[to]:
                    best[to] = new
            state, cost, edits = PUT_IN[state][0], cost + INSERT, edits + "I"
    # a survivor goes if another can follow it at less cost, or at the same with lesser edits
    left = [(number, edits, state, cost) for state, (cost, number, edits) in best.items() if not any((best[x][0] + price, *best[x][1:]) < best[y] for (x, y), price in STANDS_IN.items() if y == state and x in best)]
    return tuple((state, cost, number, edits) for number, edits, state, cost in sorted(left))


class Edit:
    """Node of the backpointer tree: the edits at one turn. `refs` counts children and survivors that stand on it."""

    __slots__ = ("before", "children", "edits", "refs", "state", "turn")

    def __init__(self, before: Edit | None, state: str, edits: str, turn: tuple[str, str] | None) -> None:
        self.before, self.state, self.edits, self.turn = before, state, edits, turn
        self.refs, self.children = 0, set()

    def leave(self) -> None:
        """One reference less; frees what nothing else holds."""
        node = self
        node.refs -= 1
        while not node.refs and node.before is not None:
            before, node.before = node.before, None
            before.children.discard(node)
            before.refs -= 1
            node = before


class Repair:
    """The pass over one conversation. `emit(letter, role, text)` gets every edit once it is settled; role and text are
    None for deleted turns."""

    def __init__(self, emit: Callable[[str, str | None, str | None], None], known: dict) -> None:
        self.emit, self.known = emit, known
        self.root = Edit(None, "", "", None)
        self.root.refs = 1
        self.survivors, self.nodes, self.cost = (("", 0),), [self.root], 0
        self.unsettled = self.most_unsettled = 0

    def add(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        initial = role[:1]
        kind = (initial if initial in ("s", "u", "a") else "", must_go, truncated)
        key = (self.survivors, kind)
        if key not in self.known:
            new = step(self.survivors, kind)
            least = min(cost for _, cost, _, _ in new)
            self.known[key] = tuple((s, c - least) for s, c, _, _ in new), tuple((n, e) for _, _, n, e in new), least
        after, moves, more = self.known[key]
        self._grow(after, moves, more, (role, text))

    def _grow(self, after, moves, more: int, turn) -> None:
        old, new = self.nodes, []
        for number, edits in moves:
            node = Edit(old[number], self.survivors[number][0], edits, turn)
            node.refs = 1
            node.before.refs += 1
            node.before.children.add(node)
            new.append(node)
        for node in old:
            node.leave()
        self.survivors, self.nodes = after, new
        self.cost += more
        self.unsettled += 1
        self.most_unsettled = max(self.most_unsettled, self.unsettled)
        self._settle()

    def _settle(self) -> None:
        while self.root.refs == 1 and self.root.children:
            node = self.root.children.pop()
            node.before, self.root = None, node
            self.unsettled -= 1
            state = node.state
            for letter in node.edits:
                put_to, put = PUT_IN[state]
                if letter == "D":
                    self.emit("D", None, None)
                elif letter == "I":
                    self.emit("I", put, "")
                    state = put_to
                elif letter == "R":
                    self.emit("R", put, node.turn[1])
                else:
                    self.emit("K", *node.turn)

    def close(self) -> int:
        """Settles everything and returns the cost."""
        ends = []
        for number, (state, cost) in enumerate(self.survivors):
            for inserts in range(3):
                if state in ENDS:
                    ends.append((cost + INSERT * inserts, number, "I" * inserts, state))
                    break
                state = PUT_IN[state][0]
        cost, number, edits, state = min(ends)
        self._grow(((state, 0),), ((number, edits),), cost, None)
        return self.cost


class _Conversation:
    def __init__(self, conv_id, known: dict, turns: list | None) -> None:
        self.conv_id, self.out, self.letters, self.place = conv_id, turns, [], 0
        self.digest, self.any_line = hashlib.sha256(), False
        self.repair = Repair(self.settled, known)
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.last = self.before = None

    def settled(self, letter: str, role: str | None, text: str | None) -> None:
        self.letters.append(letter)
        if role is not None:
            self.digest.update((("\n" if self.any_line else "") + f"{role}:{text}").encode())
            self.any_line = True
            if self.out is not None:
                self.out.append((self.conv_id, self.place, letter, role, text))
            self.place += 1

    def add(self, turn, role: str, text: str, late: bool, blank: bool, truncated: bool) -> None:
        if turn is not None and turn != self.last:
            self.distinct += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        row = (turn, role, text)
        duplicate = not blank and (late or row == self.before)
        truncated = truncated and not blank and not duplicate
        if self.rows and self.before[1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = row
        self.rows += 1
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.repair.add(role, text, blank or duplicate, truncated)

    def close(self) -> tuple:
        cost = self.repair.close()
        gaps = self.last - self.first + 1 - self.distinct if self.distinct else 0
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.letters), self.digest.hexdigest(), self.repair.most_unsettled


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, most_unsettled long"
TURNS = "conv_id long, place long, edit string, role string, text string"
_REPORT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in "gaps blank duplicate truncated illegal cost".split()], ("audit", pa.string()), ("repaired_sha256", pa.string()), ("most_unsettled", pa.int64())])
_TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
FLUSH = 2_000


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _pass(turns: bool):
    """Function for mapInArrow over rows sorted by conversation and turn: the report, or the repaired turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        now, reports, lines = None, [], [] if turns else None
        schema, out = (_TURNS, lines) if turns else (_REPORT, reports)
        for batch in batches:
            for conv_id, gone, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        reports.append(now.close())
                    now = _Conversation(conv_id, known, lines)
                if not gone:
                    now.add(*row)
                if len(out) >= FLUSH:
                    yield _batch(out, schema)
                    out.clear()
            if turns:
                reports.clear()
        if now is not None:
            reports.append(now.close())
        if out:
            yield _batch(out, schema)

    return run


def spaced(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone: rows harmed as crc32 of conv_id:turn modulo 20 says. Dropped rows stay as rows that are gone, so that
    their conversation is still known."""
    kind = F.crc32(F.concat(spaced(F.col("conv_id")), F.lit(":"), spaced(F.col("turn"))).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced(F.col("role")).alias("role"), spaced(F.col("text")).alias("text"), kind.alias("kind"))
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))).withColumn("gone", F.col("kind") == 0)
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def _repair(rows: DataFrame, turns: bool) -> DataFrame:
    if "gone" not in rows.columns:
        rows = rows.withColumn("gone", F.lit(False))
    key = F.md5(F.concat(spaced(F.col("conv_id")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced(F.col("role")).alias("role"), spaced(F.col("text")).alias("text"), "gone")
    rows = materialize(rows.withColumn("key", F.when(~F.col("gone"), key)))
    seen = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("k"), F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("nulls")).where("k > 1")
    rows = join_spread(rows, seen, "key", "k", rows.count(), "left")
    late = F.coalesce(F.col("turn").isNotNull() & (F.col("nulls") | (F.col("turn") > F.col("first"))), F.lit(False))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    truncated = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    marked = rows.select("conv_id", "gone", "turn", "role", "text", late.alias("late"), blank.alias("blank"), truncated.alias("truncated"))
    ordered = marked.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    return ordered.mapInArrow(_pass(turns), TURNS if turns else REPORT)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place, edit (K, R or I), role, text of every turn of the repaired conversations."""
    return _repair(rows, True)


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text; `gone` marks rows that only name their conversation): faults, cost, the edits and the digest
    of the repaired turns, and the most turns that were unsettled at once."""
    return _repair(rows, False)

"""Lexical regions: which parts of a text are comments, strings or fenced blocks, by a finite automaton over bytes.

A dialect's regions become one table of steps (state, kind of byte) → state. A run of bytes is then a function from the
state before it to the state behind it, and functions compose: runs are followed side by side from every state, their
functions are composed from left to right, and each run is labelled from the state that it truly begins in. Within a task this makes the work a
few array operations for a batch; between tasks, `with_code` cuts long texts into pieces whose functions Spark gathers (a few bytes each) and folds, so
that no task follows a text from end to end.

`code` is the text with comments, strings and fences blanked, `bare` the text with comments and fences blanked; both keep line breaks and have a
character for each of the text's, so places found in one hold in all. Null texts stay null; a region that is never closed reaches to the end of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

CODE, COMMENT, STRING, FENCE = range(4)


@dataclass(frozen=True)
class Region:
    """From `opens` to `closes`. `one_line`: a line break ends it too; `nests`: it may hold itself; `word`: opens only where no
    word goes before; `own_line`: marks stand first in their lines and the rest of the closing line belongs to it;
    `longer`: the region that begins when the opening mark comes three times."""

    kind: int
    opens: str
    closes: str
    escape: str = ""
    one_line: bool = False
    nests: bool = False
    word: bool = False
    own_line: bool = False
    longer: str = ""


_QUOTES = [Region(STRING, q, q, "\\", one_line=True) for q in "'\""]
DIALECTS: dict[str, tuple[Region, ...]] = {
    "python": (*(Region(STRING, q, q, "\\", one_line=True, longer=q * 3) for q in "'\""), *(Region(STRING, q * 3, q * 3, "\\") for q in "'\""), Region(COMMENT, "#", "\n")),
    "web": (*_QUOTES, Region(STRING, "`", "`", "\\"), Region(COMMENT, "//", "\n"), Region(COMMENT, "/*", "*/")),
    "css": (*(Region(STRING, q, q, "\\") for q in "'\""), Region(COMMENT, "/*", "*/"), Region(STRING, "url(", ")", word=True)),
    "sql": (Region(STRING, "'", "'"), Region(COMMENT, "--", "\n"), Region(COMMENT, "/*", "*/", nests=True)),
    "prisma": (Region(STRING, '"', '"', "\\", one_line=True), Region(COMMENT, "//", "\n")),
    "jsonc": (Region(STRING, '"', '"', "\\", one_line=True), Region(COMMENT, "//", "\n"), Region(COMMENT, "/*", "*/")),
    "markdown": tuple(Region(FENCE, f, f, own_line=True) for f in ("```", "~~~")),
}
#: Languages of files whose dialect has another name.
DIALECT_OF = {"typescript": "web", "javascript": "web", "vue": "web", "svelte": "web", "astro": "web"}
#: Nested comments are told apart to this depth; deeper ones count as of this depth.
DEPTH = 24
TAG = re.compile(rb"(?=(\$\w*\$))")
#: Bytes in a run that is followed from every state; bytes in a piece of a long text.
RUN, PIECE = 128, 1 << 20
#: Tags of dollar quotes that texts of one automaton may have together.
TAGS = 12

_BLANK, _WORD, _OTHER = range(3)


class Automaton:
    """Tables over (state, kind of byte): `step` the next state, `label` the byte's region, `back` how many bytes before it belong
    to the region it opens."""

    def __init__(self, regions: tuple[Region, ...]) -> None:
        self.regions = regions
        marks = {c for r in regions for c in r.opens + r.closes + r.escape if c != "\n"}
        # bytes that no region names behave alike, but for blanks, line breaks and letters
        kinds: dict[str, int] = {"\n": 0, " ": 1, "é": 2, "\x01": 3}
        for c in sorted(marks):
            kinds.setdefault(c, len(kinds))
        self.kind_of = np.full(256, 3, np.uint8)
        for b in range(256):
            c = chr(b)
            if b >= 128 or c.isalnum() or c in "_-":
                self.kind_of[b] = 2
            elif c in " \t\r\f\v":
                self.kind_of[b] = 1
        for c, k in kinds.items():
            if k not in (1, 2, 3):
                self.kind_of[ord(c)] = k
        if any(r.word for r in regions):  # letters of marks may come in capitals
            for c in marks:
                if c.isalpha():
                    self.kind_of[ord(c.upper())] = kinds[c]
        chars = sorted(kinds, key=kinds.get)
        self.context = any(r.word or r.own_line for r in regions)
        start = self._code("", _BLANK)
        number, todo = {start: 0}, [start]
        rows: list[list[tuple[int, int, int]]] = []
        while len(rows) < len(todo):
            row = []
            for c in chars:
                after, label, back = self._advance(todo[len(rows)], c)
                if after not in number:
                    number[after] = len(todo)
                    todo.append(after)
                row.append((number[after], label, back))
            rows.append(row)
        table = np.array(rows, np.int32)
        size = np.uint8 if len(rows) < 256 else np.uint16
        self.step, self.label, self.back = table[:, :, 0].astype(size), table[:, :, 1].astype(np.uint8), table[:, :, 2].astype(np.uint8)

    # states: ("code", what of an opening mark was read, what stands before it), (region, depth, what was read, context)

    def _code(self, read: str, before: int) -> tuple:
        return ("code", read, before if self.context else _OTHER)

    @staticmethod
    def _after(c: str, before: int) -> int:
        return _BLANK if c == "\n" or (c in " \t\r\f\v" and before == _BLANK) else _WORD if c.isalnum() or c in "_-" else _OTHER

    def _advance(self, state: tuple, c: str) -> tuple[tuple, int, int]:
        return self._in_code(state, c) if state[0] == "code" else self._in_region(state, c)

    def _in_code(self, state: tuple, c: str) -> tuple[tuple, int, int]:
        _, read, before = state
        text = read + c
        for k in range(len(text)):
            part = text[k:]
            for r, region in enumerate(self.regions):
                if not region.opens.startswith(part) or (region.word and before == _WORD) or (region.own_line and before != _BLANK):
                    continue
                if part == region.opens:
                    return (r, 1, "?" if region.longer else "", _OTHER), region.kind, len(part) - 1
                return self._code(part, before), CODE, 0
            before = self._after(text[k], before)
        return self._code("", before), CODE, 0

    def _in_region(self, state: tuple, c: str) -> tuple[tuple, int, int]:
        r, depth, read, before = state
        region = self.regions[r]
        same = lambda depth, read, before=_OTHER: ((r, depth, read, before), region.kind, 0)
        if read == "tail":  # behind the closing mark of a region of whole lines
            return (self._code("", _BLANK), CODE, 0) if c == "\n" else same(depth, "tail")
        if read == "?":  # right behind the opening mark
            if c == region.opens:
                return same(depth, "??")
            read = ""
        elif read == "??":  # an empty string, unless the mark comes once more
            if c == region.opens:
                return (next(k for k, x in enumerate(self.regions) if x.opens == region.longer), 1, "", _OTHER), region.kind, 0
            return self._in_code(self._code("", _OTHER), c)
        if region.escape and read == region.escape:
            return same(depth, "")
        if region.escape and c == region.escape:
            return same(depth, region.escape)
        if region.one_line and c == "\n":
            return self._code("", _BLANK), CODE, 0
        text = read + c
        for k in range(len(text)):
            part = text[k:]
            if region.closes.startswith(part) and not (region.own_line and before != _BLANK):
                if part != region.closes:
                    return same(depth, part, before)
                if region.own_line:
                    return same(depth, "tail")
                return (self._code("", self._after(c, _OTHER)), region.kind, 0) if depth == 1 else same(depth - 1, "")
            if region.nests and region.opens.startswith(part):
                return same(min(depth + 1, DEPTH), "") if part == region.opens else same(depth, part)
            before = self._after(text[k], before)
        return same(depth, "", before if region.own_line else _OTHER)

    # ------------------------------------------------------------ runs

    def _runs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(kinds of bytes by run, first run of each text); runs are filled up with a kind that stays in its state."""
        counts = np.array([-(-len(t) // RUN) for t in texts], np.int64)
        first = np.concatenate(([0], np.cumsum(counts)))
        kinds = np.full((first[-1], RUN), self.step.shape[1], np.uint8)
        for k, t in enumerate(texts):
            kinds[first[k] : first[k + 1]].reshape(-1)[: len(t)] = self.kind_of[np.frombuffer(t, np.uint8)]
        return kinds, first

    def _steps(self) -> np.ndarray:
        return np.column_stack([self.step, np.arange(len(self.step), dtype=self.step.dtype)])

    def functions(self, kinds: np.ndarray) -> np.ndarray:
        """State behind each run for every state before it."""
        step = self._steps()
        at = np.tile(np.arange(len(step), dtype=step.dtype), (len(kinds), 1))
        for k in range(RUN):
            at = step[at, kinds[:, k, None]]
        return at

    def function(self, text: bytes) -> list[int]:
        """The whole text's function."""
        kinds, _ = self._runs([text])
        out = np.arange(len(self.step))
        for f in self.functions(kinds):
            out = f[out]
        return out.tolist()

    def labels(self, texts: list[bytes], starts: list[int] | None = None) -> list[np.ndarray]:
        """Region of every byte of the texts, which begin in the given states (else in code)."""
        kinds, first = self._runs(texts)
        functions = self.functions(kinds)
        state = np.zeros(len(kinds), self.step.dtype)
        for k in range(len(texts)):
            now = starts[k] if starts else 0
            for run in range(first[k], first[k + 1]):
                state[run] = now
                now = functions[run, now]
        label = np.column_stack([self.label, np.zeros(len(self.label), np.uint8)])
        back = np.column_stack([self.back, np.zeros(len(self.back), np.uint8)])
        step, out, more = self._steps(), np.empty(kinds.shape, np.uint8), np.empty(kinds.shape, np.uint8)
        for k in range(RUN):
            out[:, k], more[:, k] = label[state, kinds[:, k]], back[state, kinds[:, k]]
            state = step[state, kinds[:, k]]
        flat, found = out.reshape(-1), np.flatnonzero(more.reshape(-1))
        for k in range(1, int(more.max(initial=0)) + 1):
            some = found[more.reshape(-1)[found] >= k]
            flat[some - k] = flat[some]
        return [flat[first[k] * RUN : first[k] * RUN + len(t)] for k, t in enumerate(texts)]


@lru_cache(maxsize=64)
def automaton(dialect: str, tags: tuple[bytes, ...] = ()) -> Automaton:
    regions = DIALECTS.get(dialect, ())
    return Automaton((*regions, *(Region(STRING, t.decode("latin-1"), t.decode("latin-1")) for t in tags)))


def tags_of(dialect: str, text: bytes) -> set[bytes]:
    return {m.group(1) for m in TAG.finditer(text)} if dialect == "sql" else set()


def blanked(text: bytes, label: np.ndarray, kinds: tuple[int, ...]) -> bytes:
    """The text with one blank for each character of the regions but line breaks."""
    raw = np.frombuffer(text, np.uint8)
    hit = np.isin(label, kinds) & (raw != 10)
    if not hit.any():
        return text
    out = np.where(hit, np.uint8(32), raw)
    return out[~(hit & (raw & 0xC0 == 0x80))].tobytes()


def _both(text: bytes, label: np.ndarray) -> tuple[bytes, bytes]:
    return blanked(text, label, (COMMENT, STRING, FENCE)), blanked(text, label, (COMMENT, FENCE))


def mask(texts: list[bytes], dialects: list[str]) -> list[tuple[bytes, bytes]]:
    """(code, bare) of every text."""
    out: list[tuple[bytes, bytes] | None] = [None] * len(texts)
    groups: dict[tuple, list[int]] = {}
    open_tags: dict[str, tuple[set[bytes], list[int]]] = {}
    for k, (text, dialect) in enumerate(zip(texts, dialects)):
        own = tags_of(dialect, text)
        tags, members = open_tags.setdefault(dialect, (set(), []))
        if members and len(tags | own) > TAGS:
            groups[dialect, tuple(sorted(tags)), k] = members
            tags, members = open_tags[dialect] = (set(), [])
        tags |= own
        members.append(k)
    for dialect, (tags, members) in open_tags.items():
        groups[dialect, tuple(sorted(tags)), -1] = members
    for (dialect, tags, _), members in groups.items():
        if not DIALECTS.get(dialect):
            for k in members:
                out[k] = texts[k], texts[k]
            continue
        machine = automaton(dialect, tags)
        for k, label in zip(members, machine.labels([texts[k] for k in members])):
            out[k] = _both(texts[k], label)
    return out


# ---------------------------------------------------------------- plans


def _groups(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    start = held = at = 0
    for at, size in enumerate(sizes, 1):
        held += size
        if held >= limit:
            yield start, at
            start, held = at, 0
    if at > start:
        yield start, at


def _mask_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds code and bare to rows that begin with _text and _dialect."""
    for batch in batches:
        texts, dialects = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()
        done: list[tuple[bytes | None, bytes | None]] = []
        for low, high in _groups((len(t or b"") for t in texts), PIECE):
            part = mask([t or b"" for t in texts[low:high]], dialects[low:high])
            done += [(None, None) if t is None else p for t, p in zip(texts[low:high], part)]
        more = [pa.array([d[k] for d in done], pa.binary()).cast(pa.string()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "code", "bare"])


def _cut(piece: int):
    """Pieces of long texts, cut behind line breaks, else blanks, so that no mark is cut through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, dialect, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw, at, n = text.encode(), 0, 0
                tags = sorted(tags_of(dialect, raw))
                while at < len(raw):
                    end = len(raw)
                    if at + piece < end:
                        cut = max(raw.rfind(b"\n", at, at + piece), -1)
                        cut = cut if cut >= 0 else raw.rfind(b" ", at, at + piece)
                        behind = [x for x in (raw.find(b"\n", at + piece), raw.find(b" ", at + piece)) if x >= 0]
                        end = (cut if cut >= 0 else min(behind, default=len(raw) - 1)) + 1
                    yield pa.RecordBatch.from_arrays([pa.array([uid]), pa.array([n], pa.int32()), pa.array([dialect]), pa.array([tags], pa.list_(pa.binary())), pa.array([raw[at:end]], pa.binary())], names=["uid", "n", "dialect", "tags", "piece"])
                    at, n = end, n + 1

    return run


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        ends = [automaton(r["dialect"], tuple(r["tags"])).function(r["piece"]) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends, pa.list_(pa.int32()))], names=["uid", "n", "ends"])


def _mask_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            label = automaton(r["dialect"], tuple(r["tags"])).labels([r["piece"]], [r["start"]])[0]
            done.append(_both(r["piece"], label))
        more = [pa.array([d[k] for d in done], pa.binary()).cast(pa.string()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *more], names=["uid", "n", "code", "bare"])


def _long(rows: DataFrame, piece: int) -> DataFrame:
    """code and bare for texts longer than a piece: functions of pieces by one task each, folded per text, then labels by piece."""
    rows = materialize(rows.withColumn("_uid", F.monotonically_increasing_id()))
    cut = rows.select("_uid", "_dialect", "_text").mapInArrow(_cut(piece), "uid long, n int, dialect string, tags array<binary>, piece binary")
    pieces = materialize(cut.repartition(F.xxhash64("uid", "n")))
    found = pieces.mapInArrow(_functions, "uid long, n int, ends array<int>").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("n", "ends"))).alias("f"))
    fold = F.aggregate("f", F.array(F.lit(0)), lambda states, f: F.concat(states, F.array(F.element_at(f["ends"], F.element_at(states, -1) + 1))))
    starts = found.select("uid", F.posexplode(F.slice(fold, F.lit(1), F.size("f"))).alias("n", "start"))
    done = pieces.join(starts, ["uid", "n"]).select("uid", "n", "dialect", "tags", "piece", "start").mapInArrow(_mask_pieces, "uid long, n int, code string, bare string")
    whole = done.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("n", "code", "bare"))).alias("p"))
    whole = whole.select(F.col("uid").alias("_uid"), F.array_join("p.code", "").alias("code"), F.array_join("p.bare", "").alias("bare"))
    return rows.join(whole, "_uid").drop("_uid")


def with_code(rows: DataFrame, text: str = "text", language: str = "language", piece: int = PIECE) -> DataFrame:
    """rows with `code` and `bare`; the dialect goes by the language column, unknown and null ones have no regions."""
    names = F.create_map(*(F.lit(x) for p in DIALECT_OF.items() for x in p))
    dialect = F.coalesce(F.element_at(names, F.col(language)), F.col(language), F.lit(""))
    rows = rows.drop("code", "bare")
    columns = rows.columns
    keyed = rows.select(F.col(text).cast("string").alias("_text"), dialect.alias("_dialect"), *columns)
    long_ = F.coalesce(F.octet_length("_text") > piece, F.lit(False))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields)
    short = keyed.where(~long_).mapInArrow(_mask_rows, f"{fields}, code string, bare string")
    return short.unionByName(_long(keyed.where(long_), piece)).select(*columns, "code", "bare")

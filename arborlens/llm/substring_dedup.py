"""Substring dedup: repeated passages found by suffix automata of reference shards and taken out of every document.

Every window of `width` words has a mark: the least hash of its runs of GRAM words. Following windows with the same mark
at the same place form a segment, so equal windows lie in segments of equal mark, and no window occurs twice within one
segment. Marks that occur once are done with: nothing in their segments repeats. What is left is the reference: its distinct segments, each with
its number of occurrences, dealt to shards by mark, so that a shard holds every segment that can share a window with another
of its own. Each shard becomes a suffix automaton over words whose states know how often their strings occur. It is sent
where its part of the documents is streamed, and built there, as Spark's broadcast would take all automata through the driver and to
every task. The stream reads, at every word, the longest match that occurs twice; where it has `width` words, they repeat.

A mark with more than KINDS distinct segments (a short phrase in many contexts) is too large for one automaton: its
segments are cut into windows, which are counted by two hashes, an exact way whatever the number. Segments and windows that very many rows
hold are pre-aggregated and joined without gathering their rows. Tables of marks are a third of the input at most; texts are shuffled twice.

Defined results: null and empty texts have no words; texts of fewer than `width` words keep all; rows of equal id are rows of
their own, and so equal rows lose all words of their windows; null ids are kept as such; a passage that repeats within
one document alone is removed there; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SEPARATOR, U64, WINDOW, _power_tables, discard, groups_of_bytes, join_spread, materialize, mix, text_bytes, word_hashes

WIDTH, GRAM = 35, 8
#: Distinct segments of a mark beyond which its windows are counted; segments in a shard's automaton (besides those of its last mark).
KINDS, SHARD = 1_000, 1_000
#: Words whose windows are marked at once.
CHUNK = 1 << 19
SEGMENTS = "uid long, at long, n int, mark long, body long"


# ---------------------------------------------------------------- marks and segments


def _sum_of(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of words[start:end] for every pair."""
    power, back = _power_tables(len(words) + 1)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(U64))


def segments(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, mark, hash of the segment's words) of all segments of the texts."""
    doc, word = word_hashes(texts, fold=False)
    first = np.searchsorted(doc, np.arange(len(texts)))
    found: list[tuple[np.ndarray, ...]] = []
    for low in range(0, max(0, len(doc) - width + 1), CHUNK):
        high = min(len(doc), low + CHUNK + width - 1)
        w, d = word[low:high], doc[low:high]
        window = np.flatnonzero(d[: len(d) - width + 1] == d[width - 1 :])
        if not len(window):
            continue
        at = np.arange(len(w) - gram + 1)
        mark = _sum_of(w, at, at + gram)
        # hash above, place below: the least of equal hashes is the leftmost
        least = (mark >> U64(20) << U64(20)) | at.astype(U64)
        runs, have = width - gram + 1, 1
        while have < runs:
            more = min(have, runs - have)
            least = np.minimum(least[: len(least) - more], least[more:])
            have += more
        place = (least[window] & U64(0xFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        start, n = window[new], np.diff(np.append(new, len(window)))
        found.append((d[start], low + start - first[d[start]], n, mark[place[new]], _sum_of(w, start, start + n + width - 1)))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64))
    return tuple(np.concatenate(c) for c in zip(*found))


def _cut(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for low, high in groups_of_bytes(len(t) for t in raw):
                doc, at, n, mark, body = segments(raw[low:high], width, gram)
                yield pa.RecordBatch.from_arrays([pa.array(uid[low:high][doc]), pa.array(at), pa.array(n.astype(np.int32)), pa.array(mark.view(np.int64)), pa.array(body.view(np.int64))], names=["uid", "at", "n", "mark", "body"])

    return run


def _contents(width: int):
    """Words of the wanted segments, separated by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["mark", "body", "k", "hot", "words"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        for batch in batches:
            rows = []
            for raw, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = raw.split()  # bytes split at x20 and x09-x0D exactly
                rows += [(s["mark"], s["body"], s["k"], s["hot"], b" ".join(words[s["at"] : s["at"] + s["n"] + width - 1])) for s in wanted]
            for low, high in groups_of_bytes((len(r[4]) for r in rows), 8 * WINDOW):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[low:high]), types)], names=names)

    return run


# ---------------------------------------------------------------- automata


class SuffixAutomaton:
    """Of weighted sequences: every state stands for strings that end at the same places; `count` is their weight."""

    def __init__(self, sequences: Iterable[tuple[list[int], int]]) -> None:
        step: list[dict[int, int]] = [{}]
        link, size, count = [-1], [0], [0]
        for sequence, weight in sequences:
            last = 0
            for c in sequence:
                at = step[last].get(c)
                if at is not None and size[at] == size[last] + 1:
                    last = at
                    count[last] += weight
                    continue
                fresh = at is None
                if fresh:
                    new = len(step)
                    step.append({})
                    link.append(0)
                    size.append(size[last] + 1)
                    count.append(0)
                    p = last
                    while p >= 0 and c not in step[p]:
                        step[p][c] = new
                        p = link[p]
                    if p < 0:
                        last = new
                        count[last] += weight
                        continue
                    at = step[p][c]
                else:
                    p = last
                if size[at] == size[p] + 1:
                    suffix = at
                else:
                    suffix = len(step)
                    step.append(dict(step[at]))
                    link.append(link[at])
                    size.append(size[p] + 1)
                    count.append(0)
                    link[at] = suffix
                    while p >= 0 and step[p].get(c) == at:
                        step[p][c] = suffix
                        p = link[p]
                if fresh:
                    link[new] = suffix
                    last = new
                else:
                    last = suffix
                count[last] += weight
        order = np.argsort(np.asarray(size), kind="stable").tolist()
        for v in reversed(order[1:]):
            count[link[v]] += count[v]
        # longest suffix of a state's strings that occurs twice
        twice = [0] * len(size)
        for v in order[1:]:
            twice[v] = size[v] if count[v] > 1 else twice[link[v]]
        self.step, self.link, self.size, self.count, self.twice = step, link, size, count, twice

    def matches(self, sequence: list[int]) -> Iterator[int]:
        """After every element: length of the longest suffix read that occurs at least twice in the reference."""
        step, link, size, count, twice = self.step, self.link, self.size, self.count, self.twice
        state = held = 0
        for c in sequence:
            while state and c not in step[state]:
                state = link[state]
                held = size[state]
            if c in step[state]:
                state = step[state][c]
                held += 1
            else:
                held = 0
            yield held if count[state] > 1 else twice[link[state]] if state else 0


def repeated_windows(pieces: list[tuple[bytes, int]], width: int = WIDTH) -> list[int]:
    """For each of the shard's (words, occurrences): bits of its windows that occur twice in the shard."""
    number: dict[bytes, int] = {}
    shard = [([number.setdefault(w, len(number)) for w in words.split(b" ")], k) for words, k in pieces]
    automaton = SuffixAutomaton(shard)
    return [sum(1 << (end - width + 1) for end, held in enumerate(automaton.matches(sequence)) if held >= width) for sequence, _ in shard]


def _shards(width: int, shard: int):
    """Rows sorted by mark; a shard is a run of whole marks."""

    def masks(rows: list[tuple]) -> pa.RecordBatch:
        bits = repeated_windows([(words, k) for _, _, words, k in rows], width)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(bits, pa.int64())], names=["mark", "body", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("mark", "body", "words", "k")]):
                if len(rows) >= shard and row[0] != rows[-1][0]:
                    yield masks(rows)
                    rows.clear()
                rows.append(row)
        if rows:
            yield masks(rows)

    return run


def _windows(width: int):
    """Every window of the segments: two hashes and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mark, body, k = (batch.column(c).to_numpy() for c in ("mark", "body", "k"))
            text = batch.column("words").to_pylist()
            for low, high in groups_of_bytes((len(t) for t in text), WINDOW):
                doc, word = word_hashes(text[low:high], fold=False)
                at = np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1 :]) if len(doc) >= width else np.zeros(0, np.int64)
                own = doc[at]
                one, two = _sum_of(word, at, at + width), _sum_of(mix(word), at, at + width)
                place = (at - np.searchsorted(doc, own)).astype(np.int32)
                own = own + low
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (one.view(np.int64), two.view(np.int64), mark[own], body[own], place, k[own])], names=["one", "two", "mark", "body", "place", "k"])

    return run


# ---------------------------------------------------------------- plans


def _hot_bits(contents: DataFrame, width: int) -> DataFrame:
    """mark, body and bits of segments whose mark has too many kinds: their windows are counted, not the segments."""
    windows = contents.select("mark", "body", "k", "words").mapInArrow(_windows(width), "one long, two long, mark long, body long, place int, k long")
    windows = materialize(windows.select(F.struct("one", "two").alias("window"), "mark", "body", "place", "k"))
    total = windows.count()
    often = windows.groupBy("window").agg(F.sum("k").alias("times"), F.count("*").alias("rows")).where("times > 1").drop("times")
    hit = join_spread(windows, often, "window", "rows", total)
    return hit.groupBy("mark", "body").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits"))


def repeated_segments(rows: DataFrame, width: int = WIDTH, gram: int = GRAM, kinds: int = KINDS, shard: int = SHARD) -> DataFrame:
    """uid, at, bits for rows (uid, raw), one table: windows at + k of the document repeat somewhere where bit k is set."""
    found = materialize(rows.select("uid", "raw").mapInArrow(_cut(width, gram), SEGMENTS), codec="zstd")
    key = F.struct("mark", "body").alias("key")
    distinct = materialize(found.groupBy("mark", "body").agg(F.count("*").alias("k"), F.min(F.struct("uid", "at", "n")).alias("one")))
    marks = distinct.groupBy("mark").agg(F.sum("k").alias("times"), F.count("*").alias("kinds")).where("times > 1").drop("times")
    wanted = join_spread(distinct, marks, "mark", "kinds", distinct.count())
    wanted = wanted.select("one.uid", F.struct("one.at", "one.n", "mark", "body", "k", (F.col("kinds") > kinds).alias("hot")).alias("s")).groupBy("uid").agg(F.collect_list("s").alias("wanted"))
    contents = rows.join(wanted, "uid").select("raw", "wanted").mapInArrow(_contents(width), "mark long, body long, k long, hot boolean, words binary")
    contents = materialize(contents)
    dealt = contents.where("not hot").select("mark", "body", "words", "k").repartition("mark").sortWithinPartitions("mark", "body")
    bits = dealt.mapInArrow(_shards(width, shard), "mark long, body long, bits long").unionByName(_hot_bits(contents.where("hot"), width)).where("bits <> 0")
    side = materialize(bits.join(distinct.select("mark", "body", "k"), ["mark", "body"]).select(key, "bits", "k"))
    discard(contents)
    spread = found.select("uid", "at", key)
    return join_spread(spread, side, "key", "k", found.count()).select("uid", "at", "bits")


def _keep(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raws = batch.column(0), batch.column(1).to_pylist()
            kept, counts, removed = [], [], []
            for raw, hits in zip(raws, batch.column(2).to_pylist()):
                words = raw.split()
                counts.append(len(words))
                if hits:
                    edge = np.zeros(len(words) + 1, np.int32)
                    for hit in hits:
                        at, bits = hit["at"], hit["bits"]
                        while bits:
                            k = (bits & -bits).bit_length() - 1
                            edge[at + k] += 1
                            edge[at + k + width] -= 1
                            bits &= bits - 1
                    stays = np.cumsum(edge[:-1]) == 0
                    words = [words[k] for k in np.flatnonzero(stays)]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, kinds: int = KINDS, shard: int = SHARD) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (joined by one space) of every row of docs."""
    assert _SEPARATOR[[0x20, *range(0x09, 0x0E)]].all() and 1 <= gram <= width and width - gram < 62
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("raw")), codec="zstd")
    hits = repeated_segments(rows, width, gram, kinds, shard).groupBy("uid").agg(F.collect_list(F.struct("at", "bits")).alias("hits"))
    return rows.join(hits, "uid", "left").select("doc_id", "raw", "hits").mapInArrow(_keep(width), "doc_id long, n_words long, n_removed long, kept string")

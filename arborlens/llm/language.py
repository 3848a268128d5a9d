"""Language identification by cross-parsing.

Per language a suffix automaton of labelled text recognises every string that occurs in it. A text is parsed greedily:
a phrase goes on while it occurs in the language's text, and ends where it no longer does. The language whose automaton
needs the fewest phrases, relative to what it needs for unseen text of its own, wins.

The automata are built from at most `sample` bytes per language, taken in equal shares from the documents of least
hash, `most` of them at most (what short ones leave of their shares goes to the longer ones), and measured on at most
`sample` / 4 bytes of every fifth of these documents, which are not learned from; of a single document the last fifth is
measured on. The samples travel to the tasks, which build
the automata once per worker. Texts are lower-cased and parsed whole. Runs of SEGMENT bytes are parsed side by side, each as
if a phrase began with it; then every run's last phrase is followed into the next runs until a phrase of its parse begins
where one of theirs does, from where on both are the same. So the phrases counted are those of one parse from the text's
first byte to its last, with the longest matches.

Defined results: null texts and texts without a letter are `und` with score 0, and so are all texts if no language was
learned; rows without language and the held-out quarter (crc32 of the id mod 4 = 2) are not learned from; ties go to
the first language in code point order; repeated rows are rows; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of_texts, held_out, materialize, text_key

SAMPLE, DOCS, SEGMENT, SHARPNESS = 32_768, 128, 512, 12.0
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
for _c in range(97, 123):
    _FOLD[_c] = _c
for _c in range(65, 91):
    _FOLD[_c] = _c + 32


def folded(text: bytes) -> np.ndarray:
    """Bytes with every ASCII character but letters as a space."""
    return _FOLD[np.frombuffer(text, np.uint8)]


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        now = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = now
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[now] = copy
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
        last = now
    return moves


class Parser:
    """All languages' automata in one table of moves: 0 is no move; each language has a start state."""

    def __init__(self, samples: dict[str, bytes], unseen: dict[str, bytes]) -> None:
        self.languages = sorted(samples)
        own = {k: folded(v) for k, v in samples.items()}
        letters = np.unique(np.concatenate(list(own.values())))
        self.width = len(letters) + 1
        self.kind = np.zeros(256, np.int64)  # 0: a byte that no sample holds
        self.kind[letters] = np.arange(1, self.width)
        tables, base, starts = [np.zeros((1, self.width), np.int32)], 1, []
        for k in self.languages:
            moves = suffix_automaton(own[k])
            rows = np.zeros((len(moves), self.width), np.int32)
            for i, m in enumerate(moves):
                for c, to in m.items():
                    rows[i, self.kind[c]] = to + base
            tables.append(rows)
            starts.append(base)
            base += len(moves)
        self.moves = np.concatenate(tables).ravel()
        self.start = np.array(starts, np.int64)
        self.again = self.moves.reshape(-1, self.width)[self.start]  # a new phrase with this byte
        self.again = np.where(self.again == 0, self.start[:, None], self.again).astype(np.int64)
        self.usual = np.ones(len(self.languages))
        for i, k in enumerate(self.languages):
            if unseen.get(k):
                self.usual[i] = self.phrases([unseen[k]])[0, i] / len(unseen[k])
            else:
                self.usual[i] = 0.25
        self.usual = np.maximum(self.usual, 1e-3)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases per text and language of the greedy parse of each whole text."""
        size = np.array([len(t) for t in texts])
        total, langs = int(size.sum()), len(self.languages)
        buf = self.kind.astype(np.uint8)[folded(b"".join(texts))]
        runs = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), runs)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
        first = np.repeat(np.cumsum(size) - size, runs) + nth * SEGMENT
        length = np.minimum(SEGMENT, size[owner] - nth * SEGMENT)
        begins = np.zeros((langs, total + 1), np.int8)  # where a phrase begins in its run's own parse
        begins[:, first] = 1
        order = np.argsort(-length, kind="stable")
        live = np.searchsorted(-length[order], -np.arange(SEGMENT), "left")  # runs longer than t
        state = np.repeat(self.start[:, None], len(owner), 1)
        for t in range(SEGMENT):
            n = int(live[t])
            if not n:
                break
            at = first[order[:n]] + t
            c = buf[at]
            to = self.moves[state[:, :n] * self.width + c]
            ended = to == 0
            begins[:, at] |= ended
            state[:, :n] = np.where(ended, self.again[:, c], to)
        final = np.empty_like(state)
        final[:, order] = state
        end = np.cumsum(size)[owner]
        out = np.zeros((len(texts), langs), np.int64)
        for k in range(langs):
            more, meets = self._follow(k, final[k], first + length, end, buf, begins[k])
            before = np.zeros(total + 1, np.int32)  # phrases that begin before a place
            np.cumsum(begins[k, :-1], dtype=np.int32, out=before[1:])
            # from run to run by the places where parses meet
            text = np.flatnonzero(size)
            place = first[np.searchsorted(owner, text)]
            while len(text):
                run = np.searchsorted(first, place, "right") - 1
                out[text, k] += before[first[run] + length[run]] - before[place] + more[run]
                place = meets[run]
                on = place < end[run]
                text, place = text[on], place[on]
        return np.maximum(out, 1)

    def _follow(self, k: int, state: np.ndarray, at: np.ndarray, end: np.ndarray, buf: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases begun, place met) of every run's parse beyond its end, until it meets the runs' own or the text ends."""
        more, meets = np.zeros(len(at), np.int64), end.copy()
        live = np.flatnonzero(at < end)
        state, at = state[live], at[live]
        while len(live):
            c = buf[at]
            to = self.moves[state * self.width + c]
            ended = to == 0
            met = ended & (begins[at] > 0)
            meets[live[met]] = at[met]
            more[live[ended & ~met]] += 1
            state, at = np.where(ended, self.again[k, c], to), at + 1
            on = ~met & (at < end[live])
            live, state, at = live[on], state[on], at[on]
        return more, meets


_built: dict[int, Parser] = {}


def parser(samples: dict[str, bytes], unseen: dict[str, bytes]) -> Parser:
    """Built once per worker."""
    key = hash((tuple(sorted(samples.items())), tuple(sorted(unseen.items()))))
    if key not in _built:
        _built.clear()
        _built[key] = Parser(samples, unseen)
    return _built[key]


def shares(sizes: list[int], room: int) -> list[int]:
    """Part of each size so that all together are at most room: equal ones, but no more than the size."""
    out, left = [0] * len(sizes), room
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    for n, k in enumerate(order):
        out[k] = min(sizes[k], left // (len(sizes) - n))
        left -= out[k]
    return out


def joined(texts: list[bytes], room: int) -> bytes:
    """A share of each text, at most room bytes together, a space between them."""
    texts = texts[: max(1, room // 2)]
    return b" ".join(t[:n] for t, n in zip(texts, shares([len(t) for t in texts], room - len(texts) + 1), strict=True))


def learn_samples(docs: DataFrame, sample: int, most: int = DOCS) -> tuple[dict[str, bytes], dict[str, bytes]]:
    """Training bytes and further bytes per language: two bounded strings each."""
    own = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.regexp_like(F.col("text"), F.lit(r"\p{L}")) & ~held_out(F.col("doc_id")))
    own = own.withColumn("_key", text_key(F.col("text")))
    # the least text of each of 64 * most hash slots: repeated rows are one, and no language brings more rows to the window
    order = F.xxhash64("doc_id", "_key")
    least = own.groupBy("lang", F.pmod(order, F.lit(64 * most)).alias("slot")).agg(F.min(F.struct(order.alias("order"), "doc_id", "_key")).alias("d"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id", "_key"))
    chosen = materialize(least.select("lang", "d.*").withColumn("place", place).where(F.col("place") <= most).drop("order"))
    # the sample needs no more of a text than its own size; repeated rows are one
    texts = own.select("doc_id", "lang", "_key", F.substring(F.lower(F.col("text")), 1, sample * 5 // 4).alias("text")).join(F.broadcast(chosen), ["doc_id", "lang", "_key"])
    texts = texts.groupBy("lang", "_key").agg(F.min("place").alias("place"), F.first("text").alias("text"))

    def gather(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("text").sort_values("place", kind="stable")
        texts = [t.encode() for t in frame["text"]]
        if len(texts) > 1:
            far = [t for k, t in enumerate(texts) if k % 5 == min(4, len(texts) - 1)]
            train = joined([t for k, t in enumerate(texts) if k % 5 != min(4, len(texts) - 1)], sample)
        else:
            cut = min(sample, len(texts[0]) * 4 // 5)
            train, far = texts[0][:cut], [texts[0][cut:]]
        return pd.DataFrame({"lang": [key[0]], "train": [train], "unseen": [joined(far, sample // 4)]})

    rows = texts.groupBy("lang").applyInPandas(gather, "lang string, train binary, unseen binary").collect()
    return {r["lang"]: bytes(r["train"]) for r in rows if r["train"]}, {r["lang"]: bytes(r["unseen"]) for r in rows if r["unseen"]}


def identify(docs: DataFrame, sample: int = SAMPLE, most: int = DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    samples, unseen = learn_samples(base, sample, most)
    raw = F.when(F.regexp_like(F.col("text"), F.lit(r"\p{L}")), F.lower("text")).cast("binary")

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = parser(samples, unseen) if samples else None
        for frame in frames:
            for low, high in batches_of_texts(frame):
                part = frame.iloc[low:high]
                out = part.drop(columns="raw").assign(lang_pred="und", score=0.0)
                has = np.array([r is not None for r in part["raw"]])
                if own and has.any():
                    texts = [r for r in part["raw"] if r is not None]
                    rate = own.phrases(texts) / np.array([len(t) for t in texts])[:, None] / own.usual
                    best = rate.argmin(1)
                    p = np.exp(-SHARPNESS * (rate - rate.min(1)[:, None]))
                    out.loc[has, "lang_pred"] = [own.languages[k] for k in best]
                    out.loc[has, "score"] = 1 / p.sum(1)
                yield out

    return base.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), raw.alias("raw")).mapInPandas(predict, "doc_id long, held_out boolean, lang_pred string, score double")

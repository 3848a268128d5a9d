"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and their first STEM bytes, lower-cased and without ASCII punctuation, hashed. The machine is
b + sum w_i + sum over pairs <v_i, v_j> over the terms of a text, so a pair such as insult and group mention can weigh
what neither weighs alone; additive weights cannot learn that. It knows every term of at least two labelled texts, whether
or not it tells labels apart by itself; where these are more than `terms`, the ones that tell labels apart come first (half of
the places at most), then the most frequent. A term's own weight moves the less, the smaller its |z|; its factors for pairs move
freely. Other terms weigh nothing.

Fitting reads at most `sample` labelled rows, one for each id and text (those of least hash) outside the held-out quarter (crc32 of the id
mod 4 = 2), and of these so many that they hold at most `room` distinct terms together (32 MB of slots in the driver, and 48 MB of counts at most); scoring reads every whole text. Only the text enters a score.

Defined results: null and empty texts score as a text without terms, which is the base rate of the sample or, without
labels of both kinds, 0; repeated labels beyond the first are not learned from; repeated rows are scored as rows; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TERM_GAPS, U64, batches_of_texts, held_out, labelled_texts, materialize, mix, text_bytes, text_key, with_text_score, word_hashes

SAMPLE, TERMS, BITS, RANK, STEM, ROOM = 20_000, 65_536, 22, 8, 5, 16_000_000


def term_ids(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    doc, word = word_hashes(texts, TERM_GAPS)
    _, stem = word_hashes(texts, TERM_GAPS, STEM)
    both = np.concatenate((word, mix(stem + U64(STEM))))
    return np.concatenate((doc, doc)), (both >> U64(64 - bits)).astype(np.int64)


class Machine:
    """Factorization machine; slots maps a hashed term to its place or -1."""

    def __init__(self, terms: np.ndarray, w: np.ndarray, v: np.ndarray, b: float) -> None:
        self.terms, self.w, self.v, self.b = terms, w.astype(np.float32), v.astype(np.float32), float(b)

    def slots(self, bits: int = BITS) -> np.ndarray:
        out = np.full(1 << bits, -1, np.int32)
        out[self.terms] = np.arange(len(self.terms))
        return out

    def margin(self, doc: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        """Margins of n texts from (text, slot) pairs, distinct."""
        out = np.full(n, self.b)
        out += np.bincount(doc, self.w[slot], minlength=n)
        for k in range(self.v.shape[1]):
            x = self.v[slot, k]
            out += 0.5 * (np.bincount(doc, x, minlength=n) ** 2 - np.bincount(doc, x * x, minlength=n))
        return out


def choose_terms(seen: np.ndarray, up: np.ndarray, both: np.ndarray, y: np.ndarray, most: int, strong: float = 3.3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed terms, their log-odds, |z|), at most `most` of the terms seen, which `both` texts hold, `up` of them toxic."""
    up, both = up.astype(float), both.astype(float)
    pos, neg = y.sum(), len(y) - y.sum()
    # deviation from what the base rate expects, in standard errors
    expected = both * pos / len(y)
    z = np.maximum(np.abs(up - expected) - 0.5, 0) / np.sqrt(both * pos / len(y) * neg / len(y) + 1e-9)
    first = np.argsort(-z, kind="stable")[: most // 2]
    rank = both.copy()
    rank[first[z[first] >= strong]] = np.inf
    order = np.argsort(-rank, kind="stable")[:most]
    seen, up, both, z = seen[order], up[order], both[order], z[order]
    share = (both + 1) / (len(y) + 2)
    a, c = np.maximum(up + 4 * share * pos / len(y), 0.05), np.maximum(both - up + 4 * share * neg / len(y), 0.05)
    odds = np.log(a / np.maximum(pos - up + 1, 1)) - np.log(c / np.maximum(neg - both + up + 1, 1))
    return seen, np.clip(odds, -4, 4), z


def slot_type(n: int) -> type:
    """Two bytes hold a slot of up to 65,536 terms."""
    return np.uint16 if n <= 1 << 16 else np.int32


def fit(texts: list[np.ndarray], y: np.ndarray, terms: int = TERMS, rank: int = RANK, bits: int = BITS, rounds: int = 30, ridge: float = 2e-3) -> Machine:
    """The machine of texts, given as the distinct hashed terms of each."""
    both = np.zeros(1 << bits, np.int32)
    up = np.zeros(1 << bits, np.int32)
    for own, label in zip(texts, y, strict=True):
        both[own] += 1
        up[own] += int(label)
    seen = np.flatnonzero(both >= 2)
    chosen = choose_terms(seen, up[seen], both[seen], y, terms)
    place = Machine(chosen[0], np.zeros(0), np.zeros((0, 1)), 0).slots(bits)
    own = [place[t] for t in texts]
    return learn(*chosen, [s[s >= 0].astype(slot_type(len(chosen[0]))) for s in own], y, rank, rounds, ridge)


def learn(chosen: np.ndarray, odds: np.ndarray, z: np.ndarray, texts: list[np.ndarray], y: np.ndarray, rank: int = RANK, rounds: int = 30, ridge: float = 2e-3) -> Machine:
    """Logistic loss by Adagrad over batches of texts, given as the slots of their chosen terms; starts from the terms' own
    shrunk log-odds and small random factors."""
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    draw = np.random.Generator(np.random.PCG64(7))
    trust = z**3 / (z**3 + 3.3**3)
    m = Machine(chosen, odds * 0.5 * trust * z / (z + 3), draw.normal(0, 0.02, (len(chosen), rank)), base)
    if not len(chosen):
        return m
    pace = np.maximum(0.05, trust).astype(np.float32)
    w, v, b = m.w, m.v, m.b
    gw, gv, gb = np.full(w.shape, 1e-2, np.float32), np.full(v.shape, 1e-2, np.float32), 1e-6
    batch = 256
    for turn in range(rounds):
        order = draw.permutation(len(y))
        for at in range(0, len(y), batch):
            some = order[at : at + batch]
            count = np.array([len(texts[k]) for k in some])
            s = np.concatenate([texts[k] for k in some])
            d = np.repeat(np.arange(len(some)), count)
            full = np.flatnonzero(count)
            total = np.zeros((len(some), rank), np.float32)
            if len(s):
                total[full] = np.add.reduceat(v[s], (np.cumsum(count) - count)[full], axis=0)
            square = np.bincount(d, (v**2).sum(1)[s], minlength=len(some))
            margin = b + np.bincount(d, w[s], minlength=len(some)) + 0.5 * ((total**2).sum(1) - square)
            g = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[some]
            # gradients by term: sums of g and of g * total over its texts; a pair of a term with itself is taken off
            pull = np.concatenate((g[:, None] * total, g[:, None]), 1).astype(np.float32)
            dw, dv = ridge * w / 8, ridge * v / 8
            if len(s):
                by = np.argsort(s, kind="stable")
                of = s[by]
                first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                of = of[first]
                sums = np.add.reduceat(pull[d[by]], first, axis=0) / len(some)
                dw[of] += pace[of] * sums[:, -1]
                dv[of] += sums[:, :-1] - sums[:, -1:] * v[of]
            gw += dw**2
            gv += dv**2
            w -= 0.15 * pace * dw / np.sqrt(gw)
            v -= 0.03 * dv / np.sqrt(gv)
            db = g.mean()
            gb += db**2
            b -= 0.05 * db / np.sqrt(gb)
    return Machine(chosen, w, v, b)


def distinct_pairs(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((doc << 32) | term)
    return key >> 32, key & 0xFFFFFFFF


def fit_machine(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS, room: int = ROOM) -> Machine:
    """The machine learned from the labelled rows of docs."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    labels = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    learned = materialize(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("_key"), text_bytes(F.col("text")).alias("raw"))

    def sampled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low, high in batches_of_texts(frame):
                part = frame.iloc[low:high]
                doc, term = distinct_pairs(*term_ids(list(part["raw"])))
                cut = np.searchsorted(doc, np.arange(1, high - low))
                own = np.split(term, cut)
                yield pd.DataFrame({"label": part["label"], "n": [len(t) for t in own], "terms": [t.astype(np.int32) for t in own]})

    # at most `sample` rows, repeated ids or not, as far as their terms have room
    found = materialize(labelled_texts(base, learned, sample).mapInPandas(sampled, "label int, n int, terms array<int>").withColumn("place", F.xxhash64("terms")))
    places = found.select("place", "n").toPandas().groupby("place")["n"].sum().sort_index()
    fits = places.index[places.cumsum() <= room]
    found = found.where(F.col("place") <= (int(fits[-1]) if len(fits) else -(2**63)))
    # terms are counted by Spark; the driver gets the counts of those of two texts, and the slots of the chosen ones
    counts = found.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").cast("int").alias("both"), F.sum("label").cast("int").alias("up"))
    counts = counts.where("both >= 2").toPandas().sort_values("term")
    y = found.select("label").toPandas()["label"].to_numpy(float)
    if 0 < y.sum() < len(y):
        chosen = choose_terms(*(counts[c].to_numpy() for c in ("term", "up", "both")), y, terms)
        known, kind = np.sort(chosen[0]), slot_type(len(chosen[0]))
        rank_of = np.argsort(chosen[0], kind="stable").astype(kind)

        def slotted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                own = []
                for t in frame["terms"]:
                    at = np.minimum(np.searchsorted(known, t), max(0, len(known) - 1))
                    own.append(rank_of[at[known[at] == t]].tobytes() if len(known) else b"")
                yield frame.drop(columns="terms").assign(slots=own)

        rows = found.select("place", "label", "terms").mapInPandas(slotted, "place long, label int, slots binary").toPandas().sort_values(["place", "label"], kind="stable")
        machine = learn(*chosen, [np.frombuffer(t, kind) for t in rows["slots"]], rows["label"].to_numpy(float))
        del rows
    else:
        machine = Machine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 1)), 30.0 if y.sum() else -30.0)
    del counts
    return machine


def scorer(machine: Machine):
    """Function that makes, in a task, the function from texts to scores."""

    def make():
        slots = machine.slots()

        def score(texts: list[bytes]) -> np.ndarray:
            doc, term = term_ids(texts)
            slot = slots[term]
            doc, slot = distinct_pairs(doc[slot >= 0], slot[slot >= 0].astype(np.int64))
            return 1 / (1 + np.exp(-np.clip(machine.margin(doc, slot, len(texts)), -30, 30)))

        return score

    return make


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    machine = fit_machine(docs, labels, sample, terms)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = with_text_score(rows, "score", scorer(machine))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = 0.3) -> DataFrame:
    """Rows of docs that are not predicted toxic, filtered where they are scored."""
    machine = fit_machine(docs, labels, sample)
    return with_text_score(docs, "_toxic", scorer(machine)).where(F.col("_toxic") < least).drop("_toxic")

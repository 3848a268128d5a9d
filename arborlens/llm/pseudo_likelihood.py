"""LM scoring by masked pseudo-likelihood.

P(word | context) = P(class | context) * P(word | class, context). A window network predicts every word's class from the
two words before and the two after it: one embedding table per position, summed, tanh, softmax. The classes are the `words`
most frequent words of all documents, `clusters` classes of words by the company they keep, and `buckets` hash classes for
the rest.

With `branch`, the network goes on to predict the word within its cluster: the words of each cluster are the leaves of a
binary tree, whose every node chooses a side by the first branch - 1 hidden units and a bias (hierarchical softmax). Trees
halve a cluster's occurrences again and again, by the direction of company that varies most; biases start from the counts,
so an untrained tree gives exactly a word's share of the cluster. Words of hash classes, and without `branch` those of
clusters, have their exact count in all documents over the class's count plus one; what is left belongs to unseen words.
Counts of the words that occur most (at most `head` of them) travel to the tasks, those of all others are joined.

A word's company are the frequent words up to REACH places away in all texts, each as a fixed vector of DIMS signs, summed.
Words of the head that occur more than once and have company are clustered by the directions of these sums (spherical
k-means, words weighing their counts, over at most `head` vectors in the driver); so words of one language or subject share
classes, and context tells about them. All other words, those seen once among them, have hash classes.

The network is trained on all word positions (with `rate`, on one in so many), each pack of texts in one of `rounds` rounds,
whatever the size of the corpus. In a round packs are dealt to groups of about GROUP positions, each group trains from the
shared weights and Adagrad sums, and the groups' results are averaged, those of a tree's node by how often each group came
through it. A document's score is the sum of the conditional
log-probabilities of all its words, and that per word.

Defined results: texts without words, empty and null texts have no tokens, log_prob 0 and score null; words at an end
see a border class beyond it; repeated rows are scored as rows; rows without doc_id are scored; ties among words go to
the smaller hash; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TERM_GAPS, U64, batches_of_texts, brief_shuffles, discard, materialize, text_bytes, word_hashes

WORDS, CLUSTERS, BUCKETS, HIDDEN, RATE, GROUP, ROUNDS = 64, 28, 4, 32, 1, 200_000, 3
HEAD, PACK, DIMS, REACH = 262_144, 16_384, 12, 8
SPAN, PARTS = 16_384, 8
BRANCH = 8
OFFSETS = (-2, -1, 1, 2)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents; word is the 64-bit hash."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low, high in batches_of_texts(frame):
                _, word = word_hashes(list(frame["raw"].iloc[low:high]), TERM_GAPS)
                word, n = np.unique(word, return_counts=True)
                yield pd.DataFrame({"word": word.view(np.int64), "n": n})

    return docs.select(text_bytes(F.col("text")).alias("raw")).mapInPandas(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def places(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of the values among sorted ones."""
    if not len(sorted_):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return at, sorted_[at] == values


def classes(word: np.ndarray, frequent: np.ndarray, buckets: int, clusters: int = 0) -> np.ndarray:
    """Class of each word that is in no cluster: its place among the sorted frequent ones, else a bucket after these and the clusters."""
    at, found = places(frequent, word)
    return np.where(found, at, len(frequent) + clusters + (word % U64(buckets)).astype(np.int64))


class Index:
    """Places of values among many sorted 64-bit hashes, by a table of the first place of every prefix."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        bits = max(1, len(values).bit_length() + 1)
        self.shift = U64(64 - bits)
        self.first = np.append(np.searchsorted(values, np.arange(1 << bits, dtype=U64) << self.shift), len(values))

    def places(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of the values; the place of one that is not found means nothing."""
        prefix = (values >> self.shift).astype(np.int64)
        at, end, found = self.first[prefix], self.first[prefix + 1], np.zeros(len(values), bool)
        live = np.flatnonzero(at < end)
        while len(live):
            hit = self.values[at[live]] == values[live]
            found[live[hit]] = True
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return np.minimum(at, max(0, len(self.values) - 1)), found


def located(docs: DataFrame, frequent: np.ndarray, heads: np.ndarray, buckets: int, meet: bool) -> DataFrame:
    """Table of rid, doc_id, places (of the words in order: 32-bit places among `frequent`, after these among `heads`, or -1 - bucket)
    and tail (hashes of the words that are in neither). With `meet`, further rows hold in `near` the company of words of the
    head, as 64-bit numbers in rows of 1 + DIMS: place in `heads`, sums of the sign vectors of frequent words up to REACH words away
    in the same text; their rid is the number of the span of SPAN places."""
    signs = np.zeros((DIMS, len(frequent) + 1), np.int64)
    signs[:, :-1] = np.random.Generator(np.random.PCG64(23)).integers(0, 2, (DIMS, len(frequent))) * 2 - 1
    signs = signs[::2] + (signs[1::2] << 32)  # summed two at a time

    def locate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, met, index = np.zeros((len(heads) if meet else 0, 1 + DIMS), np.int64), np.zeros(len(heads), bool), Index(heads)
        for frame in frames:
            for low, high in batches_of_texts(frame):
                part = frame.iloc[low:high]
                doc, word = word_hashes(list(part["raw"]), TERM_GAPS)
                kind, often = places(frequent, word)
                at, found = index.places(word)
                place = np.where(found, at + len(frequent), -1 - (word % U64(buckets)).astype(np.int64))
                place = np.where(often, kind, place).astype(np.int32)
                ends = np.cumsum(np.bincount(doc, minlength=high - low))
                beyond = np.flatnonzero(place < 0)
                yield part.drop(columns="raw").assign(
                    places=[k.tobytes() for k in np.split(place, ends[:-1])],
                    tail=np.split(word[beyond].view(np.int64), np.searchsorted(doc[beyond], np.arange(1, high - low))),
                    near=None,
                )
                if not meet:
                    continue
                kind[~often] = len(frequent)
                here = np.flatnonzero(found & ~often)
                at, end = at[here], ends[doc[here]]
                start = np.concatenate(([0], ends))[doc[here]]
                start, end = np.maximum(here - REACH, start), np.minimum(here + REACH + 1, end)
                own, slot = np.unique(at, return_inverse=True)
                met[own] = True
                run, both = np.zeros(len(word) + 1, np.int64), np.zeros((len(signs), len(own)), np.int64)
                for pair, total in zip(signs, both, strict=True):
                    np.cumsum(pair.take(kind), out=run[1:])
                    np.add.at(total, slot, run.take(end) - run.take(start))
                low = both.astype(np.int32)
                near = np.stack((low, (both - low) >> 32), 1).reshape(DIMS, -1)
                sums[own, 1:] += near.T
        for span in range(-(-len(heads) // SPAN) if meet else 0):
            here = span * SPAN + np.flatnonzero(met[span * SPAN : (span + 1) * SPAN])
            if len(here):
                sums[here, 0] = here
                yield pd.DataFrame({"rid": [span], "doc_id": [None], "places": [None], "tail": [None], "near": [sums[here].tobytes()]})

    raws = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("raw"))
    return materialize(raws.mapInPandas(locate, "rid long, doc_id long, places binary, tail array<long>, near binary"), codec="zstd")


def company(rows: DataFrame) -> np.ndarray:
    """The sums in the rows `near` of a table of places, as rows of 1 + DIMS ordered by place in the head: added up per partition,
    then for each span of places, whose sums come to the driver."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}
        for frame in frames:
            for span, raw in zip(frame["span"], frame["near"], strict=True):
                near = np.frombuffer(raw, np.int64).reshape(-1, 1 + DIMS)
                own = sums.setdefault(span, np.zeros((SPAN, 1 + DIMS), np.int64))  # in the first column: how many sums
                at = near[:, 0] - span * SPAN
                own[at, 0] += 1
                own[at, 1:] += near[:, 1:]
        for span, own in sums.items():
            at = np.flatnonzero(own[:, 0])
            own = own[at]
            own[:, 0] = at + span * SPAN
            yield pd.DataFrame({"span": [span], "near": [own.tobytes()]})

    near = rows.where("near is not null").select(F.col("rid").cast("int").alias("span"), "near").mapInPandas(add, "span int, near binary")
    found = sorted(near.repartition(PARTS, "span").mapInPandas(add, "span int, near binary").collect())
    return np.concatenate([np.zeros((0, 1 + DIMS), np.int64), *(np.frombuffer(r["near"], np.int64).reshape(-1, 1 + DIMS) for r in found)])


def cluster(x: np.ndarray, weight: np.ndarray, k: int, turns: int = 20) -> np.ndarray:
    """Cluster of each unit vector by spherical k-means; the first centres are drawn by weight and distance, always the same for the same rows."""
    draw = np.random.Generator(np.random.PCG64(29))
    centres, far = np.zeros((0, x.shape[1]), np.float32), np.ones(len(x))
    for _ in range(min(k, len(x))):
        odds = np.cumsum(weight * far)
        if odds[-1] <= 0:
            break
        centres = np.vstack([centres, x[min(np.searchsorted(odds, draw.random() * odds[-1], "right"), len(x) - 1)]])
        far = np.minimum(far, np.maximum(0, 1 - x @ centres[-1]))
    own = np.zeros(len(x), np.int64)
    for _ in range(turns):
        old, own = own, (x @ centres.T).argmax(1)
        if (old == own).all():
            break
        sums = np.stack([np.bincount(own, weight * x[:, d], minlength=len(centres)) for d in range(x.shape[1])], 1)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres).astype(np.float32)
    return own


@dataclass(frozen=True)
class Trees:
    """Binary trees over the words of clusters: where each leaf's steps begin (and one more, the end), the steps from the root as
    2 * node + side, and the nodes' weights, of which the last is the bias."""

    first: np.ndarray
    steps: np.ndarray
    nodes: np.ndarray

    def __getstate__(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The last step to every leaf and to every node (-1: none) and the weights, which take a fraction of the bytes: leaves
        share the steps to the nodes above them."""
        to_leaf, to_node = np.full(len(self.first) - 1, -1, np.int32), np.full(len(self.nodes), -1, np.int32)
        some = np.diff(self.first) > 0
        to_leaf[some] = self.steps[self.first[1:][some] - 1]
        inner = np.ones(len(self.steps), bool)
        inner[self.first[:-1][some]] = False  # a leaf's first step begins at a root
        inner = np.flatnonzero(inner)
        to_node[self.steps[inner] >> 1] = self.steps[inner - 1]
        return to_leaf, to_node, self.nodes

    def __setstate__(self, state: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        step, to_node, nodes = state
        leaf, way = np.flatnonzero(step >= 0), []
        n, step = np.zeros(len(step), np.int64), step[step >= 0]
        while len(leaf):
            way.append((leaf, step))
            n[leaf] += 1
            above = to_node[step >> 1]
            leaf, step = leaf[above >= 0], above[above >= 0]
        first = np.concatenate(([0], np.cumsum(n)))
        steps, at = np.empty(first[-1], np.int32), first[1:].copy()
        for leaf, step in way:
            at[leaf] -= 1
            steps[at[leaf]] = step
        for name, value in (("first", first), ("steps", steps), ("nodes", nodes)):
            object.__setattr__(self, name, value)

    def ways(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, node, side) of all steps to the leaves; those below zero have none."""
        own = np.flatnonzero(leaf >= 0)
        leaf = leaf.take(own)
        start = self.first.take(leaf)
        n = self.first.take(leaf + 1) - start
        step = np.repeat(start - np.cumsum(n) + n, n)
        step += np.arange(len(step))
        step = self.steps.take(step).astype(np.int64)
        return np.repeat(own, n), step >> 1, step & 1

    def reading(self, h: np.ndarray) -> np.ndarray:
        """What nodes read of the hidden layer: its first units, and one for the bias."""
        read = np.ones((len(h), self.nodes.shape[1]), np.float32)
        read[:, :-1] = h[:, : read.shape[1] - 1]
        return read

    def log_probs(self, h: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Of every leaf within its cluster."""
        own, node, side = self.ways(leaf)
        z = dots(self.reading(h).take(own, 0), self.nodes.take(node, 0))
        z *= (1 - 2 * side).astype(np.float32)
        np.exp(np.clip(z, -80, 80, out=z), out=z)
        z += 1
        return -np.bincount(own, np.log(z, out=z), minlength=len(leaf))


def grow(x: np.ndarray, weight: np.ndarray, label: np.ndarray, width: int) -> Trees:
    """One tree for each label over its rows of x: a node halves its rows' weight along the coordinate that varies most; its bias
    is the log of the sides' odds."""
    rows, seg, made, found = np.arange(len(x)), label, 0, []
    bias = [np.zeros(0)]
    while True:
        _, seg, n = np.unique(seg, return_inverse=True, return_counts=True)
        rows = rows[n[seg] > 1]
        if not len(rows):
            break
        _, seg = np.unique(seg[n[seg] > 1], return_inverse=True)
        w, many = weight[rows], seg.max() + 1
        whole = np.bincount(seg, w)
        mean = [np.bincount(seg, w * x[rows, d]) / whole for d in range(x.shape[1])]
        varies = np.stack([np.bincount(seg, w * (x[rows, d] - mean[d][seg]) ** 2) for d in range(x.shape[1])])
        order = np.lexsort((x[rows, varies.argmax(0)[seg]], seg))
        rows, seg, w = rows[order], seg[order], w[order]
        before = np.cumsum(w) - w
        side = (before - (np.cumsum(whole) - whole)[seg] + w / 2 > whole[seg] / 2).astype(np.int64)
        # whatever the rounding, both sides have rows
        ends = np.flatnonzero(np.diff(seg, append=many))
        side[ends], side[np.concatenate(([0], ends[:-1] + 1))] = 1, 0
        right = np.bincount(seg, w * side)
        bias.append(np.log(right) - np.log(whole - right))
        found.append((rows, 2 * (made + seg) + side))
        made, seg = made + many, 2 * seg + side
    leaf, step = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
    first = np.concatenate(([0], np.cumsum(np.bincount(leaf, minlength=len(x)))))
    nodes = np.zeros((made, width), np.float32)
    nodes[:, -1] = np.concatenate(bias)
    return Trees(first, step[np.argsort(leaf, kind="stable")].astype(np.int32), nodes)


def windows(doc: np.ndarray, kind: np.ndarray, border: int) -> np.ndarray:
    """Context classes (positions x offsets), `border` beyond the ends of a text."""
    out = np.full((len(kind), len(OFFSETS)), border, np.int64)
    for k, o in enumerate(OFFSETS):
        a, b = (slice(-o, None), slice(None, o)) if o < 0 else (slice(None, -o), slice(o, None))
        if len(kind) > abs(o):
            out[a, k] = np.where(doc[a] == doc[b], kind[b], border)
    return out


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows of a with those of b."""
    return (a * b) @ np.ones(a.shape[1], a.dtype)


def tanh(x: np.ndarray) -> np.ndarray:
    """In place, by way of exp, which takes half the time; off by less than 1e-6."""
    x *= 2
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    np.divide(-2, x, out=x)
    x += 1
    return x


def add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds each of the rows to the row of `out` at its place; places may repeat. An even number of columns is added in pairs."""
    kind = np.float32 if out.shape[1] % 2 else np.complex64
    out, rows = out.view(kind), rows.view(kind)
    np.add.at(out.reshape(-1), np.arange(out.size).reshape(out.shape).take(at, 0).reshape(-1), rows.reshape(-1))


def numbered(keys: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the different keys in any order, the place of every key among them), without sorting; `mark` is scratch with an item for
    each possible key."""
    step = np.arange(len(keys))
    mark[keys] = step
    chosen = mark.take(keys)  # of every key, one step
    own = np.flatnonzero(chosen == step)
    step[own] = np.arange(len(own))
    return keys.take(own), step.take(chosen)


def keys_of(context: np.ndarray, base: int) -> np.ndarray:
    """One number for each context; all classes are below `base`."""
    key = np.zeros(len(context), np.int64)
    for column in context.T:
        key = key * base + column
    return key


def alike(key: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions ordered by their keys, for each of these the number of its key, and where each key begins (and the end); all
    keys are under `below`."""
    bits = len(key).bit_length()
    if below < 1 << 63 - bits:  # with the position in one number, which sorts faster
        key = np.sort(key << bits | np.arange(len(key)))
        order, key = key & (1 << bits) - 1, key >> bits
    else:
        order = np.argsort(key, kind="stable")
        key = key.take(order)
    new = np.ones(len(key) + 1, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:-1])
    return order, np.cumsum(new[:-1]) - 1, np.flatnonzero(new)


def sums_of(rows: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the rows from each beginning to the next; an even number of columns is added in pairs, as complex numbers are."""
    if rows.shape[1] % 2:
        return np.add.reduceat(rows, begin, axis=0)
    return np.add.reduceat(rows.view(np.complex64), begin, axis=0).view(np.float32)


class Network:
    """Weights as one flat float32 array: embeddings (offsets x (size + 1) x hidden), bias, output, output bias."""

    def __init__(self, flat: np.ndarray, size: int, hidden: int) -> None:
        self.flat, self.size = flat, size
        shapes = [(len(OFFSETS), size + 1, hidden), (hidden,), (hidden, size), (size,)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        self.embed, self.bias, self.out, self.prior = (part.reshape(s) for part, s in zip(np.split(flat, ends[:-1]), shapes, strict=True))

    @staticmethod
    def fresh(size: int, hidden: int) -> np.ndarray:
        draw = np.random.Generator(np.random.PCG64(11))
        parts = [draw.normal(0, 0.1, len(OFFSETS) * (size + 1) * hidden), np.zeros(hidden), draw.normal(0, 0.1, hidden * size), np.zeros(size)]
        return np.concatenate(parts).astype(np.float32)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.embed[0].take(context[:, 0], 0)
        for k in range(1, len(OFFSETS)):
            h += self.embed[k].take(context[:, k], 0)
        h += self.bias
        return tanh(h)

    def log_probs(self, context: np.ndarray, target: np.ndarray, step: int = 1024, trees: Trees | None = None, leaf: np.ndarray | None = None) -> np.ndarray:
        """Of the target classes, and of the leaves within them where they are not below zero. Few frequent words and clusters make
        most contexts, so the network is asked once for each different one."""
        result, ones = np.empty(len(target)), np.ones(self.size, np.float32)
        room = np.empty((step, self.size), np.float32)
        base = self.size + 1
        order, number, begin = alike(keys_of(context, base), base ** len(OFFSETS))
        once, wide = order.take(begin[:-1]), 0 if trees is None else trees.nodes.shape[1] - 1
        units = np.empty((len(once), wide), np.float32)
        for a in range(0, len(once), step):
            h = self.hidden(context.take(once[a : a + step], 0))
            units[a : a + step] = h[:, :wide]
            z = np.matmul(h, self.out, out=room[: len(h)])
            z += self.prior
            low, high = begin[a], begin[a + len(h)]
            some, row = order[low:high], number[low:high] - a
            own = z[row, target.take(some)]
            result[some] = own - np.log(np.exp(z, out=z) @ ones).take(row)
        if trees is not None:
            for a in range(0, len(order), step):
                some = order[a : a + step]
                result[some] += trees.log_probs(units.take(number[a : a + step], 0), leaf.take(some))
        return result

    def train(
        self, context: np.ndarray, target: np.ndarray, seen: np.ndarray, size: int = 1024, rate: float = 0.05, trees: Trees | None = None, leaf: np.ndarray | None = None, past_nodes: np.ndarray | None = None
    ) -> np.ndarray | None:
        """One pass of Adagrad over the windows, in batches that ask the network once for each different context; `seen`, its sums of squares in the order of `flat`, is carried on, and so is
        `past_nodes` of the trees' nodes. Gives how often each node was passed."""
        passed, mark = (None, None) if trees is None else (np.zeros(len(trees.nodes), np.float32), np.zeros(len(trees.nodes), np.int64))
        past = Network(seen, self.size, self.embed.shape[2])
        order = np.random.Generator(np.random.PCG64(len(target))).permutation(len(target))
        embed = np.zeros_like(self.embed)
        ones, each = np.ones((self.size, 1), np.float32), np.ones(size, np.float32)
        base = self.size + 1
        keys = keys_of(context, base)
        room = np.empty((size, self.size), np.float32)
        for a in range(0, len(order), size):
            some = order[a : a + size]
            by, number, begin = alike(keys.take(some), base ** len(OFFSETS))
            some = some.take(by)
            c, t = context.take(some.take(begin[:-1]), 0), target.take(some)
            h = self.hidden(c)
            p = np.matmul(h, self.out, out=room[: len(h)])
            p += self.prior
            np.clip(p, -30, 30, out=p)
            np.exp(p, out=p)
            p *= np.diff(begin).astype(np.float32)[:, None] / (len(t) * (p @ ones))
            np.subtract.at(p.reshape(-1), number * self.size + t, np.float32(1 / len(t)))
            dh = p @ self.out.T
            if trees is not None:
                self.branch(trees, leaf.take(some), number, h, dh, past_nodes, passed, mark)
            dh *= 1 - h * h
            embed[...] = 0
            for k in range(len(OFFSETS)):
                add_rows(embed[k], c[:, k], dh)
            for k, g in {"out": h.T @ p, "prior": each[: len(h)] @ p, "bias": each[: len(h)] @ dh, "embed": embed}.items():
                sums = getattr(past, k)
                sums += g * g
                getattr(self, k)[...] -= rate * g / np.sqrt(sums)
        return passed

    @staticmethod
    def branch(trees: Trees, leaf: np.ndarray, number: np.ndarray, h: np.ndarray, dh: np.ndarray, past: np.ndarray, passed: np.ndarray, mark: np.ndarray, rate: float = 0.5) -> None:
        """One step of the nodes on the way to the leaves, whose rows of h (in ascending order) `number` has; adds their part to dh. Nodes learn from sums over the batch, not means:
        most are passed a few times. `past` has one sum of squares a node, of the weight that moves most; `mark` is scratch."""
        own, node, side = trees.ways(leaf)
        if not len(own):
            return
        own = number.take(own)
        begin = np.append(0, np.flatnonzero(own[1:] != own[:-1]) + 1)
        read, weights = trees.reading(h).take(own, 0), trees.nodes.take(node, 0)
        g = np.negative(dots(read, weights))
        np.exp(np.clip(g, -30, 30, out=g), out=g)
        g += 1
        np.divide(1, g, out=g)
        g -= side.astype(np.float32)
        each = np.repeat(g, read.shape[1]).reshape(read.shape)
        weights *= each
        read *= each
        part = np.zeros((len(h), read.shape[1]), np.float32)
        part[own.take(begin)] = sums_of(weights, begin)
        part /= len(leaf)
        dh[:, : part.shape[1] - 1] += part[:, :-1]
        np.add.at(passed, node, np.float32(1))
        node, slot = numbered(node, mark)
        g = np.zeros((len(node), read.shape[1]), np.float32)
        add_rows(g, slot, read)
        sums = past.take(node)
        sums += reduce(np.maximum, (g * g).T)
        past[node] = sums
        g *= np.repeat(rate / np.sqrt(sums), g.shape[1]).reshape(g.shape)
        np.subtract(trees.nodes.take(node, 0), g, out=g)
        whole = f"V{g.itemsize * g.shape[1]}"  # a row is one item
        np.put(trees.nodes.view(whole), node, g.view(whole))


def packed(frames: Iterator[pd.DataFrame], codes: np.ndarray, border: int) -> Iterator[pd.DataFrame]:
    """Packs of about PACK positions, as codes of the words: texts with two borders before and after each; of long texts, pieces
    that overlap by two words on either side, which are marked as context by negative codes."""
    for frame in frames:
        edge, out, held = np.full(2, border, np.int32), [], 0
        for rid, raw in zip(frame["rid"], frame["places"], strict=True):
            code = codes[np.frombuffer(raw, np.int32)]
            whole = np.concatenate((edge, code, edge))
            for at in range(0, len(code), PACK):
                piece = whole[at : at + PACK + 4].copy()
                for side in (piece[:2], piece[-2:]):
                    side[side != border] = -1 - side[side != border]
                out.append(piece)
                held += len(piece) - 4
                if held >= PACK:
                    yield pd.DataFrame({"rows": [np.concatenate(out).tobytes()], "salt": [int(rid) ^ at << 40]})
                    out, held = [], 0
        if out:
            yield pd.DataFrame({"rows": [np.concatenate(out).tobytes()], "salt": [int(frame["rid"].iloc[-1]) ^ 1 << 62]})


#: What a group has learnt: how many groups, the sum of their weights, numbers of nodes, and for each of these how often it
#: was passed and the sums, as often, of its weights and sums of squares.
LEARNT = "part int, n long, w array<double>, node binary, learnt binary"


def learner(shared: Broadcast, known: Broadcast, size: int, hidden: int, rate: int):
    """One group's training from the shared weights, nodes and sums of squares; `known` has the classes of codes and the trees."""

    def learn(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        (start, nodes, past), (kinds, trees) = shared.value, known.value
        stream = np.concatenate([np.frombuffer(r, np.int32) for r in frame.sort_values("salt")["rows"]]).astype(np.int64)
        at = np.flatnonzero((stream >= 0) & (stream != size))
        if rate > 1:
            at = at[np.random.Generator(np.random.PCG64(len(at))).integers(0, rate, len(at)) == 0]
        leaf = np.maximum(stream[at] - size, 0) - 1
        stream = kinds[np.where(stream < 0, -1 - stream, stream)].astype(np.int64)
        context = np.stack([stream[at + o] for o in OFFSETS], 1)
        weights, sums = np.split(start.copy(), 2)
        net, node, learnt = Network(weights, size, hidden), np.zeros(0, np.int32), np.zeros(0, np.float32)
        if trees is None:
            net.train(context, stream[at], sums)
        else:
            own, squares = Trees(trees.first, trees.steps, nodes.copy()), past.copy()
            passed = net.train(context, stream[at], sums, trees=own, leaf=leaf, past_nodes=squares)
            node = np.flatnonzero(passed)
            often = passed.take(node)[:, None]
            learnt = np.concatenate((often, own.nodes.take(node, 0), squares.take(node)[:, None]), 1)
            learnt[:, 1:] *= often
        return pd.DataFrame({"part": [0], "n": [1], "w": [np.concatenate((weights, sums)).astype(float)], "node": [node.astype(np.int32).tobytes()], "learnt": [learnt.tobytes()]})

    return learn


def adder(nodes: int, width: int):
    """Sums of what groups have learnt, nodes dealt to PARTS rows."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, rows = 0, np.zeros(0), None
        for frame in frames:
            for k, w, node, learnt in zip(frame["n"], frame["w"], frame["node"], frame["learnt"], strict=True):
                rows = np.zeros((nodes, 2 + width)) if rows is None else rows
                if k:
                    n, sums = n + int(k), np.array(w, float) if n == 0 else sums + w
                if len(node):
                    rows[np.frombuffer(node, np.int32)] += np.frombuffer(learnt, np.float32).reshape(-1, 2 + width)
        if rows is not None:
            passed = np.flatnonzero(rows[:, 0])
            for part in range(PARTS):
                node = passed[passed % PARTS == part]
                yield pd.DataFrame({"part": [part], "n": [n if part == 0 else 0], "w": [sums if part == 0 else np.zeros(0)], "node": [node.astype(np.int32).tobytes()], "learnt": [rows[node].astype(np.float32).tobytes()]})

    return add


def average(learned: DataFrame, trees: Trees | None, past: np.ndarray | None) -> np.ndarray | None:
    """Mean of the rows' vectors w: added up per partition, then in a few tasks, whose sums come to the driver. The nodes that were
    passed get their means in place."""
    nodes, width = (0, 0) if trees is None else trees.nodes.shape
    rows = learned.mapInPandas(adder(nodes, width), LEARNT).repartition(PARTS, "part").mapInPandas(adder(nodes, width), LEARNT).collect()
    for r in rows:
        if len(r["node"]):
            node, sums = np.frombuffer(r["node"], np.int32), np.frombuffer(r["learnt"], np.float32).reshape(-1, 2 + width)
            mean = sums[:, 1:] / sums[:, :1]
            trees.nodes[node], past[node] = mean[:, :width], mean[:, width]
    n = sum(r["n"] for r in rows)
    return sum(np.array(r["w"]) for r in rows if r["n"]) / n if n else None


def train(packs: DataFrame, total: int, kinds: np.ndarray, size: int, hidden: int, rate: int, group: int, rounds: int, trees: Trees | None) -> np.ndarray:
    """Weights learnt from the codes in `packs`, of `total` positions; `kinds` has the class of each code. Nodes learn in place."""
    groups = max(1, -(-total // (max(1, rounds) * rate * group)))
    weights = Network.fresh(size, hidden)
    flat = np.concatenate((weights, np.full(len(weights), 1e-4, np.float32)))
    nodes, past = (None, None) if trees is None else (trees.nodes, np.ones(len(trees.nodes), np.float32))
    share = packs.sparkSession.sparkContext.broadcast
    known = share((kinds, None if trees is None else Trees(trees.first, trees.steps, nodes[:, :0])))
    for turn in range(rounds if total else 0):
        shared = share((flat, nodes, past))  # for this round alone: its copies on all machines go at the end
        dealt = packs.where(F.col("turn") == turn).withColumn("group", F.pmod(F.xxhash64("salt", F.lit(turn)), F.lit(groups)))
        mean = average(dealt.groupBy("group").applyInPandas(learner(shared, known, size, hidden, rate), LEARNT), trees, past)
        shared.destroy()
        flat = flat if mean is None else mean.astype(np.float32)
    known.destroy()
    return flat[: len(weights)]


def bucket_of(word, buckets: int):
    """Bucket of a signed 64-bit hash, read as unsigned."""
    return F.pmod(F.pmod(word, F.lit(buckets)) + F.when(word < 0, 2**64 % buckets).otherwise(0), F.lit(buckets))


@dataclass(frozen=True)
class Model:
    """What fit() learns: sorted frequent words, sorted words of the head with their counts and clusters (-1: none), the
    counts of the clusters and buckets, the network, the trees with the leaf of each word of the head (-1: none), and the table of
    all counts with the least level of the head in it."""

    frequent: np.ndarray
    heads: np.ndarray
    seen: np.ndarray
    labels: np.ndarray
    mass: np.ndarray
    clusters: int
    buckets: int
    hidden: int
    flat: np.ndarray
    trees: Trees | None
    leaf: np.ndarray
    counts: DataFrame
    least: int

    @property
    def size(self) -> int:
        return len(self.frequent) + self.clusters + self.buckets

    def classes(self) -> np.ndarray:
        """Class of each word of the head that is not frequent."""
        first = len(self.frequent)
        return first + np.where(self.labels >= 0, self.labels, self.clusters + (self.heads % U64(self.buckets)).astype(np.int64))

    def codes(self) -> np.ndarray:
        """By place (see located(); places below zero count from the end): the class, or for leaves the number of classes, plus one,
        plus the leaf."""
        first, own = len(self.frequent), self.classes()
        if self.trees is not None:
            own = np.where(self.leaf >= 0, self.size + 1 + self.leaf, own)
        return np.concatenate((np.arange(first), own, first + self.clusters + np.arange(self.buckets)[::-1])).astype(np.int32)

    def class_of_codes(self) -> np.ndarray:
        """Class of each code; the border is the code after the last class."""
        leaves = np.zeros(0, np.int64)
        if self.trees is not None:
            some = np.flatnonzero(self.leaf >= 0)
            leaves = np.empty(len(some), np.int64)
            leaves[self.leaf[some]] = self.classes()[some]
        return np.concatenate((np.arange(self.size + 1), leaves)).astype(np.int16)

    def inner(self) -> np.ndarray:
        """By place: what counts tell of log P(word | class); for words beyond the head the log of their count is to be added."""
        first, spread = len(self.frequent), np.log(self.mass + 1)
        own = np.log(self.seen.astype(float)) - spread[self.classes() - first]
        if self.trees is not None:
            own[self.leaf >= 0] = 0
        return np.concatenate((np.zeros(first), own, -spread[self.clusters :][::-1]))

    def kinds(self, word: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of each word, its place in the head (of which `index` is the index), and whether it is in there."""
        kind = classes(word, self.frequent, self.buckets, self.clusters)
        at, found = index.places(word)
        if found.any():
            label = np.where(found, self.labels[at], -1)
            kind = np.where((kind >= len(self.frequent)) & (label >= 0), len(self.frequent) + label, kind)
        return kind, at, found

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_tokens, log_prob, score for every row of docs."""
        return self.scored(located(docs, self.frequent, self.heads, self.buckets, False))

    def scored(self, rows: DataFrame) -> DataFrame:
        """The same for a table of places."""
        rows = rows.where("near is null")
        flat, size, hidden, trees, codes, kinds, inner = self.flat, self.size, self.hidden, self.trees, self.codes(), self.class_of_codes(), self.inner()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            net = Network(flat, size, hidden)
            for frame in frames:
                for low, high in batches_of_texts(frame, "places", 1 << 20):
                    part = frame.iloc[low:high]
                    n = np.array([len(k) // 4 for k in part["places"]])
                    doc, place = np.repeat(np.arange(high - low), n), np.frombuffer(b"".join(part["places"]), np.int32)
                    code = codes[place]
                    kind = kinds[code].astype(np.int64)
                    value = net.log_probs(windows(doc, kind, size), kind, trees=trees, leaf=np.maximum(code - size, 0) - 1)
                    yield part.drop(columns="places").assign(n_tokens=n, log_prob=np.bincount(doc, value + inner[place], minlength=high - low))

        out = rows.select("rid", "doc_id", "places").mapInPandas(run, "rid long, doc_id long, n_tokens long, log_prob double")
        if self.least:
            # words beyond the head; those seen once or never add log 1
            tail = rows.select("rid", F.explode("tail").alias("word")).join(self.counts.where((level() < self.least) & (F.col("n") > 1)), "word")
            out = out.join(tail.groupBy("rid").agg(F.sum(F.log("n")).alias("more")), "rid", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
        return out.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("score"))


def level(n: str = "n") -> Column:
    """Level of a count, in sixteenths of a binary order."""
    return F.floor(F.log2(n) * 16)


def fit(
    docs: DataFrame, words: int = WORDS, buckets: int = BUCKETS, hidden: int = HIDDEN, rate: int = RATE, group: int = GROUP, rounds: int = ROUNDS, head: int = HEAD, clusters: int = CLUSTERS, branch: int = 0
) -> tuple[Model, DataFrame]:
    """The model of docs (doc_id, text), and docs as a table of places."""
    counts = materialize(word_counts(docs))
    top = counts.orderBy(F.desc("n"), "word").limit(words).collect()
    frequent = np.sort(np.array([r["word"] for r in top], np.int64).view(U64))
    mass = np.zeros(clusters + buckets)
    for r in counts.groupBy(bucket_of(F.col("word"), buckets).alias("k")).agg(F.sum("n").alias("n")).collect():
        mass[clusters + r["k"]] = r["n"]
    total = int(mass.sum())
    for r in top:
        mass[clusters + r["word"] % 2**64 % buckets] -= r["n"]
    # the most frequent words, cut at a count so that they are at most `head`
    least, room = 0, head
    for r in sorted(counts.groupBy(level().alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True):
        room -= r["words"]
        if room < 0:
            least = r["level"] + 1
            break
    known = counts.where(level() >= least).toPandas().astype({"word": "int64", "n": "int64"})
    word = known["word"].to_numpy().view(U64)
    order = np.argsort(word)
    heads, seen = word[order], known["n"].to_numpy()[order]
    meet = bool(clusters and len(heads) and len(frequent))
    rows = located(docs, frequent, heads, buckets, meet)
    labels, leaf, trees = np.full(len(heads), -1, np.int64), np.full(len(heads), -1, np.int32), None
    if meet:
        near = company(rows)
        at, x = near[:, 0], near[:, 1:].astype(np.float32)
        length = np.linalg.norm(x, axis=1)
        good = (length > 0) & (seen[at] > 1)
        if good.any():
            at, x = at[good], x[good] / length[good, None]
            labels[at] = cluster(x, seen[at].astype(float), clusters)
            np.add.at(mass, labels[at], seen[at])
            np.subtract.at(mass, clusters + (heads[at] % U64(buckets)).astype(np.int64), seen[at])
            if branch:
                often = np.argsort(-seen[at], kind="stable")  # what frequent words need lies together in memory
                at, x = at[often], x[often]
                leaf[at] = np.arange(len(at))
                trees = grow(x, seen[at].astype(float), labels[at], min(branch, hidden + 1))
    size = len(frequent) + clusters + buckets
    model = Model(frequent, heads, seen, labels, mass, clusters, buckets, hidden, Network.fresh(size, hidden), trees, leaf, counts, least)
    if not rounds or not total:
        return model, rows
    codes = model.codes()
    packs = rows.where("near is null").select("rid", "places").mapInPandas(lambda frames: packed(frames, codes, size), "rows binary, salt long")
    packs = materialize(packs.withColumn("turn", F.pmod(F.xxhash64("salt"), F.lit(rounds))), codec="zstd")
    flat = train(packs, total, model.class_of_codes(), size, hidden, rate, group, rounds, trees)
    discard(packs)
    return Model(**{**vars(model), "flat": flat}), rows


def score(
    docs: DataFrame, words: int = WORDS, buckets: int = BUCKETS, hidden: int = HIDDEN, rate: int = RATE, group: int = GROUP, rounds: int = ROUNDS, head: int = HEAD, clusters: int = CLUSTERS, learn_from: DataFrame | None = None, branch: int = 0
) -> DataFrame:
    """doc_id, n_tokens, log_prob, score for every row of docs; counts, classes and network come from `learn_from` or, by default, from docs."""
    with brief_shuffles(docs.sparkSession):
        model, rows = fit(docs if learn_from is None else learn_from, words, buckets, hidden, rate, group, rounds, head, clusters, branch)
    return model.scored(rows) if learn_from is None else model.score(docs)

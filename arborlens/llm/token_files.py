"""Token ids in files of independently reset, checksummed blocks, coded by an adaptive context-mixing range coder.

A block holds the ids of whole documents, laid out in `lanes` runs side by side; coder and model go through all lanes
in step, so their work is vectorised, and nothing is carried from block to block. Per id the model mixes three
predictions: the id last seen after the same two ids (order 2), after the same id (order 1), and the frequencies of
all ids so far (order 0). The weights of the first two are the hit rates, kept up to date, of predictions of the same
confidence; order 0 has the rest. The mixture drives one arithmetic coding step per id (carry-less range coder, 48-bit
window, 24-bit words, one stream per lane).

A file is a Parquet table of such blocks in ascending order of doc_id: the documents are range-partitioned by id, every
partition writes its blocks in order. Reading checks every block's CRC-32 and refuses a damaged one.

Defined results: null texts are empty and hold the end id alone; rows without doc_id come first; repeated rows are
written as often as they come; other columns are ignored; an empty table gives no rows. Ids must be below 65,536.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_ids, groups_of_bytes, materialize
from .mixing import prefix_sums
from .tokens import GROUP, encoder

LANES, STEPS, TOKENS = 8192, 512, 4_000_000
MAGIC, HEAD = b"ACM1", "<4sQIIIIII"
WHOLE, ZERO, SLOTS2 = 24, 20, 18  # bits of the mixture, of order 0, of the order-2 table
WORD, TOP, WINDOW = 24, 1 << 24, (1 << 48) - 1


# by confidence and hit: the next confidence, in its place, and whether the guess stays
_sure, _hit = np.arange(32) // 2, np.arange(32) % 2
NEXT = np.where(_hit == 1, np.minimum(_sure + 1, 15), _sure >> 1) << 16
KEPT = (_hit == 1) | (_sure > 1)


class Damaged(ValueError):
    """A block whose checksum or layout is wrong."""


class Model:
    """The mixed prediction, the same on both sides; `spread` gives the spans, `learn` takes the ids of one step. All
    arrays have one place per lane; gathers are `take`, which numpy does several times faster than indexing."""

    def __init__(self, lanes: int, ids: int) -> None:
        self.lanes, self.ids = lanes, ids
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        # id, and confidence above it: the order-2 table, then the order-1 table
        self.seen = np.zeros((1 << SLOTS2) + (1 << 16), np.int32)
        self.key = np.zeros(2 * lanes, np.int64)
        self.hits = np.zeros((2, 32))  # per order: tries and hits by confidence
        self.count = np.zeros(ids, np.int64)
        self.pending: list[np.ndarray] = []
        self.step, self.next = 0, 1
        self._zero()
        self._weights()

    def _zero(self) -> None:
        total = self.count.sum()
        room = (1 << ZERO) - self.ids
        freq = 1 + (self.count * room // total if total else np.full(self.ids, room // self.ids))
        freq[0] += (1 << ZERO) - freq.sum()
        self.freq = freq
        self.place = (np.cumsum(freq) - freq) << 21 | freq  # start above size
        self.symbol = None

    def symbols(self) -> np.ndarray:
        if self.symbol is None:
            self.symbol = np.repeat(np.arange(self.ids, dtype=np.uint16), self.freq)
        return self.symbol

    def _weights(self) -> None:
        tries, hits = self.hits[:, 0::2], self.hits[:, 1::2]
        rate = (hits + 0.4) / (tries + hits + 2.0)
        whole = 1 << WHOLE
        self.weight2 = np.clip(rate[0] * whole * 0.97, 64, whole * 0.9).astype(np.int64)
        self.weight1 = np.clip(rate[1], 1e-6, 0.95)

    def spread(self) -> None:
        n = self.lanes
        key = self.key[:n]
        np.multiply(self.last, 0x2F0B4C47, out=key)
        key += self.before * 0x1E35A7BD
        key >>= 7
        key &= (1 << SLOTS2) - 1
        np.add(self.last, 1 << SLOTS2, out=self.key[n:])
        self.both = self.seen.take(self.key).astype(np.int64)  # the order-2 part, then the order-1 part
        self.sure, self.guess = self.both >> 16, self.both & 0xFFFF
        self.p2, self.p1, self.c2, self.c1 = self.guess[:n], self.guess[n:], self.sure[:n], self.sure[n:]
        self.a = self.weight2.take(self.c2)
        rest = ((1 << WHOLE) - (1 << ZERO) - self.a) * self.weight1.take(self.c1)
        self.b = self.a + rest.astype(np.int64)
        self.unit = ((1 << WHOLE) - self.b) >> ZERO

    def span(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of the ids in the mixture."""
        place = self.place.take(ids)
        start, size = (place >> 21) * self.unit, (place & 0x1FFFFF) * self.unit
        start += self.b
        self.twice = np.concatenate((ids, ids))
        self.hit = self.guess == self.twice
        self.two, self.one = self.hit[: self.lanes], self.hit[self.lanes :]
        np.copyto(start, self.a, where=self.one)
        np.copyto(size, self.b - self.a, where=self.one)
        np.copyto(start, 0, where=self.two)
        np.copyto(size, self.a, where=self.two)
        return start, size

    def find(self, slot: np.ndarray) -> np.ndarray:
        """The ids at these places of the mixture."""
        zero = (np.maximum(slot - self.b, 0) / self.unit).astype(np.int64)  # below 2^24: the quotient's floor is exact
        ids = self.symbols().take(zero, mode="clip").astype(np.int64)
        np.copyto(ids, self.p1, where=slot < self.b)
        np.copyto(ids, self.p2, where=slot < self.a)
        return ids

    def learn(self, ids: np.ndarray) -> None:
        """Takes the ids that `span` was asked for last."""
        state = self.sure * 2
        state += self.hit
        new = np.where(KEPT.take(state), self.guess, self.twice)
        new |= NEXT.take(state)
        self.seen.put(self.key, new, mode="clip")  # no key is outside; this mode alone does not look for any
        if self.step < 16 or not self.step % 8:
            self.hits *= 0.97
            n = self.lanes
            self.hits[0] += np.bincount(state[:n], minlength=32)
            self.hits[1] += np.bincount(state[n:][~self.two], minlength=32)
            self._weights()
        self.before, self.last = self.last, ids
        self.pending.append(ids)
        self.step += 1
        if self.step >= self.next:
            self.count += np.bincount(np.concatenate(self.pending), minlength=self.ids)
            self.pending = []
            self.next = self.step + min(self.step, 96)
            self._zero()


def encode_lanes(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(words per lane, all words as 3 bytes each) of ids (steps x lanes)."""
    steps, lanes = ids.shape
    model = Model(lanes, vocabulary)
    low, size = np.zeros(lanes, np.int64), np.full(lanes, (1 << 48) - 1, np.int64)
    every = np.arange(lanes)
    owners, words = [], []  # in the order of coding; the words of a lane are put together at the end

    def shift_out(k: np.ndarray, tops: np.ndarray) -> None:
        owners.append(k.astype(np.uint16))
        words.append(tops.astype("<u4"))

    for row in ids:
        row = row.astype(np.int64)
        model.spread()
        start, span = model.span(row)
        model.learn(row)
        size >>= WHOLE
        start *= size
        low += start
        size *= span
        _flush(low, size, shift_out)
    for shift in (WORD, 0):
        shift_out(every, (low >> shift) & 0xFFFFFF)
    owner = np.concatenate(owners)
    out = np.concatenate(words).take(np.argsort(owner, kind="stable"))  # short keys are sorted by radix
    return np.bincount(owner, minlength=lanes), out.view(np.uint8).reshape(-1, 4)[:, :3].ravel()


def _flush(low: np.ndarray, size: np.ndarray, shift_out) -> None:
    """Shift out words until every lane has room for a step; shift_out(lanes, top words). A lane without room whose top
    word is not settled yet gives up the part of its span beyond the next border."""
    lanes = np.flatnonzero(size < TOP)
    while len(lanes):
        own, span = low.take(lanes), size.take(lanes)
        open_ = (own ^ (own + span)) >= TOP
        if open_.any():
            np.copyto(span, -own & (TOP - 1), where=open_)
        shift_out(lanes, own >> WORD)
        own <<= WORD
        own &= WINDOW
        span <<= WORD
        low[lanes], size[lanes] = own, span
        lanes = lanes[span < TOP]


def decode_lanes(counts: np.ndarray, words: np.ndarray, steps: int, vocabulary: int) -> np.ndarray:
    lanes = len(counts)
    model = Model(lanes, vocabulary)
    low, size = np.zeros(lanes, np.int64), np.full(lanes, (1 << 48) - 1, np.int64)
    at = np.cumsum(counts) - counts
    wide = np.zeros((len(words) // 3 + 8, 4), np.uint8)
    wide[:-8, :3] = words.reshape(-1, 3)
    words = wide.view("<u4").ravel().astype(np.int64)
    code = (words[at] << WORD) | words[at + 1]
    at = at + 2
    out = np.empty((steps, lanes), np.uint16)

    def shift_in(k: np.ndarray, _: np.ndarray) -> None:
        own = at.take(k)
        code[k] = ((code.take(k) << WORD) & WINDOW) | words.take(own)
        at[k] = own + 1

    for t in range(steps):
        model.spread()
        size >>= WHOLE
        slot = (((code - low) & WINDOW) / size).astype(np.int64)  # both below 2^48: the floor is exact below 2^24
        np.minimum(slot, (1 << WHOLE) - 1, out=slot)
        ids = model.find(slot)
        start, span = model.span(ids)
        model.learn(ids)
        out[t] = ids
        start *= size
        low += start
        size *= span
        _flush(low, size, shift_in)
    return out


def write_block(doc_ids: list[int | None], documents: list[np.ndarray], vocabulary: int) -> bytes:
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint16)
    lanes = int(min(LANES, max(1, -(-len(ids) // STEPS))))
    steps = -(-len(ids) // lanes)
    laid = np.zeros(lanes * steps, np.uint16)
    laid[: len(ids)] = ids
    counts, words = encode_lanes(np.ascontiguousarray(laid.reshape(lanes, steps).T), vocabulary)
    keys = zlib.compress(np.array([0 if k is None else k for k in doc_ids], "<i8").tobytes() + np.array([k is None for k in doc_ids], "<u1").tobytes(), 1)
    lengths = zlib.compress(np.array([len(d) for d in documents], "<u4").tobytes(), 1)
    sizes = zlib.compress(counts.astype("<u4").tobytes(), 1)
    head = struct.pack(HEAD, MAGIC, len(ids), lanes, vocabulary, len(documents), len(keys), len(lengths), len(sizes))
    body = head + keys + lengths + sizes + words.tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(block: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    if len(block) < struct.calcsize(HEAD) + 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise Damaged("checksum of a token block does not match")
    magic, n, lanes, vocabulary, docs, k, m, s = struct.unpack_from(HEAD, block)
    if magic != MAGIC:
        raise Damaged("not a token block")
    at = struct.calcsize(HEAD)
    keys, lengths, sizes = zlib.decompress(block[at : at + k]), zlib.decompress(block[at + k : at + k + m]), zlib.decompress(block[at + k + m : at + k + m + s])
    words = np.frombuffer(block[at + k + m + s : -4], np.uint8)
    own, none = np.frombuffer(keys[: 8 * docs], "<i8"), np.frombuffer(keys[8 * docs :], "<u1")
    ids = decode_lanes(np.frombuffer(sizes, "<u4").astype(np.int64), words, -(-n // lanes), vocabulary).T.reshape(-1)[:n]
    ends = np.cumsum(np.frombuffer(lengths, "<u4"), dtype=np.int64)
    return [None if x else int(i) for i, x in zip(own, none, strict=True)], np.split(ids, ends[:-1]) if docs else []


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, block: int = TOKENS) -> DataFrame:
    """The written files as (part, number, tokens, block): read back from the shared folder."""
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(tokenizer)
        vocabulary = max(end_id + 1, own.library.get_vocab_size())
        keys, held, size, number, part = [], [], 0, 0, 0

        def out() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "number": [number], "tokens": [size], "block": [write_block(keys, held, vocabulary)]})

        for frame in frames:
            texts = [t or "" for t in frame["text"]]
            for low, high in groups_of_bytes(map(len, texts), GROUP):
                rows = frame.iloc[low:high]
                for part, doc_id, ids in zip(rows["part"], rows["doc_id"], own.all_ids(texts[low:high]), strict=True):
                    keys.append(None if pd.isna(doc_id) else int(doc_id))
                    held.append(np.append(ids, np.uint16(end_id)))
                    size += len(held[-1])
                    if size >= block:
                        yield out()
                        keys, held, size, number = [], [], 0, number + 1
        if held:
            yield out()

    return materialize(rows.mapInPandas(write, "part int, number int, tokens long, block binary"))


def read_token_files(files: DataFrame) -> DataFrame:
    """part, number, doc_id, start (within the block), n_tokens, ids_crc32 of every document in the files."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, number, block in zip(frame["part"], frame["number"], frame["block"], strict=True):
                keys, documents = read_block(bytes(block))
                n = np.array([len(d) for d in documents], np.int64)
                out = pd.DataFrame({"part": np.int32(part), "number": np.int32(number), "doc_id": pd.array(keys, "Int64"), "start": np.cumsum(n) - n, "n_tokens": n})
                yield out.assign(ids_crc32=[crc32_ids(d) for d in documents])

    return files.select("part", "number", "block").mapInPandas(read, "part int, number int, doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as the files give them back."""
    files = write_token_files(docs, tokenizer, end_id)
    base = prefix_sums(files.select("part", "number", "tokens"), [], [F.col("part").asc(), F.col("number").asc()], {"base": F.col("tokens")}).drop("tokens")
    read = read_token_files(files).join(base, ["part", "number"])
    return read.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")

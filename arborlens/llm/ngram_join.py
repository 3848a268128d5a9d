"""N-gram Jaccard self-join by vertical partitioning.

The global order of shingles (their hash) is cut into fragments. Every document's set is cut with it, so a fragment
holds all occurrences of its shingles and can tell which are shared by several distinct sets. Only shared shingles can
lie in an intersection: the fragments' partial counts are summed per set, and a set whose shared part is below the
threshold leaves. Pairs of what remains come from the rarest shared shingles (prefix filter, with size and position
filters; exact for any global order). A pair's overlap is counted apart in each of a few wide fragments and summed.

Components need no pair inside a component that is known already. So every shingle's sets are first compared with one of
them, at first the one whose shingles are most widely shared (hub rounds, linear in the sets), components are drawn, and rounds go on with other hubs while many pairs across
components are left; then all pairs that are left are compared.

Defined results: equal sets are one class, collapsed before any join (a group of copies is never expanded); texts
without words, empty and null texts have an empty set and link with nothing; texts with fewer than `width` words have
their whole sequence as single shingle; rows without doc_id take no part; rows that repeat a doc_id are kept as rows
of their own and share a component if their sets link; other columns of the input are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, batches_of_texts, connected_components, discard, join_spread, materialize, mix, release, text_bytes, word_hashes

#: Shingles in a fragment, about, once FRAGMENTS of them are full (a set has a row in each fragment); wide fragments in
#: which pairs are counted; hub rounds at most; sets of one shingle that one task pairs; places of a hub's pairs.
FRAGMENT, FRAGMENTS, WIDE, ROUNDS, BLOCK, SALTS = 2_000_000, 64, 8, 1, 512, 256


def shingles(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash), distinct per text, ordered by text and hash."""
    doc, word = word_hashes(texts)
    if not len(doc):
        return doc, word
    factor = mix(np.arange(1, width + 1, dtype=U64) * U64(0xD1B54A32D192ED03)) | U64(1)
    count = np.bincount(doc, minlength=len(texts))
    full = doc[: -width + 1] == doc[width - 1 :] if width > 1 else np.ones(len(doc), bool)
    at = np.flatnonzero(full) if len(doc) >= width else np.zeros(0, np.int64)
    value = np.zeros(len(at), U64)
    for k in range(width):
        value += word[at + k] * factor[k]
    docs = doc[at]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.searchsorted(doc, short)
        tail = np.full(len(short), 0x5851F42D4C957F2D, U64) * count[short].astype(U64)
        for k in range(width - 1):
            has = count[short] > k
            tail[has] += word[first[has] + k] * factor[k]
        docs, value = np.concatenate((docs, short)), np.concatenate((value, tail))
    value = mix(value)
    order = np.lexsort((value, docs))
    docs, value = docs[order], value[order]
    keep = np.ones(len(docs), bool)
    keep[1:] = (docs[1:] != docs[:-1]) | (value[1:] != value[:-1])
    return docs[keep], value[keep]


def _cut(frames: Iterator[pd.DataFrame], fragments: int, width: int) -> Iterator[pd.DataFrame]:
    """One row per chunk of texts and fragment: the sets' fingerprints and sizes, the length of each set's part, and the
    low 48 bits of its shingles. Rows of negative fragment carry doc_id, fingerprint and size of every text."""
    serial = 0
    for frame in frames:
        for low, high in batches_of_texts(frame):
            part = frame.iloc[low:high]
            texts, n = list(part["raw"]), high - low
            doc, value = shingles(texts, width)
            size = np.bincount(doc, minlength=n).astype(np.int64)
            # a commutative 64-bit fingerprint of the set
            print_ = np.zeros(n, U64)
            np.add.at(print_, doc, mix(value ^ U64(0xA0761D6478BD642F)))
            print_ = mix(print_ + size.astype(U64) * U64(0xE7037ED1A0B428DB)).view(np.int64)
            place = (value >> U64(40)).astype(np.int64) * fragments >> 24
            order = np.argsort(place * n + doc, kind="stable")
            place, doc = place[order], doc[order]
            low48 = value[order].view(np.uint8).reshape(-1, 8)[:, :6]
            bounds = np.searchsorted(place, np.arange(fragments + 1))
            rows = [(-1 - serial % fragments, part["doc_id"].to_numpy(np.int64).tobytes(), print_.tobytes(), size.tobytes(), b"")]
            for f in np.flatnonzero(np.diff(bounds)):
                a, b = bounds[f], bounds[f + 1]
                count = np.bincount(doc[a:b], minlength=n)
                own = np.flatnonzero(count)
                rows.append((int(f), print_[own].tobytes(), size[own].astype(np.int32).tobytes(), count[own].astype(np.int32).tobytes(), low48[a:b].tobytes()))
            serial += 1
            yield pd.DataFrame(rows, columns=["fragment", "keys", "sizes", "counts", "body"])
    release()


CUT = "fragment int, keys binary, sizes binary, counts binary, body binary"
SHARED = "fragment int, doc_id long, fp long, n long, k int, weight long, toks array<long>, df array<int>"


def _pick(fragment: int, rows: list[tuple]) -> Iterator[pd.DataFrame]:
    """The shared part of every set in one whole fragment, with the number of distinct sets that hold each shingle.
    Shingles are numbered within the fragment, which stands above the number."""
    fp = np.concatenate([np.frombuffer(r[0], np.int64) for r in rows])
    size = np.concatenate([np.frombuffer(r[1], np.int32) for r in rows])
    count = np.concatenate([np.frombuffer(r[2], np.int32) for r in rows])
    body = np.concatenate([np.frombuffer(r[3], np.uint8) for r in rows]).reshape(-1, 6)
    rows.clear()
    # of equal sets one stays
    fps, first = np.unique(fp, return_index=True)
    stays = np.zeros(len(fp), bool)
    stays[first] = True
    body = body[np.repeat(stays, count)]
    fp, size, count = fp[stays], size[stays], count[stays]
    wide = np.zeros((len(body), 8), np.uint8)
    wide[:, :6] = body
    del body
    key = wide.view(np.int64).ravel()
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    del key, wide
    starts = np.flatnonzero(new)
    number = (np.cumsum(new) - 1).astype(np.int32)
    df_of = np.diff(np.append(starts, len(number))).astype(np.int32)
    tok = np.empty(len(order), np.int32)
    tok[order] = number
    del order, number, new
    own = np.repeat(np.arange(len(fp), dtype=np.int32), count)
    df = df_of[tok]
    hit = df > 1
    tok, df, own = tok[hit].astype(np.int64), df[hit], own[hit]
    del hit
    left = np.flatnonzero(np.bincount(own, minlength=len(fp)))
    at = np.append(np.searchsorted(own, left), len(own))
    tok |= np.int64(fragment) << np.int64(32)
    for a in range(0, len(left), 20_000):
        b = min(len(left), a + 20_000)
        lo, cuts = at[a], at[a + 1 : b]
        part = left[a:b]
        yield pd.DataFrame({"fragment": np.int32(fragment), "doc_id": None, "fp": fp[part], "n": size[part].astype(np.int64), "k": np.diff(at[a : b + 1]).astype(np.int32), "weight": np.add.reduceat(df[lo : at[b]], at[a:b] - lo, dtype=np.int64), "toks": np.split(tok[lo : at[b]], cuts - lo), "df": np.split(df[lo : at[b]], cuts - lo)})


def _share(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, rows = None, []
    for frame in frames:
        for fragment, keys, sizes, counts, body in frame.itertuples(index=False):
            if fragment < 0:
                yield pd.DataFrame({"fragment": np.int32(fragment), "doc_id": np.frombuffer(keys, np.int64), "fp": np.frombuffer(sizes, np.int64), "n": np.frombuffer(counts, np.int64), "k": None, "weight": None, "toks": None, "df": None})
                continue
            if fragment != now and rows:
                yield from _pick(now, rows)
                rows = []
            now = fragment
            rows.append((keys, sizes, counts, body))
    if rows:
        yield from _pick(now, rows)
    release()


def count_pairs(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """(a, b) of the distinct pairs (a, b, need) whose overlap is at least `need`: counted per wide fragment, summed per
    pair. b may be a hub of any number of pairs: its pairs are dealt to SALTS places, and its parts go to those in use."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    theirs = salted.select("b", "salt").distinct().join(wide.select(F.col("fp").alias("b"), "part", F.col("toks").alias("other")), "b")
    mine = salted.join(wide.select(F.col("fp").alias("a"), "part", "toks"), "a")
    partial = mine.join(theirs, ["b", "salt", "part"]).select("a", "b", "need", F.size(F.array_intersect("toks", "other")).alias("k"))
    return partial.groupBy("a", "b").agg(F.sum("k").alias("k"), F.first("need").alias("need")).where("k >= need").select("a", "b")


def _fits(percent: int):
    """Size and position filters of a pair with columns of a and of b: n (whole size), s (shared shingles) and at (place
    of their common shingle among these, from 0). The pair's first common shingle passes whenever the pair can link."""
    room = F.least(F.col("s_a") - F.col("at_a"), F.col("s_b") - F.col("at_b"))  # with the common shingle itself
    return (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (room >= F.col("need"))


def _need(percent: int):
    """Least overlap with which sets of these sizes link."""
    return F.ceil((F.col("n_a") + F.col("n_b")) * percent / F.lit(100 + percent)).cast("long")


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80, fragment: int = FRAGMENT, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs with a doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("raw")).where("doc_id is not null")
    chars = docs.agg(F.sum(F.length("raw"))).first()[0] or 0
    fragments = int(max(FRAGMENTS, -(-chars // (7 * fragment))))
    tasks = min(fragments, max(512, fragments // 8))
    cut = docs.mapInPandas(lambda frames: _cut(frames, fragments, width), CUT)
    dealt = cut.repartitionById(tasks, F.pmod(F.col("fragment"), F.lit(tasks))).sortWithinPartitions("fragment")
    parts = materialize(dealt.mapInPandas(_share, SHARED))
    sets = parts.where("fragment < 0").select("doc_id", "fp", "n")

    # partial counts, summed per set: a set of n shingles needs percent * n / 100 shared ones to link at all
    least = F.ceil(F.col("n") * percent / F.lit(100)).cast("int")
    sizes = parts.where("fragment >= 0").groupBy("fp").agg(F.first("n").alias("n"), F.sum("k").cast("int").alias("s"), F.sum("weight").alias("weight"))
    # how many sets hold a shingle of the set, on average: of near copies, those nearest to what all share have most
    able = materialize(sizes.where(F.col("s") >= least).select("fp", "n", "s", (F.col("s") - least + 1).alias("prefix"), (F.col("weight") / F.col("n")).alias("central")))
    rows = parts.where("fragment >= 0").select("fp", "fragment", "toks", "df").join(able, "fp")
    rare = rows.groupBy("fp", "n", "s", "prefix", "central").agg(F.flatten(F.collect_list(F.arrays_zip("df", "toks"))).alias("own"))
    rare = rare.select("fp", "n", "s", "central", F.posexplode(F.slice(F.array_sort("own"), F.lit(1), F.col("prefix"))).alias("at", "t")).select("fp", "n", "s", "central", "at", F.col("t.toks").alias("tok"))
    rare = materialize(rare)
    several = rare.groupBy("tok").agg(F.count("*").alias("k")).where("k > 1")
    total = rare.count()
    open_ = materialize(join_spread(rare, several, "tok", "k", total).select("tok", "fp", "n", "s", "central", "at"))
    part = F.floor(F.col("fragment").cast("long") * WIDE / F.lit(fragments)).cast("int")
    wide = rows.join(open_.select("fp").distinct(), "fp", "left_semi")
    wide = materialize(wide.groupBy("fp", part.alias("part")).agg(F.flatten(F.collect_list("toks")).alias("toks")))
    discard(rare, able)

    side = lambda df, x, *more: df.select("tok", *more, *(F.col(c).alias(f"{c}_{x}") for c in ("fp", "n", "s", "at", "c")))
    fitting = lambda met: met.where("c_a <> c_b").withColumn("need", _need(percent)).where(_fits(percent)).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"), "need")
    joined = None
    total = open_.count()
    for turn in range(rounds + 1):
        if joined is None:
            placed = open_.withColumn("c", F.col("fp"))
        else:
            placed = materialize(open_.join(joined, F.col("fp") == F.col("node"), "left").select(*open_.columns, F.coalesce("component", "fp").alias("c")))
            # a shingle with sets of k components has k * (k - 1) / 2 pairs of components to compare, at the least
            groups = placed.groupBy("tok", "c").agg(F.count("*").alias("k")).groupBy("tok").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("same"))
            left = groups.agg(F.sum((F.col("k") * F.col("k") - F.col("same")) / 2)).first()[0] or 0
            if not left:
                break
        if turn < rounds and (joined is None or left > total):
            hub = F.min_by(F.struct("fp", "n", "s", "at", "c"), F.struct(F.xxhash64("fp", F.lit(turn)) if turn else -F.col("central"), "fp"))
            hubs = placed.groupBy("tok").agg(hub.alias("h"), F.count("*").alias("k"))
            hubs = hubs.select("tok", "k", *(F.col(f"h.{c}").alias(f"{c}_b") for c in ("fp", "n", "s", "at", "c")))
            met, last = join_spread(side(placed, "a"), hubs, "tok", "k", total), False
        else:
            # every two blocks of a shingle's sets meet once
            many = placed.groupBy("tok").agg(F.count("*").alias("k"), F.count_distinct("c").alias("kinds")).where("kinds > 1").select("tok", "k")
            cut_ = join_spread(placed, many, "tok", "k", total).withColumn("cuts", F.ceil(F.col("k") / F.lit(block)).cast("int"))
            cut_ = cut_.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
            first = side(cut_.where("own <= other").withColumnRenamed("own", "i").withColumnRenamed("other", "j"), "a", "i", "j")
            second = side(cut_.where("own >= other").withColumnRenamed("own", "j").withColumnRenamed("other", "i"), "b", "i", "j")
            met, last = first.join(second, ["tok", "i", "j"]).where("i < j or fp_a < fp_b"), True
        pairs = materialize(fitting(met).distinct())
        links = count_pairs(pairs, wide)
        if joined is not None:
            links = links.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b")))
        joined = connected_components(links)
        discard(pairs, placed)
        if last:
            break

    # equal sets are one class; its least doc_id stands for it
    classes = materialize(sets.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("k")))
    moved = materialize(classes.join(joined, classes["fp"] == joined["node"]).select("fp", "low", "component"))
    groups = moved.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("k"))
    moved = join_spread(moved, groups, "component", "k", total).select("fp", "component_id")
    labels = materialize(classes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"), "k"))
    out = join_spread(sets, labels, "fp", "k", sets.count(), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))

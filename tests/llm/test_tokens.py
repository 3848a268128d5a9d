import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arborlens.llm import tokens
from arborlens.llm.packing import cut, intervals, pack_documents, plan
from arborlens.llm.token_files import Damaged, read_block, token_file_digest, write_block
from arborlens.llm.tokens import Encoder, encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abzABÉßñ'.,! \n\t0123 \u0085　\x1će<|>endoftext")), max_size=60))
def test_memo_gives_the_library_ids(text):
    for path, library in LIBRARY.items():
        assert encoder(path).ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_block_round_trip_and_damage():
    draw = np.random.default_rng(1)
    for n in (0, 1, 3, 5000):
        docs = [draw.zipf(1.3, k).clip(0, 49_000).astype(np.uint16) for k in draw.integers(1, 40, n // 20 + 1 if n else 0)]
        block = write_block([None if k == 1 else k for k in range(len(docs))], docs, 49_408)
        keys, back = read_block(block)
        assert keys == [None if k == 1 else k for k in range(len(docs))]
        assert all(np.array_equal(a, b) for a, b in zip(docs, back, strict=True))
    broken = bytearray(block)
    broken[len(broken) // 2] ^= 1
    with pytest.raises(Damaged):
        read_block(bytes(broken))


def test_block_of_all_lanes_round_trips():
    draw = np.random.default_rng(2)
    docs = [draw.zipf(1.2, 70_000).clip(0, 49_000).astype(np.uint16) for _ in range(60)]
    keys, back = read_block(write_block(list(range(60)), docs, 49_408))
    assert keys == list(range(60)) and all(np.array_equal(a, b) for a, b in zip(docs, back, strict=True))


def texts(seed=2):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdeé", k=draw.randint(1, 7))) for _ in range(300)]
    rows = [(k, " ".join(draw.choices(words, k=draw.choice((1, 20, 300, 3000)))) + ".") for k in range(60)]
    return [*rows, (60, None), (61, ""), (62, rows[3][1]), (62, rows[3][1])]


def test_token_files_digest(spark):
    rows = texts()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("start", F.lit(1))
    got = sorted(tuple(r) for r in token_file_digest(frame.repartition(5), WORD).collect())
    want, at = [], 0
    for i, text in rows:
        ids = [*LIBRARY[WORD].encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)
    assert token_file_digest(frame.limit(0), WORD).count() == 0


def test_cut():
    assert cut(1, 4) == [(0, 1)]
    assert cut(4, 4) == [(0, 4)]
    assert cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_plan_uses_every_length_and_comes_near_the_bound():
    draw = np.random.default_rng(4)
    lengths = np.concatenate((draw.integers(1, 1024, 20_000), np.full(9_000, 700), np.full(100, 1024)))
    count = dict(zip(*(v.tolist() for v in np.unique(lengths, return_counts=True)), strict=True))
    planned = plan(count, 1024)
    used: dict[int, int] = {}
    for p, n in planned:
        assert sum(p) <= 1024 and n > 0
        for k in p:
            used[k] = used.get(k, 0) + n
    assert used == count
    sequences = sum(n for _, n in planned)
    # 9,000 pieces of 700 leave room only for shorter ones
    assert sequences <= 1.01 * max(-(-lengths.sum() // 1024), int((lengths > 512).sum()))
    assert len(intervals(planned)) < 8000


def test_pack_documents(spark):
    rows = texts()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash"))
    got = pack_documents(frame.repartition(4), BYTE, capacity=256).collect()
    pieces: dict[tuple[int, int], list] = {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["piece"]), []).append(r)
    for i, text in rows:
        ids = [*LIBRARY[BYTE].encode(text or "", add_special_tokens=False).ids, 2]
        for k, (at, n) in enumerate(cut(len(ids), 256)):
            for r in pieces[i, k]:
                assert (r["start"], r["length"], r["ids_crc32"]) == (at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()))
    assert len(got) == sum(len(cut(len(LIBRARY[BYTE].encode(t or "", add_special_tokens=False).ids) + 1, 256)) for _, t in rows)
    sequences: dict[int, list] = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    assert pack_documents(frame.limit(0), BYTE).count() == 0


def test_a_word_is_encoded_once_whatever_its_capitals_and_punctuation(monkeypatch):
    own = Encoder(WORD)
    asked = []
    monkeypatch.setattr(own, "word", lambda word, lead, known=own.word: asked.append(word) or known(word, lead))
    got = own.all_ids(["Kalor, kalor KALOR.\nkalor; mild", "", "«kalor» (Mild) mild!? Ärger ärger-", "  \t kalor\n\n", "١٢ ǅ ÅÉ... ...", "x" * 100 + " " + "X" * 100])
    want = ["Kalor, kalor KALOR.\nkalor; mild", "", "«kalor» (Mild) mild!? Ärger ärger-", "  \t kalor\n\n", "١٢ ǅ ÅÉ... ...", "x" * 100 + " " + "X" * 100]
    assert [g.tolist() for g in got] == [LIBRARY[WORD].encode(t, add_special_tokens=False).ids for t in want]
    assert sorted(asked) == sorted(set(asked)) and {"kalor", "mild", "ärger"} <= set(asked)


def test_groups_of_texts_give_the_library_ids(monkeypatch):
    monkeypatch.setattr(tokens, "GROUP", 50)
    own, rows = Encoder(WORD), [t or "" for _, t in texts()]
    assert [g.tolist() for g in own.all_ids(rows)] == [LIBRARY[WORD].encode(t, add_special_tokens=False).ids for t in rows]
    assert own.all_ids([]) == []


def test_every_letter_of_the_fast_path_gives_the_library_ids():
    letters = [chr(c) for c in range(0xC0, 0x250)]
    text = " ".join(w for c in letters for w in (c, f"{c}stanbul", f"a{c}b", f"x{c},"))
    for path, library in LIBRARY.items():
        assert encoder(path).ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert encoder(WORD).ids("İstanbul").tolist() == LIBRARY[WORD].encode("İstanbul", add_special_tokens=False).ids

import binascii
import random
import struct

import numpy as np
import pytest
from helpers import documents
from pyspark.sql import functions as F

from beleg.llm import packing

TEXTS = [
    "", "One two  three\n\nfour.", " lead and trail ", "a\tb\n c\n\n\n d\xa0e  f", "it's they'll\n've 12 345 x1", "\n\n\n", "   ", "é̀ 漢字 かな 한글\n漢字",
    "word" * 400, "x\x1cy \x85z", "end.\nNext line\nand 9\n9", "a \nb\n c", "\r\nwin\r\nlines\r\n", "😀 😀😀\n😀",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_words_encode_like_the_whole_text(tokenizer):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choices(["a", "Bc", "é", "1", "22", ".", "'s", "'", " ", "  ", "\n", "\t", "　", "\xa0", "字"], k=rng.randint(1, 60))) for _ in range(3000)]
    found = list(packing.Encoder(packing.default_tokenizer())(texts))
    for text, ids in zip(texts, found):
        assert "".join(" ".join([head, *rest]) for head, rest in packing.lines_of(text)) == text
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("words,chars", [(5, 1 << 20), (1 << 20, 40), (1 << 20, 1 << 20)])
def test_words_are_forgotten(monkeypatch, tokenizer, words, chars):
    monkeypatch.setattr(packing, "CACHED_WORDS", words)
    monkeypatch.setattr(packing, "CACHED_CHARS", chars)
    monkeypatch.setattr(packing, "BATCH_CHARS", 10)
    encoder = packing.Encoder(packing.default_tokenizer())
    texts = [*TEXTS, None, " ".join(f"w{i}" for i in range(70_000)), " ".join("x" * i for i in range(1, 300))] * 2
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder(texts)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def plain_best_fit(lengths, window):
    """The tightest open window by looking at all of them."""
    rooms, loads = [], []
    for length in lengths:
        fitting = [(room, k) for k, room in enumerate(rooms) if room >= length]
        if fitting:
            room, k = min(fitting)
            rooms[k] -= length
        else:
            rooms.append(window - length)
    return sorted(rooms)


@pytest.mark.parametrize("window", [1, 7, 8, 64, 1024])
def test_best_fit_equals_a_search_of_all_windows(window):
    rng = random.Random(window)
    for _ in range(20):
        lengths = sorted((rng.randint(1, window) for _ in range(rng.randint(0, 200))), reverse=True)
        numbers, offsets = packing.best_fit(lengths, window)
        rooms = {}
        for n, offset, length in zip(numbers, offsets, lengths):
            assert offset == window - rooms.get(n, window) and offset + length <= window
            rooms[n] = window - offset - length
        assert sorted(rooms.values()) == plain_best_fit(lengths, window)


def test_every_id_lies_in_one_piece_and_sequences_are_gapless(spark, tokenizer):
    rng = random.Random(5)
    texts = TEXTS + [None] + [" ".join(rng.choices(["alpha", "Beta", "größe", "12", "naïve"], k=rng.randint(1, 3000))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "copy"), (3, "copy"), (None, "no id"), (None, None)]
    docs = documents(spark, rows).withColumn("start", F.lit("clash")).withColumn("ids", F.lit(1)).repartition(3)
    out = packing.pack(docs, group_tokens=5000).collect()
    sequences, pieces = {}, {}
    for r in out:
        ids = list(struct.unpack(f"<{r['length']}I", r["ids"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    expected = {}
    for i, text in rows:
        ids = ids_of(tokenizer, text)
        expected.setdefault((i, len(ids)), []).extend((s, ids[s:s + 1024]) for s in range(0, len(ids), 1024))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in expected.items()}


def test_query_rows_equal_pieces(spark, tokenizer):
    rows = [(1, "word " * 2500), (2, None), (3, "short"), (4, "x")]
    got = {(r["doc_id"], r["start"]): r for r in packing.judge(documents(spark, rows)).collect()}
    for i, text in rows:
        ids = ids_of(tokenizer, text)
        for s in range(0, len(ids), 1024):
            r, part = got.pop((i, s)), ids[s:s + 1024]
            assert (r["length"], r["doc_tokens"], r["ids_crc32"]) == (len(part), len(ids), binascii.crc32(struct.pack(f"<{len(part)}I", *part)))
    assert not got


def test_groups_are_packed_tightly_and_sequences_put_together(spark):
    rng = random.Random(9)
    docs = documents(spark, [" ".join(rng.choices(["tree", "house", "river"], k=rng.randint(1, 900))) for _ in range(400)])
    cut = packing.cut_lineage(packing.pieces(docs), "pieces")
    placed = packing.cut_lineage(packing.place(cut), "placed")
    sequences = packing.sequences(placed).collect()
    used = sum(r["n_tokens"] for r in sequences)
    size = sum(len(r["ids"]) // 4 for r in sequences)
    assert used == placed.agg(F.sum("length")).first()[0] and used / size > 0.97
    for r in sequences:
        n = r["n_tokens"]
        assert len(r["ids"]) == 4 * (n if n & (n - 1) == 0 else 1024)
    whole = {}
    for r in sequences:
        for d in r["documents"]:
            whole.setdefault(d["doc_id"], {})[d["start"]] = bytes(r["ids"])[4 * d["offset"]:4 * (d["offset"] + d["length"])]
    encoder = packing.Encoder(packing.default_tokenizer())
    rows = docs.collect()
    for r, ids in zip(rows, encoder([r["text"] for r in rows])):
        assert b"".join(whole[r["doc_id"]][s] for s in sorted(whole[r["doc_id"]])) == ids + b"\0\0\0\0"


def test_empty_table_and_one_hot_key(spark):
    empty = documents(spark, [])
    assert packing.judge(empty).count() == 0
    assert packing.sequences(packing.pack(empty)).count() == 0
    hot = packing.pack(documents(spark, [(7, "same words again")] * 500), group_tokens=200)
    assert hot.select("sequence_id", "offset").distinct().count() == 500

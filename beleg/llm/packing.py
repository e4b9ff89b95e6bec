"""Packing documents into sequences of one length by best-fit decreasing.

A document's ids (a byte-level BPE without special tokens, then one end id) are cut into full windows, each a sequence of its
own, and a tail. Tails are dealt to groups of about ``group_tokens`` ids; in each group they are placed longest first into the
open window with the least room that holds them. A segment tree over the remaining capacities finds that window in
log2(window) steps. Ids travel in the pieces only; what is planned are lengths.

Ids are found word by word: a text is cut after words, where the tokenizer's own splitting always cuts, so words met before need
no second encoding and no text is held as one encoding, however long. Words that are new are encoded many at a time.

Groups are dealt by a hash of the place in the pieces table, not by a column, so no key makes a group large: their number
follows the ids of all tails. The pieces table is written before it is planned, so places stay as they are when an executor
is lost.

Defined results: a null or empty text is its end id alone. Repeated rows, and rows with equal or null doc_id, are packed one by
one. Ties of length go by place in the pieces table; which of several equally long pieces meet in a sequence depends on how the
table was split. Sequence ids are unique, not gapless. Special tokens written out in a text are what the tokenizer file makes
of them. An empty table gives an empty result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from beleg.llm.tables import cut_lineage

WINDOW = 1024
END_ID = 0
GROUP_TOKENS = 1 << 22
CACHED_WORDS = 1 << 19  # a worker forgets all words once it has more, or more characters of them
CACHED_CHARS = 1 << 24
BATCH_CHARS = 1 << 20
BATCH_BYTES = 1 << 22  # of ids that leave a task at a time

# White space that is not one space or line feed between two other characters.
_ODD = re.compile(r"(^\s+|\s+\Z|\s\s+|[^\S \n])")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def lines_of(text: str) -> list[tuple[str, list[str]]]:
    """The text as heads and the words that follow them, each after one space: what is encoded on its own, one after another.

    A head is the first word of the text or of a line with the white space before it.
    """
    if " ".join(text.split()) == text.replace("\n", " "):  # no other white space, and none at the ends
        runs = ["", text]
    else:
        runs = ["", *_ODD.split(text)]
        if not runs[1]:  # the text begins with white space
            runs = runs[2:]
    out = []
    for run, regular in zip(runs[::2], runs[1::2]):
        for k, line in enumerate(regular.split("\n")):
            first, *rest = line.split(" ")
            out.append((("\n" if k else run) + first, rest))
    return out


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit numbers; remembers the ids of words by number until they are too many."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.forget()

    def forget(self) -> None:
        number = count().__next__
        self.words: defaultdict[str, int] = defaultdict(number)  # words after a space
        self.heads: defaultdict[str, int] = defaultdict(number)
        self.chars = 0
        self.sizes, self.ids, self.used = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 17, dtype="<u4"), 0
        self.begins = np.zeros_like(self.sizes)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4") for x in found]

    def _encode_words(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, sizes): many words are one text; only their first ids begin with a space."""
        for at in range(0, len(words), 200):
            some = words[at:at + 200]
            ids = self._encode([" " + " ".join(some)])[0]
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(some):
                yield ids, np.diff(starts, append=len(ids))
            else:
                found = self._encode([" " + w for w in some])
                yield np.concatenate(found), np.array([len(x) for x in found])

    def _learn(self, numbers: list[int], parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        """Keep the ids of new words, whose numbers are given in the same order."""
        at = 0
        for ids, sizes in parts:
            mine = np.array(numbers[at:at + len(sizes)])
            at += len(sizes)
            if mine.max() >= len(self.sizes):
                self.sizes, self.begins = (np.concatenate([x, np.zeros(max(len(x), int(mine.max())), dtype=x.dtype)]) for x in (self.sizes, self.begins))
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), dtype="<u4")])
            self.sizes[mine], self.begins[mine] = sizes, self.used + np.cumsum(sizes) - sizes
            self.ids[self.used:self.used + len(ids)] = ids
            self.used += len(ids)

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            if len(self.words) + len(self.heads) > CACHED_WORDS or self.chars > CACHED_CHARS:
                self.forget()
            n_words, n_heads, size, numbers, ends = len(self.words), len(self.heads), 0, [], []
            word, head = self.words.__getitem__, self.heads.__getitem__  # what is new gets the next number
            while at < len(texts) and (not ends or size < BATCH_CHARS):
                for first, rest in lines_of(texts[at]) if texts[at] else ():
                    numbers.append(head(first))
                    numbers.extend(map(word, rest))
                size += len(texts[at] or "")
                ends.append(len(numbers))
                at += 1
            for known, before in ((self.words, n_words), (self.heads, n_heads)):
                new = list(islice(reversed(known.items()), len(known) - before))
                if new:
                    self.chars += sum(len(w) for w, _ in new)
                    spelled = [w for w, _ in new]
                    found = self._encode_words(spelled) if known is self.words else ((x, np.array([len(x)])) for x in self._encode(spelled))
                    self._learn([k for _, k in new], found)
            used = np.array(numbers, dtype=np.int64)
            sizes = self.sizes[used]
            upto = np.concatenate([[0], np.cumsum(sizes)])
            ids = self.ids[np.repeat(self.begins[used] - upto[:-1], sizes) + np.arange(upto[-1])].tobytes()
            cuts = [0, *(4 * upto[ends]).tolist()]
            yield from (ids[a:b] for a, b in zip(cuts, cuts[1:]))


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker: it is kept from task to task."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, part, at): the windows and the tail of every document.

    ids are little-endian unsigned 32-bit numbers. part is the task, at counts its full windows and its tails, each from 0.
    tokenizer is a file that every executor has.
    """
    path = tokenizer or default_tokenizer()
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)]).add("start", "long").add("length", "long").add("doc_tokens", "long").add("ids", "binary").add("part", "long").add("at", "long")
    target, end = to_arrow_schema(schema), np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_full, n_tails = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            rows: list[tuple] = []
            size = 0

            def out() -> pa.RecordBatch:
                columns = list(zip(*rows)) or [[]] * 7
                ids_of = batch.column(0).take(pa.array(columns[0], pa.int64()))
                return pa.RecordBatch.from_arrays([ids_of.cast(target.field(0).type), *(pa.array(c, type=f.type) for c, f in zip(columns[1:], list(target)[1:]))], schema=target)

            for k, ids in enumerate(encoder(path)(batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    full = length == window
                    rows.append((k, start, length, n, ids[4 * start:4 * (start + length)], part, n_full if full else n_tails))
                    n_full, n_tails = n_full + full, n_tails + (not full)
                size += len(ids)
                if size >= BATCH_BYTES:
                    yield out()
                    rows.clear()
                    size = 0
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Openings:
    """Open windows by their remaining capacity, under a segment tree that tells which capacities there are."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, number: int) -> None:
        self.open[room].append(number)
        i = room + self.leaves
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, room: int) -> int:
        number = self.open[room].pop()
        i = room + self.leaves
        if not self.open[room]:
            self.any[i] = 0
            while i > 1 and not self.any[i ^ 1]:
                i >>= 1
                self.any[i] = 0
        return number

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of need or more."""
        i = need + self.leaves
        while not self.any[i]:
            while i & 1:  # a right child: nothing larger below the same parent
                i >>= 1
            if i <= 0:
                return None
            i += 1
            if self.any[i]:
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                break
            if i == 1:
                return None
        return i - self.leaves


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each piece, given in falling order of length."""
    openings, made, numbers, offsets = Openings(window), 0, [], []
    for length in lengths:
        room = openings.tightest(length)
        if room is None:
            room, number, made = window, made, made + 1
        else:
            number = openings.take(room)
        numbers.append(number)
        offsets.append(window - room)
        if room > length:
            openings.add(room - length, number)
    return numbers, offsets


def place(cut: DataFrame, window: int = WINDOW, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """A written pieces table (with or without its ids, and with any columns more) with sequence_id and offset in place of part and at."""
    full = F.col("length") == window
    row = cut.agg(
        F.max("part").alias("part"), F.max(F.when(full, F.col("at"))).alias("at"), F.sum(F.when(~full, F.col("length"))).alias("tokens")).first()
    parts, groups = (row["part"] or 0) + 1, max(1, -(-(row["tokens"] or 0) // group_tokens))
    first = (-1 if row["at"] is None else row["at"]) * parts + parts

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "part", "at"], ascending=[False, True, True])
        pdf["number"], pdf["offset"] = best_fit(pdf["length"].tolist(), window)
        return pdf[["part", "at", "group", "number", "offset"]]

    tails = cut.filter(~full)
    dealt = tails.select("part", "at", "length", F.pmod(F.xxhash64("part", "at"), F.lit(groups)).alias("group"))
    planned = dealt.groupBy("group").applyInPandas(pack, "part long, at long, group long, number long, offset long")
    planned = planned.select("part", "at", (F.lit(first) + F.col("number") * groups + F.col("group")).alias("sequence_id"), "offset")
    whole = cut.filter(full).withColumn("sequence_id", F.col("at") * parts + F.col("part")).withColumn("offset", F.lit(0).cast("long"))
    return whole.drop("part", "at").unionByName(tails.join(planned, ["part", "at"]).drop("part", "at"))


def sequences(placed: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """(sequence_id, n_tokens, ids, documents): placed pieces with their ids put together, padded unless n_tokens is a power of two.

    A sequence has at most ``window`` pieces, so its group is bounded.
    """
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "start", "length")))
    n = F.col("n_tokens")
    pad = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(window - n).cast("int")
    joined = F.aggregate("rows", F.lit(b""), lambda all_ids, r: F.concat(all_ids, r["ids"]))
    padding = F.unhex(F.repeat(F.lit(np.array([pad_id], dtype="<u4").tobytes().hex()), pad))
    grouped = placed.groupBy("sequence_id").agg(rows.alias("rows"), F.sum("length").alias("n_tokens"))
    return grouped.select("sequence_id", "n_tokens", F.concat(joined, padding).alias("ids"), F.transform("rows", lambda r: F.struct(r["doc_id"].alias("doc_id"), r["start"].alias("start"), r["length"].alias("length"), r["offset"].alias("offset"))).alias("documents"))


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """All pieces with their ids and their places."""
    return place(cut_lineage(pieces(docs, tokenizer, window), "pieces"), window, group_tokens)


def judge(docs: DataFrame) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    # The digest is taken in the written table's scan, so that ids are not shuffled to their places.
    cut = cut_lineage(pieces(docs), "pieces")
    return place(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over training token windows.

Words are maximal runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased. A window is ``width``
consecutive words of a benchmark item; an item with fewer words (but not none) is one window. The windows are looked up by
a 64-bit hash of word numbers and each hit is verified word by word.

The set is sent in blocks of at most about ``block_pairs`` (window, item) pairs, whose text the driver passes on block by
block; a larger benchmark needs more passes over the documents, never a larger broadcast.

Defined results: null and wordless texts have no words and no hits; null items are ignored; equal items count once each
by their item_id, a null item_id counts as the string ``null``; repeated document rows are judged one by one; an empty
benchmark hits nothing; columns besides the text are passed through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from beleg.llm.tables import cut_lineage, spare_name

WIDTH = 10
BLOCK_PAIRS = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# In UTF-8 every byte of a non-ASCII character is over 0x7F, so words can be cut on bytes.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class WindowSet:
    """Windows of one block: word numbers, and by window length the sorted hashes and the items of each window."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.numbers: dict[bytes, int] = {}
        self.items: dict[bytes, list[str]] = {}
        lengths: dict[int, set[bytes]] = {}
        for window, item in pairs:
            words = window.encode("utf-8", "surrogatepass").split(b" ")
            row = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], dtype=np.int64)
            lengths.setdefault(len(words), set()).add(row.tobytes())
            self.items.setdefault(row.tobytes(), []).append(item)
        self.hashes = {}
        for length, rows in lengths.items():
            table = np.frombuffer(b"".join(rows), dtype=np.int64).reshape(-1, length)
            self.hashes[length] = np.unique(_mix(table.T))

    def find(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie inside an occurrence of a window, and the items of the windows that occur."""
        ids = np.fromiter(map(self.numbers.get, words, repeat(0)), dtype=np.int64, count=len(words))
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        hit, items = np.zeros(len(words) + 1, dtype=np.int64), set()
        for length, hashes in self.hashes.items():
            if len(words) < length:
                continue
            starts = np.flatnonzero(known[length:] - known[:-length] == length)
            if not len(starts):
                continue
            mixed = _mix([ids[starts + j] for j in range(length)])
            at = np.searchsorted(hashes, mixed)
            for start in starts[hashes[np.minimum(at, len(hashes) - 1)] == mixed]:
                found = self.items.get(ids[start:start + length].tobytes())
                if found is not None:
                    hit[start] += 1
                    hit[start + length] -= 1
                    items.update(found)
        return np.cumsum(hit[:-1]) > 0, items


def _mix(columns) -> np.ndarray:
    mixed = np.zeros(len(columns[0]), dtype=np.uint64)
    for column in columns:
        mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct (window, item_id) of all items."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))
    return (
        benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words.alias("words"))
        .filter(F.size("words") > 0)
        .select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i + 1, width), " "))).alias("window"))
        .distinct()
    )


def _spans(mask: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def scan(docs: DataFrame, benchmark: DataFrame, names: tuple[str, str, str], width: int = WIDTH, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """docs with three more columns, in order of ``names``: number of words, hit word ranges (stop exclusive), sorted items."""
    spark = docs.sparkSession
    windows = cut_lineage(benchmark_windows(benchmark, width), "benchmark")
    blocks = max(1, -(-windows.count() // block_pairs))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    n_words, spans, items = names
    schema = T.StructType([*docs.schema.fields, T.StructField(n_words, T.LongType()), T.StructField(spans, span), T.StructField(items, T.ArrayType(T.StringType()))])
    text_at, target = docs.columns.index("text"), to_arrow_schema(schema)

    def scanned(sent: Broadcast, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = sent.value
            for batch in batches:
                kept = batch.columns if first else batch.columns[:-3]
                before = [(None, None)] * batch.num_rows if first else zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())
                counts, ranges, found = [], [], []
                for text, (old_ranges, old_items) in zip(batch.column(text_at), before):
                    words = words_of(text.as_py())
                    mask, items = windows.find(words)
                    for old in old_ranges or ():
                        mask[old["start"]:old["stop"]] = True
                    counts.append(len(words))
                    ranges.append(_spans(mask) if mask.any() else [])
                    found.append(sorted(items.union(old_items or ())))
                added = [pa.array(x, type=field.type) for x, field in zip((counts, ranges, found), list(target)[-3:])]
                yield pa.RecordBatch.from_arrays([*kept, *added], names=target.names)

        return run

    out = docs
    for block in range(blocks):
        rows = windows.filter(F.pmod(F.xxhash64("window", "item_id"), F.lit(blocks)) == block).collect()
        sent = spark.sparkContext.broadcast(WindowSet([(r["window"], r["item_id"]) for r in rows]))
        out = out.mapInArrow(scanned(sent, block == 0), schema)
    return out


def judge(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs.select("doc_id", "text"), benchmark, ("n_words", "hit_ranges", "items"), width, block_pairs)
    n_hit = F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda total, x: total + x["stop"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_ranges") > 0).alias("contaminated"),
    )


_WORD = re.compile("[0-9A-Za-z\u0080-\U0010FFFF]+")


def without_ranges(text: str | None, ranges) -> str | None:
    """The text without the words of the ranges and what stands between them."""
    if not text or not ranges:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    out, end = [], 0
    for r in ranges:
        out.append(text[end:at[r["start"]][0]])
        end = at[r["stop"] - 1][1]
    return "".join([*out, text[end:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", width: int = WIDTH, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """docs without contaminated documents, or (``remove="spans"``) without the hit passages; the columns of docs."""
    names = tuple(spare_name(docs, n) for n in ("n_words", "hit_ranges", "hit_items"))
    found = scan(docs, benchmark, names, width, block_pairs)
    if remove == "documents":
        return found.filter(F.size(names[1]) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))
    if remove != "spans":
        raise ValueError(f"remove must be documents or spans, not {remove}")
    cut = F.udf(without_ranges, "string")
    text = F.when(F.size(names[1]) > 0, cut("text", names[1])).otherwise(F.col("text"))
    return found.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))


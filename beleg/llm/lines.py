"""Fuzzy line deduplication by MinHash.

Lines (cut at line feeds) are compared lower-cased with white space runs as one space. A line's features are its shingles of
8 code points (a shorter line is one shingle). 32 minima in 8 bands of 4 bring lines of Jaccard similarity 0.8 together with
probability 0.985 at least; candidates are verified by exact Jaccard similarity; verified links are joined to components by
distributed union-find, and of each component the line that comes first (least doc_id, then line number) stays.

Only distinct lines take part in the comparison, so copies cost nothing. No pairs of a large bucket are emitted: its lines meet
their least one first; where that leaves several components, blocks of lines meet blocks of lines, each pair of blocks in one
task that returns a spanning forest of its links (see ``components``). Lines that need verifying are fetched in one more
scan, in which a bitmap of fixed size (``filter_bits``) tells which lines may be needed before anything is shuffled: a full
bitmap costs time, never a line.

Defined results: blank lines are no lines; they stay. A null text stays null. A document that loses all its lines to others
goes. Rows equal in doc_id and text are copies of each other: the first by the
hash of all columns keeps the lines, the others go. Null doc_ids come last. An empty
table gives an empty result. Other columns are passed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beleg.llm.components import block_pairs, bucket_components
from beleg.llm.tables import content_hash, cut_lineage, map_rows, row_key

SHINGLE = 8
ROWS = 4
BANDS = 8
SIMILARITY = 0.8
FILTER_BITS = 1 << 23
BLOCK_CHARS = 100_000
_CHUNK = 1 << 16  # code points whose minima are taken at a time: they stay in a core's cache

_rng = np.random.default_rng(8)
_FACTORS = _rng.integers(1 << 31, 1 << 32, ROWS * BANDS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalise(line: str) -> str:
    return " ".join(line.lower().split())


# Every other white space character; a line feed ends a line.
_ODD_SPACES = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")


def normalised_lines(text: str) -> list[str]:
    """``normalise`` of each line. Most texts have single spaces between words only: they are lower-cased whole and then cut."""
    odd = "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " "
    if odd or any(c in text for c in _ODD_SPACES):
        return [normalise(line) for line in text.split("\n")]
    return text.lower().split("\n")


def _rolled(codes: np.ndarray, factor: int) -> np.ndarray:
    """codes as digits to the base ``factor``, SHINGLE = 8 of them from every place on, modulo 2^64; two, four, then eight at once."""
    for step in (1, 2, 4):
        codes = codes[:-step] * np.uint64(pow(factor, step, 1 << 64)) + codes[step:]
    return codes


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lines, one line after another, short ones filled up to a shingle, and the lines' lengths."""
    padded = [line if len(line) >= SHINGLE else line.ljust(SHINGLE, "\0") for line in lines]
    return np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.array([len(p) for p in padded])


def _shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of the lines, one line after another, and where each line starts."""
    codes, lengths = _codes(lines)
    rolled = _rolled(codes.astype(np.uint64), 0x100000001B3)
    whole = np.ones(len(codes), dtype=bool)
    ends = np.cumsum(lengths)
    for j in range(1, SHINGLE):
        whole[ends - j] = False
    rolled = rolled[whole[:len(rolled)]]
    rolled = (rolled ^ (rolled >> np.uint64(29))) * _MIX
    counts = lengths - SHINGLE + 1
    return rolled ^ (rolled >> np.uint64(32)), np.cumsum(counts) - counts


def band_keys(lines: list[str]) -> np.ndarray:
    """A row of BANDS signed 64-bit keys for each normalised line."""
    out, at = np.empty((len(lines), BANDS), dtype=np.int64), 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + len(lines[end]) <= _CHUNK):
            size += len(lines[end]) + SHINGLE
            end += 1
        hashes, starts = _shingle_hashes(lines[at:end])
        base = (hashes >> np.uint64(32)).astype(np.uint32)
        for band in range(BANDS):
            key = np.full(end - at, band + 1, dtype=np.uint64)
            for row in range(ROWS):
                least = np.minimum.reduceat(base * _FACTORS[band * ROWS + row], starts)
                key = (key ^ least) * _MIX
                key ^= key >> np.uint64(31)
            out[at:end, band] = key.view(np.int64)
        at = end
    return out


def _line_id(line: str) -> tuple[int, int]:
    return tuple(_line_ids([line])[0].tolist())


def _line_ids(lines: Iterable[str]) -> np.ndarray:
    """A row of two signed 64-bit numbers, high and low, for each line."""
    digests = b"".join(xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass")) for line in lines)
    return np.frombuffer(digests, dtype=">i8").astype(np.int64).reshape(-1, 2)


LINE_SCHEMA = "k1 long, k2 long, doc_id long, line_no int, high long, low long, bands array<long>"


def line_table(docs: DataFrame) -> DataFrame:
    """Blank lines (null id), and of each batch the first place of every other line: its document's key, its number, its 128-bit
    id, and its band keys. Further places of a line in its batch are left out: the first is before them whatever else is found."""

    def run(k1: list, k2: list, ids: list, texts: list) -> Iterator[dict[str, list]]:
        first: dict[str, tuple] = {}
        places = []
        for a, b, i, text in zip(k1, k2, ids, texts):
            if text is None:
                continue
            none, number = i is None, i or 0
            for n, line in enumerate(normalised_lines(text)):
                place = (none, number, n, a, b)
                if not line:
                    places.append(place)
                elif (before := first.get(line)) is None or place < before:
                    first[line] = place
        found, blank = _line_ids(first), len(places)
        places = [*first.values(), *places]
        high, low = (pa.concat_arrays([pa.array(found[:, k]), pa.nulls(blank, pa.int64())]) for k in (0, 1))
        keys = band_keys(list(first)).ravel()
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * BANDS), pa.array(keys))
        yield {
            "k1": [p[3] for p in places], "k2": [p[4] for p in places], "doc_id": [None if p[0] else p[1] for p in places],
            "line_no": [p[2] for p in places], "high": high, "low": low, "bands": pa.concat_arrays([bands, pa.nulls(blank, bands.type)]),
        }

    keyed = docs.select(*row_key("doc_id", "text"), F.col("doc_id").cast("long"), "text")
    return map_rows(keyed, LINE_SCHEMA, run, "k1", "k2", "doc_id", "text")


def _texts_of(docs: DataFrame, needed: DataFrame, filter_bits: int) -> DataFrame:
    """(id, line): the normalised text of the lines whose ids are needed, and maybe a few more."""
    bit = F.pmod("id", F.lit(filter_bits))
    word = needed.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(id & 63L as int))").alias("one")).groupBy("word").agg(F.bit_or("one").alias("bits"))
    bitmap = np.zeros(filter_bits >> 6, dtype=np.int64)
    for r in word.collect():  # at most filter_bits / 64 rows
        bitmap[r["word"]] = r["bits"]
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(texts: list) -> Iterator[dict[str, list]]:
        lines = list(dict.fromkeys(line for text in texts if text for line in normalised_lines(text) if line))
        low = _line_ids(lines)[:, 1]
        at = low % filter_bits
        wanted = np.flatnonzero((sent.value[at >> 6] >> (at & 63)) & 1)
        yield {"id": low[wanted], "line": [lines[k] for k in wanted]}

    return map_rows(docs, "id long, line string", run, "text").join(needed, "id", "left_semi").distinct()


def _features(line: str) -> set[str]:
    return {line[i:i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def _feature_arrays(lines: list[str]) -> list[np.ndarray]:
    """The features of each line as ascending numbers, equal in two of these lines for equal features only.

    Of lines with fewer than 256 kinds of characters a shingle is one number of 64 bits, a byte for each character; 0 fills up
    short lines. Other lines' features are numbered.
    """
    codes, lengths = _codes(lines)
    kinds = 0
    if codes.max(initial=0) > 255:
        alphabet, codes = np.unique(codes, return_inverse=True)
        kinds = len(alphabet)
        codes = codes + (alphabet[0] != 0)
    if kinds > 255 or any("\0" in line for line in lines):
        numbers: dict[str, int] = {}
        return [np.array(sorted(numbers.setdefault(f, len(numbers)) for f in _features(line)), dtype=np.uint64) for line in lines]
    packed, out = _rolled(codes.astype(np.uint64), 256), []
    for end, length in zip(np.cumsum(lengths).tolist(), lengths.tolist()):
        found = np.sort(packed[end - length:end - SHINGLE + 1])
        new = np.ones(len(found), dtype=bool)
        np.not_equal(found[1:], found[:-1], out=new[1:])
        out.append(found[new])
    return out


def _n_common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate((x, y))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _similar(limit: float):
    """Keeps the pairs whose exact Jaccard similarity reaches the limit; one pair's features are held at a time."""

    def run(a: list, b: list, left: list, right: list) -> Iterator[dict[str, list]]:
        links, at, x = [], 0, None
        while at < len(a):
            end, size = at, 0
            while end < len(a) and size < _CHUNK * 4:
                size += len(right[end]) + (len(left[end]) if end == at or a[end] != a[end - 1] else 0)
                end += 1
            # Each least line, then those it meets.
            new = [k == at or a[k] != a[k - 1] for k in range(at, end)]
            features = iter(_feature_arrays([line for k, first in zip(range(at, end), new) for line in ((left[k], right[k]) if first else (right[k],))]))
            for k, first in zip(range(at, end), new):
                x = next(features) if first else x
                y = next(features)
                least, most = sorted((len(x), len(y)))
                if least >= limit * most and (common := _n_common(x, y)) >= limit * (least + most - common):
                    links.append((a[k], b[k]))
            at = end
        yield {"a": [p[0] for p in links], "b": [p[1] for p in links]}

    return run


def _forest(ids: list[int], components: list[int], lines: list[str], limit: float) -> list[tuple[int, int]]:
    """Links that join what is similar among the lines, as a spanning forest over their components.

    Only lines of different components are compared, and of those only lines whose numbers of shingles allow the limit.
    """
    number = {c: k for k, c in enumerate(dict.fromkeys(components))}
    root = np.array([number[c] for c in components])
    if len(number) < 2:
        return []
    features = _feature_arrays(lines)
    sizes = np.array([len(x) for x in features])
    # Only shingles of several lines can be common; they are the columns of a bit matrix.
    shingles, rows = np.concatenate(features), np.repeat(np.arange(len(features)), sizes)
    order = np.argsort(shingles)
    shingles, rows = shingles[order], rows[order]
    column = np.cumsum(np.concatenate(([False], shingles[1:] != shingles[:-1])))
    several = np.bincount(column) > 1
    shared, column = several[column], (np.cumsum(several) - 1)[column]
    rows, column = rows[shared], column[shared]
    width = int(several.sum()) // 64 + 1
    bits = np.zeros(len(features) * width, dtype=np.uint64)
    np.bitwise_or.at(bits, rows * width + (column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    bits = bits.reshape(len(features), width)
    links = []
    for k in range(len(features)):
        least, most = np.minimum(sizes[k + 1:], sizes[k]), np.maximum(sizes[k + 1:], sizes[k])
        others = np.flatnonzero((root[k + 1:] != root[k]) & (least >= limit * most)) + k + 1
        if not len(others):
            continue
        common = np.bitwise_count(bits[others] & bits[k]).sum(axis=1, dtype=np.int64)
        for other in others[common >= limit * (sizes[others] + sizes[k] - common)]:
            if root[other] != root[k]:
                root[root == root[other]] = root[k]
                links.append((ids[k], ids[other]))
    return links


def _links_in_blocks(limit: float):
    """Rows sorted by (key, i, j): the lines of one pair of blocks at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, {}

        def links() -> pa.RecordBatch:
            found = _forest(list(rows), [r[0] for r in rows.values()], [r[1] for r in rows.values()], limit)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for key, i, j, number, component, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, i, j) != group:
                    if len(rows) > 1:
                        yield links()
                    group, rows = (key, i, j), {}
                rows[number] = (component, line)
        if len(rows) > 1:
            yield links()

    return run


def line_components(docs: DataFrame, table: DataFrame, limit: float = SIMILARITY, filter_bits: int = FILTER_BITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, component) of distinct lines (lower half of their ids) that are similar to another one."""
    fetched: list[DataFrame] = []

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut_lineage(pairs, "candidates")
        needed = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        fetched.append(cut_lineage(_texts_of(docs, needed, filter_bits), "texts"))
        left, right = (fetched[0].select(F.col("id").alias(n), F.col("line").alias(t)) for n, t in (("a", "left"), ("b", "right")))
        # Least lines meet many others: sorted by them, their features are taken once.
        met = pairs.join(right, "b").join(left, "a")
        return map_rows(met, "a long, b long", _similar(limit), "a", "b", "left", "right")

    def verify_rest(rest: DataFrame) -> DataFrame:
        # All ids of a larger bucket were in a pair before, so their texts are at hand.
        dealt = block_pairs(rest.join(fetched[0], "id"), block_chars, F.length("line"))
        dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        return dealt.select("key", "i", "j", "id", "component", "line").mapInArrow(_links_in_blocks(limit), "a long, b long")

    members = table.filter("bands IS NOT NULL").select(F.explode("bands").alias("key"), F.col("low").alias("id"))
    return bucket_components(members, verify, verify_rest)


def kept_lines(docs: DataFrame, limit: float = SIMILARITY, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(k1, k2, keep, n_blank): by document key, the numbers of the lines that stay, and how many of them are blank."""
    table = cut_lineage(line_table(docs), "lines")
    found = line_components(docs, table, limit, filter_bits)
    # Lines without a similar other one stand for themselves; 128 bits tell them apart.
    placed = table.drop("bands").filter("low IS NOT NULL").join(found.withColumnRenamed("id", "low"), "low", "left")
    groups = (F.coalesce("component", "low").alias("c1"), F.when(F.col("component").isNull(), F.col("high")).alias("c2"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no", "k1", "k2")
    winners = placed.select(*groups, order.alias("place")).groupBy("c1", "c2").agg(F.min("place").alias("place"))
    blank = table.filter("low IS NULL").select("k1", "k2", "line_no", F.lit(True).alias("blank"))
    stay = winners.select("place.k1", "place.k2", "place.line_no", F.lit(False).alias("blank")).union(blank)
    return stay.groupBy("k1", "k2").agg(
        F.array_sort(F.collect_set("line_no")).alias("keep"), F.size(F.collect_set(F.when(F.col("blank"), F.col("line_no")))).alias("n_blank"))


def dedupe_lines(docs: DataFrame, limit: float = SIMILARITY, filter_bits: int = FILTER_BITS, counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with the lines that stay; documents that lose all lines go, unless ``counts`` names columns for the number of
    lines and of removed lines: then every document is returned."""
    kept = kept_lines(docs, limit, filter_bits)
    # Counted where the text is read: behind the join each use would count again.
    n_lines_of = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    keyed = docs.select(F.struct("*").alias("row"), "text", n_lines_of.alias("n_all"), content_hash(docs).alias("order"), *row_key("doc_id", "text"))
    # Copies are numbered before the join, which then finds its rows in order: texts are sorted once.
    numbered = keyed.withColumn("copy", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("order")))
    out = numbered.join(kept, ["k1", "k2"], "left")
    none, lines = F.array().cast("array<int>"), F.split("text", "\n", -1)
    # All lines of a further copy are copies.
    stay = F.when(F.col("copy") == 1, F.coalesce("keep", none)).otherwise(none)
    # The text is cut once, as the one element of an array, and lines are picked from that; inside the inner function it would be cut for each line.
    picked = F.transform(F.array(lines), lambda cut: F.array_join(F.transform(stay, lambda i: F.get(cut, i)), "\n"))
    n_all = F.col("n_all")
    text = F.when(F.col("text").isNotNull(), F.when(F.size(stay) == n_all, F.col("text")).otherwise(F.get(picked, F.lit(0))))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(n_all - F.coalesce("n_blank", F.lit(0)))
    n_stay = F.greatest(F.size(stay) - F.coalesce("n_blank", F.lit(0)), F.lit(0))
    columns = [text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    if counts is None:
        return out.filter((n_lines == 0) & (F.col("copy") == 1) | (n_stay > 0) | F.col("text").isNull()).select(*columns)
    return out.select(*columns, n_lines.cast("long").alias(counts[0]), (n_lines - F.when(n_lines == 0, 0).otherwise(n_stay)).cast("long").alias(counts[1]))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, text_sha256 of what stays (of the empty text if null)."""
    out = dedupe_lines(docs.select("doc_id", "text"), counts=("n_lines", "n_removed"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))

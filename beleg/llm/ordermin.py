"""Document fingerprints by order MinHash, in DataFrame operations only.

A text's k-mers are its runs of ``K`` white-space separated words (a text with fewer words, but some, is one k-mer); the j-th
occurrence of a k-mer is a feature of its own. Features are dealt by their hash to ``SKETCHES`` x ``TUPLE`` strata; the least
feature of each stratum is selected. The selected features of a sketch are put in their order in the text and hashed as a
tuple, so a sketch changes when a selected k-mer changes, when its number of occurrences does, or when the order does: that is
what makes it sensitive to edit distance and not to overlap alone. Likeness of two fingerprints is the share of equal sketches
among those that either has.

The order of documents (descending doc_id) is cut into buckets of neighbouring ids at approximate quantiles, so that the next
document of each is found inside a bucket; the first document of each bucket is handed to the bucket before. Texts are
shuffled to their buckets (the check tool saw two shuffles of that size); all steps on words and features happen inside the row, without a shuffle or a sort that could spill.

Defined results: null and empty texts, and texts of white space, have an empty fingerprint (all sketches ``-``); two empty ones are alike
1.0. Null doc_ids come last; equal ids are ordered by a hash of the text, then the text. Of one document the next is itself.
Repeated rows are documents of their own. An empty table gives an empty result. Texts of over 2^27 words keep their result
equal for equal texts, but positions are taken modulo 2^27.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beleg.llm.tables import cut_lineage

K = 3
SKETCHES = 16
TUPLE = 2
BUCKET_ROWS = 2_000
_POSITION_BITS = 27
_HASH_BITS = 36


def _bounds(docs: DataFrame, bucket_rows: int) -> list[int]:
    """Least doc_ids of the buckets but the first, ascending: a bounded number of approximate quantiles."""
    n = docs.count()
    buckets = min(20_000, max(1, -(-n // bucket_rows)))
    if buckets == 1:
        return []
    quantiles = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("q")).first()["q"] or []
    return sorted(set(quantiles))


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(bucket, at, doc_id, text, next_text, last): last marks rows whose next document lies in another bucket."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = _bounds(docs, bucket_rows)
    # Bucket 0 has the least ids. The number of the bucket is found by binary search, as nested conditions on constants.
    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("doc_id") < bounds[middle], search(low, middle)).otherwise(search(middle + 1, high))

    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(search(0, len(bounds))) if bounds else F.lit(0)
    order = (F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text"))
    placed = docs.withColumn("bucket", bucket.cast("int"))
    within = Window.partitionBy("bucket").orderBy(*order)
    rows = placed.select("bucket", F.row_number().over(within).alias("at"), "doc_id", "text", F.lead("text").over(within).alias("next_text"), F.lead("bucket").over(within).isNull().alias("last"))

    ends = placed.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    before = Window.orderBy(F.col("bucket").desc())
    everything = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row for each bucket: a bounded table.
    ends = ends.select("bucket", "top", F.coalesce(F.lag("bucket").over(before), F.last("bucket").over(everything)).alias("asks"))
    starts = placed.select("bucket", "doc_id", "text").join(ends, (placed["bucket"] == ends["bucket"]) & placed["doc_id"].eqNullSafe(ends["top"]))
    starts = starts.groupBy("asks").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")).select(F.col("asks").alias("bucket"), F.col("first.text").alias("first_text"))
    starts = cut_lineage(starts, "starts")
    # The join keeps to the partitioning by bucket.
    next_text = F.coalesce("next_text", F.when(F.col("last"), F.col("first_text")))
    return rows.join(starts, "bucket", "left").select("bucket", "at", "doc_id", "text", next_text.alias("next_text"), "last")


def edited(text: Column, following: Column) -> Column:
    """The last half of the text replaced by as many first code points of the following one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def with_fingerprints(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """rows with a fingerprint of each text column named in ``names`` (text -> fingerprint) in its place.

    Everything happens inside the row, on arrays: the k-mers, sorted, lie in runs of equal ones with rising positions, which
    numbers their occurrences; the features, sorted, lie in strata with the least one first.
    """
    kept = [c for c in rows.columns if c not in names]
    mask, strata = (1 << _POSITION_BITS) - 1, SKETCHES * TUPLE

    def step(rows: DataFrame, make: Callable[[str], Column]) -> DataFrame:
        return rows.select(*kept, *(make(t).alias(t) for t in names))

    def kmers(t: str) -> Column:
        last = F.greatest(F.size(t) - K, F.lit(0))
        hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(*(F.get(t, i + j) for j in range(K))), 64 - _HASH_BITS), _POSITION_BITS) + i.bitwiseAND(F.lit(mask)))
        return F.when(F.size(t) > 0, F.sort_array(hashed)).otherwise(F.array().cast("array<bigint>"))

    def runs(t: str) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.shiftright(F.get(t, i), _POSITION_BITS) != F.shiftright(F.get(t, i - 1), _POSITION_BITS)))
        return F.struct(F.col(t).alias("sorted"), F.when(F.size(t) > 0, starts).otherwise(F.array().cast("array<int>")).alias("starts"))

    def features(t: str) -> Column:
        in_order, starts = F.col(f"{t}.sorted"), F.col(f"{t}.starts")

        def feature(start: Column, j: Column) -> Column:
            h = F.xxhash64(F.shiftright(F.get(in_order, start), _POSITION_BITS), j)
            packed = F.shiftleft(F.shiftrightunsigned(h, 64 - 31), _POSITION_BITS) + F.get(in_order, start + j).bitwiseAND(F.lit(mask))
            return F.shiftleft(F.pmod(h, F.lit(strata)), 31 + _POSITION_BITS) + packed

        def run(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(in_order))
            return F.transform(F.sequence(F.lit(0), end - start - 1), lambda j: feature(start, j))

        return F.sort_array(F.flatten(F.transform(starts, run)))

    def selected(t: str) -> Column:
        shift = 31 + _POSITION_BITS
        least = F.filter(t, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(t, i - 1), shift)))
        return F.array_sort(F.transform(least, lambda x: F.struct(
            (F.shiftright(x, shift) % SKETCHES).alias("sketch"), x.bitwiseAND(F.lit(mask)).alias("pos"),
            F.shiftright(x, _POSITION_BITS).alias("feature"))))

    def sketches(t: str) -> Column:
        def sketch(i: Column) -> Column:
            own = F.transform(F.filter(t, lambda e: e["sketch"] == i), lambda e: F.hex(e["feature"]))
            return F.when(F.size(own) > 0, F.lower(F.lpad(F.hex(F.xxhash64(F.array_join(own, ","))), 16, "0"))).otherwise("-")

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SKETCHES - 1)), sketch), " ")

    for make in (lambda t: F.filter(F.split(F.coalesce(t, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != ""), kmers, runs, features, selected, sketches):
        rows = step(rows, make)
    return rows.select(*kept, *(F.col(t).alias(f) for t, f in names.items()))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches among those that either fingerprint has; 1 if neither has any."""
    x, y = F.split(a, " "), F.split(b, " ")
    either = [F.when((F.get(x, i) != "-") | (F.get(y, i) != "-"), 1).otherwise(0) for i in map(F.lit, range(SKETCHES))]
    equal = [F.when((F.get(x, i) == F.get(y, i)) & (F.get(x, i) != "-"), 1).otherwise(0) for i in map(F.lit, range(SKETCHES))]
    n = reduce(Column.__add__, either)
    return F.when(n == 0, 1.0).otherwise(reduce(Column.__add__, equal) / n)


def judge(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = with_next(docs, bucket_rows)
    # The next document's own fingerprint is the row's below, but for the last row of a bucket.
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text"))).select(
        "bucket", "at", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "last",
        "text", "edited", F.when(F.col("last"), F.col("next_text")).alias("beyond"))
    marked = with_fingerprints(rows, {"text": "f0", "edited": "f1", "beyond": "f2"})
    following = F.when(F.col("last"), F.col("f2")).otherwise(F.lead("f0").over(Window.partitionBy("bucket").orderBy("at")))
    return marked.withColumn("following", following).select(
        "doc_id", "n_chars", "edited_sha256", F.col("f0").alias("fingerprint"), F.col("f1").alias("edited_fingerprint"),
        likeness(F.col("f0"), F.col("f1")).alias("near_edited"), likeness(F.col("f0"), F.col("following")).alias("near_next"))

"""Mixing sources to target weights by Pfair scheduling.

Each stream (a source with a target weight, or all other sources together) is cut into blocks of ``block_docs`` documents in
a random but fixed order. Slots of the output hold one block each. Among streams of whole-number weights a with total H, the
i-th block of a stream is released at floor((i-1) H/a) and due at ceil(i H/a); earliest deadline first among the released
blocks meets every deadline, so after any number of slots each stream is less than one block from its target share.

All windows end at multiples of H, so the schedule repeats with period H. One period is scheduled on the driver (its size
is the sum of the weights, whatever the data); blocks find their slot by arithmetic and a join with that template.

No row is dropped when a stream runs out: periods are whole as long as every stream can fill its part; then follows one
period in which the streams that run out have their remaining blocks as weight; then the others go on among themselves with
their weights, and so on. That makes at most two kinds of period per stream.

Defined results: a null source belongs to the other stream, as do sources without a weight; a source named with weight 0 is
an error. Rows are ordered in a stream by a hash of doc_id, then doc_id, then text; repeated rows take places next to each
other. Null and empty texts are rows like any other. An empty table gives an empty result. Other columns are passed through.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beleg.llm.tables import cut_lineage, spare_name

OTHER = "*"
NAMES = ("stream", "block", "release", "deadline", "slot", "place")
BLOCK_DOCS = 4
BUCKET_ROWS = 20_000
#: Target weights of the sources: those that are thought better come oftener.
WEIGHTS = {f"src{i}": 10 if i == 0 else 6 if i < 10 else 3 for i in range(20)} | {OTHER: 2}


def period(weights: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(stream, index from 0, release, deadline, slot) of one period of the sum of the weights."""
    total = sum(weights.values())
    jobs = sorted((i * total // a, -(-(i + 1) * total // a), s, i) for s, a in weights.items() for i in range(a))
    out, waiting, at = [], [], 0
    for slot in range(total):
        while at < len(jobs) and jobs[at][0] <= slot:
            release, deadline, stream, i = jobs[at]
            heapq.heappush(waiting, (deadline, stream, i, release))
            at += 1
        deadline, stream, i, release = heapq.heappop(waiting)
        out.append((stream, i, release, deadline, slot))
    return out


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple[int, int, int, dict[str, int], dict[str, int]]]:
    """(first slot, number of periods, slots of a period, weights, first block of each stream), one after another."""
    left, out, slot = {s: n for s, n in blocks.items() if n}, [], 0
    done = dict.fromkeys(left, 0)
    while left:
        whole = min(n // weights[s] for s, n in left.items())
        shares = {s: weights[s] if whole else min(weights[s], n) for s, n in left.items()}
        times, size = max(1, whole), sum(shares.values())
        out.append((slot, times, size, shares, {s: done[s] for s in left}))
        slot += times * size
        for s, a in shares.items():
            done[s] += a * times
            left[s] -= a * times
        left = {s: n for s, n in left.items() if n}
    return out


def mix(
    docs: DataFrame, weights: dict[str, int] = WEIGHTS, block_docs: int = BLOCK_DOCS, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """docs in slot order with stream, block, release, deadline, slot and place in the block; every row stays.

    A new column whose name docs already has gets underscores before it.
    """
    if any(int(w) != w or w < 1 for w in weights.values()):
        raise ValueError("weights must be whole and positive")
    weights = {OTHER: 1} | weights
    spark = docs.sparkSession
    stream_name, block_name, release_name, deadline_name, slot_name, place_name = (spare_name(docs, n) for n in NAMES)
    named = [s for s in weights if s != OTHER]
    of_source = F.when(F.col("source").isin(named), F.col("source")).otherwise(F.lit(OTHER)).alias("stream")
    buckets = max(1, -(-docs.count() // bucket_rows))
    drawn = F.xxhash64("doc_id", F.lit(1)).alias("draw")
    in_bucket = F.pmod(F.shiftright(drawn, 7), F.lit(buckets)).alias("bucket")

    # A stream is numbered bucket by bucket, so that no task gets a whole stream.
    sizes = cut_lineage(docs.groupBy(of_source, in_bucket).agg(F.count("*").alias("n")), "sizes")
    totals = {r["stream"]: -(-r["n"] // block_docs) for r in sizes.groupBy("stream").agg(F.sum("n").alias("n")).collect()}
    upto = Window.partitionBy("stream").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("stream", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    within = Window.partitionBy("stream", "bucket").orderBy("draw", "doc_id", "text_hash")
    marked = docs.select(F.struct("*").alias("row"), of_source, in_bucket, drawn, "doc_id", F.xxhash64("text").alias("text_hash"))
    ranked = marked.select("row", "stream", "bucket", (F.row_number().over(within) - 1).alias("rank")).join(offsets, ["stream", "bucket"])
    rank = F.col("rank") + F.col("before")
    placed = ranked.select("row", "stream", F.floor(rank / block_docs).alias("block"), F.pmod(rank, F.lit(block_docs)).cast("int").alias("place"))

    parts, template = [], []
    for k, (first, times, size, shares, start) in enumerate(phases(totals, weights)):
        parts += [(k, s, start[s], start[s] + times * a, a, first, size) for s, a in shares.items()]
        template += [(k, s, i, release, deadline, slot) for s, i, release, deadline, slot in period(shares)]
    p = spark.createDataFrame(parts, "phase int, p_stream string, low long, high long, share long, first long, size long")
    t = spark.createDataFrame(template, "t_phase int, t_stream string, t_index long, release long, deadline long, slot long")
    # Both tables depend on the weights alone: at most 2 S^2 and 2 S x (sum of the weights) rows for S streams.
    placed = placed.join(F.broadcast(p), F.expr("stream = p_stream AND block >= low AND block < high"))
    placed = placed.join(F.broadcast(t), F.expr("phase = t_phase AND stream = t_stream AND (block - low) % share = t_index"))
    base = F.expr("first + (block - low) div share * size")
    out = placed.select(
        "row.*", F.col("stream").alias(stream_name), F.col("block").alias(block_name), (base + F.col("release")).alias(release_name),
        (base + F.col("deadline")).alias(deadline_name), (base + F.col("slot")).alias(slot_name), F.col("place").alias(place_name),
    )
    # Slots are cut into ranges of equal length, so the order needs no sampling.
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    span = max(1, -(-sum(totals.values()) // n))
    return out.repartitionById(n, F.floor(F.col(slot_name) / span).cast("int")).sortWithinPartitions(slot_name, place_name)


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, stream, block, release, deadline, slot, place, in slot order."""
    return mix(docs.select("doc_id", "source", F.xxhash64("text").alias("text"))).drop("text")

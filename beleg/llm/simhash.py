"""SimHash near-duplicates: fingerprints linked at 2 or fewer differing bits, found through deletion-variant signatures.

Words are runs without ASCII white space, A-Z lower-cased; a text's features are its 3-word shingles, repeats included. Where
two fingerprints differ in at most 2 bits, one of their two 32-bit segments differs in at most one. Each segment is indexed
whole and under its 32 one-wildcard variants, so an equality join finds the pair; a bit count verifies it. Only distinct
fingerprints take part, so copies cost nothing. Large buckets: see ``components.bucket_components``; what is left of them is
cut further by a third of the other segment, as two differing bits leave one of three thirds equal, and compared in pairs of
blocks that return a spanning forest of their links.

Defined results: null, empty and blank texts have fingerprint zero, linked like any other. Fewer than 3 words are one
shingle. Components of equal fingerprints have their least doc_id; null doc_ids are ignored in it unless a component has no
other. Repeated rows are members like any other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beleg.llm.components import block_pairs, bucket_components
from beleg.llm.tables import content_hash, cut_lineage, map_rows, row_key

SHINGLE = 3
SEED = 42
MAX_BITS = 2
BLOCK_ROWS = 4096  # a task holds two blocks of a large group at a time


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint as an unsigned number."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([digest(s, seed) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 255):  # sums of 255 bits fit in a byte
        ones += np.unpackbits(hashes[at:at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, fp) of every row of docs."""

    def run(k1: list, k2: list, ids: list, texts: list) -> Iterator[dict[str, list]]:
        yield {"k1": k1, "k2": k2, "doc_id": ids, "fp": [_signed(fingerprint(t)) for t in texts]}

    keyed = docs.select(*row_key("doc_id", "text"), F.col("doc_id").cast("long"), "text")
    return map_rows(keyed, "k1 long, k2 long, doc_id long, fp long", run, "k1", "k2", "doc_id", "text")


def segment_keys(fp: Column) -> Column:
    """66 keys: both segments, whole and with each bit in turn as a wildcard. Key: segment value, then wildcard place, then segment."""
    halves = [F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))]
    keys = []
    for s, half in enumerate(halves):
        keys.append(F.shiftleft(half, 7) + F.lit(32 * 2 + s))
        keys += [F.shiftleft(half.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i))), 7) + F.lit(i * 2 + s) for i in range(32)]
    return F.array(*keys)


def _verify(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)


def _other_thirds(key: Column, fp: Column) -> Column:
    """Keys of the thirds of the segment that a bucket does not compare: two fingerprints linked in the bucket agree in one of them at least."""
    other = F.when(key.bitwiseAND(F.lit(1)) == 0, fp.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(fp, 32))
    cuts = ((0, 11), (11, 11), (22, 10))
    return F.array(*(F.shiftleft(F.shiftrightunsigned(other, low).bitwiseAND(F.lit((1 << n) - 1)), 2) + F.lit(k) for k, (low, n) in enumerate(cuts)))


def _forest(ids: np.ndarray, components: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what is linked among the fingerprints, as a spanning forest over their components."""
    _, root = np.unique(components, return_inverse=True)
    bits, links = ids.view(np.uint64), []
    if root.max() == 0:
        return links
    for k in range(len(ids)):
        others = np.flatnonzero(root[k + 1:] != root[k]) + k + 1
        for other in others[np.bitwise_count(bits[others] ^ bits[k]) <= MAX_BITS]:
            if root[other] != root[k]:
                root[root == root[other]] = root[k]
                links.append((int(ids[k]), int(ids[other])))
    return links


def _links_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, i, j): the fingerprints of one pair of blocks at a time, of which two blocks' rows are held."""
    held: list[np.ndarray] = []

    def links() -> pa.RecordBatch:
        rows = np.concatenate(held)
        found = _forest(np.ascontiguousarray(rows[:, 3]), rows[:, 4])
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
        ends = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
        for piece in np.split(rows, ends) if len(rows) else ():
            if held and (held[-1][-1, :3] != piece[0, :3]).any():
                yield links()
                held = []
            held.append(piece)
    if held:
        yield links()


def _verify_rest(rest: DataFrame) -> DataFrame:
    """Links among fingerprints of different components that share a bucket and a third of its other segment, found in pairs of blocks."""
    thirds = rest.withColumn("third", F.explode(_other_thirds(F.col("key"), F.col("id"))))
    # Where two groups get one key, more is compared, and nothing is linked that is not.
    grouped = cut_lineage(thirds.select(F.xxhash64("key", "third").alias("key"), "id", "component"), "thirds")
    # A third whose fingerprints are all in one component can add nothing.
    mixed = grouped.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 < c2").select("key")
    dealt = block_pairs(grouped.join(mixed, "key", "left_semi"), BLOCK_ROWS, F.lit(1))
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.select("key", "i", "j", "id", "component").mapInArrow(_links_in_blocks, "a long, b long")


def link_fingerprints(marked: DataFrame) -> DataFrame:
    """(id, component) of distinct fingerprints fp that are linked to another one."""
    # Few bytes of fingerprints become 66 times as many rows: they are dealt out before, not gathered in few tasks.
    tasks = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = marked.select(F.col("fp").alias("id")).distinct().repartition(tasks, "id")
    members = distinct.select(F.explode(segment_keys(F.col("id"))).alias("key"), "id")
    return bucket_components(members, _verify, _verify_rest)


def _marked_components(marked: DataFrame) -> DataFrame:
    """marked with the component (a fingerprint) of each row."""
    found = link_fingerprints(marked).withColumnRenamed("id", "fp")
    return marked.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    marked = cut_lineage(fingerprints(docs), "fingerprints")
    found = link_fingerprints(marked).withColumnRenamed("id", "fp")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    of_component = least.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = least.join(of_component, "component").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that with the least doc_id (null last), of equal ones the least hash of all columns. The columns of docs."""
    marked = cut_lineage(fingerprints(docs), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    kept = _marked_components(marked).groupBy("component").agg(F.min(order).alias("best")).select("best.k1", "best.k2")
    keyed = docs.select(F.struct("*").alias("row"), content_hash(docs).alias("order"), *row_key("doc_id", "text")).join(kept, ["k1", "k2"], "left_semi")
    copy = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("order"))
    return keyed.select("row", copy.alias("copy")).filter("copy = 1").select("row.*")

"""Connected components of a link table, and candidate links from buckets, without large groups in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beleg.llm.tables import cut_lineage


def _checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"] or 0


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the least neighbour of u. The least is pre-aggregated; the join back can be split by Spark where a u is hot."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("least")), "u")


def _star_round(edges: DataFrame) -> DataFrame:
    """Large-star, then small-star, on edges with u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = (
        _with_least(both).filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.least("least", "u").alias("v")).distinct()
    )
    small = _with_least(large)
    onward = small.filter(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    return onward.union(small.select("u", F.col("least").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id that is linked to another one; component is the smallest id reachable.

    links: columns a and b of one orderable type; order, repeats and self-links don't matter. Distributed union-find by
    alternating stars: every round is written to the shared folder, so a lost executor costs a round at most. The number of
    rounds grows with the logarithm of the longest path.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = cut_lineage(edges, "links"), None
    while (now := _checksum(edges)) != before:
        edges, before = cut_lineage(_star_round(edges), "stars"), now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def block_pairs(rest: DataFrame, block_size: int, weight: Column) -> DataFrame:
    """rest (key, id, ...) dealt to pairs of blocks: in each (key, i, j) lie the rows of blocks i and j of that key.

    A key's rows are cut into blocks of about block_size in weight by the hash of their id, so however large a key is, no
    task gets more than two blocks, and a row is repeated once for each block of its key.
    """
    blocks = rest.groupBy("key").agg(F.ceil(F.sum(weight) / block_size).alias("blocks"))
    dealt = rest.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("own", "other", "blocks")


def bucket_components(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame], verify_rest: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """(id, component) under all links between two ids of one bucket that are confirmed.

    members: (key, id). Emitting all pairs of a bucket grows with its square, so each id first meets the bucket's least id
    only; buckets of two are done by that. Links only matter up to components: of the larger buckets, only those whose ids
    are still in several components are looked at again.
    verify: gets (a, b) without repeats and returns the links among them.
    verify_rest: gets (key, id, component) of those buckets and returns links enough to join what is linked in a bucket.
    """
    buckets = members.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
    buckets = cut_lineage(buckets.filter("low < high"), "buckets")
    wide = buckets.filter("n > 2").select("key", "low")
    wide = cut_lineage(members.join(wide, "key").distinct(), "wide")
    pairs = buckets.select(F.col("low").alias("a"), F.col("high").alias("b")).union(
        wide.filter("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")))
    links = cut_lineage(verify(pairs.distinct()), "verified")
    found = cut_lineage(components(links), "components")

    placed = wide.join(found, "id", "left").select("key", "id", "low", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 < c2").select("key")
    # The least id has met all others of its bucket.
    rest = cut_lineage(placed.join(mixed, "key", "left_semi").filter("id <> low").select("key", "id", "component"), "rest")
    more = cut_lineage(verify_rest(rest), "verified")
    if more.isEmpty():
        return found
    # Components found so far stand for their links.
    stars = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
    return cut_lineage(components(stars.union(more)), "components")

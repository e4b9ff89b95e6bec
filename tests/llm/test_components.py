import random

import pandas as pd
from helpers import union_find
from pyspark.sql import functions as F

from beleg.llm.components import block_pairs, bucket_components, components


def test_components_equal_union_find(spark):
    draw = random.Random(5)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert found == {i: c for i, c in union_find(touched, [p for p in links if p[0] != p[1]]).items()}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_buckets_lose_no_component(spark):
    draw = random.Random(6)
    ids = {draw.randrange(1000) for _ in range(150)}
    members = [(k, i) for i in ids for k in (i // 40, 1000 + i // 55)]

    def near(pairs):
        return pairs.filter(F.abs(F.col("a") - F.col("b")) <= 4)

    def by_pairs(rest):
        other = rest.select("key", F.col("id").alias("b"), F.col("component").alias("component2"))
        return near(rest.withColumnRenamed("id", "a").join(other, "key").filter("component < component2").select("a", "b"))

    def by_blocks(rest):
        def links(block):
            x = sorted(set(block["id"]))
            return pd.DataFrame([(a, b) for a in x for b in x if a < b and b - a <= 4], columns=["a", "b"], dtype="int64")

        return block_pairs(rest, 3, F.lit(1)).groupBy("key", "i", "j").applyInPandas(links, "a long, b long")

    buckets = {}
    for k, i in members:
        buckets.setdefault(k, set()).add(i)
    links = [(a, b) for g in buckets.values() for a in g for b in g if a < b and b - a <= 4]
    want = union_find({x for p in links for x in p}, links)
    for rest in (by_pairs, by_blocks):
        found = {r["id"]: r["component"] for r in bucket_components(spark.createDataFrame(members, "key long, id long"), near, rest).collect()}
        assert found == want

"""A Merkle manifest of a dataset, with a proof for every row.

Rows are leaves; each language has a binary tree over its leaves in doc_id order, and the subroots have one over the languages.
Work goes by superblocks of 2^bits consecutive nodes. On the way up a superblock is reduced to its top node, and the top nodes
are the next level's nodes, until each tree is one node. On the way down the nodes of a superblock and the outer nodes that its
proofs need (the siblings between its top and the root, one row for the superblock) are cogrouped, and one applyInPandas
reduces the superblock again, joins local and outer siblings to proofs and folds them.

Leaves are numbered by a range sort and the sizes of its partitions, so a language's size doesn't matter: the largest group is
2^bits rows. Texts are read once; what is shuffled are ids and hashes. Ordered leaves and each level's nodes are written tables.

Defined results: null values are ``-`` in a leaf, null languages come first, null doc_ids first in their language and are never
tampered with. Equal doc_ids of a language are ordered by their leaves; equal rows are leaves of their own, one after another.
An empty table has no root and gives an empty result. Texts of any length are hashed whole. Columns besides the five hashed
ones are not read.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beleg.llm.tables import cut_lineage

BITS = 10
HASHED = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree long, idx long, size long, value string"
_ALONE = "-"  # in a proof: a node without a sibling at that level


def _coded(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    return F.sha2(F.concat(*(_coded(changed.get(c, F.col(c))) for c in HASHED)), 256)


def tampering() -> Column:
    """The leaf of a row with one more in n_chars where 7 divides the CRC-32 of its doc_id; else null."""
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    return F.when(hit, leaf_of(n_chars=F.col("n_chars").cast("decimal(38,0)") + 1))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """A table with each row's place in the order, from 0. df has to be a written table, so that ``spread`` is the same whenever it is read."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Rows equal in the order are dealt to several ranges by spread.
    ranged = df.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(n, *order, "spread").sortWithinPartitions(*order, "spread")
    stored = cut_lineage(ranged.drop("spread").withColumn("at", F.monotonically_increasing_id()), "ordered")
    stored = stored.withColumn("part", F.shiftright("at", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each of n partitions
    offsets = stored.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    low = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.join(F.broadcast(offsets), "part").withColumn(name, low + F.col("before")).drop("at", "part", "before")


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(size: int, bits: int) -> int:
    """Levels that a superblock of a tree with so many nodes has."""
    return min(bits, (size - 1).bit_length())


def reduce_levels(values: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, from the given ones up."""
    out = [values]
    for _ in range(levels):
        v = out[-1]
        out.append([digest(*v[i:i + 2]) for i in range(0, len(v), 2)])
    return out


def siblings(levels: list[list[str]], i: int) -> list[str]:
    """Of the i-th node, level by level: ``L`` or ``R`` and the sibling, or ``-``."""
    out = []
    for nodes in levels[:-1]:
        other = i ^ 1
        out.append(_ALONE if other >= len(nodes) else ("R" if other > i else "L") + nodes[other])
        i >>= 1
    return out


def fold(value: str, path: list[str]) -> str:
    for step in path:
        value = digest(value) if step == _ALONE else digest(value, step[1:]) if step[0] == "R" else digest(step[1:], value)
    return value


def climb(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """The tables of nodes (tree, idx, size, value), from the given one up to one node in each tree."""

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        size = int(pdf["size"].iloc[0])
        top = reduce_levels(pdf["value"].tolist(), height(size, bits))[-1]
        return pd.DataFrame({"tree": pdf["tree"].iloc[:1], "idx": pdf["idx"].iloc[:1] // (1 << bits), "size": -(-size >> bits), "value": top})

    out = [nodes]
    while (nodes.agg(F.max("size")).first()[0] or 0) > 1:
        slim = nodes.select("tree", "idx", "size", "value")
        tops = slim.filter("size > 1").groupBy("tree", F.shiftright("idx", bits).alias("block")).applyInPandas(up, NODE)
        nodes = cut_lineage(tops.union(slim.filter("size = 1")), "nodes")
        out.append(nodes)
    return out


def _descend(nodes: DataFrame, outer: DataFrame, bits: int) -> DataFrame:
    """The outer nodes of every node: (tree, idx, path, subroot) from those of the superblocks."""

    def down(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        pdf, path = pdf.sort_values("idx"), list(above["path"].iloc[0])
        levels = reduce_levels(pdf["value"].tolist(), height(int(pdf["size"].iloc[0]), bits))
        return pd.DataFrame({"tree": pdf["tree"], "idx": pdf["idx"], "path": [siblings(levels, i) + path for i in range(len(pdf))], "subroot": above["subroot"].iloc[0]})

    schema = "tree long, idx long, path array<string>, subroot string"
    return _cogrouped(nodes, outer, bits).applyInPandas(down, schema)


def _cogrouped(nodes: DataFrame, outer: DataFrame, bits: int):
    blocks = nodes.groupBy("tree", F.shiftright("idx", bits).alias("block"))
    return blocks.cogroup(outer.withColumnRenamed("idx", "block").groupBy("tree", "block"))


def prove(docs: DataFrame, changed_leaf: Column | None = None, bits: int = BITS, whole_proofs: bool = True) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof (array of sided siblings) or proof_sha256, folded_root.

    changed_leaf: the leaf of the row as it is found now, null where it is as it was when the manifest was made.
    """
    changed = F.lit(None).cast("string") if changed_leaf is None else changed_leaf
    slim = docs.select(F.col("lang").isNotNull().alias("has_lang"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("language"), F.col("doc_id").alias("doc"), leaf_of().alias("value"), changed.alias("changed"))
    rows = numbered(cut_lineage(slim, "leaves"), ["has_lang", "language", "doc", "value"], "number")
    languages = cut_lineage(rows.groupBy("has_lang", "language").agg(F.min("number").alias("first"), F.count("*").alias("size")), "languages")
    languages = numbered(languages, ["has_lang", "language"], "tree")
    leaves = rows.join(languages, ["has_lang", "language"]).select("tree", (F.col("number") - F.col("first")).alias("idx"), "size", "value", F.col("doc").cast("string"), "changed")
    lower = climb(cut_lineage(leaves, "leaves"), bits)

    # The subroots are the leaves of one more tree.
    n_trees = languages.count()
    subroots = lower[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n_trees).cast("long").alias("size"), "value")
    upper = climb(cut_lineage(subroots, "subroots"), bits)
    found = upper[-1].first()
    root = found["value"] if found else None

    outer = upper[-1].select("tree", "idx", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"))
    for nodes in upper[-2::-1]:
        outer = cut_lineage(_descend(nodes, outer, bits), "outer")
    # What is outer for a subroot is so for the top of its language's tree.
    tops = lower[-1].select("tree", F.col("value").alias("subroot"))
    outer = outer.select(F.col("idx").alias("tree"), "path").join(tops, "tree").select("tree", F.lit(0).cast("long").alias("idx"), "path", "subroot")
    for nodes in lower[-2:0:-1]:
        outer = cut_lineage(_descend(nodes, outer, bits), "outer")

    def finish(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        pdf, path = pdf.sort_values("idx"), list(above["path"].iloc[0])
        values = pdf["value"].tolist()
        levels = reduce_levels(values, height(int(pdf["size"].iloc[0]), bits))
        proofs, folded, tops = [], [], {}
        outer_hashes = "".join(step[1:] for step in path)
        for i, (value, now) in enumerate(zip(values, pdf["changed"].tolist())):
            local = siblings(levels, i)
            top = fold(now or value, local)
            if top not in tops:  # the outer nodes are the same for all of the superblock
                tops[top] = fold(top, path)
            folded.append(tops[top])
            proofs.append(local + path if whole_proofs else digest("".join(step[1:] for step in local), outer_hashes))
        return pd.DataFrame({"doc": pdf["doc"].tolist(), "leaf": values, "subroot": above["subroot"].iloc[0], "proof": proofs, "folded_root": folded})

    proof = "proof array<string>" if whole_proofs else "proof string"
    done = _cogrouped(lower[0], outer, bits).applyInPandas(finish, f"doc string, leaf string, subroot string, {proof}, folded_root string")
    return done.select(
        F.col("doc").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "leaf", "subroot", F.lit(root).cast("string").alias("root"),
        F.col("proof").alias("proof" if whole_proofs else "proof_sha256"), "folded_root")


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, with the tampering of the contract."""
    return prove(docs, tampering(), whole_proofs=False).withColumn("verified", F.col("folded_root") == F.col("root"))

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from beleg.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Every level of a tree over the nodes, by the definition."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        v = levels[-1]
        levels.append([H(*v[i:i + 2]) for i in range(0, len(v), 2)])
    return levels


def brute(rows):
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append(r)
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    trees = {v: tree([leaf(r) for r in sorted(by_lang[v], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for v in langs}
    top = tree([trees[v][-1][0] for v in langs])
    out = []
    for k, v in enumerate(langs):
        for i, r in enumerate(sorted(by_lang[v], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            value, proof = leaf((*r[:3], r[3] + 1, r[4])) if changed else leaf(r), []
            for levels, at in ((trees[v], i), (top, k)):
                for nodes in levels[:-1]:
                    pair = nodes[at & ~1:(at & ~1) + 2]
                    proof += [x for j, x in enumerate(pair) if j != at & 1]
                    pair[at & 1] = value
                    value, at = H(*pair), at >> 1
            out.append((r[0], leaf(r), trees[v][-1][0], top[-1][0], H(*proof), value, not changed))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in r))


@pytest.mark.parametrize("sizes", [[1], [2], [3], [1, 1], [1, 1, 1, 5], [17, 4, 1], [300, 9, 64, 65, 1, 2]])
def test_equals_a_tree_by_the_definition(spark, sizes):
    rng = random.Random(len(sizes) * 100 + sizes[0])
    rows = []
    for k, n in enumerate(sizes):
        lang = None if k == 1 else ["en", "é", "Z", "a", "zz", "b"][k]
        rows += [(rng.randrange(10 ** 12), rng.choice([None, "src", "größe"]), lang, rng.choice([None, 7, 12]), rng.choice([None, "", "text", "字 " * 50])) for _ in range(n)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, COLUMNS)
    got = merkle.prove(docs, merkle.tampering(), bits=3, whole_proofs=False).withColumn("verified", F.expr("folded_root = root"))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert order(map(tuple, got.collect())) == order(brute(rows))


def test_query_with_nulls_repeats_and_clashing_names(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (None, "s", None, 1, "x"), (5, "s", "en", 2 ** 63 - 1, "y"), (5, "s", "en", 3, "y"), (5, "s", "en", 3, "y")]
    rows += [(i, "s", "en", i, "t" * i) for i in range(40)] + [(8, "hot", "en", 1, "same")] * 50
    docs = spark.createDataFrame(rows, COLUMNS)
    for c in ("leaf", "tree", "idx", "value", "root", "at", "spread"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = merkle.judge(docs.repartition(5))
    assert order(map(tuple, got.collect())) == order(brute(rows))


def test_whole_proofs_fold_to_the_root(spark):
    rows = [(i, f"src{i % 3}", ["de", "en", "fr"][i % 3] if i % 7 else None, i, f"text {i}") for i in range(120)]
    for r in merkle.prove(spark.createDataFrame(rows, COLUMNS), bits=2).collect():
        assert merkle.fold(r["leaf"], r["proof"]) == r["root"] == r["folded_root"]
        assert merkle.fold(merkle.digest("other"), r["proof"]) != r["root"]


def test_empty_table(spark):
    assert merkle.judge(spark.createDataFrame([], COLUMNS)).collect() == []

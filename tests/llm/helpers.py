"""Brute-force counterparts shared by the tests."""

from __future__ import annotations


def union_find(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, **columns):
    """A documents table of texts (or (doc_id, text))."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, columns.get("lang"), columns.get("source", f"src{k % 3}"), None if t is None else len(t)) for k, (i, t) in enumerate(rows)], DOCUMENTS)

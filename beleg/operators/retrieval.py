"""First-stage retrieval for batches of questions.

The engine's own two scorers: BM25 over words and exact cosine over vectors. Both keep a
fixed breadth per query whatever the caller's limit, because copies are collapsed later.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beleg.functions.markers import RETRIEVAL_BREADTH
from beleg.functions.text import tokens

_K1, _B = 1.2, 0.75
UNITS = 1_000_000  # scores are summed as whole millionths: exact, whatever the partitioning


def query_terms(queries: DataFrame, text: str = "question") -> DataFrame:
    """(query_id, token), one row per distinct word of a question."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"))


def corpus_statistics(passages: DataFrame, text: str = "text") -> DataFrame:
    """One row (n, mean): passages and their mean length in words. Worth storing beside a corpus."""
    return passages.select(F.size(tokens(F.col(text))).alias("length")).agg(
        F.count("*").alias("n"), F.avg("length").alias("mean")
    )


def bm25_units(tf: Column, length: Column, df: Column, total: Column, mean: Column) -> Column:
    """The weight of one word of a question in one passage, in whole millionths."""
    idf = F.log(1 + (total - df + 0.5) / (df + 0.5))
    saturated = tf * (_K1 + 1) / (tf + _K1 * (1 - _B + _B * length / mean))
    return F.round(idf * saturated * UNITS).cast("bigint")


def retrieve(
    queries: DataFrame, passages: DataFrame, breadth: int = RETRIEVAL_BREADTH, text: str = "text",
    corpus: DataFrame | None = None,
) -> DataFrame:
    """Top ``breadth`` passages per query by BM25: (query_id, passage_id, score, rank).

    ``queries(query_id, question)``, ``passages(passage_id, text)``; ``corpus`` saves one scan
    when its statistics are at hand. Words that no question
    uses are dropped before any exchange; what is shuffled is one row per passage and
    question word, already counted map-side. No word is cut for being frequent: the weights of
    the asked words, one row per question and word, go to all tasks. Left to choose by sizes at
    run time, Spark sent the matched passages instead and scored them in one task.
    """
    terms = query_terms(queries)
    # An inner explode would have its input tokenised again in an inferred "not empty" filter.
    words = passages.select("passage_id", tokens(F.col(text)).alias("_tokens")).select(
        "passage_id", F.size("_tokens").alias("length"), F.explode_outer("_tokens").alias("token")
    )
    corpus = corpus_statistics(passages, text) if corpus is None else corpus
    statistics = corpus.select(F.struct("n", "mean")).scalar()
    total, mean = statistics["n"], statistics["mean"]

    counted = words.join(terms.select("token").distinct(), "token", "left_semi").groupBy(
        "token", "passage_id", "length"
    ).agg(F.count("*").alias("tf"))
    # Reading ``tf`` keeps this branch equal to the other one, so their exchange is shared.
    frequency = counted.groupBy("token").agg(F.count_if(F.col("tf") > 0).alias("df"))
    weights = counted.join(F.broadcast(terms.join(frequency, "token")), "token").withColumn("units", bm25_units(F.col("tf"), F.col("length"), F.col("df"), total, mean))
    scored = weights.groupBy("query_id", "passage_id").agg((F.sum("units") / UNITS).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("passage_id").asc())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= breadth)


def _unit_rows(vectors) -> np.ndarray:
    matrix = np.asarray(list(vectors), dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _best(query_ids, matrix, ids, vectors, k: int) -> pd.DataFrame:
    """The k best vectors of one batch for every query."""
    scores = np.round(_unit_rows(vectors) @ matrix.T, 6)
    ids = np.asarray(ids)
    parts = []
    for column, query_id in enumerate(query_ids):
        order = np.lexsort((ids, -scores[:, column]))[:k]
        parts.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[order], "score": scores[order, column]}))
    return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int = RETRIEVAL_BREADTH, block_rows: int = 4096) -> DataFrame:
    """Exact cosine top-k: (query_id, vec_id, score, rank).

    ``queries(query_id, embedding)``, ``vectors(vec_id, embedding)``. The queries are sent to the vectors in blocks of about
    ``block_rows``, however many there are: the driver and a task hold one block at a time. Each Arrow batch keeps its
    own k best per query, so at most k rows per query and batch are shuffled.
    """
    if k < 1:
        raise ValueError("k must be positive")
    id_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {id_type}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, score double"

    def scorer(query_ids: list, matrix: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch) and query_ids:
                    yield _best(query_ids, matrix, batch["vec_id"], batch["embedding"], k)

        return score

    n_blocks = max(1, -(-queries.count() // block_rows))
    partial = None
    for block in range(n_blocks):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block).select("query_id", "embedding").toPandas()
        query_ids = rows["query_id"].tolist()
        matrix = _unit_rows(rows["embedding"]) if query_ids else np.zeros((0, 1))
        found = vectors.select("vec_id", "embedding").mapInPandas(scorer(query_ids, matrix), schema)
        partial = found if partial is None else partial.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

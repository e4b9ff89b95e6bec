"""Order, deduplication, limits and shared source records of retrieved passages.

``scope`` is the answer a row belongs to (a query, a request, a topic). Every operator is
scoped, so nothing needs a total order over the data set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beleg.functions.text import is_blank, squeeze
from beleg.operators.annotate import source_json


def _columns(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _score(score: str) -> Column:
    return F.coalesce(F.col(score), F.lit(0.0))


def rank_hits(
    hits: DataFrame, scope: str | Sequence[str] = "query_id", score: str = "score", title: str = "title",
    rank: str = "rank",
) -> DataFrame:
    """Position by score (null counts 0), then title (null counts empty), then retrieval order."""
    order = Window.partitionBy(*_columns(scope)).orderBy(
        _score(score).desc(), F.coalesce(F.col(title), F.lit("")).asc(), F.col(rank).asc()
    )
    return hits.withColumn("pos", F.row_number().over(order))


def top_per_scope(df: DataFrame, limit: int, scope: str | Sequence[str] = "query_id", pos: str = "pos") -> DataFrame:
    """First ``limit`` rows of each scope by position, renumbered from 1.

    The rank filter is pushed below the exchange (each task keeps its own best ``limit``
    rows per scope), so a scope holding a third of all rows does not reach one task whole.
    """
    order = Window.partitionBy(*_columns(scope)).orderBy(F.col(pos).asc())
    return df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop(pos).withColumnRenamed(
        "_n", pos
    )


def passage_key(text: Column, pos: Column) -> Column:
    """Identity of a passage: its squeezed text, never its document; blanks stay apart.

    The digest stands for the text so that a shuffle carries 64 characters, not the passage.
    """
    return F.when(is_blank(text), F.concat(F.lit("empty:"), pos.cast("string"))).otherwise(
        F.sha2(squeeze(text), 256)
    )


def dedupe(
    passages: DataFrame, scope: str | Sequence[str] = "query_id", text: str = "text", score: str = "score",
    pos: str = "pos", queried_year: str | None = None, key: str | None = None,
) -> DataFrame:
    """Collapse equal texts within a scope.

    The best score wins (first of equals), at the first copy's position; with
    ``queried_year`` the years of all copies become the sorted ``queried_years``. All of it
    is one aggregate with partial merging, so many copies of one text shrink before the
    exchange. ``key`` names a precomputed passage key.
    """
    names = _columns(scope)
    key_column = F.col(key) if key else passage_key(F.col(text), F.col(pos))
    kept = [c for c in passages.columns if c not in {*names, pos, queried_year, key}]
    winner = F.max_by(F.struct(*kept), F.struct(_score(score), -F.col(pos))).alias("_row")
    aggregates = [winner, F.min(pos).alias(pos)]
    if queried_year:
        aggregates.append(F.array_sort(F.collect_set(queried_year)).alias("queried_years"))
    grouped = passages.withColumn("_key", key_column).groupBy(*names, "_key").agg(*aggregates)
    extra = ["queried_years"] if queried_year else []
    return grouped.select(*names, pos, *(F.col(f"_row.{c}").alias(c) for c in kept), *extra,
                          *([F.col("_key").alias(key)] if key else []))


def with_source_json(items: DataFrame, source: str = "source", source_fields: str = "core") -> DataFrame:
    """The projected source record as text; null where an item has no source."""
    column = F.col(source)
    return items.withColumn("source_json", F.when(column.isNotNull(), source_json(column, source_fields)))


def intern_sources(
    items: DataFrame, scope: str | Sequence[str] = "query_id", source: str = "source_json", pos: str = "pos",
) -> DataFrame:
    """``source_id`` s1, s2, ... per scope in order of first appearance; null without source.

    Two windows over one exchange on the scope. A scope is one answer, bounded by its
    result limit; the sources table is ``sources_of`` the result.
    """
    names = _columns(scope)
    first = F.min(F.when(F.col(source).isNotNull(), F.col(pos))).over(Window.partitionBy(*names, source))
    number = F.dense_rank().over(Window.partitionBy(*names).orderBy(F.col("_first").asc_nulls_last()))
    return items.withColumn("_first", first).withColumn(
        "source_id", F.when(F.col(source).isNotNull(), F.concat(F.lit("s"), number.cast("string")))
    ).drop("_first")


def sources_of(items: DataFrame, scope: str | Sequence[str] = "query_id", source: str = "source_json") -> DataFrame:
    """The shared sources table of interned items."""
    names = _columns(scope)
    return items.filter(F.col("source_id").isNotNull()).select(*names, "source_id", source).dropDuplicates(
        [*names, "source_id"]
    )


def resolve_hit_sources(
    items: DataFrame, sources: DataFrame, scope: str | Sequence[str] = "query_id", source: str = "source_json",
) -> DataFrame:
    """Re-expand ``source_id`` to its record; items without one keep a null source."""
    return items.drop(source).join(sources, [*_columns(scope), "source_id"], "left")


def token_overlap(question: Column, text: Column) -> Column:
    """Default passage scorer: share of the question's distinct words the passage holds."""
    from beleg.functions.text import tokens

    wanted = F.array_distinct(tokens(question))
    shared = F.size(F.array_intersect(wanted, tokens(text)))
    return F.when(F.size(wanted) > 0, F.round(shared / F.size(wanted), 6)).otherwise(F.lit(0.0))


def rerank(
    hits: DataFrame, top_k: int = 1, scorer=token_overlap, scope: str | Sequence[str] = "query_id",
    question: str = "question", text: str = "text", pos: str = "pos",
) -> DataFrame:
    """Score (question, passage), keep the best one or two; empty texts are left out.

    ``scorer`` maps two columns to a column: an expression, or an Arrow pandas UDF.
    """
    if top_k not in (1, 2):
        raise ValueError("top_k must be 1 or 2")
    scored = hits.filter(F.coalesce(F.col(text), F.lit("")) != "").withColumn(
        "rerank_score", scorer(F.col(question), F.col(text))
    )
    order = Window.partitionBy(*_columns(scope)).orderBy(F.col("rerank_score").desc_nulls_last(), F.col(pos).asc())
    return scored.withColumn("rerank_pos", F.row_number().over(order)).filter(F.col("rerank_pos") <= top_k)

from __future__ import annotations

import pandas as pd
import numpy as np
import pytest
from pyspark.sql import functions as F

from beleg.operators import ranking as R
from beleg.operators import retrieval
from beleg.plans import search as plans

HITS = "query_id int, pos int, score double, text string, title string, queried_year int"


def hits(spark, rows):
    return spark.createDataFrame(rows, HITS)


def test_dedupe_best_copy_at_first_position(spark):
    df = hits(spark, [(1, 1, 0.1, "a  b", "low", 2015), (1, 2, 0.5, "c", "c", 2015), (1, 3, 0.9, " a\nb ", "high", 2016), (1, 4, 0.9, "a b", "tie", 2015),
                      (2, 1, None, "a b", "other scope", 2015)])
    got = R.dedupe(df, queried_year="queried_year").orderBy("query_id", "pos").collect()
    assert [(r.query_id, r.pos, r.title, r.queried_years) for r in got] == [
        (1, 1, "high", [2015, 2016]), (1, 2, "c", [2015]), (2, 1, "other scope", [2015])]


def test_null_scores_tie_keeps_first_and_blanks_stay_apart(spark):
    df = hits(spark, [(1, 1, None, "x", "first", 1), (1, 2, 0.0, "x", "second", 1), (1, 3, 0.3, "", "e1", 1), (1, 4, 0.3, " ", "e2", 1)])
    got = R.dedupe(df).orderBy("pos").collect()
    assert [r.title for r in got] == ["first", "e1", "e2"]


def test_rank_and_limit(spark):
    df = hits(spark, [(1, 1, None, "a", "b", 0), (1, 2, 0.5, "b", None, 0), (1, 3, 0.5, "c", "a", 0), (1, 4, 0.5, "d", None, 0)]).withColumnRenamed("pos", "rank")
    got = R.top_per_scope(R.rank_hits(df), 3).orderBy("pos").collect()
    assert [(r.pos, r["rank"]) for r in got] == [(1, 2), (2, 4), (3, 3)]


def test_intern_and_resolve(spark):
    df = spark.createDataFrame([(1, 1, "B"), (1, 2, "A"), (1, 3, "B"), (1, 4, None), (2, 1, "A")], "query_id int, pos int, source_json string")
    items = R.intern_sources(df)
    got = [(r.query_id, r.pos, r.source_id) for r in items.orderBy("query_id", "pos").collect()]
    assert got == [(1, 1, "s1"), (1, 2, "s2"), (1, 3, "s1"), (1, 4, None), (2, 1, "s1")]
    back = R.resolve_hit_sources(items, R.sources_of(items)).orderBy("query_id", "pos").collect()
    assert [r.source_json for r in back] == ["B", "A", "B", None, "A"]


def test_rerank_accepts_arrow_scorers(spark):
    @F.pandas_udf("double")
    def by_length(question: pd.Series, text: pd.Series) -> pd.Series:
        return text.str.len().astype("float64")

    df = spark.createDataFrame([(1, 1, "q w", "q"), (1, 2, "q w", "q w longer"), (1, 3, "q w", ""), (1, 4, "q w", "w q")], "query_id int, pos int, question string, text string")
    assert [r.pos for r in R.rerank(df, 2).orderBy("rerank_pos").collect()] == [2, 4]
    assert [r.pos for r in R.rerank(df, 1, by_length).collect()] == [2]
    with pytest.raises(ValueError):
        R.rerank(df, 3)


def brute_force_top(queries, vectors, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(queries) @ unit(vectors).T, 6)
    return {(q, int(v)) for q in range(len(queries)) for v in sorted(range(len(vectors)), key=lambda v: (-scores[q, v], v))[:k]}


def test_vector_top_k_in_one_block_and_in_several(spark):
    rng = np.random.default_rng(3)
    queries, vectors = rng.normal(size=(7, 5)), rng.normal(size=(90, 5))
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<double>")
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "vec_id long, embedding array<double>")
    want = brute_force_top(queries, vectors, 4)
    assert {(r.query_id, r.vec_id) for r in retrieval.vector_top_k(q, v, 4).collect()} == want
    assert {(r.query_id, r.vec_id) for r in retrieval.vector_top_k(q, v, 4, block_rows=2).collect()} == want


PASSAGES = "passage_id long, text string, title string, file_type string, language string, media_type string, created_at string, last_updated_at string"


def corpus(spark, texts):
    return spark.createDataFrame([(i, t, f"2020-01-0{1 + i % 9}_doc-{i}.pdf", "PDF", "de", None, None, None) for i, t in enumerate(texts)], PASSAGES)


def test_search_limits_after_collapsing_copies(spark):
    passages = corpus(spark, ["solar power 2020"] * 30 + ["solar wind", "solar only here", "nothing"])
    queries = spark.createDataFrame([(1, "solar")], "query_id long, question string")
    answer = plans.search(queries, passages, max_results=3)
    rows = answer.items.orderBy("pos").collect()
    assert len({r.text for r in rows}) == 3 and [r.pos for r in rows] == [1, 2, 3]
    assert {r.source_id for r in answer.sources.collect()} == {"s1", "s2", "s3"}
    with pytest.raises(ValueError):
        plans.search(queries, passages, max_results=26)


def test_results_do_not_depend_on_partitioning(spark):
    passages = corpus(spark, [f"word{i % 7} word{i % 3} common {i % 5}" for i in range(200)])
    queries = spark.createDataFrame([(i, f"word{i} common") for i in range(5)], "query_id long, question string")
    shape = lambda df: sorted(map(tuple, df.select("query_id", "passage_id", "score", "rank").collect()))
    first = shape(retrieval.retrieve(queries, passages))
    assert first == shape(retrieval.retrieve(queries.repartition(3), passages.repartition(13).orderBy(F.rand(1))))


def test_timeline_merges_years_and_checks_its_range(spark):
    passages = corpus(spark, ["metric 2019 and 2020 value", "metric 2021", "metric"])
    good = spark.createDataFrame([(1, "metric", 2019, 2021)], "request_id long, metric string, start_year int, end_year int")
    answer = plans.timeline(good, passages)
    rows = answer.items.orderBy("pos").collect()
    assert "text" not in answer.items.columns and rows[0].queried_years == [2019, 2020, 2021]
    assert answer.summary.first().duplicates_collapsed == 6
    for start, end in ((2021, 2020), (2010, 2020)):
        bad = spark.createDataFrame([(1, "metric", start, end)], good.schema)
        with pytest.raises(Exception, match="the range ends in 2020|11 years from 2010"):
            plans.timeline(bad, passages).items.collect()


def test_charts_by_topic(spark):
    passages = corpus(spark, ["<title>PV</title> solar <data>Year,newly installed 2020,1 2021,2</data>", "solar without data"])
    topics = spark.createDataFrame([(1, "solar")], "topic_id long, topic string")
    rows = plans.get_charts(topics, passages).items.collect()
    assert len(rows) == 1 and rows[0].row_count == 2 and rows[0].source_id == "s1"
    tuned = plans.probe_queries(topics, ("only {topic}",)).collect()
    assert [r.question for r in tuned] == ["only solar"]
    with pytest.raises(Exception, match="topic must not be empty"):
        plans.probe_queries(spark.createDataFrame([(1, " ")], "topic_id long, topic string")).collect()

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from beleg.operators.retrieval import retrieve
from beleg.plans import search as plans
from beleg.sources import postings

WORDS = ["".join(c) for c in zip("abcdefghijklmnopqrst", "tsrqponmlkjihgfedcba")]


def corpus(spark, n=300, seed=4):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, weights=range(1, 21), k=rng.randint(0, 40))) for _ in range(n)] + [None, "", "...", "é É é", "at at AT"]
    rows = [(i, t, f"{i % 7}.pdf", "PDF", "en", None, None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "passage_id long, text string, title string, file_type string, language string, media_type string, created_at string, last_updated_at string")


def questions(spark, n=40, seed=5):
    rng = random.Random(seed)
    rows = [(f"q{i}", " ".join(rng.choices([*WORDS, "unheard"], k=rng.randint(1, 4)))) for i in range(n)]
    return spark.createDataFrame([*rows, ("none", "unheard"), ("empty", ""), ("null", None)], "query_id string, question string")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return postings.write_postings(corpus(spark), str(tmp_path_factory.mktemp("index")), groups=8)


def found(df):
    return sorted((r["query_id"], r["rank"], r["passage_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("terms_at_a_time", [7, 1000])
def test_equals_retrieval_by_a_scan(spark, index, terms_at_a_time):
    asked = questions(spark)
    want = found(retrieve(asked, corpus(spark), 11))
    assert want and found(postings.retrieve_indexed(asked, index, 11, terms_at_a_time)) == want


def test_reads_folders_of_asked_words_only_and_shuffles_once(spark, index):
    asked = spark.createDataFrame([("q", WORDS[3])], "query_id string, question string")
    hits = postings.retrieve_indexed(asked, index, 5)
    group = spark.range(1).select(postings._group(F.lit(WORDS[3]), index.groups)).first()[0]
    executed = hits._jdf.queryExecution().executedPlan().toString()
    assert f"word_group" in executed and "Bucketed: true" in hits._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert {f.rsplit("word_group=", 1)[1].split("/")[0] for f in index.postings.filter(F.col("word_group") == group).inputFiles() if "word_group=" in f} >= {str(group)}
    # What is shuffled of postings are ranked rows: the only exchange besides broadcasts of question words is by query.
    shuffles = [line for line in executed.splitlines() if "Exchange hashpartitioning" in line and "block" in line]
    assert not shuffles
    assert any("WindowGroupLimit" in line and "Partial" in line for line in executed.splitlines())


def test_opened_again(spark, tmp_path):
    path = str(tmp_path / "index")
    postings.write_postings(corpus(spark, 60), path, groups=3, blocks=2)
    again = postings.read_postings(spark, path)
    assert (again.groups, again.blocks, again.n) == (3, 2, 65)
    asked = questions(spark, 10)
    assert found(postings.retrieve_indexed(asked, again)) == found(retrieve(asked, corpus(spark, 60)))


def test_plans_with_and_without_an_index(spark, index):
    asked, passages = questions(spark, 6), corpus(spark)
    plain, stored = (plans.search(asked, passages, index=i) for i in (None, index))
    key = lambda answer: sorted((r["query_id"], r["pos"], r["passage_id"], r["score"]) for r in answer.items.collect())
    assert key(plain) == key(stored) and sorted(map(tuple, plain.summary.collect())) == sorted(map(tuple, stored.summary.collect()))
    requests = spark.createDataFrame([(1, WORDS[0], 2000, 2002), (2, "unheard", 2001, 2001)], "request_id long, metric string, start_year int, end_year int")
    plain, stored = (plans.timeline(requests, passages, index=i) for i in (None, index))
    assert sorted(map(tuple, plain.summary.collect())) == sorted(map(tuple, stored.summary.collect()))


def test_empty_corpus_and_no_questions(spark, index, tmp_path):
    empty = postings.write_postings(corpus(spark).limit(0), str(tmp_path / "none"))
    assert postings.retrieve_indexed(questions(spark, 2), empty).collect() == []
    assert postings.retrieve_indexed(questions(spark, 2).limit(0), index).collect() == []

from __future__ import annotations

from beleg.operators.retrieval import retrieve


def test_matches_stay_where_they_are(spark):
    """What is sent to all tasks is the asked words' weights, however the passages that hold them compare in size."""
    passages = spark.createDataFrame([(i, "wagon " * (i % 3) + "yard") for i in range(50)], "passage_id long, text string")
    found = retrieve(spark.createDataFrame([(1, "Wagon"), (2, "yard wagon")], "query_id int, question string"), passages, breadth=40)
    assert found.filter("query_id = 1").count() == 33 and found.filter("query_id = 2").count() == 40
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan

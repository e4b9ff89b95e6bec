from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from beleg.sources import records
from beleg.streaming import buckets, ingest

SCHEMA = "doc_id string, text string, ingest_seq bigint"


def put(spark, path, rows, batch_id, checkpoint="c", n=8):
    return buckets.upsert(path, SCHEMA, spark.createDataFrame(rows, SCHEMA), checkpoint, batch_id, buckets=n)


def table(spark, path):
    return {r["doc_id"]: (r["text"], r["ingest_seq"]) for r in buckets.read_buckets(spark, path, SCHEMA).collect()}


def folders(path, version):
    return sorted(p.name for p in Path(path, "data", f"version={version}").glob("bucket=*"))


def test_equals_a_dictionary(spark, tmp_path):
    rng, path, want = random.Random(7), str(tmp_path / "t"), {}
    for batch_id in range(4):
        rows = [(f"d{rng.randint(0, 30)}", f"t{rng.random()}", batch_id * 100 + k) for k in range(rng.randint(1, 12))]
        put(spark, path, rows, batch_id)
        for doc_id, text, seq in rows:
            want[doc_id] = (text, seq)
        assert table(spark, path) == want
    late = put(spark, path, [("d1", "older", -5)], 9)
    assert table(spark, path) == want | {"d1": want.get("d1", ("older", -5))} and late.top == 300 + len(rows) - 1


def test_a_batch_of_one_id_rewrites_one_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, [(f"d{i}", "x", 0) for i in range(200)], 0)
    assert len(folders(path, 0)) == 8
    state = put(spark, path, [("d17", "y", 1)], 1)
    assert len(folders(path, 1)) == 1 and sorted(state.live.values()) == [0] * 7 + [1]
    assert len(table(spark, path)) == 200 and table(spark, path)["d17"] == ("y", 1)
    only = buckets.read_buckets(spark, path, SCHEMA, [b for b, v in state.live.items() if v == 1])
    assert all("version=1/" in f for f in only.inputFiles()) and only.filter("doc_id = 'd17'").count() == 1


def test_replays_other_checkpoints_and_unfinished_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, [("a", "1", 1)], 0)
    assert put(spark, path, [("a", "again", 9)], 0).version == 0 and table(spark, path) == {"a": ("1", 1)}
    # A version without a commit is not seen, and is written anew.
    spark.createDataFrame([("zz", "half", 5, 3)], f"{SCHEMA}, bucket int").write.partitionBy("bucket").parquet(f"{path}/data/version=1")
    assert table(spark, path) == {"a": ("1", 1)}
    put(spark, path, [("b", "2", 2)], 0, "other", n=3)
    assert table(spark, path) == {"a": ("1", 1), "b": ("2", 2)} and buckets.state_of(spark, path).buckets == 8
    assert put(spark, path, [], 5).version == 1


def test_empty(spark, tmp_path):
    assert buckets.read_buckets(spark, str(tmp_path / "none"), SCHEMA).collect() == []
    assert put(spark, str(tmp_path / "none"), [], 0).version is None


OBJECT = "key string, size long, last_modified timestamp, etag string, content binary"


def stream_of(spark, folder):
    return spark.readStream.schema(OBJECT).parquet(folder)


def add(spark, folder, *objects):
    rows = [(key, len(text), None, etag, text.encode()) for key, text, etag in objects]
    spark.createDataFrame(rows, OBJECT).withColumn("last_modified", F.current_timestamp()).coalesce(1).write.mode("append").parquet(folder)


def test_ingest_knows_what_is_done_without_reading_the_log(spark, tmp_path, monkeypatch):
    source, docs = str(tmp_path / "in"), str(tmp_path / "docs")
    add(spark, source, ("a.md", "one", "e1"), ("b.md", "two", "e1"))
    ingest.incremental_ingest(stream_of(spark, source), docs, str(tmp_path / "c1"), buckets=4)
    read = lambda: sorted((r["source_uri"], r["text"], r["ingest_seq"]) for r in records.read_log(spark, docs).collect())
    first = read()
    assert [r[:2] for r in first] == [("a.md", "one"), ("b.md", "two")]
    add(spark, source, ("a.md", "one", "e1"), ("b.md", "two, changed", "e2"), ("c.md", "three", "e1"))
    with monkeypatch.context() as m:
        m.setattr(ingest, "read_log", lambda *a: pytest.fail("the log is read"))
        ingest.incremental_ingest(stream_of(spark, source), docs, str(tmp_path / "c1"), buckets=4)
    assert read() == sorted([*first, ("b.md", "two, changed", first[0][2] + 1), ("c.md", "three", first[0][2] + 1)])
    # A new checkpoint sees all objects again and appends nothing; so does one beside a log without the table.
    ingest.incremental_ingest(stream_of(spark, source), docs, str(tmp_path / "c2"), buckets=4)
    Path(ingest.known_path(docs)).rename(tmp_path / "gone")
    add(spark, source, ("d.md", "four", "e1"))
    before = len(read())
    ingest.incremental_ingest(stream_of(spark, source), docs, str(tmp_path / "c3"), buckets=4)
    assert len(read()) == before + 1 and max(r[2] for r in read()) == first[0][2] + 2

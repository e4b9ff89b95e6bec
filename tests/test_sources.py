from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from beleg.operators import documents as D
from beleg.operators import gateway_log as L
from beleg.operators.extraction import extract_with, extract_with_gazetteer
from beleg.plans.build import run_build
from beleg.sources import feedback, objects, records
from beleg.streaming import gateway, jobs
from beleg.sources.triples import read_graph


def write(root, **files):
    for name, body in files.items():
        path = root / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)


def test_build_resumes_and_rebuilds_from_the_whole_log(spark, tmp_path):
    source, work = tmp_path / "in", tmp_path / "work"
    write(source, **{"a__x.md": b'---\ntitle: "T"\n---\nWasserkraft und Netz', "b.json": b'{"k": 1, "n": {"x": 1}}', "c.txt": b"bad \xff byte"})
    write(source, **{"a__x.md.metadata.json": json.dumps({"metadataAttributes": {"title": {"value": {"stringValue": "Side"}}}}).encode()})
    labels = spark.createDataFrame([("Wasserkraft",), ("netz",)], "label string")
    run = lambda: run_build(spark, str(source), str(work), "https://e.org/", lambda docs: extract_with_gazetteer(docs, labels))
    run()
    docs = {r.source_uri.rsplit("/", 1)[-1]: r for r in records.read_log(spark, str(work / "documents")).collect()}
    assert set(docs) == {"x.md", "b.json", "c.txt"}
    assert docs["x.md"].properties == {"title": "Side"} and docs["x.md"].text == "Wasserkraft und Netz"
    assert docs["b.json"].properties == {"k": "1"} and docs["c.txt"].text == "bad � byte"
    first = {tuple(r) for r in read_graph(spark, str(work / "graph")).collect()}
    assert any(t[1].endswith("relprop/mentioned_with") for t in first)
    run()
    assert records.read_log(spark, str(work / "documents")).count() == 3
    write(source, **{"c.txt": b"longer than before", "d.txt": b"new Netz"})
    run()
    log = records.read_log(spark, str(work / "documents"))
    assert log.count() == 5 and D.latest_by_id(log).count() == 4
    uris = {t[2] for t in (tuple(r) for r in read_graph(spark, str(work / "graph")).collect()) if t[1].endswith("sourceUri")}
    assert len(uris) == 4 and records.read_manifest(spark, str(work / "manifest")).count() == 4
    listed = objects.list_objects(spark, str(source), prefix="a/").collect()
    assert [(r.key, r.extension) for r in listed] == [("a/x.md", "md")]


def test_failing_extractions_are_left_out(spark):
    def extractor(text):
        if "bad" in text:
            raise ValueError(text)
        return {text}, {(text, "p", "o")}

    docs = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", " ")], "doc_id string, text string")
    got = extract_with(docs, extractor, "m").collect()
    assert [(r.doc_id, r.entities, r.mention_counts) for r in got] == [("1", ["good"], {"good": 1, "o": 0})]


def test_choose_extraction(spark):
    long = "x" * 200
    rows = [(1, long, "y" * 500, {}), (2, "short", "longer text", {}), (3, "same", "four", {}), (4, None, " ", {"a": "b"})]
    got = D.choose_extraction(spark.createDataFrame(rows, "i int, primary_text string, fallback_text string, properties map<string,string>"), max_chars=50).orderBy("i").collect()
    assert [(r.text, r.text_truncated) for r in got] == [("x" * 50, True), ("longer text", False), ("same", False), ("", False)]
    assert set(got[3].properties) == {"a", "extractionWarning"} and got[0].properties == {}


@pytest.mark.parametrize("size", [1, 7, 40, 5000])
def test_chunks_keep_the_whole_text(spark, size):
    text = "One sentence. Two!\nThree? " + "nowhitespace" * 9 + " tail. End"
    got = D.chunk_documents(spark.createDataFrame([(1, text), (2, "")], "doc_id int, text string"), size).orderBy("chunk_no").collect()
    assert "".join(r.text for r in got) == text and max(len(r.text) for r in got) <= size
    if size == 40:
        assert got[0].text == "One sentence. Two!\nThree? "


def test_pending(spark):
    listed = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "key string, etag string")
    docs = spark.createDataFrame([("r/a", "1"), ("r/b", "old"), ("r/c", None)], "source_uri string, etag string")
    assert sorted(r.key for r in D.pending_objects(listed, docs, "r/").collect()) == ["b", "d"]
    manifest = spark.createDataFrame([("a", "1"), ("b", "old")], "key string, etag string")
    assert sorted(r.key for r in D.pending_by_manifest(listed, manifest).collect()) == ["b", "c", "d"]


def test_feedback(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1, 23, 59), " q ", "", None, "s", {"n": "1"}), (datetime.datetime(2024, 1, 2, 0, 1), "q2", "a", "r", "s", None)]
    df = spark.createDataFrame(rows, feedback.SCHEMA)
    for _ in range(2):
        feedback.append_feedback(df, str(tmp_path / "f"))
    got = feedback.read_feedback(spark, str(tmp_path / "f"))
    assert got.count() == 4 and got.select("day").distinct().count() == 2
    entry = feedback.render_entry(got.filter("user_question = 'q'")).first().entry
    assert entry.startswith("## 2024-01-01T23:59:00Z\n\n**user_question**\n\nq\n\n**answer**\n\n_not provided_") and entry.endswith("**n**\n\n1\n")


LOG = "ts timestamp, method string, latency_ms double, status int"


def log_rows(*minutes):
    return [(datetime.datetime(2024, 1, 1, 12, 0) + datetime.timedelta(minutes=m), "tools/call", float(m), 200) for m in minutes]


def test_late_rows_are_dropped_and_streams_match_batch(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    stream = lambda: spark.readStream.schema(LOG).parquet(source)
    for minutes in ((1, 2, 61), (90,), (3, 88)):  # minute 3 comes when the watermark has passed it
        spark.createDataFrame(log_rows(*minutes), LOG).coalesce(1).write.mode("append").parquet(source)
        late = jobs.update_table(gateway.request_metrics(stream()), table, checkpoint)
    assert late == 1
    got = {r.window_start.minute + 60 * r.window_start.hour - 720: r.calls for r in jobs.current_rows(spark, table, ["window_start", "method"]).collect()}
    assert got == {0: 2, 60: 1, 85: 1, 90: 1}
    on_time = spark.createDataFrame(log_rows(1, 2, 61, 90, 88), LOG)
    assert {r.calls for r in L.request_counts(on_time).collect()} == {1, 2}


def test_percentiles(spark):
    df = spark.createDataFrame(log_rows(*[0] * 3) + [(datetime.datetime(2024, 1, 1, 12, 1), "m", v, 200) for v in (10.0, 20.0, 20.0, 40.0)], LOG)
    batch, stream_form = L.latency_percentiles(df).first(), L.streaming_percentiles(df).first()
    assert tuple(batch) == tuple(stream_form) and batch.p50 == 10.0


def test_requests_keep_nested_braces(spark):
    body = "{id=1, method=tools/call, params={name=t, arguments={query=a, f={b=c}}}}"
    rows = [(body, None, None, None), ("{method=tools/list}", "x isError=true", None, None), (None, None, None, "Error: x"), (None, None, "true", None)]
    df = spark.createDataFrame(rows, "request_body string, response_body string, gateway_error string, log string")
    assert [(r.tool, r.args) for r in L.parse_requests(df).collect()] == [("t", "query=a, f={b=c}")]
    assert L.failures(df).count() == 3


def test_hooks_see_saved_batches(spark, tmp_path):
    from beleg.streaming.ingest import incremental_ingest

    source, seen = str(tmp_path / "o"), []
    rows = [("a.txt", 1, "e", datetime.datetime(2024, 1, 1), bytearray(b"x")), ("a.txt.metadata.json", 1, "e", None, bytearray(b"{}"))]
    schema = "key string, size long, etag string, last_modified timestamp, content binary"
    spark.createDataFrame(rows, schema).write.parquet(source)
    incremental_ingest(spark.readStream.schema(schema).parquet(source), str(tmp_path / "d"), str(tmp_path / "c"), "r/",
                       lambda docs, batch: seen.extend(r.source_uri for r in docs.collect()))
    assert seen == ["r/a.txt"]

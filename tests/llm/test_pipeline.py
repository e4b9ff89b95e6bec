import corpus_pipeline
from helpers import DOCUMENTS
from test_decontaminate import slow as slow_benchmark
from test_lines import slow as slow_lines
from test_simhash import want_components

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_equal_brute_force(spark):
    assert [f for _, f in corpus_pipeline.STAGES] == [
        corpus_pipeline.identify_language, corpus_pipeline.dedupe_lines, corpus_pipeline.dedupe_documents, corpus_pipeline.remove_benchmark, corpus_pipeline.mix_sources]
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(150)
    extra = [(10_000, None, "en", "src0", 0), (10_001, "12 %%", "en", None, 5), (10_002, "", None, "src1", 0)]
    docs = documents.union(spark.createDataFrame(extra, DOCUMENTS)).cache()
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], FOLDER).cache())
        assert steps[-1].columns[:5] == docs.columns
    language, lines, single, clean, mixed = map(rows_of, steps[1:])
    assert sorted(language) == sorted(r for r in rows_of(docs) if r[1] and any(c.isalpha() for c in r[1]))
    want = slow_lines(language)
    assert sorted(lines) == sorted((i, t) for i, t in want.items() if t.split())
    assert all(r["n_chars"] == len(r["text"]) for r in steps[2].collect())
    _, groups = want_components(lines)
    assert sorted(single) == sorted(r for r in lines if groups[r[0]] == r[0])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hits = slow_benchmark(single, items)
    assert sorted(clean) == sorted(r for r in single if not hits[r[0]][4])
    assert sorted(mixed) == sorted(clean)


def test_run_and_extra_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(40).selectExpr("*", "1 AS slot", "'r' AS row")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "stream", "block", "release", "deadline", "_slot", "place"] and 0 < out.count() <= 40
    empty = spark.createDataFrame([], DOCUMENTS)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, FOLDER)
        assert empty.collect() == []


def test_documents_without_any_label_stay(spark):
    docs = spark.createDataFrame([(1, "some text", None, "s", 9), (2, "12 %", None, "s", 4), (3, None, None, "s", None), (4, "é", None, "s", 1)], DOCUMENTS)
    assert sorted(rows_of(corpus_pipeline.identify_language(spark, docs, FOLDER))) == [(1, "some text"), (4, "é")]

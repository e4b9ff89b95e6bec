from __future__ import annotations

import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from beleg.checks import all_queries
from beleg.checks.registry import _STORED, runnable
from beleg.functions.iris import XSD
from beleg.sources import triples as T

SMOKE = "/root/testdata/sf0.001"
TRIPLE = "s string, p string, o string, o_kind string, o_type string"
all_queries.load()


def test_lines_are_read_as_the_pattern_reads_them(spark):
    """Lines cut at their separators and lines that are matched, against the pattern alone; an IRI may hold a space."""
    subjects, predicates = ("<http://k/s>", "_:b", "<>", "<a b>", '<a"b>', "", "\t<x>"), ("<http://k/p>", '<p"q>', "<>", "_:p")
    objects = ("<http://o>", "<>", "_:o", '"t"', '"a > b"', '"a \\" b"', '"x"^^<http://t>', '"x"^^<>', '"x"@de', '"q"^^<a"b>', '"', '""', '"a" "b"', "<o", '"é😀"', '"x"^^', '" ."', '"> ."')
    lines = [f"{s} {p} {o}{end}" for s, p, o, end in product(subjects, predicates, objects, (" .", ".", " . # c", " . x", "", "> .", " .\n"))]
    wanted = []
    for line in lines:
        m = re.match(T._STATEMENT.replace(r"\s*(?:#.*)?$", r"\s*(?:#.*)?(?:\n)?\Z"), line)
        if m:
            s, blank, p, o, o_blank, text, datatype, tag = m.groups()
            literal = None if text is None else text.replace('\\"', '"')
            kind = "literal" if text is not None else "blank" if o_blank else "iri"
            wanted.append((blank or s, p, o_blank or o if text is None else literal, kind, None if text is None else datatype or tag or XSD + "string"))
    got = [tuple(r) for r in T.from_ntriples(spark.createDataFrame([(v,) for v in [*lines, None]], "value string")).collect()]
    assert len(wanted) > 500 and sorted(got, key=str) == sorted(wanted, key=str)


def test_plain_lines_are_cut_without_a_pattern(spark):
    made = spark.createDataFrame([("http://k/s", "http://k/p", "o", "literal", None), ("http://k/s", "http://k/p", "5", "literal", XSD + "integer"), ("s", "p", "o", "iri", None)], TRIPLE)
    lines = T.to_ntriples(made).unionByName(spark.createDataFrame([("_:b <p> <o> .",)], "value string"))
    read = T.from_ntriples(lines)
    assert read.count() == 4
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and plan.count("split(") == 2  # once for every line, once for those that are matched


def test_overlay_does_not_exchange_the_graph(spark, tmp_path):
    graph = spark.range(2000).select(F.concat(F.lit("s"), "id").alias("s"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("p"),
                                     F.lit("o").alias("o"), F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("o_type"))
    over = spark.createDataFrame([("s0", "a", "o", "literal", None), ("s1", "a", "o", "literal", None), ("s3", "c", "o", "literal", None)], TRIPLE)
    paths = [str(tmp_path / name) for name in ("graph", "over", "again")]
    for rows, path in zip((graph, over, over), paths):
        T.write_overlay(rows, path)
    for some in (paths[:1], paths[:2], paths):
        kept, plain = T.read_graph(spark, *some, sets=True), T.read_graph(spark, *some)
        assert sorted(kept.collect(), key=str) == sorted(plain.collect(), key=str)
        assert "hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    assert T.read_graph(spark, *paths, sets=True).count() == 2002
    assert all("zstd" in f.name for f in tmp_path.glob("graph/*/part-*"))


@pytest.mark.parametrize("query", ["s8_write_graph", "s9_read_ntriples", "s11_write_overlay"])
def test_files_are_written_from_the_build(spark, query):
    before = set(_STORED)
    assert runnable(query)(spark, SMOKE).count() > 20
    assert not [k for k in set(_STORED) - before if k[2] == "graph"]


def test_timeline_numbers_its_passages_once(spark):
    summary = runnable("r5b_timeline_summary")(spark, SMOKE)
    assert summary.count() == 5
    assert "l_shipdate" not in summary._jdf.queryExecution().optimizedPlan().toString()

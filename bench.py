"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is warmed by one run, on a smaller folder beside the measured one where there is one, and then has up
to BENCH_RUNS timed runs (median, default 3) within BENCH_SECONDS (default 15; at least one run). Throughput figures relate the
time to the input that was worked on: a batch measure, not comparable with the latency of
one interactive request.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from beleg.checks import all_queries
from beleg.checks.fixtures import Inputs
from beleg.checks.graph_inputs import triples
from beleg.checks.passage_queries import indexed
from beleg.checks.registry import QUERIES
from beleg.session import configure

HEADLINE = {
    "r1_retrieve_bm25": ("questions/s", lambda d: d.questions.count()),
    "r1c_retrieve_indexed": ("questions/s", lambda d: d.questions.count()),
    "r1d_write_index": ("passages/s", lambda d: d.documents.count()),
    "r4_search": ("questions/s", lambda d: d.questions.count()),
    "r5_timeline": ("requests/s", lambda d: d.region.count()),
    "c9_get_charts": ("topics/s", lambda d: d.chart_blocks.count()),
    "r1b_vector_top_k": ("vectors/s", lambda d: d.embeddings.count()),
    "r3_dedupe": ("passages/s", lambda d: d.lineitem.count()),
    "r10_intern_sources": ("passages/s", lambda d: d.lineitem.count()),
    "p2_bases": ("passages/s", lambda d: d.lineitem.count()),
    "p3_years_covered": ("passages/s", lambda d: d.lineitem.count()),
    "p4_truncation": ("passages/s", lambda d: d.lineitem.count()),
    "p9_mention_count": ("documents/s", lambda d: d.documents.count()),
    "p18_chunk_documents": ("documents/s", lambda d: d.documents.count()),
    "j1_match_publications": ("names/s", lambda d: d.orders.count()),
    "j2_match_with_fallback": ("names/s", lambda d: d.orders.count()),
    "g7_build_graph": ("triples/s", lambda d: triples(d).count()),
    "g13_annotate_graph": ("triples/s", lambda d: triples(d).count()),
    "g17_clean_graph": ("triples/s", lambda d: triples(d).count()),
    "g18_neighbor_edges": ("triples/s", lambda d: triples(d).count()),
    "g19_match_patterns": ("triples/s", lambda d: triples(d).count()),
    "a9_questions_ranked": ("events/s", lambda d: d.events.count()),
    "t5_latency_percentiles_batch": ("events/s", lambda d: d.events.count()),
    "t4c_request_metrics_stream": ("events/s", lambda d: d.events.count()),
}
#: These answer from an index that is written once per corpus: what that takes is r1d_write_index, not part of their time.
INDEXED = {"r1c_retrieve_indexed": "doc_passages", "r4_search": "doc_passages", "r5_timeline": "line_passages"}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs, budget = int(os.environ.get("BENCH_RUNS", "3")), float(os.environ.get("BENCH_SECONDS", "15"))
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.01")
    small = small if os.path.isdir(small) else folder
    names = sys.argv[1:] or list(HEADLINE)
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    all_queries.load()
    d, seconds, throughput = Inputs(spark, folder), {}, {}

    def run(name: str, where: str = folder) -> float:
        start = time.perf_counter()
        QUERIES[name](Inputs(spark, where)).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in names:
        run(name, small)
        if name in INDEXED:
            indexed(Inputs(spark, folder), INDEXED[name])
        taken = [run(name)]
        while len(taken) < runs and sum(taken) + taken[-1] <= budget:
            taken.append(run(name))
        seconds[name] = round(statistics.median(taken), 3)
        unit, size = HEADLINE.get(name, (None, None))
        if size is not None:
            throughput[name] = f"{size(d) / seconds[name]:.3g} {unit}"
        print(f"{name}: {seconds[name]}s {throughput.get(name, '')}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "throughput": throughput, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

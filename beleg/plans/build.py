"""The graph build: always from the whole log, never from the last run alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beleg.functions.text import is_blank
from beleg.session import cut_lineage
from beleg.operators.documents import latest_by_id, pending_extractions
from beleg.operators.graph_clean import consolidate_records, merge_records, report_of_counts, triple_counts
from beleg.operators.graph_build import (
    expand_triples, graph_documents, graph_entities, graph_labels, graph_properties, graph_relations,
)
from beleg.sources.objects import list_objects
from beleg.sources.records import DOCUMENT_SCHEMA, EXTRACTION_SCHEMA, append_log, read_log, write_manifest
from beleg.sources.triples import write_graph
from beleg.sources.vocabulary import Vocabulary


def build_graph(docs: DataFrame, extractions: DataFrame | None, base: str, apart: bool = False) -> DataFrame:
    """Triples of all documents and extractions; the last record of an id counts.

    Of a text only whether there is any enters the graph, so bodies are left behind before records are exchanged;
    every table then starts at that one exchange. ``apart`` is for readers of a few predicates (``triples_of``).
    """
    bare = docs.withColumn("text", F.when(~is_blank(F.col("text")), "x"))
    latest = latest_by_id(bare.select(*(c for c in bare.columns if c != "etag")))
    if extractions is None:
        return expand_triples(base, graph_documents(latest, base), graph_properties(latest, base, "doc_id"), apart=apart)
    graphs = latest_by_id(extractions)
    return expand_triples(
        base, graph_documents(latest, base), graph_properties(latest, base, "doc_id"), graph_labels(graphs, base),
        graph_entities(graphs, base), graph_relations(graphs, base, "doc_id"), apart,
    )


def build_merged_graph(docs: DataFrame, extractions: DataFrame, vocab: Vocabulary, base: str) -> DataFrame:
    """``build_graph`` with predicates folded and entities merged: the same triples as those passes over the built graph leave.

    Nothing of the raw graph is written; see ``consolidate_records``.
    """
    return build_graph(docs, None, base).unionByName(consolidate_records(latest_by_id(extractions), vocab, base))


def build_clean_graph(docs: DataFrame, extractions: DataFrame, vocab: Vocabulary, base: str) -> DataFrame:
    """``build_merged_graph`` without orphans: the same triples as ``clean_graph`` leaves of the built graph, of which nothing is written."""
    return build_graph(docs, None, base).unionByName(merge_records(latest_by_id(extractions), vocab, base, prune=True).triples)


def build_clean_report(docs: DataFrame, extractions: DataFrame, vocab: Vocabulary, base: str) -> DataFrame:
    """The ``clean_report`` of a graph and what ``build_clean_graph`` leaves of it: both are counted as they are made, documents once for both."""
    graphs = latest_by_id(extractions)
    about_documents = triple_counts(build_graph(docs, None, base))
    stated = expand_triples(base, labels=graph_labels(graphs, base), entities=graph_entities(graphs, base), relations=graph_relations(graphs, base, "doc_id"))
    merged = merge_records(graphs, vocab, base, prune=True)
    source, cleaned = (about_documents.unionByName(triple_counts(t)) for t in (stated, merged.triples))
    return report_of_counts(source, cleaned, merged.groups, merged.unused, vocab, base)


def run_build(
    spark: SparkSession, source_root: str, work_root: str, base: str,
    extract: Callable[[DataFrame], DataFrame] | None = None, allowed: DataFrame | None = None,
) -> None:
    """Ingest what is new or changed, extract what is missing, rebuild the graph, then the manifest.

    Each step is committed before the next starts; a run that dies is resumed by the next one.
    """
    from beleg.streaming.ingest import ingest_pending

    docs_path, extractions_path = f"{work_root}/documents", f"{work_root}/extractions"
    # What arrives or changes during the build is left to the next one: one listing serves ingest and manifest.
    listing = cut_lineage(list_objects(spark, source_root), "listing")
    ingest_pending(spark, source_root, docs_path, listing=listing)
    docs = read_log(spark, docs_path, DOCUMENT_SCHEMA)
    extractions = None
    if extract is not None:
        from beleg.streaming.ingest import next_sequence, records_or_empty

        done = records_or_empty(spark, extractions_path, EXTRACTION_SCHEMA)
        waiting = pending_extractions(latest_by_id(docs), done, allowed)
        append_log(extract(waiting).withColumn("ingest_seq", next_sequence(done)), extractions_path)
        extractions = records_or_empty(spark, extractions_path, EXTRACTION_SCHEMA)
    write_graph(build_graph(docs, extractions, base), f"{work_root}/graph")
    write_manifest(listing, f"{work_root}/manifest")

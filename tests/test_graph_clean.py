from __future__ import annotations

import datetime
import json
import random
from collections import Counter

import pytest

from beleg.checks import all_queries
from beleg.checks.registry import _STORED, runnable
from beleg.operators import graph_clean
from beleg.plans import build
from beleg.sources.records import DOCUMENT_SCHEMA, EXTRACTION_SCHEMA
from beleg.sources.vocabulary import vocabulary_from_json

KG, SMOKE = "https://example.org/kg/", "/root/testdata/sf0.001"
all_queries.load()


def harbour(spark, seed):
    """Documents, extractions with odd, repeated and missing names, of which several are never counted, and a vocabulary."""
    rng = random.Random(seed)
    names = ["Crane", " kran", "KRAN", "tide", "Quay", "quay ", "Pier", "Mole", "", None, "Buoy", "Lock"]
    verbs = ["lies at", "Lies at", "moored to", " near", "label", None]
    counted = {name for name in names if name and rng.random() < 0.4}
    docs, found = [], []
    for i in range(10):
        docs.append((f"n{i}", f"s3://harbour/n{i}.txt", "text/plain", 5, "x", False, {"Zone": "north"}, "e", 1))
        for seq in range(rng.randint(0, 2)):
            relations = [(rng.choice(names[:7]), rng.choice(verbs), rng.choice(names[:7])) for _ in range(rng.randint(0, 3))]
            counts = {name: rng.randint(0, 2) for name in counted}
            found.append((f"n{i}", rng.choices(names, k=rng.randint(0, 5)), relations, "m", datetime.datetime(2024, 1, 1), counts, seq))
    vocab = {
        "schema_version": "1", "content_hash": "sha256:" + "0a" * 32, "term_iri_base": "https://t/", "vocab_iri_base": "https://v#", "normalization": {"stop_suffixes": ["netz"]},
        "terms": {"crane": {"term": "Crane", "type": "device"}, "lock": {"term": "Lock", "type": "device"}}, "alias_index": {"crane": "crane", "kran": "crane", "lock": "lock"},
        "contested_aliases": {"pier": {"senses": ["crane", "lock"]}}, "generic_keys": ["tide"], "predicates": {}, "predicate_map": {"lies_at": "at", "moored_to": "at"},
    }
    return spark.createDataFrame(docs, DOCUMENT_SCHEMA), spark.createDataFrame(found, EXTRACTION_SCHEMA), vocabulary_from_json(spark, json.dumps(vocab))


@pytest.mark.parametrize("seed", [1, 2])
def test_orphans_go_before_triples_are_made(spark, seed):
    docs, found, vocab = harbour(spark, seed)
    stages = graph_clean.clean_stages(build.build_graph(docs, found, KG), vocab, KG)
    assert Counter(map(tuple, build.build_clean_graph(docs, found, vocab, KG).collect())) == Counter(map(tuple, stages.cleaned.collect()))
    assert stages.cleaned.count() < stages.merged.count() - 3


@pytest.mark.parametrize("seed", [1, 2])
def test_report_counts_as_the_stages_do(spark, seed):
    docs, found, vocab = harbour(spark, seed)
    stages = graph_clean.clean_stages(build.build_graph(docs, found, KG), vocab, KG)
    report, by_stages = (r.first().asDict() for r in (build.build_clean_report(docs, found, vocab, KG), graph_clean.clean_report(stages, vocab, KG)))
    assert report == by_stages
    assert report["graph_triples"] == stages.source.count() and report["clean_triples"] == stages.cleaned.count()
    assert min(report[name] for name in ("entities_dropped", "entities_flagged", "alias_groups_merged", "predicate_edges_rewritten")) > 0


@pytest.mark.parametrize("query", ["g17_clean_graph", "a12_clean_report"])
def test_cleaning_stores_no_graph(spark, query):
    before = set(_STORED)
    assert runnable(query)(spark, SMOKE).count() > 0
    assert not [k for k in set(_STORED) - before if k[2] in ("graph", "folded", "merged", "cleaned")]

from __future__ import annotations

import datetime
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from beleg.checks import all_queries
from beleg.checks.fixtures import BASE, Inputs
from beleg.checks.graph_inputs import extraction_records
from beleg.checks.registry import _STORED, runnable
from beleg.functions.iris import RDF_OBJECT, RDF_PREDICATE, RDF_SUBJECT, RDF_TYPE
from beleg.functions.text import strip
from beleg.operators import graph_build as G, graph_clean, graph_overlay, graph_query
from beleg.plans.build import build_graph, build_merged_graph
from beleg.sources.records import DOCUMENT_SCHEMA, EXTRACTION_SCHEMA
from beleg.sources.triples import from_ntriples, read_graph, read_ntriples, to_ntriples, write_graph, write_ntriples, write_overlay
from beleg.sources.vocabulary import read_vocabulary, vocabulary_from_json

KG, TERM, VOC = "https://example.org/kg/", "https://terms.example/t/", "https://terms.example/v#"
TRIPLE = "s string, p string, o string, o_kind string, o_type string"


def graph(spark, *rows):
    def expand(term):
        return term if term.startswith("http") else KG + term

    built = []
    for s, p, o in rows:
        iri = isinstance(o, str) and not o.startswith('"')
        built.append((expand(s), expand(p), expand(o) if iri else str(o).strip('"'), "iri" if iri else "literal", None))
    return spark.createDataFrame(built, TRIPLE)


# Rail yard terms: slug -> (spelling, type, further aliases).
TERMS = {
    "turnout": ("Turnout", "device", ("weiche", "switch point")), "gauge": ("Gauge", "quantity", ()), "wagon": ("Wagon", "vehicle", ("gueterwagen",)),
    "signal-box": ("Signal box", "building", ("stellwerk",)), "timetable": ("Timetable", "record", ("fahrplan", "horaire")),
}
GENERIC, DISPUTED = ("gauge", "horaire"), {"point": ("signal-box", "turnout"), "plan": ("timetable",)}
VERBS = {"rolls-on": ("carries", False, "What moves along what."), "next-to": ("next-to", True, "Both lie side by side.")}
VERB_NAMES = {"rolls_on": "rolls-on", "runs_along": "rolls-on", "beside": "next-to", "neben": "next-to", "adjoins": "next-to"}


def vocabulary(spark, **overrides):
    aliases = {key: slug for slug, (name, _, more) in TERMS.items() for key in (name.lower(), *more)}
    data = {
        "schema_version": "3.2", "content_hash": "sha256:" + "0f" * 32, "term_iri_base": TERM, "vocab_iri_base": VOC,
        "normalization": {"stop_suffixes": ["anlage", "nanlage"]},
        "terms": {slug: {"term": name, "type": kind} for slug, (name, kind, _) in TERMS.items()},
        "alias_index": aliases, "contested_aliases": {k: {"senses": list(v)} for k, v in DISPUTED.items()}, "generic_keys": list(GENERIC),
        "predicates": {k: {"inverse": i, "symmetric": y, "definition": d} for k, (i, y, d) in VERBS.items()}, "predicate_map": VERB_NAMES,
    }
    return vocabulary_from_json(spark, json.dumps({**data, **overrides}))


def rows(df):
    return {(r.s.replace(KG, ""), r.p.replace(KG, ""), r.o.replace(KG, "")) for r in df.collect()}


class Made:
    """A random graph, and what an overlay of the vocabulary has to say about it."""

    def __init__(self, seed):
        rng = random.Random(seed)
        self.rows, self.overlay, self.unresolved = [], set(), Counter()
        self.linked, self.generic, self.unknown, self.contested, self.entities, self.verbs = 0, 0, 0, 0, 0, Counter()
        node = f"glossary/{'0f' * 6}"
        self.overlay |= {(node, RDF_TYPE, "GlossaryVersion"), (node, "contentHash", "sha256:" + "0f" * 32), (node, "schemaVersion", "3.2"), (node, "termIriBase", TERM)}
        for i in range(rng.randint(2, 6)):
            day, slug = f"20{rng.randint(10, 29)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", [rng.choice(["rail", "yard", "depot"]) for _ in range(3)]
            self.rows += [(f"doc/n{i}", RDF_TYPE, "Document"), (f"doc/n{i}", "sourceUri", f'"s3://store/{day}_{"-".join(slug)}.pdf"')]
            self.overlay |= {(f"doc/n{i}", "publicationDate", day), (f"doc/n{i}", "title", " ".join(slug))}
        self.documents = i + 1
        aliases = {key: slug for slug, (name, _, more) in TERMS.items() for key in (name.lower(), *more)}
        texts = rng.sample([*aliases, *DISPUTED, "Buffer stop", "Ballast", "Sleeper", "Catenary"], 11)
        for i, text in enumerate(texts):
            label, key, of = f"label/w{i}", text.lower(), rng.sample(range(100, 999), rng.randint(1, 3))
            self.rows.append((label, "labelText", f'"{text.upper() if rng.random() < 0.5 else text}"'))
            said = self.rows[-1][2].strip('"')
            for e in of:
                n = rng.randint(0, 30)
                self.rows += [(f"entity/x{i}-{e}", "hasLabelForm", label), (f"entity/x{i}-{e}", "mentionCount", n)]
                if key not in DISPUTED and key not in aliases:
                    self.unresolved[said] += n
            if key in DISPUTED:
                self.contested += 1
                self.overlay |= {(label, "accordingTo", node)} | {(label, "contestedTerm", TERM + slug) for slug in DISPUTED[key]}
            elif key in GENERIC:
                self.generic += 1
            elif key in aliases:
                slug, self.linked, self.entities = aliases[key], self.linked + 1, self.entities + len(of)
                kind = VOC + TERMS[slug][1]
                self.overlay |= {(label, "canonicalTerm", TERM + slug), (label, "matchRule", "exact"), (label, "termType", kind), (label, "accordingTo", node)}
                self.overlay |= {t for e in of for t in ((f"entity/x{i}-{e}", "canonicalTerm", TERM + slug), (f"entity/x{i}-{e}", "termType", kind))}
            else:
                self.unknown += 1
        for i in range(rng.randint(5, 15)):
            name = rng.choice([*VERB_NAMES, "Beside", "sees", "pulls"])
            self.rows.append((f"assertion/k{i}", RDF_PREDICATE, f"relprop/{name}"))
            self.verbs[name] += 1
            if verb := VERB_NAMES.get(name.lower()):
                inverse, symmetric, definition = VERBS[verb]
                self.overlay |= {(f"relprop/{name}", "canonicalPredicate", f"rel/{verb}"), (f"relprop/{name}", "accordingTo", node), (f"rel/{verb}", RDF_TYPE, "ControlledPredicate"),
                                 (f"rel/{verb}", "definition", definition), (f"rel/{verb}", "inversePredicate", f"rel/{inverse}"), (f"rel/{verb}", "symmetric", str(symmetric).lower())}
        rng.shuffle(self.rows)


def extraction(doc_id, entities, relations, counts=None):
    at = datetime.datetime(2024, 1, 2, 3, 4, 5)
    return (doc_id, entities, [{"s": s, "p": p, "o": o} for s, p, o in relations], "m", at, counts or {}, 1)


def test_tables_and_triples(spark):
    graphs = spark.createDataFrame([
        extraction("d1", ["Molka", "molka ", "Teer"], [("Molka", " drains to ", "Uferland"), ("Molka", "Drains To", "Uferland")], {"Molka": 3, "molka ": 9}),
        extraction("d2", ["MOLKA"], [], {"MOLKA": 1})], EXTRACTION_SCHEMA)
    labels = {r.label_text for r in G.graph_labels(graphs, KG).collect()}
    assert labels == {"MOLKA", "Teer", "Uferland"}
    entities = {(r.doc_iri[-2:], r.label): r for r in G.graph_entities(graphs, KG).collect()}
    assert set(entities) == {("d1", "Molka"), ("d1", "Teer"), ("d1", "Uferland"), ("d2", "MOLKA")}
    assert entities["d1", "Molka"].mention_count == 3 and entities["d1", "Uferland"].mention_count == 0
    assert entities["d1", "Molka"].entity_iri != entities["d2", "MOLKA"].entity_iri
    assert entities["d1", "Molka"].label_iri == entities["d2", "MOLKA"].label_iri
    relations = G.graph_relations(graphs, KG).collect()
    # A case variant shares its assertion and keeps its own predicate.
    assert len({r.assertion_iri for r in relations}) == 1
    assert {r.predicate_iri for r in relations} == {KG + "relprop/drains_to", KG + "relprop/Drains_To"}
    docs = spark.createDataFrame([("d1", "s3://b/x.pdf", "application/pdf", 5, " ", False, {"a b": "1", "a-b": "1"}, "e", 1),
                                  ("d1", "s3://b/x.pdf", "application/pdf", 6, "t", True, {}, "f", 2)], DOCUMENT_SCHEMA)
    triples = build_graph(docs, graphs, KG)
    assert triples.count() == triples.distinct().count()
    found = rows(triples)
    assert ("doc/d1", "sizeBytes", "6") in found and ("doc/d1", "hasText", "true") in found
    assert ("assertion/" + relations[0].assertion_iri[-16:], "extractedAt", "2024-01-02T03:04:05.000000Z") in found
    assert len(rows(G.expand_triples(KG, properties=G.graph_properties(docs, KG)))) == 1


def test_labels_resolve_by_rule(spark):
    want = {"Lok": ("unresolved", None, None), "anlage": ("unresolved", None, None), "Weichenanlage": ("best", "desuffix", "turnout"), "Stellwerkanlage ": ("best", "desuffix", "signal-box"),
            "Wägón": ("best", "ascii_fold", "wagon")}
    for slug, (name, _, more) in TERMS.items():
        for alias in (name, *more):
            generic = alias.lower() in GENERIC
            want |= {spelled: ("generic", None, None) if generic else ("best", "exact", slug) for spelled in (alias.upper(), f" {alias} ", alias.title())}
    want |= {spelled: ("contested", None, None) for alias in DISPUTED for spelled in (alias, alias.upper())}
    labels = spark.createDataFrame([(t,) for t in want], "label_text string")
    assert {r.label_text: (r.outcome, r.rule, r.slug) for r in graph_overlay.resolve_labels(labels, vocabulary(spark)).collect()} == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlay(spark, seed):
    made, vocab = Made(seed), vocabulary(spark)
    triples = graph(spark, *made.rows)
    overlay = graph_overlay.annotate_graph(triples, vocab)
    assert rows(overlay) == made.overlay and overlay.count() == len(made.overlay)
    report = graph_overlay.annotation_report(triples, vocab, KG, overlay).first()
    known = [v for v in made.verbs if v.lower() in VERB_NAMES]
    assert (report.labels_linked, report.labels_generic, report.labels_unresolved, report.entities_annotated, report.documents_dated,
            report.predicates_annotated, report.predicates_total) == (made.linked, made.generic, made.unknown, made.entities, made.documents, len(known), len(made.verbs))
    assert [tuple(r) for r in graph_overlay.unresolved_head(triples, vocab).collect()] == sorted(made.unresolved.items(), key=lambda x: (-x[1], x[0]))


def test_base_uri(spark):
    assert graph_overlay.detect_base_uri(graph(spark, *Made(4).rows)) == KG
    with pytest.raises(ValueError, match="sourceUri"):
        graph_overlay.detect_base_uri(graph(spark, ("x/1", RDF_TYPE, "Thing")))


@pytest.mark.parametrize("seed", [1, 2])
def test_predicates_fold(spark, seed):
    rng, plain, asserted = random.Random(seed), set(), {}
    names = rng.sample([*VERB_NAMES, "sees", "pulls", "pushes"], 6)
    for i in range(40):
        name = rng.choice(names)
        plain.add((f"entity/m{rng.randint(0, 9)}", name, f"entity/m{rng.randint(0, 9)}"))
        asserted[f"assertion/q{i}"] = name
    used = {n: f"rel/{VERB_NAMES[n]}" if n in VERB_NAMES else f"relprop/{n}" for n in asserted.values()}
    triples = graph(spark, *((s, f"relprop/{n}", o) for s, n, o in plain), *((a, RDF_PREDICATE, f"relprop/{n}") for a, n in asserted.items()))
    vocab = vocabulary(spark)
    assert rows(graph_clean.canonicalize_predicates(triples, vocab, KG)) == {(s, used.get(n, f"relprop/{n}"), o) for s, n, o in plain} | {(a, RDF_PREDICATE, used[n]) for a, n in asserted.items()}
    loose = Counter(n for _, n, _ in plain if n in used and n not in VERB_NAMES)
    assert [tuple(r) for r in graph_clean.uncontrolled_head(triples, vocab).collect()] == sorted(loose.items(), key=lambda x: (-x[1], x[0]))
    merged = {v: sorted(n for n in used if VERB_NAMES.get(n) == v) for v in VERBS}
    got = {r.canonical: r.raw_names for r in graph_clean.predicate_merges(triples, vocab).collect()}
    assert got == {v: n for v, n in merged.items() if len(n) > 1}
    moved = sum(n in VERB_NAMES and n in used for _, n, _ in plain) + sum(n in VERB_NAMES for n in asserted.values())
    assert graph_clean.predicate_edges_rewritten(triples, vocab, KG).first()[0] == moved


def entity(name, label, mentions):
    return ((f"entity/{name}", RDF_TYPE, "Entity"), (f"entity/{name}", "label", f'"{name}"'), (f"entity/{name}", "hasLabelForm", f"label/{label}"),
            (f"entity/{name}", "mentionCount", mentions))


def test_entities_merge_by_label_and_by_term(spark):
    # By label: v1, v2, v3. By term (weiche, switch point): v4, v6. v5 alone.
    labels = {"k1": "Ballast", "k2": "Weiche", "k3": "Switch Point", "k4": "Fahrplan"}
    counts = {"v1": ("k1", 11), "v2": ("k1", 0), "v3": ("k1", 2), "v4": ("k2", 1), "v5": ("k4", 9), "v6": ("k3", 6)}
    ends = (("v2", "relprop/pulls", "v6"), ("v6", "relprop/label", "v3"), ("v5", "relprop/sees", "v5"))
    triples = graph(
        spark, *((f"label/{k}", "labelText", f'"{t}"') for k, t in labels.items()), *(t for v, (k, n) in counts.items() for t in entity(v, k, n)),
        *((f"doc/{v}", "mentions", f"entity/{v}") for v in counts), *((f"entity/{s}", p, f"entity/{o}") for s, p, o in ends))
    stages = graph_clean.clean_stages(triples, vocabulary(spark), KG)
    got, into = rows(stages.cleaned), {"v2": "v1", "v3": "v1", "v6": "v4"}
    assert {s for s, p, o in got if p == RDF_TYPE} == {f"entity/{v}" for v in counts if v not in into}
    assert {(s, o) for s, p, o in got if p == "mentionCount"} == {("entity/v1", "13"), ("entity/v4", "7"), ("entity/v5", "9")}
    assert {(s, p, o) for s, p, o in got if p.startswith("relprop/")} == {(f"entity/{into.get(s, s)}", p, f"entity/{into.get(o, o)}") for s, p, o in ends}
    assert {(s, o) for s, p, o in got if p == "mentions"} == {(f"doc/{v}", f"entity/{into.get(v, v)}") for v in counts}
    report = graph_clean.clean_report(stages, vocabulary(spark), KG).first()
    assert (report.entities_before, report.entities_after, report.label_groups_merged, report.alias_groups_merged) == (6, 3, 1, 1)
    contested = vocabulary(spark, contested_aliases={"weiche": {"senses": ["turnout"]}})
    again = rows(graph_clean.clean_graph(triples, contested, KG))
    assert {s for s, p, o in again if p == RDF_TYPE} == {"entity/v1", "entity/v4", "entity/v5", "entity/v6"}


def test_orphans_go_and_connected_ones_stay(spark):
    triples = graph(spark, *entity("e1", "l1", 0), *entity("e2", "l2", 0), *entity("e3", "l3", 1), ("doc/d1", "mentions", "entity/e1"),
                    ("assertion/a1", RDF_SUBJECT, "entity/e3"), ("assertion/a1", RDF_OBJECT, "entity/e2"))
    got = rows(graph_clean.prune_orphans(triples, KG))
    assert not [t for t in got if "entity/e1" in t] and ("entity/e2", RDF_TYPE, "Entity") in got
    assert [r.entity for r in graph_clean.flagged_entities(triples, KG).collect()] == [KG + "entity/e2"]


def test_neighbours(spark):
    triples = graph(spark, ("entity/a", "label", '"Fischfang"'), ("entity/b", "label", '"FISCHFANG"'), ("entity/c", "label", '"Becken"'),
                    ("entity/a", "relprop/_floats_on_", "entity/c"), ("entity/c", "relprop/feeds", "entity/b"), ("entity/a", "relprop/x", "entity/a"),
                    ("entity/a", "relprop/y", "entity/b"), ("entity/a", "relprop/z", "entity/unlabelled"), ("entity/a", "rel/part-of", "entity/c"))
    seeds = spark.createDataFrame([(" fischfang",), ("nobody",)], "entity string")
    got = {r.entity: r for r in graph_query.neighbors(triples, seeds, KG).collect()}
    found = got[" fischfang"]
    assert (found.spelling, found.found, found.nodes, found.neighbor_count) == ("FISCHFANG", True, 2, 3)
    ways = {n.label: [(v.predicate, v.direction) for v in n.via] for n in found.neighbors}
    assert ways == {"Becken": [("feeds", "in"), ("floats on", "out")], "FISCHFANG": [("y", "out")], "Fischfang": [("y", "in")]}
    assert not got["nobody"].found and got["nobody"].neighbor_count == 0
    assert graph_query.neighbor_edges(triples, seeds, KG, "out", ("relprop/", "rel/")).filter("label = 'Becken'").count() == 2
    with pytest.raises(ValueError):
        graph_query.neighbors(triples, seeds, KG, "sideways")


def test_patterns(spark):
    triples = graph(spark, *[(f"doc/d{i}", "mentions", "entity/a") for i in range(4)], ("entity/a", "label", '"A"'))
    patterns = [("?d", KG + "mentions", "?e"), ("?e", KG + "label", "?l")]
    got = graph_query.match_patterns(triples, patterns, KG, ["?d", "?l"], limit=3).collect()
    assert [(r.d, r.l, r.truncated) for r in got] == [("doc:d0", "A", True), ("doc:d1", "A", True), ("doc:d2", "A", True)]
    assert not graph_query.match_patterns(triples, patterns, KG, limit=4).first().truncated
    assert graph_query.clamp_limit(0) == 1 and graph_query.clamp_limit(9999) == 500
    assert graph_query.pattern_exists(triples, patterns).first()[0] is True
    with pytest.raises(ValueError, match="connected"):
        graph_query.solve_patterns(triples, [("?a", KG + "label", "?b"), ("?c", KG + "mentions", "?d")])
    hint = lambda p: graph_query.empty_result_hint(graph_query.solve_patterns(facts, p), facts, KG).collect()
    facts = graph(spark, ("entity/a", "relprop/x", "entity/b"))
    assert [tuple(r) for r in hint([("?s", KG + "nope", "?o")])] == [("rel:x", 1)] and hint([("?s", KG + "relprop/x", "?o")]) == []


def test_files(spark, tmp_path):
    triples = graph(spark, *Made(5).rows, ("doc/n0", "title", '"quo\\te \n tab\t"'))
    path, beside = str(tmp_path / "g"), str(tmp_path / "o")
    write_graph(triples, path)
    overlay = graph_overlay.annotate_graph(triples, vocabulary(spark), KG)
    write_overlay(overlay.unionByName(triples.limit(1)), beside)
    assert rows(read_graph(spark, path)) == rows(triples)
    assert read_graph(spark, path, beside).count() == triples.count() + overlay.count()
    write_overlay(overlay, beside, in_place=path)
    assert read_graph(spark, path).count() == triples.count() + overlay.count()
    assert rows(from_ntriples(to_ntriples(triples))) == rows(triples)
    file = tmp_path / "v.json"
    file.write_text(json.dumps({"schema_version": "1", "alias_index": {"a": "x"}, "generic_keys": ["a"], "contested_aliases": {"b": {"senses": ["y"]}}, "terms": {}}))
    assert {(r.key, r.slug, r.generic) for r in read_vocabulary(spark, str(file)).keys.collect()} == {("a", "x", True), ("b", None, False)}


def test_typed_patterns(spark):
    triples = spark.createDataFrame([
        ("http://k/a", "http://k/p", "http://k/e2", "literal", None), ("http://k/b", "http://k/p", "http://k/e2", "iri", None),
        ("http://k/e2", "http://k/label", "7", "literal", "http://t/int"), ("http://k/e2", "http://k/label", "7", "literal", None)], TRIPLE)
    joined = graph_query.solve_patterns(triples, [("?s", "http://k/p", "?x"), ("?x", "http://k/label", "?l")])
    assert {(r.s, r._type_l) for r in joined.collect()} == {("http://k/b", "http://t/int"), ("http://k/b", None)}
    typed = [("?x", "http://k/label", graph_query.Literal("7", "http://t/int"))]
    assert graph_query.solve_patterns(triples, typed).count() == 1
    assert graph_query.solve_patterns(triples, [("?x", "http://k/label", "7")]).count() == 0
    ground = ("http://k/b", "http://k/p", "http://k/e2")
    assert graph_query.solve_patterns(triples, [*typed, ground]).count() == 1
    assert graph_query.solve_patterns(triples, [*typed, ("http://k/b", "http://k/p", "http://k/e3")]).count() == 0
    assert graph_query.pattern_exists(triples, [ground]).first()[0] and not graph_query.pattern_exists(triples, [("http://k/a", *ground[1:])]).first()[0]
    made = graph_query.construct_triples(triples, [("?x", "http://k/label", "?l")], [("?x", "http://k/named", "?l"), ("?l", "http://k/of", "?x")])
    assert made.columns == triples.columns and {tuple(r)[3:] for r in made.collect()} == {("literal", "http://t/int"), ("literal", None)}
    cut = graph_query.describe_node(triples, "http://k/e2", limit=2).collect()
    assert len(cut) == 2 and all(r.truncated for r in cut)


def test_line_exchange(spark):
    rows_in = [("_:b1", "http://k/p", "a \u0001 \\ \" \n\t é", "literal", "@de-CH"), ("http://k/s", "http://k/p", "_:b1", "blank", None),
               ("http://k/s", "http://k/p", "x", "literal", "http://www.w3.org/2001/XMLSchema#string"), ("http://k/s", "http://k/p", "http://k/o", "iri", None)]
    triples = spark.createDataFrame(rows_in, TRIPLE)
    assert {tuple(r) for r in from_ntriples(to_ntriples(triples)).collect()} == set(rows_in)
    lines = spark.createDataFrame([(v,) for v in (
        r'<http://k/s> <http://k/p> "caf\u00e9 \\u0041 \U0001F600 \uD83D\uDE00 \b\'"@fr .', "# note", "", "junk .", r'_:x <http://k/p> "5"^^<http://t/int> . # note')], "value string")
    got = [tuple(r) for r in from_ntriples(lines).collect()]
    assert got == [("http://k/s", "http://k/p", "caf\u00e9 \\u0041 \U0001F600 \U0001F600 \b'", "literal", "@fr"), ("_:x", "http://k/p", "5", "literal", "http://t/int")]
    from beleg.sources.triples import unread_lines

    assert tuple(unread_lines(lines).first()) == (2, 1)


def test_written_lines_are_compressed(spark, tmp_path):
    made = graph(spark, *((f"entity/{i:016x}", "label", f'"wagon {i}"') for i in range(2000)))
    write_ntriples(made, str(tmp_path / "lines"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect()) == sorted(r.value for r in to_ntriples(made).collect())
    assert sorted(read_ntriples(spark, str(tmp_path / "lines")).select("s", "p", "o").collect()) == sorted(made.select("s", "p", "o").collect())
    written = sum(f.stat().st_size for f in (tmp_path / "lines").glob("part-*"))
    assert written < to_ntriples(made).selectExpr("sum(length(value))").first()[0] / 5
    odd = spark.createDataFrame([('_:a <http://k/p> "x > y\u0000 > " .\u2028',), ("<http://k/a> <http://k/p> _:b . # > c",)], "value string")
    assert sorted(tuple(r) for r in from_ntriples(odd).select("s", "o", "o_kind").collect()) == [("_:a", "x > y\u0000 > ", "literal"), ("http://k/a", "_:b", "blank")]


def test_statements_are_reduced_within_their_document(spark):
    """Spellings that coincide once written as IRIs count once, without an exchange of triples; ``apart`` gives the same rows."""
    docs = spark.createDataFrame([(f"d{i}", f"s3://yard/{i}", "text/plain", i, " " if i % 2 else "x", None, {"a b": "1", "a-b": "1", "a.b": "2"}, "e", 1) for i in range(3)], DOCUMENT_SCHEMA)
    facts = [("Wagon", "rolls on", "Track"), ("wagon ", "Rolls on", "track"), ("Wagon", "rolls-on", "Track"), ("Wagon", "rolls on", "Siding")]
    found = spark.createDataFrame([(f"d{i}", ["Wagon"], facts[:i + 2], "m", datetime.datetime(2024, 1, 1), {"Wagon": 2}, 1) for i in range(3)], EXTRACTION_SCHEMA)
    made = build_graph(docs, found, KG)
    got = sorted(made.collect(), key=str)
    assert len(got) == len(set(got)) and len(got) == 3 * (6 + 2) + 3 * 2 + (2 + 2 + 3) * 5 + (2 + 2 + 3) + (1 + 2 + 3) * 6 + (2 + 3 + 4)
    assert got == sorted(build_graph(docs, found, KG, apart=True).collect(), key=str)
    tables = G.graph_documents(docs, KG), G.graph_properties(docs, KG), G.graph_labels(found, KG), G.graph_entities(found, KG), G.graph_relations(found, KG)
    assert got == sorted(G.expand_triples(KG, *tables).collect(), key=str)
    assert "hashpartitioning(s#" not in made._jdf.queryExecution().executedPlan().toString()


def test_readers_of_a_predicate_leave_the_rest_unread(spark):
    docs = spark.createDataFrame([("d", "s3://yard/1", "text/plain", 1, "x", None, {}, "e", 1)], DOCUMENT_SCHEMA)
    found = spark.createDataFrame([("d", ["Wagon"], [], "m", datetime.datetime(2024, 1, 1), {}, 1)], EXTRACTION_SCHEMA)
    asked = graph_query.labels_containing(build_graph(docs, found, KG, apart=True), "WAG", KG)
    assert [r.label for r in asked.collect()] == ["Wagon"]
    assert "assertion/" not in asked._jdf.queryExecution().optimizedPlan().toString()


SMOKE = "/root/testdata/sf0.001"
all_queries.load()


def test_extraction_records_read_the_orders_once(spark):
    """One scan and one join make what fixtures ``facts`` and ``named`` state in three; repeated rows of a document are merged."""
    d = Inputs(spark, SMOKE)
    assert extraction_records(d)._jdf.queryExecution().optimizedPlan().toString().count("o_orderdate#") <= 3
    d._known["orders"] = d.orders.filter("o_orderkey < 60").unionByName(d.orders.filter("o_orderkey = 10")).unionByName(
        d.orders.filter("o_orderkey = 10").withColumn("o_custkey", F.lit(-1).cast("bigint")))
    wanted = {(r.doc_id, r.label): r.n for r in d.named.groupBy("doc_id", "label").agg(F.max_by("n", "listed").alias("n")).collect()}
    got = extraction_records(d).select("doc_id", F.explode("mention_counts").alias("label", "n")).collect()
    assert len(got) == len(wanted) and {(r.doc_id, r.label): r.n for r in got} == wanted
    assert sorted(tuple(r) for r in extraction_records(d).select("doc_id", F.inline("relations")).collect()) == sorted(
        tuple(r) for r in d.facts.select("doc_id", "s", "p", "o").collect())


def test_strip_uses_no_pattern(spark):
    texts = [chr(c) + "a" + chr(c) + "b" + chr(c) for c in (*range(0x2100), 0x3000, 0xFEFF)] + ["", " \u3000\n", "\u2003é\x1c", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    shown = rows.select(strip(F.col("t")).alias("new"), F.regexp_replace("t", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "").alias("old"))
    assert shown.filter("NOT new <=> old").count() == 0
    assert "regexp" not in rows.select(strip(F.col("t")))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_predicates_are_counted_without_a_stored_graph(spark):
    before = set(_STORED)
    assert runnable("a4_predicate_counts")(spark, SMOKE).filter("is_relation").count() > 0
    assert not [k for k in set(_STORED) - before if k[2] == "graph"]


def test_base_and_documents_in_one_reading(spark):
    made = graph(spark, ("d1", "sourceUri", '"a"'), ("d2", "sourceUri", '"b"'), ("d1", "zz/sourceUri", '"c"'))
    assert sorted(tuple(r) for r in graph_overlay.base_uris(made).collect()) == [(KG, 2), (KG + "zz/", 1)]
    assert tuple(runnable("p17_detect_base_uri")(spark, SMOKE).first()) == (BASE, Inputs(spark, SMOKE).orders.count())


def test_drawing_types_meet_descriptions_in_one_aggregate(spark):
    made = graph(
        spark, ("doc/1", RDF_TYPE, "Document"), ("doc/1", "sourceUri", '"s3://yard/x.pdf"'), ("doc/1", "prop/Zone", '"north"'), ("doc/1", "mentions", "entity/1"),
        ("entity/1", RDF_TYPE, "Entity"), ("entity/1", "label", '"Wagon"'), ("label/1", RDF_TYPE, "Label"), ("label/1", "labelText", '"Wagon"'),
        ("entity/1", "hasLabelForm", "label/1"), ("doc/2", "prop/Zone", '"south"'))
    nodes, edges = graph_query.drawing_tables(made)
    assert sorted(tuple(r) for r in nodes.collect()) == [
        ("Zone=north", "value", "Zone: north", "value"), (KG + "doc/1", "document", "x.pdf", "unknown"), (KG + "entity/1", "entity", "Wagon", "entity")]
    assert sorted(tuple(r) for r in edges.collect()) == [("Zone=north", KG + "doc/1", "Zone"), (KG + "doc/1", KG + "entity/1", "mentions")]
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "regexp_extract" not in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_entities_merge_before_triples_are_made(spark, seed):
    rng = random.Random(seed)
    names = ["Turnout", " weiche", "WEICHE", "gauge", "horaire", "fahrplan", "Fahrplan ", "point", "Shed", "shed ", "Crane", "", None]
    verbs = ["rolls on", "Rolls on", "runs along", " beside", "label", "near", "Near", None]
    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    docs, extractions = [], []
    for i in range(12):
        docs.append((f"n{i}", f"s3://yard/n{i}.txt", "text/plain", 5, "x", False, {"Zone": "north"}, "e", 1))
        for seq in range(rng.randint(0, 2)):
            entities = rng.choices(names, k=rng.randint(0, 5))
            relations = [(rng.choice(names), rng.choice(verbs), rng.choice(names)) for _ in range(rng.randint(0, 9))]
            counts = {name: rng.randint(0, 4) for name in names if name is not None and rng.random() < 0.7}
            extractions.append((f"n{i}", entities, relations, "m", at, counts, seq))
    docs = spark.createDataFrame(docs, "doc_id string, source_uri string, content_type string, size_bytes bigint, text string, text_truncated boolean, properties map<string,string>, etag string, ingest_seq bigint")
    extractions = spark.createDataFrame(extractions, "doc_id string, entities array<string>, relations array<struct<s:string,p:string,o:string>>, model string, extracted_at timestamp, mention_counts map<string,bigint>, ingest_seq bigint")
    vocab = vocabulary(spark)
    by_passes = graph_clean.consolidate_entities(graph_clean.canonicalize_predicates(build_graph(docs, extractions, KG), vocab, KG), vocab, KG)
    merged = build_merged_graph(docs, extractions, vocab, KG)
    assert Counter(map(tuple, merged.collect())) == Counter(map(tuple, by_passes.collect()))
    assert merged.filter(F.col("p") == KG + "mentions").count() > 0


def test_consolidation_stores_no_raw_graph(spark):
    before = set(_STORED)
    assert runnable("g15_consolidate_entities")(spark, SMOKE).count() > 0
    assert not [k for k in set(_STORED) - before if k[2] in ("graph", "folded")]

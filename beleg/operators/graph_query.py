"""Questions to the graph as joins over the triple table, for batches of seeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beleg.functions.iris import RDF_OBJECT, RDF_PREDICATE, RDF_SUBJECT, RDF_TYPE, abbreviate, is_relation, speak_predicate
from beleg.functions.text import after, last_segment, local_name, normalise_label, null_if_empty, strip
from beleg.functions import markers as M

DEFAULT_LIMIT, MAX_LIMIT = 50, 500
RELATION_PREFIXES = ("relprop/",)


def _labelled(triples: DataFrame, base: str) -> DataFrame:
    return triples.filter(F.col("p") == base + "label").select(F.col("s").alias("node"), F.col("o").alias("label"))


def neighbor_edges(
    triples: DataFrame, seeds: DataFrame, base: str, direction: str = "both",
    relation_prefixes: Sequence[str] = RELATION_PREFIXES,
) -> DataFrame:
    """(entity, label, predicate, direction), one row per distinct way to a neighbour.

    ``seeds(entity)`` holds labels in any case; each stands for every node that carries it.
    Edges are joined on nodes, which belong to one document, so a label of a third of the
    corpus is spread over its nodes.
    """
    if direction not in ("out", "in", "both"):
        raise ValueError("direction must be one of out, in, both")
    labels = _labelled(triples, base)
    nodes = _seed_nodes(triples, seeds, base)
    facts = triples.filter(is_relation(F.col("p"), base, tuple(relation_prefixes)) & (F.col("o_kind") == "iri")).select("s", "p", "o")
    ways = []
    if direction in ("out", "both"):
        ways.append(facts.select(F.col("s").alias("node"), "p", F.col("o").alias("other"), F.lit("out").alias("direction")))
    if direction in ("in", "both"):
        ways.append(facts.select(F.col("o").alias("node"), "p", F.col("s").alias("other"), F.lit("in").alias("direction")))
    edges = ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1])
    reached = nodes.select("entity", "node").join(edges.filter(F.col("node") != F.col("other")), "node")
    named = reached.join(labels.withColumnRenamed("node", "other"), "other")
    return named.select(
        "entity", "label", speak_predicate(F.col("p"), base, tuple(relation_prefixes)).alias("predicate"), "direction"
    ).distinct()


def _seed_nodes(triples: DataFrame, seeds: DataFrame, base: str) -> DataFrame:
    wanted = seeds.select("entity", normalise_label(F.col("entity")).alias("_key")).distinct()
    labels = _labelled(triples, base).withColumn("_key", normalise_label(F.col("label")))
    return labels.join(wanted, "_key")


def neighbors(
    triples: DataFrame, seeds: DataFrame, base: str, direction: str = "both",
    relation_prefixes: Sequence[str] = RELATION_PREFIXES,
) -> DataFrame:
    """One answer per seed: spelling, found, nodes, neighbor_count, neighbors[label, via[]].

    A seed nobody carries is an answer too (found = false), not an error. An answer nests all
    neighbours of its seed; ``neighbor_edges`` gives them as rows.
    """
    edges = neighbor_edges(triples, seeds, base, direction, relation_prefixes)
    grouped = edges.groupBy("entity", "label").agg(
        F.array_sort(F.collect_set(F.struct("predicate", "direction"))).alias("via")
    )
    answers = grouped.groupBy("entity").agg(
        F.count("*").alias("neighbor_count"), F.array_sort(F.collect_list(F.struct("label", "via"))).alias("neighbors")
    )
    nodes = _seed_nodes(triples, seeds, base).groupBy("entity").agg(
        F.min("label").alias("spelling"), F.count_distinct("node").alias("nodes")
    )
    return seeds.select("entity").distinct().join(nodes, "entity", "left").join(answers, "entity", "left").select(
        "entity", F.coalesce("spelling", "entity").alias("spelling"), F.col("nodes").isNotNull().alias("found"),
        F.coalesce("nodes", F.lit(0)).alias("nodes"), F.lit(direction).alias("direction"),
        F.coalesce("neighbor_count", F.lit(0)).alias("neighbor_count"), "neighbors",
    )


@dataclass(frozen=True)
class Literal:
    """A literal as constant of a pattern; a plain string is an IRI (or ``?name``, a variable)."""

    value: str
    datatype: str | None = None


Term = str | Literal
Pattern = tuple[Term, Term, Term]


def _is_variable(term: Term) -> bool:
    return isinstance(term, str) and term.startswith("?")


def _constant(term: Term, column: str) -> Column:
    """Whether a column holds a constant: value, and in object place kind (and datatype, where one is given)."""
    if isinstance(term, Literal):
        same = (F.col(column) == term.value) & (F.col("o_kind") == "literal")
        return same if term.datatype is None else same & (F.col("o_type") == term.datatype)
    return (F.col(column) == term) & (F.col("o_kind") == "iri") if column == "o" else F.col(column) == term


def _matches(triples: DataFrame, pattern: Pattern) -> DataFrame:
    """Rows of one pattern with its variables as columns (``?x``, its kind and its datatype)."""
    rows, columns, seen = triples, [], {}
    for term, column in zip(pattern, ("s", "p", "o")):
        if not _is_variable(term):
            rows = rows.filter(_constant(term, column))
        elif term in seen:
            rows = rows.filter(F.col(column) == F.col(seen[term]))
            if column == "o":
                rows = rows.filter(F.col("o_kind") == "iri")
        else:
            seen[term] = column
            kind, datatype = (F.col("o_kind"), F.col("o_type")) if column == "o" else (F.lit("iri"), F.lit(None).cast("string"))
            columns += [F.col(column).alias(term[1:]), kind.alias(f"_kind_{term[1:]}"), datatype.alias(f"_type_{term[1:]}")]
    return rows.select(*columns)


def _selectivity(pattern: Pattern) -> tuple[int, int]:
    """Bound object or subject before bound predicate only, fewer variables first."""
    s, p, o = (not _is_variable(t) for t in pattern)
    return -(2 * o + 2 * s + p), sum(map(_is_variable, pattern))


def solve_patterns(triples: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """All bindings of conjunctive patterns: one filtered scan each, equi-joined on shared variables.

    The join starts at the pattern with the most bound places and goes on with the most bound one that shares a
    variable, whatever the order they are written in. Shared variables join on value, kind and datatype. A pattern
    without variables is a condition on the whole. Patterns that share no variable with the rest are refused rather
    than multiplied out.
    """
    if not patterns:
        raise ValueError("at least one pattern is needed")
    ground = [p for p in patterns if not any(map(_is_variable, p))]
    waiting = [(p, {t[1:] for t in p if _is_variable(t)}) for p in sorted((p for p in patterns if p not in ground), key=_selectivity)]
    if waiting:
        first, bound = waiting.pop(0)
        solved = _matches(triples, first)
    else:
        solved = triples.filter(_all_constants(ground[0])).select(F.lit(1).alias("_any")).limit(1)
    while waiting:
        position = next((i for i, (_, names) in enumerate(waiting) if names & bound), None)
        if position is None:
            raise ValueError("patterns must be connected by shared variables")
        pattern, names = waiting.pop(position)
        shared = sorted(names & bound)
        rows = _matches(triples, pattern)
        kinds = [f"_{what}_{n}" for n in shared for what in ("kind", "type")]
        other = rows.withColumnsRenamed({c: f"_other{c}" for c in [*shared, *kinds]})
        same = [solved[c].eqNullSafe(other[f"_other{c}"]) if c.startswith("_type_") else solved[c] == other[f"_other{c}"] for c in [*shared, *kinds]]
        solved = solved.join(other, reduce(Column.__and__, same)).drop(*(f"_other{c}" for c in [*shared, *kinds]))
        bound = bound | names
    for pattern in ground:
        solved = solved.filter(triples.filter(_all_constants(pattern)).limit(1).agg(F.count("*")).scalar() > 0)
    return solved


def _all_constants(pattern: Pattern) -> Column:
    return reduce(Column.__and__, (_constant(t, c) for t, c in zip(pattern, ("s", "p", "o"))))


def clamp_limit(limit: int) -> int:
    return max(1, min(int(limit), MAX_LIMIT))


def match_patterns(
    triples: DataFrame, patterns: Sequence[Pattern], base: str, select: Sequence[str] | None = None,
    where: Column | None = None, limit: int = DEFAULT_LIMIT, distinct: bool = False,
) -> DataFrame:
    """Rows of the selected variables, abbreviated, in order, cut at ``limit`` with a flag.

    The cut is a top-k over ``limit + 1`` rows: enough to know whether more existed.
    """
    solved = solve_patterns(triples, patterns)
    if where is not None:
        solved = solved.filter(where)
    names = [n.removeprefix("?") for n in select] if select else [c for c in solved.columns if not c.startswith("_")]
    shown = solved.select(*(abbreviate(F.col(n), F.col(f"_kind_{n}"), base).alias(n) for n in names))
    if distinct:
        shown = shown.distinct()
    return _cut(shown, limit, *names)


def pattern_exists(triples: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """One row: does any binding exist?"""
    return solve_patterns(triples, patterns).limit(1).agg((F.count("*") > 0).alias("exists"))


def _cut(df: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first ``limit`` rows, with a flag that tells whether more existed; a top-k over ``limit + 1`` rows."""
    limit = clamp_limit(limit)
    everything = Window.partitionBy(F.lit(1))  # at most limit + 1 rows are left
    return df.orderBy(*order).limit(limit + 1).withColumn("_n", F.row_number().over(everything.orderBy(*order))).withColumn(
        "truncated", F.count("*").over(everything) > limit
    ).filter(F.col("_n") <= limit).drop("_n")


def construct_triples(triples: DataFrame, patterns: Sequence[Pattern], template: Sequence[Pattern], limit: int | None = None) -> DataFrame:
    """New triples, in the columns of a graph, from the bindings of the patterns; with a ``limit`` also ``truncated``.

    Bindings that would put a literal in subject or predicate place make no triple.
    """
    solved = solve_patterns(triples, patterns)

    def made(pattern: Pattern) -> Column:
        terms = [F.col(t[1:]) if _is_variable(t) else F.lit(t.value if isinstance(t, Literal) else t) for t in pattern]
        last = pattern[2]
        if _is_variable(last):
            kind, datatype = F.col(f"_kind_{last[1:]}"), F.col(f"_type_{last[1:]}")
        else:
            kind, datatype = F.lit("literal" if isinstance(last, Literal) else "iri"), F.lit(last.datatype if isinstance(last, Literal) else None).cast("string")
        sound = [F.col(f"_kind_{t[1:]}") != "literal" for t in pattern[:2] if _is_variable(t)]
        triple = F.struct(*(t.alias(n) for t, n in zip(terms, "spo")), kind.alias("o_kind"), datatype.alias("o_type"))
        return F.when(reduce(Column.__and__, sound), triple) if sound else triple

    built = solved.select(F.explode(F.array(*(made(p) for p in template))).alias("_t")).filter("_t IS NOT NULL").select("_t.*").distinct()
    return built if limit is None else _cut(built, limit, "s", "p", "o", "o_kind", "o_type")


def describe_node(triples: DataFrame, node: str, limit: int | None = None) -> DataFrame:
    """Every triple a node is subject or object of; with a ``limit`` also ``truncated``."""
    found = triples.filter((F.col("s") == node) | ((F.col("o") == node) & (F.col("o_kind") == "iri")))
    return found if limit is None else _cut(found, limit, "s", "p", "o", "o_kind", "o_type")


def predicate_counts(triples: DataFrame, base: str) -> DataFrame:
    """(predicate, is_relation, n)."""
    return triples.groupBy(F.col("p").alias("predicate")).agg(F.count("*").alias("n")).withColumn(
        "is_relation", is_relation(F.col("predicate"), base)
    )


def graph_schema(triples: DataFrame, base: str, predicates: int = 20, documents: int = 25) -> DataFrame:
    """What a caller needs to write a pattern: (section, name, detail, n).

    Sections: triples, node_type, vocabulary, relation (top ``predicates``), relations (distinct
    and facts), documents (count) and document (first ``documents`` by IRI).
    """
    counts = predicate_counts(triples, base)
    shown = abbreviate(F.col("predicate"), F.lit("iri"), base)
    nothing = F.lit(None).cast("string")

    def section(name: str, df: DataFrame, label: Column, n: Column, detail: Column = nothing) -> DataFrame:
        return df.select(F.lit(name).alias("section"), label.alias("name"), detail.alias("detail"), n.cast("bigint").alias("n"))

    relations = counts.filter("is_relation")
    top = relations.orderBy(F.col("n").desc(), "predicate").limit(predicates)
    types = triples.filter(F.col("p") == RDF_TYPE).groupBy("o").agg(F.count("*").alias("n"))
    docs = triples.filter((F.col("p") == RDF_TYPE) & (F.col("o") == base + "Document")).select("s")
    uris = triples.filter(F.col("p") == base + "sourceUri").groupBy("s").agg(F.min("o").alias("uri"))
    listed = docs.orderBy("s").limit(documents).join(uris, "s", "left")
    parts = (
        section("triples", triples.agg(F.count("*").alias("n")), nothing, F.col("n")),
        section("node_type", types, abbreviate(F.col("o"), F.lit("iri"), base), F.col("n")),
        section("vocabulary", counts.filter(~F.col("is_relation")), shown, F.col("n")),
        section("relations", relations.agg(F.count("*").alias("n")), F.lit("distinct"), F.col("n")),
        section("relations", relations.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), F.lit("facts"), F.col("n")),
        section("relation", top, F.concat(F.lit("rel:"), after(F.col("predicate"), F.lit(base + "relprop/"))), F.col("n")),
        section("documents", docs.agg(F.count("*").alias("n")), F.lit("count"), F.col("n")),
        section("document", listed, abbreviate(F.col("s"), F.lit("iri"), base), F.lit(None), F.col("uri")),
    )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def empty_result_hint(result: DataFrame, triples: DataFrame, base: str, top: int = 12) -> DataFrame:
    """The most used relation predicates, but only when ``result`` has no row."""
    rows = result.limit(1).agg(F.count("*")).scalar()
    return predicate_counts(triples, base).filter(F.col("is_relation") & (rows == 0)).orderBy(
        F.col("n").desc(), "predicate"
    ).limit(top).select(abbreviate(F.col("predicate"), F.lit("iri"), base).alias("predicate"), "n")


# --- named questions ---------------------------------------------------------------


def predicates_of(triples: DataFrame, label: Column | str, base: str) -> DataFrame:
    """Which predicates the nodes of a label actually carry."""
    nodes = _labelled(triples, base).filter(F.col("label") == label).select(F.col("node").alias("s")).distinct()
    return triples.join(nodes, "s", "left_semi").select("p").distinct()


def relation_predicates_by_use(triples: DataFrame, base: str) -> DataFrame:
    return predicate_counts(triples, base).filter("is_relation").select("predicate", "n").orderBy(F.col("n").desc(), "predicate")


def pointing_at(triples: DataFrame, label: str, base: str) -> DataFrame:
    """(source_label, p): what points at a label, and with what relation."""
    labels = _labelled(triples, base)
    targets = labels.filter(F.col("label") == label).select(F.col("node").alias("o"))
    facts = triples.filter(is_relation(F.col("p"), base)).select("s", "p", "o")
    return facts.join(targets, "o").join(labels.select(F.col("node").alias("s"), F.col("label").alias("source_label")), "s").select(
        "source_label", "p"
    )


def documents_mentioning(triples: DataFrame, label: str, base: str) -> DataFrame:
    """(source_uri) of documents that mention an entity with this label."""
    nodes = _labelled(triples, base).filter(F.col("label") == label).select(F.col("node").alias("o"))
    mentions = triples.filter(F.col("p") == base + "mentions").select(F.col("s").alias("doc"), "o").join(nodes, "o").select("doc")
    uris = triples.filter(F.col("p") == base + "sourceUri").select(F.col("s").alias("doc"), F.col("o").alias("source_uri"))
    return mentions.join(uris, "doc").select("source_uri")


def extraction_models(triples: DataFrame, base: str) -> DataFrame:
    """(s, p, o, model) of every assertion: one pivoting aggregate on the assertion."""
    names = {RDF_SUBJECT: "s", RDF_PREDICATE: "p", RDF_OBJECT: "o", base + "extractionModel": "model"}
    rows = triples.filter(F.col("p").isin(*names)).select(F.col("s").alias("assertion"), "p", "o")
    # A case-variant spelling gives one assertion two predicates: each is a row.
    ends = rows.filter(F.col("p") != RDF_PREDICATE).groupBy("assertion").agg(
        *(F.max(F.when(F.col("p") == iri, F.col("o"))).alias(name) for iri, name in names.items() if name != "p")
    )
    predicates = rows.filter(F.col("p") == RDF_PREDICATE).select("assertion", F.col("o").alias("p"))
    return ends.join(predicates, "assertion").filter(
        F.col("s").isNotNull() & F.col("o").isNotNull() & F.col("model").isNotNull()
    ).select("s", "p", "o", "model")


def labels_containing(triples: DataFrame, text: str, base: str) -> DataFrame:
    return _labelled(triples, base).filter(F.lower("label").contains(text.lower())).select("label").distinct()


def mentions_of(triples: DataFrame, terms: DataFrame, base: str) -> DataFrame:
    """(term, source_uri, mention_count) of every document naming a term, most mentions first.

    ``terms(term)`` are matched by label form, as the term index is keyed; every match is
    enumerated.
    """
    def pairs(predicate: str, s: str, o: str) -> DataFrame:
        return triples.filter(F.col("p") == base + predicate).select(F.col("s").alias(s), F.col("o").alias(o))

    keyed = terms.select("term", normalise_label(F.col("term")).alias("_key")).distinct()
    labels = pairs("labelText", "label_iri", "label_text").withColumn("_key", normalise_label(F.col("label_text")))
    postings = labels.join(keyed, "_key").join(pairs("hasLabelForm", "entity", "label_iri"), "label_iri")
    counted = postings.join(pairs("mentionCount", "entity", "n"), "entity", "left")
    located = counted.join(pairs("mentions", "doc", "entity"), "entity").join(pairs("sourceUri", "doc", "source_uri"), "doc")
    return located.select(
        "term", "source_uri", F.coalesce(F.col("n").cast("bigint"), F.lit(0)).alias("mention_count")
    ).orderBy("term", F.col("mention_count").desc(), "source_uri")


# --- drawing -------------------------------------------------------------------------


def _typed(triples: DataFrame) -> DataFrame:
    """(s, type) of every statement that makes a node one that is drawn."""
    return triples.filter(F.col("p") == RDF_TYPE).select("s", local_name(F.col("o")).alias("type")).filter(F.col("type").isin("Document", "Entity"))


def drawing_tables(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the drawing: documents, entities, shared short literal values.

    nodes(id, kind, label, node_group), edges(a, b, label): one undirected edge per pair.
    """
    name, drawn = local_name(F.col("p")), _typed(triples).select("s")
    about = triples.filter(F.col("p") != RDF_TYPE).withColumn("name", name)

    def first(name: str) -> Column:
        return F.min(F.when(F.col("name") == name, F.col("o")))

    # Types and descriptions of a node meet in one aggregate; only what has a type is drawn.
    named = about.filter(F.col("name").isin("title", "sourceUri", "label", "contentType")).select("s", "name", "o")
    described = named.unionByName(_typed(triples), allowMissingColumns=True).groupBy("s").agg(
        F.min("type").alias("type"), first("title").alias("title"), first("sourceUri").alias("uri"), first("label").alias("label"),
        first("contentType").alias("content_type"),
    ).filter(F.col("type").isNotNull())
    tail = local_name(F.col("s"))
    file_name = null_if_empty(last_segment(F.regexp_replace("uri", "/+$", "")))
    doc_label = F.coalesce(
        F.substring(null_if_empty(strip(F.col("title"))), 1, 40), F.substring(file_name, 1, 40), F.substring(tail, 1, 12)
    )
    entity_label = F.substring(F.coalesce(null_if_empty(F.col("label")), F.substring(tail, 1, 16)), 1, 40)
    is_doc = F.col("type") == "Document"
    nodes = described.select(
        F.col("s").alias("id"), F.when(is_doc, "document").otherwise("entity").alias("kind"),
        F.when(is_doc, doc_label).otherwise(entity_label).alias("label"),
        F.when(is_doc, F.coalesce(null_if_empty(F.col("content_type")), F.lit("unknown"))).otherwise("entity").alias("node_group"),
    )
    values = about.filter(
        (F.col("o_kind") == "literal") & ~F.col("name").isin(*M.SKIPPED_VALUES)
        & (F.length("o") <= M.VALUE_NODE_CHARS) & (strip(F.col("o")) != "")
    ).join(drawn, "s", "left_semi").select("s", "name", "o", F.concat("name", F.lit("="), "o").alias("value_id"))
    value_nodes = values.groupBy("value_id").agg(F.min("name").alias("name"), F.min("o").alias("o")).select(
        F.col("value_id").alias("id"), F.lit("value").alias("kind"),
        F.concat("name", F.lit(": "), F.substring("o", 1, 24)).alias("label"), F.lit("value").alias("node_group"),
    )
    links = about.filter((F.col("o_kind") == "iri") & ~F.col("name").isin(*M.SKIPPED_EDGES)).join(drawn, "s", "left_semi").join(
        drawn.select(F.col("s").alias("o")), "o", "left_semi"
    ).select("s", "o", F.translate("name", "_", " ").alias("label"))
    ends = links.unionByName(values.select("s", F.col("value_id").alias("o"), F.col("name").alias("label")))
    edges = ends.groupBy(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).agg(F.min("label").alias("label"))
    return nodes.unionByName(value_nodes), edges

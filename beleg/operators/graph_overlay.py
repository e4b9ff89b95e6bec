"""What labels and predicates mean, as additional triples beside an untouched graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beleg.functions.iris import RDF_PREDICATE, RDF_TYPE
from beleg.functions.text import last_segment, normalise_label, strip_accents
from beleg.operators.annotate import is_glossary_candidate, with_dated_key
from beleg.operators.graph_build import triple, triples_of
from beleg.sources.vocabulary import Vocabulary


def base_uris(triples: DataFrame) -> DataFrame:
    """(base, documents): what precedes ``sourceUri`` in any predicate, and how many statements use it."""
    found = triples.filter(F.col("p").endswith("/sourceUri")).groupBy("p").agg(F.count("*").alias("documents"))
    return found.select(F.regexp_replace("p", "sourceUri\\z", "").alias("base"), "documents")


def detect_base_uri(triples: DataFrame) -> str:
    """The graph's namespace: the first of ``base_uris``. Fails loudly."""
    # Distinct predicates merge map-side; one row reaches the driver.
    found = base_uris(triples).agg(F.min("base")).first()[0]
    if found is None:
        raise ValueError("no predicate ending in /sourceUri: cannot tell the graph's base URI")
    return found


def by_suffix(triples: DataFrame, suffix: str) -> DataFrame:
    """(s, o) of every predicate with that last path segment, whatever its namespace."""
    return triples.filter(F.col("p").endswith(f"/{suffix}")).select("s", "o")


def resolve_labels(labels: DataFrame, vocab: Vocabulary, text: str = "label_text") -> DataFrame:
    """Adds outcome (contested, best, generic, unresolved), rule, slug, term_type, senses.

    Keys are tried in rule order: the normalised label, its accent-free form, that without a
    stop suffix. The first key the vocabulary knows decides.
    """
    suffix = vocab.meta.select("suffix_pattern").scalar()
    keyed = labels.withColumn("_exact", normalise_label(F.col(text)))
    keyed = keyed.withColumn("_ascii_fold", strip_accents(F.col("_exact")))
    keyed = keyed.withColumn("_desuffix", F.regexp_replace("_ascii_fold", suffix, ""))
    rules = ("exact", "ascii_fold", "desuffix")
    for rule in rules:
        entry = vocab.keys.select(
            F.col("key").alias(f"_key_{rule}"),
            F.struct(F.lit(rule).alias("rule"), "slug", "type", "generic", "senses").alias(f"_hit_{rule}"),
        )
        keyed = keyed.join(entry, keyed[f"_{rule}"] == entry[f"_key_{rule}"], "left").drop(f"_key_{rule}")
    resolved = keyed.withColumn("_hit", F.coalesce(*(F.col(f"_hit_{rule}") for rule in rules)))
    outcome = (
        F.when(F.col("_hit").isNull(), "unresolved")
        .when(F.col("_hit.senses").isNotNull(), "contested")
        .when(F.col("_hit.generic"), "generic")
        .otherwise("best")
    )
    resolved = resolved.withColumn("outcome", outcome)
    best = F.col("outcome") == "best"
    return resolved.withColumns({
        "rule": F.when(best, F.col("_hit.rule")),
        "slug": F.when(best, F.col("_hit.slug")),
        "term_type": F.when(best, F.col("_hit.type")),
        "senses": F.when(F.col("outcome") == "contested", F.array_sort("_hit.senses")),
    }).drop("_hit", *(f"_{rule}" for rule in rules), *(f"_hit_{rule}" for rule in rules))


def canonical_predicates(predicates: DataFrame, vocab: Vocabulary, p: str = "p") -> DataFrame:
    """Adds raw_name, canonical and controlled; spelling case does not matter."""
    named = predicates.withColumn("raw_name", last_segment(F.col(p)))
    return named.join(vocab.predicate_map, F.lower("raw_name") == F.col("raw"), "left").drop("raw").withColumn(
        "controlled", F.col("canonical").isNotNull()
    )


def relation_predicates(triples: DataFrame) -> DataFrame:
    """Distinct predicate IRIs that assertions use: (p)."""
    return triples.filter((F.col("p") == RDF_PREDICATE) & (F.col("o_kind") == "iri")).select(
        F.col("o").alias("p")
    ).distinct()


def label_weights(triples: DataFrame) -> DataFrame:
    """(label_iri, mentions): counts summed over the entities that carry a label.

    Joined on the entity, which belongs to one document; the label, which may be a third of
    the corpus, is only ever a key of a partially merged sum.
    """
    counts = by_suffix(triples, "mentionCount").select(F.col("s").alias("entity"), F.col("o").alias("n"))
    forms = by_suffix(triples, "hasLabelForm").select(F.col("s").alias("entity"), F.col("o").alias("label_iri"))
    return forms.join(counts, "entity", "left").groupBy("label_iri").agg(
        F.coalesce(F.sum(F.col("n").cast("bigint")), F.lit(0)).alias("mentions")
    )


def labels_of(triples: DataFrame) -> DataFrame:
    return by_suffix(triples, "labelText").select(F.col("s").alias("label_iri"), F.col("o").alias("label_text"))


def unresolved_head(triples: DataFrame, vocab: Vocabulary, limit: int = 15) -> DataFrame:
    """The glossary's work queue: unresolved candidate labels by mentions, then text."""
    waiting = resolve_labels(labels_of(triples), vocab).filter(
        (F.col("outcome") == "unresolved") & is_glossary_candidate(F.col("label_text"))
    )
    return (
        waiting.join(label_weights(triples), "label_iri", "left")
        .groupBy("label_text").agg(F.coalesce(F.sum("mentions"), F.lit(0)).alias("mentions"))
        .orderBy(F.col("mentions").desc(), "label_text").limit(limit)
    )


def _glossary_iri(base: str, meta: DataFrame) -> Column:
    digest = F.substring(F.substring_index("content_hash", ":", -1), 1, 12)
    return meta.select(F.concat(F.lit(base + "glossary/"), digest)).scalar()


def overlay_glossary_node(vocab: Vocabulary, base: str) -> DataFrame:
    """The node that names the vocabulary version every annotation refers to."""
    digest = F.substring(F.substring_index("content_hash", ":", -1), 1, 12)
    node = F.concat(F.lit(base + "glossary/"), digest)
    return triples_of(
        vocab.meta,
        triple(node, RDF_TYPE, base + "GlossaryVersion"),
        triple(node, base + "contentHash", F.col("content_hash"), "string"),
        triple(node, base + "schemaVersion", F.col("schema_version"), "string"),
        triple(node, base + "termIriBase", F.col("term_iri_base"), "string"),
    )


def overlay_labels(triples: DataFrame, vocab: Vocabulary, base: str, resolved: DataFrame | None = None) -> DataFrame:
    """Linked labels get term, rule and type; disputed ones every claimant; generic ones nothing."""
    resolved = resolve_labels(labels_of(triples), vocab) if resolved is None else resolved
    terms, vocabulary = (vocab.meta.select(c).scalar() for c in ("term_iri_base", "vocab_iri_base"))
    glossary, label = _glossary_iri(base, vocab.meta), F.col("label_iri")
    linked = triples_of(
        resolved.filter(F.col("outcome") == "best"),
        triple(label, base + "canonicalTerm", F.concat(terms, F.col("slug"))),
        triple(label, base + "matchRule", F.col("rule"), "string"),
        triple(label, base + "termType", F.concat(vocabulary, F.col("term_type"))),
        triple(label, base + "accordingTo", glossary),
    )
    disputed = resolved.filter(F.col("outcome") == "contested")
    claims = triples_of(
        disputed.select("label_iri", F.explode("senses").alias("sense")),
        triple(label, base + "contestedTerm", F.concat(terms, F.col("sense"))),
    )
    return linked.unionByName(claims).unionByName(triples_of(disputed, triple(label, base + "accordingTo", glossary)))


def overlay_entities(triples: DataFrame, label_overlay: DataFrame, base: str) -> DataFrame:
    """Term and type of an entity's label, repeated beside the entity."""
    said = label_overlay.filter(F.col("p").isin(base + "canonicalTerm", base + "termType")).withColumnRenamed(
        "s", "label_iri"
    )
    forms = by_suffix(triples, "hasLabelForm").select(F.col("s").alias("entity"), F.col("o").alias("label_iri"))
    return forms.join(said, "label_iri").select(F.col("entity").alias("s"), "p", "o", "o_kind", "o_type").distinct()


def overlay_documents(triples: DataFrame, base: str) -> DataFrame:
    """Publication date and title read from the object key."""
    docs = with_dated_key(by_suffix(triples, "sourceUri"), "o")
    return triples_of(
        docs,
        triple(F.col("s"), base + "publicationDate", F.col("publication_date"), "date"),
        triple(F.col("s"), base + "title", F.col("title"), "string"),
    )


def overlay_predicates(triples: DataFrame, vocab: Vocabulary, base: str) -> DataFrame:
    """What a raw predicate spelling means, said once about the predicate itself."""
    controlled = canonical_predicates(relation_predicates(triples), vocab).filter("controlled")
    about = triples_of(
        controlled,
        triple(F.col("p"), base + "canonicalPredicate", F.concat(F.lit(base + "rel/"), F.col("canonical"))),
        triple(F.col("p"), base + "accordingTo", _glossary_iri(base, vocab.meta)),
    )
    node = F.concat(F.lit(base + "rel/"), F.col("canonical"))
    declared = vocab.predicates.join(controlled.select("canonical").distinct(), "canonical")
    definitions = triples_of(
        declared,
        triple(node, RDF_TYPE, base + "ControlledPredicate"),
        triple(node, base + "definition", F.nullif(F.col("definition"), F.lit("")), "string"),
        triple(node, base + "inversePredicate", F.concat(F.lit(base + "rel/"), F.nullif(F.col("inverse"), F.lit("")))),
        triple(node, base + "symmetric", F.coalesce("symmetric", F.lit(False)), "boolean"),
    )
    return about.unionByName(definitions)


def annotate_graph(triples: DataFrame, vocab: Vocabulary, base: str | None = None) -> DataFrame:
    """The whole overlay. It only adds; the graph passed in is what it was."""
    base = base or detect_base_uri(triples)
    labels = overlay_labels(triples, vocab, base)
    parts = (
        labels,
        overlay_entities(triples, labels, base),
        overlay_documents(triples, base),
        overlay_predicates(triples, vocab, base),
    )
    result = overlay_glossary_node(vocab, base)
    for part in parts:
        result = result.unionByName(part)
    return result


def annotation_report(triples: DataFrame, vocab: Vocabulary, base: str, overlay: DataFrame | None = None) -> DataFrame:
    """One row of counts of what an annotation pass read and wrote."""
    overlay = annotate_graph(triples, vocab, base) if overlay is None else overlay
    p, s = F.col("p"), F.col("s")
    written = overlay.agg(
        F.count("*").alias("overlay_triples"),
        F.count_if((p == base + "canonicalTerm") & s.startswith(base + "entity/")).alias("entities_annotated"),
        F.count_if(p == base + "publicationDate").alias("documents_dated"),
        F.count_if(p == base + "canonicalPredicate").alias("predicates_annotated"),
    )
    outcomes = resolve_labels(labels_of(triples), vocab).groupBy().pivot(
        "outcome", ["best", "contested", "generic", "unresolved"]
    ).count()
    counted = outcomes.select(
        *(F.coalesce(F.col(name), F.lit(0)).alias(alias) for name, alias in (
            ("best", "labels_linked"), ("contested", "labels_contested"),
            ("generic", "labels_generic"), ("unresolved", "labels_unresolved")))
    )
    return written.select(
        triples.agg(F.count("*")).scalar().alias("graph_triples"), "overlay_triples",
        *(counted.select(c).scalar().alias(c) for c in counted.columns),
        "entities_annotated", "documents_dated", "predicates_annotated",
        relation_predicates(triples).agg(F.count("*")).scalar().alias("predicates_total"),
    )

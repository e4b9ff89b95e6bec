"""Documents and extractions to relational tables to triples.

Tables keep ids as IRIs under one base. Every table is unique by its IRI when it leaves its
function, and the predicates of different tables never coincide, so triples need no global
``distinct``: only properties and relations, where two rows may state the same, are reduced.
Rows that state the same belong to one document. Tables that still carry their ``doc_id`` come from
one record per document and are reduced within it, where its rows already lie, without an exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beleg.functions.ids import assertion_id, document_id, entity_id, label_id
from beleg.functions.iris import RDF_OBJECT, RDF_PREDICATE, RDF_SUBJECT, RDF_TYPE, XSD
from beleg.functions.text import is_blank, normalise_label, short_hash, slug

TRIPLE_COLUMNS = ("s", "p", "o", "o_kind", "o_type")


def iri(base: str, segment: str, local: Column) -> Column:
    return F.concat(F.lit(base + segment), local)


def _doc_iri(base: str, docs: DataFrame) -> Column:
    key = F.col("doc_id") if "doc_id" in docs.columns else document_id(F.col("source_uri"))
    return iri(base, "doc/", key)


def graph_documents(docs: DataFrame, base: str) -> DataFrame:
    """Identification and extraction flags; the body stays out of the graph."""
    return docs.select(
        _doc_iri(base, docs).alias("doc_iri"), "source_uri", "content_type", "size_bytes",
        (~is_blank(F.col("text"))).alias("has_text"),
        F.coalesce(F.col("text_truncated"), F.lit(False)).alias("text_truncated"),
    )


def graph_properties(docs: DataFrame, base: str, *carried: str) -> DataFrame:
    """One row per property of a document; ``carried`` columns of the document stay beside it."""
    return docs.select(*carried, _doc_iri(base, docs).alias("doc_iri"), F.explode("properties").alias("key", "value")).select(
        *carried, "doc_iri", iri(base, "prop/", slug(F.col("key"))).alias("predicate_iri"), "value"
    )


def _named(extractions: DataFrame) -> DataFrame:
    """(doc_id, label, mentions) for entities and relation endpoints of each extraction."""
    ends = F.flatten(F.transform("relations", lambda r: F.array(r["s"], r["o"])))
    labels = F.array_distinct(F.concat("entities", ends))
    return extractions.select("doc_id", "mention_counts", F.explode_outer(labels).alias("label")).filter(F.col("label").isNotNull()).select(
        "doc_id", "label", F.coalesce(F.element_at("mention_counts", F.col("label")), F.lit(0)).alias("mention_count")
    )


def graph_labels(extractions: DataFrame, base: str) -> DataFrame:
    """One row per label form of the corpus, spelled as its smallest spelling.

    A label in every document is one group, but its rows merge map-side before the exchange.
    """
    forms = _named(extractions).select(normalise_label(F.col("label")).alias("form"), "label")
    return forms.groupBy("form").agg(F.min("label").alias("label_text")).select(
        iri(base, "label/", short_hash(F.col("form"))).alias("label_iri"), "label_text"
    )


def graph_entities(extractions: DataFrame, base: str) -> DataFrame:
    """One posting per (document, label form), with the mention count of its smallest spelling."""
    named = _named(extractions).select(
        "doc_id", entity_id(F.col("doc_id"), F.col("label")).alias("id"), "label", "mention_count"
    )
    postings = named.groupBy("doc_id", "id").agg(
        F.min("label").alias("label"), F.min_by("mention_count", "label").alias("mention_count")
    )
    return postings.select(
        iri(base, "entity/", F.col("id")).alias("entity_iri"), "label",
        iri(base, "label/", label_id(F.col("label"))).alias("label_iri"),
        iri(base, "doc/", F.col("doc_id")).alias("doc_iri"), "mention_count",
    )


def graph_relations(extractions: DataFrame, base: str, *carried: str, ends: bool = False) -> DataFrame:
    """One row per extracted (s, p, o) with the provenance of its assertion; ``carried`` columns stay beside it.

    ``ends`` adds the label forms of both ends, for those who rename entities before triples are made.
    """
    doc = F.col("doc_id")
    rows = extractions.select("doc_id", "model", "extracted_at", F.explode_outer(F.array_distinct("relations")).alias("r")).filter(F.col("r").isNotNull())
    s, p, o = F.col("r.s"), F.col("r.p"), F.col("r.o")
    return rows.select(
        *carried,
        iri(base, "assertion/", assertion_id(doc, s, p, o)).alias("assertion_iri"),
        iri(base, "entity/", entity_id(doc, s)).alias("subject_iri"),
        iri(base, "relprop/", slug(p)).alias("predicate_iri"),
        iri(base, "entity/", entity_id(doc, o)).alias("object_iri"),
        iri(base, "doc/", doc).alias("doc_iri"),
        F.col("model").alias("extraction_model"),
        "extracted_at",
        *((iri(base, "label/", label_id(end)).alias(name) for name, end in (("subject_form", s), ("object_form", o))) if ends else ()),
    )


def triple(s: Column, p: Column | str, o: Column | str, o_type: str | None = None) -> Column:
    """One triple as a struct; with ``o_type`` the object is a literal of that type."""
    p = F.lit(p) if isinstance(p, str) else p
    o = F.lit(o) if isinstance(o, str) else o
    kind = "iri" if o_type is None else "literal"
    datatype = F.lit(None).cast("string") if o_type is None else F.lit(XSD + o_type)
    return F.struct(s.alias("s"), p.alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"),
                    datatype.alias("o_type"))


def triples_of(df: DataFrame, *triples: Column, apart: bool = False) -> DataFrame:
    """Several triples per row; rows with a null object give none for it.

    ``apart`` makes one select of each triple: a later filter on the predicate then leaves only those it wants,
    with the columns they need, where one generator would make all triples of a row first.
    """
    if apart:
        parts = [df.select(t["s"].alias("s"), t["p"].alias("p"), t["o"].alias("o"), t["o_kind"].alias("o_kind"), t["o_type"].alias("o_type")) for t in triples]
        return reduce(DataFrame.unionByName, parts).filter(F.col("o").isNotNull())
    return df.select(F.inline_outer(F.array(*triples))).filter(F.col("o").isNotNull())


def _once_per_document(relations: DataFrame) -> DataFrame:
    """Marks the rows of one record per document that state an edge, an assertion, or its predicate first."""
    assertion = Window.partitionBy("doc_id", "assertion_iri").orderBy("predicate_iri")
    edge = Window.partitionBy("doc_id", "subject_iri", "predicate_iri", "object_iri").orderBy("predicate_iri")
    return relations.withColumns({
        "new_assertion": F.row_number().over(assertion) == 1,
        "new_predicate": ~F.lag("predicate_iri").over(assertion).eqNullSafe(F.col("predicate_iri")),
    }).withColumn("new_edge", F.row_number().over(edge) == 1)


def timestamp_literal(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def expand_triples(
    base: str, documents: DataFrame | None = None, properties: DataFrame | None = None, labels: DataFrame | None = None,
    entities: DataFrame | None = None, relations: DataFrame | None = None, apart: bool = False,
) -> DataFrame:
    """Triples (s, p, o, o_kind, o_type) of the given tables, without duplicates.

    ``apart`` as in ``triples_of``: for readers of a few predicates.
    """
    c, parts = F.col, []
    if documents is not None:
        doc = c("doc_iri")
        parts.append(triples_of(
            documents,
            triple(doc, RDF_TYPE, base + "Document"),
            triple(doc, base + "sourceUri", c("source_uri"), "string"),
            triple(doc, base + "contentType", c("content_type"), "string"),
            triple(doc, base + "sizeBytes", c("size_bytes"), "integer"),
            triple(doc, base + "hasText", c("has_text"), "boolean"),
            triple(doc, base + "textTruncated", c("text_truncated"), "boolean"), apart=apart,
        ))
    if properties is not None:
        said = properties.distinct() if "doc_id" in properties.columns else properties.select("doc_iri", "predicate_iri", "value").distinct()
        parts.append(triples_of(said, triple(c("doc_iri"), c("predicate_iri"), c("value"), "string"), apart=apart))
    if labels is not None:
        parts.append(triples_of(
            labels,
            triple(c("label_iri"), RDF_TYPE, base + "Label"),
            triple(c("label_iri"), base + "labelText", c("label_text"), "string"), apart=apart,
        ))
    if entities is not None:
        entity = c("entity_iri")
        parts.append(triples_of(
            entities,
            triple(entity, RDF_TYPE, base + "Entity"),
            triple(entity, base + "label", c("label"), "string"),
            triple(entity, base + "hasLabelForm", c("label_iri")),
            triple(c("doc_iri"), base + "mentions", entity),
            triple(entity, base + "mentionCount", c("mention_count"), "integer"), apart=apart,
        ))
    if relations is not None:
        assertion = c("assertion_iri")
        edge, predicate, about = triple(c("subject_iri"), c("predicate_iri"), c("object_iri")), triple(assertion, RDF_PREDICATE, c("predicate_iri")), (
            triple(assertion, RDF_TYPE, base + "Assertion"),
            triple(assertion, RDF_SUBJECT, c("subject_iri")),
            triple(assertion, RDF_OBJECT, c("object_iri")),
            triple(assertion, base + "derivedFrom", c("doc_iri")),
            triple(assertion, base + "extractionModel", c("extraction_model"), "string"),
            triple(assertion, base + "extractedAt", timestamp_literal(c("extracted_at")), "dateTime"),
        )
        if "doc_id" in relations.columns:
            once = _once_per_document(relations)
            if apart:
                parts += [triples_of(once.filter("new_edge"), edge, apart=True), triples_of(once.filter("new_predicate"), predicate, apart=True),
                          triples_of(once.filter("new_assertion"), *about, apart=True)]
            else:
                parts.append(triples_of(once, F.when(c("new_edge"), edge), F.when(c("new_predicate"), predicate), *(F.when(c("new_assertion"), t) for t in about)))
        else:
            parts.append(triples_of(relations, edge, predicate, *about, apart=apart).distinct())
    if not parts:
        raise ValueError("no table given")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result

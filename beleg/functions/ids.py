"""Identity rules of the graph: what makes two things the same thing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beleg.functions.text import normalise_label, short_hash


def document_id(source_uri: Column) -> Column:
    return short_hash(source_uri)


def entity_id(doc_id: Column, label: Column) -> Column:
    """Scoped to one document: homonyms in two documents stay apart."""
    return short_hash(F.concat(doc_id, F.lit("|"), normalise_label(label)))


def label_id(label: Column) -> Column:
    """Corpus-wide lexical grouping."""
    return short_hash(normalise_label(label))


def assertion_id(doc_id: Column, subject: Column, predicate: Column, obj: Column) -> Column:
    return short_hash(F.concat_ws("|", doc_id, *(normalise_label(c) for c in (subject, predicate, obj))))

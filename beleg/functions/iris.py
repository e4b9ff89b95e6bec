"""Namespaces of the graph and how IRIs are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beleg.functions.text import after, strip

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"

RDF_TYPE = f"{RDF}type"
RDF_SUBJECT = f"{RDF}subject"
RDF_PREDICATE = f"{RDF}predicate"
RDF_OBJECT = f"{RDF}object"

# Prefix and the path segment it stands for.
SEGMENTS = (("rel", "relprop/"), ("ent", "entity/"), ("doc", "doc/"), ("lbl", "label/"), ("asr", "assertion/"))


def prefixes(base: str) -> dict[str, str]:
    bound = {"kg": base, "rdf": RDF, "rdfs": RDFS}
    bound.update({prefix: base + segment for prefix, segment in SEGMENTS})
    return bound


def abbreviate(term: Column, kind: Column, base: str) -> Column:
    """``prefix:local`` when that is a valid prefixed name, else the full IRI; literals as they are.

    The longest matching namespace decides, also when its local part is not usable.
    """
    by_length = sorted(prefixes(base).items(), key=lambda item: (-len(item[1]), item[0]))
    shown = F.when(kind == "literal", term)
    for prefix, namespace in by_length:
        local = after(term, F.lit(namespace))
        usable = ~(local.contains("/") | local.contains("#"))
        shown = shown.when(
            term.startswith(namespace),
            F.when(usable, F.concat(F.lit(f"{prefix}:"), local)).otherwise(term),
        )
    return shown.otherwise(term)


def speak_predicate(predicate: Column, base: str, relation_prefixes: tuple[str, ...] = ("relprop/",)) -> Column:
    """Relation predicate as words: prefix off, ``_`` to space, stripped."""
    spoken = F.lit(None).cast("string")
    for prefix in relation_prefixes:
        full = base + prefix
        spoken = F.when(
            predicate.startswith(full), strip(F.translate(after(predicate, F.lit(full)), "_", " "))
        ).otherwise(spoken)
    return spoken


def is_relation(predicate: Column, base: str, relation_prefixes: tuple[str, ...] = ("relprop/",)) -> Column:
    """A predicate that states a fact, as opposed to the graph's own vocabulary."""
    hit = F.lit(False)
    for prefix in relation_prefixes:
        hit = hit | predicate.startswith(base + prefix)
    return hit

"""A derived graph without duplicate predicates, duplicate entities and orphans.

Rewrites touch only the rows whose term can change: hub terms such as type IRIs, documents
and label forms never become join keys, so their frequency does not skew a partition.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beleg.functions.iris import RDF_OBJECT, RDF_PREDICATE, RDF_SUBJECT, RDF_TYPE
from beleg.operators.graph_build import TRIPLE_COLUMNS, graph_entities, graph_relations, timestamp_literal, triple, triples_of
from beleg.operators.graph_overlay import canonical_predicates, relation_predicates, resolve_labels
from beleg.session import cut_lineage
from beleg.sources.vocabulary import Vocabulary


def _predicate_mapping(triples: DataFrame, vocab: Vocabulary, base: str) -> DataFrame:
    """(old, new) for controlled predicates whose canonical IRI differs."""
    mapped = canonical_predicates(relation_predicates(triples), vocab).filter("controlled").select(
        F.col("p").alias("old"), F.concat(F.lit(base + "rel/"), F.col("canonical")).alias("new")
    )
    return mapped.filter(F.col("old") != F.col("new"))


def _renamed(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Replace a column by its mapping where it has one."""
    joined = rows.join(mapping, rows[column] == mapping["old"], "left")
    return joined.withColumn(column, F.coalesce("new", column)).drop("old", "new")


def canonicalize_predicates(triples: DataFrame, vocab: Vocabulary, base: str) -> DataFrame:
    """Fold every controlled spelling onto ``rel/<canonical>``, in edges and in assertions."""
    mapping = _predicate_mapping(triples, vocab, base)
    reified = (F.col("p") == RDF_PREDICATE) & (F.col("o_kind") == "iri")
    edge = F.col("p").startswith(base + "relprop/") | F.col("p").startswith(base + "rel/")
    rest = triples.filter(~reified & ~edge)
    # Only rewritten kinds can come to coincide, so only they are reduced again.
    edges = _renamed(triples.filter(edge), mapping, "p").select(*TRIPLE_COLUMNS)
    assertions = _renamed(triples.filter(reified), mapping, "o").select(*TRIPLE_COLUMNS)
    return rest.unionByName(edges.unionByName(assertions).distinct())


def predicate_edges_rewritten(triples: DataFrame, vocab: Vocabulary, base: str) -> DataFrame:
    """One row: how many edges and assertions change their predicate."""
    mapping = _predicate_mapping(triples, vocab, base)
    changed = triples.select(
        F.when((F.col("p") == RDF_PREDICATE) & (F.col("o_kind") == "iri"), F.col("o"))
        .when(F.col("p").startswith(base + "relprop/"), F.col("p")).alias("old")
    ).filter(F.col("old").isNotNull()).join(mapping.select("old"), "old", "left_semi")
    return changed.agg(F.count("*").alias("predicate_edges_rewritten"))


def _predicate_use(triples: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(raw_name, canonical, controlled, n): assertion predicates with their triple counts."""
    names = canonical_predicates(relation_predicates(triples), vocab)
    counts = triples.groupBy("p").agg(F.count("*").alias("n"))
    return names.join(counts, "p", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def uncontrolled_head(triples: DataFrame, vocab: Vocabulary, limit: int = 20) -> DataFrame:
    """Uncontrolled predicates by use, then name."""
    return _predicate_use(triples, vocab).filter(~F.col("controlled")).select(
        F.col("raw_name").alias("predicate"), F.col("n").alias("triples")
    ).orderBy(F.col("triples").desc(), "predicate").limit(limit)


def predicate_merges(triples: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Canonical names that more than one spelling folds onto, most merged first."""
    folded = canonical_predicates(relation_predicates(triples), vocab).filter("controlled")
    return folded.groupBy("canonical").agg(F.array_sort(F.collect_set("raw_name")).alias("raw_names")).filter(
        F.size("raw_names") > 1
    ).orderBy(F.size("raw_names").desc(), "canonical")


def entity_groups(triples: DataFrame, vocab: Vocabulary, base: str) -> DataFrame:
    """(entity, group_key, is_term): labels of one confident term are one group, others stand alone.

    An entity has one label form and a label at most one term, so groups are disjoint and no
    connected components are needed.
    """
    forms = triples.filter(F.col("p") == base + "hasLabelForm").select(F.col("s").alias("entity"), F.col("o").alias("label_iri"))
    texts = triples.filter(F.col("p") == base + "labelText").select(F.col("s").alias("label_iri"), F.col("o").alias("label_text"))
    terms = resolve_labels(texts, vocab).filter(F.col("outcome") == "best").select("label_iri", "slug")
    return forms.join(terms, "label_iri", "left").select(
        "entity", "label_iri", "slug",
        F.when(F.col("slug").isNotNull(), F.concat(F.lit("term:"), "slug")).otherwise(
            F.concat(F.lit("label:"), "label_iri")).alias("group_key"),
    )


def _canonical_entities(triples: DataFrame, vocab: Vocabulary, base: str) -> DataFrame:
    """Per group: smallest member, size and summed mentions (members without a count add 0)."""
    counts = triples.filter(F.col("p") == base + "mentionCount").select(F.col("s").alias("entity"), F.col("o").cast("bigint").alias("n"))
    members = entity_groups(triples, vocab, base).join(counts, "entity", "left")
    return members.groupBy("group_key").agg(
        F.min("entity").alias("canonical"), F.count("*").alias("size"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"),
    ).filter(F.col("size") > 1)


def consolidate_entities(triples: DataFrame, vocab: Vocabulary, base: str, cut=cut_lineage) -> DataFrame:
    """Merge every group into its smallest IRI: edges repointed, mentions summed.

    The other members' own descriptions (type, label, label form, count) go. Predicates are
    compared by full IRI, so a relation that happens to be named ``label`` survives.

    Groups and renames are needed in several places and are far smaller than the graph, so
    they are written once.
    """
    groups = cut(_canonical_entities(triples, vocab, base))
    mapping = cut(entity_groups(triples, vocab, base).join(groups, "group_key").filter(
        F.col("entity") != F.col("canonical")
    ).select(F.col("entity").alias("old"), F.col("canonical").alias("new")))

    own = [RDF_TYPE, *(base + name for name in ("hasLabelForm", "mentionCount", "label"))]
    about_entity = F.col("s").startswith(base + "entity/")
    points_at_entity = (F.col("o_kind") == "iri") & F.col("o").startswith(base + "entity/")

    described = triples.filter(about_entity & F.col("p").isin(own))
    # A merged group's count is replaced; every other description of the canonical node stays.
    kept = described.join(mapping.select(F.col("old").alias("s")), "s", "left_anti")
    kept = kept.join(
        groups.select(F.col("canonical").alias("s"), F.lit(base + "mentionCount").alias("p")), ["s", "p"], "left_anti"
    ).select(*TRIPLE_COLUMNS)
    summed = groups.select(
        F.col("canonical").alias("s"), F.lit(base + "mentionCount").alias("p"),
        F.col("mentions").cast("string").alias("o"), F.lit("literal").alias("o_kind"),
        F.lit("http://www.w3.org/2001/XMLSchema#integer").alias("o_type"),
    )
    moving = triples.filter(~(about_entity & F.col("p").isin(own)) & (about_entity | points_at_entity))
    subjects = _renamed(moving.filter(about_entity), mapping, "s").unionByName(moving.filter(~about_entity))
    pointed = _renamed(subjects.filter(points_at_entity), mapping, "o").unionByName(subjects.filter(~points_at_entity))
    still = triples.filter(~about_entity & ~points_at_entity)
    return still.unionByName(kept).unionByName(summed).unionByName(pointed.select(*TRIPLE_COLUMNS).distinct())


def _folded_relations(graphs: DataFrame, vocab: Vocabulary, base: str) -> DataFrame:
    """Relations under folded predicates; the rows of a document that state an assertion, or its predicate, first are marked."""
    named = canonical_predicates(graph_relations(graphs, base, "doc_id", ends=True), vocab, "predicate_iri")
    folded = named.withColumn("predicate_iri", F.when(F.col("controlled"), F.concat(F.lit(base + "rel/"), "canonical")).otherwise(F.col("predicate_iri")))
    assertion = Window.partitionBy("doc_id", "assertion_iri").orderBy("predicate_iri")
    return folded.withColumns({
        "new_assertion": F.row_number().over(assertion) == 1,
        "new_predicate": ~F.lag("predicate_iri").over(assertion).eqNullSafe(F.col("predicate_iri")),
    })


class MergedRecords(NamedTuple):
    """Triples of merged records, and what a report counts beside them."""

    triples: DataFrame
    groups: DataFrame          # labels, entities: how many each merged entity stands for
    unused: DataFrame | None   # canonical, kept: unmentioned entities, kept where an assertion needs them; only when they are pruned


def merge_records(graphs: DataFrame, vocab: Vocabulary, base: str, prune: bool = False, cut=cut_lineage) -> MergedRecords:
    """What ``canonicalize_predicates``, ``consolidate_entities`` and, with ``prune``, ``prune_orphans`` make of the extracted part of a built graph, from its records.

    graphs: one extraction record per document, exchanged by ``doc_id``. Entities are renamed by their label form, of which a corpus
    has far fewer than entities, before triples are made: postings and relations are written once, every description of a merged
    entity is left out before it is made, and only rows that two entities of one term can make equal are reduced again. An orphan's
    forms get no name, so nothing that names it is made.
    """
    c, entity_columns = F.col, ("doc_iri", "entity_iri", "label_iri", "label", "mention_count")
    relation_columns = ("assertion_iri", "predicate_iri", "subject_form", "object_form", "extraction_model", "extracted_at", "new_assertion", "new_predicate")
    # One table, so that both start at the records' one exchange.
    table = cut(graph_entities(graphs, base).select(*entity_columns).unionByName(
        _folded_relations(graphs, vocab, base).select("doc_iri", *relation_columns), allowMissingColumns=True))
    postings, relations = table.filter("entity_iri IS NOT NULL").select(*entity_columns), table.filter("assertion_iri IS NOT NULL")

    forms = postings.groupBy("label_iri").agg(
        F.min("label").alias("label_text"), F.min(F.struct("entity_iri", "label")).alias("least"), F.sum("mention_count").alias("mentions"), F.count("*").alias("entities"))
    slug = F.when(c("outcome") == "best", c("slug")).alias("slug")
    forms = cut(resolve_labels(forms, vocab).select(
        "label_iri", "label_text", slug, F.struct("least.entity_iri", "least.label", "label_iri").alias("least"), "mentions", "entities"))
    alone, of_terms = forms.filter("slug IS NULL"), forms.filter("slug IS NOT NULL")
    terms = of_terms.groupBy("slug").agg(
        F.min("least").alias("least"), F.sum("mentions").alias("mentions"), F.count("*").alias("labels"), F.sum("entities").alias("entities"))
    sized = ("least", "mentions", "labels", "entities")
    groups = alone.withColumn("labels", F.lit(1).cast("bigint")).select(*sized).unionByName(terms.select(*sized)).select("least.*", "mentions", "labels", "entities")
    # Forms of terms are as few as the vocabulary's keys, and as frequent as terms are.
    termed = cut(of_terms.join(terms.select("slug", c("least.entity_iri").alias("canonical")), "slug").select("label_iri", "canonical"))
    own = alone.select("label_iri", c("least.entity_iri").alias("canonical"))

    stated, described, unused = relations.filter("new_assertion"), groups, None
    if prune:
        # Few names stay unmentioned in a whole corpus; written, they are seen to be few before the ends of all assertions meet them.
        zero = groups.filter("mentions = 0").select(c("entity_iri").alias("canonical"))
        zero = cut(own.unionByName(termed).join(zero, "canonical", "left_semi").select("label_iri", "canonical"))
        needed = stated.select(F.explode(F.array("subject_form", "object_form")).alias("label_iri")).join(zero, "label_iri").select("canonical").distinct()
        unused = cut(zero.select("canonical").distinct().join(needed.withColumn("kept", F.lit(True)), "canonical", "left").fillna(False, ["kept"]))
        orphans = unused.filter("NOT kept").select("canonical")
        own, termed = own.join(orphans, "canonical", "left_anti"), termed.join(orphans, "canonical", "left_anti")
        described = groups.join(orphans.withColumnRenamed("canonical", "entity_iri"), "entity_iri", "left_anti")

    mentions = postings.select(c("doc_iri").alias("s"), F.lit(base + "mentions").alias("p"), "label_iri")
    ends = stated.select(c("assertion_iri").alias("s"), F.inline(F.array(
        F.struct(F.lit(RDF_SUBJECT).alias("p"), c("subject_form").alias("label_iri")), F.struct(F.lit(RDF_OBJECT).alias("p"), c("object_form").alias("label_iri")))))
    pointing = [
        # A document may mention two entities of one term; it has one entity of a form, and an assertion has one subject and one object.
        mentions.join(termed, "label_iri").select("s", "p", "canonical").distinct(),
        ends.join(termed, "label_iri").select("s", "p", "canonical"),
        mentions.unionByName(ends).join(termed, "label_iri", "left_anti").join(own, "label_iri").select("s", "p", "canonical"),
    ]
    renamed = own.unionByName(termed)
    edges = relations.filter("predicate_iri IS NOT NULL").select("subject_form", "predicate_iri", "object_form").distinct()
    edges = edges.join(renamed.select(c("label_iri").alias("subject_form"), c("canonical").alias("s")), "subject_form").join(
        renamed.select(c("label_iri").alias("object_form"), c("canonical").alias("o")), "object_form").select("s", "predicate_iri", "o").distinct()

    assertion, label, entity = c("assertion_iri"), c("label_iri"), c("entity_iri")
    parts = [
        triples_of(forms, triple(label, RDF_TYPE, base + "Label"), triple(label, base + "labelText", c("label_text"), "string")),
        triples_of(
            described, triple(entity, RDF_TYPE, base + "Entity"), triple(entity, base + "label", c("label"), "string"),
            triple(entity, base + "hasLabelForm", label), triple(entity, base + "mentionCount", c("mentions"), "integer")),
        triples_of(relations.filter("new_predicate"), triple(assertion, RDF_PREDICATE, c("predicate_iri"))),
        triples_of(
            stated, triple(assertion, RDF_TYPE, base + "Assertion"), triple(assertion, base + "derivedFrom", c("doc_iri")),
            triple(assertion, base + "extractionModel", c("extraction_model"), "string"),
            triple(assertion, base + "extractedAt", timestamp_literal(c("extracted_at")), "dateTime")),
        triples_of(reduce(DataFrame.unionByName, pointing), triple(c("s"), c("p"), c("canonical"))),
        triples_of(edges, triple(c("s"), c("predicate_iri"), c("o"))),
    ]
    return MergedRecords(reduce(DataFrame.unionByName, parts), groups.select("labels", "entities"), unused)


def consolidate_records(graphs: DataFrame, vocab: Vocabulary, base: str, cut=cut_lineage) -> DataFrame:
    """The triples of ``merge_records`` with every orphan."""
    return merge_records(graphs, vocab, base, cut=cut).triples


def _zero_mentions(triples: DataFrame, base: str) -> DataFrame:
    """Entities that are counted and counted zero."""
    zero = triples.filter((F.col("p") == base + "mentionCount") & (F.col("o").cast("bigint") == 0)).select(F.col("s").alias("entity"))
    entities = triples.filter((F.col("p") == RDF_TYPE) & (F.col("o") == base + "Entity")).select(F.col("s").alias("entity"))
    return zero.join(entities, "entity", "left_semi").distinct()


def _assertion_ends(triples: DataFrame) -> DataFrame:
    return triples.filter(F.col("p").isin(RDF_SUBJECT, RDF_OBJECT)).select(F.col("o").alias("entity"))


def orphan_entities(triples: DataFrame, base: str) -> DataFrame:
    """Unmentioned entities that are no end of an assertion."""
    return _zero_mentions(triples, base).join(_assertion_ends(triples), "entity", "left_anti")


def flagged_entities(triples: DataFrame, base: str) -> DataFrame:
    """Unmentioned entities kept because an assertion needs them."""
    return _zero_mentions(triples, base).join(_assertion_ends(triples), "entity", "left_semi")


def prune_orphans(triples: DataFrame, base: str) -> DataFrame:
    """Drop orphans with every triple they are part of."""
    orphans = orphan_entities(triples, base)
    about_entity = F.col("s").startswith(base + "entity/")
    points_at_entity = (F.col("o_kind") == "iri") & F.col("o").startswith(base + "entity/")
    subjects = triples.filter(about_entity).join(orphans.select(F.col("entity").alias("s")), "s", "left_anti")
    remaining = subjects.select(*TRIPLE_COLUMNS).unionByName(triples.filter(~about_entity))
    pointed = remaining.filter(points_at_entity).join(orphans.select(F.col("entity").alias("o")), "o", "left_anti")
    return pointed.select(*TRIPLE_COLUMNS).unionByName(remaining.filter(~points_at_entity))


@dataclass(frozen=True)
class CleanStages:
    """The graph before, between and after the passes; a report reads them all."""

    source: DataFrame
    folded: DataFrame
    merged: DataFrame
    cleaned: DataFrame


def clean_stages(triples: DataFrame, vocab: Vocabulary, base: str, cut=cut_lineage) -> CleanStages:
    """Run the passes one after the other; ``cut`` ends the lineage of each stage."""
    folded = cut(canonicalize_predicates(triples, vocab, base))
    merged = cut(consolidate_entities(folded, vocab, base, cut))
    return CleanStages(triples, folded, merged, cut(prune_orphans(merged, base)))


def clean_graph(triples: DataFrame, vocab: Vocabulary, base: str) -> DataFrame:
    """Predicates folded, entities merged, orphans dropped, on a derived copy."""
    return clean_stages(triples, vocab, base).cleaned


def triple_counts(triples: DataFrame, cut=cut_lineage) -> DataFrame:
    """(p, named, n): triples by predicate, and by the predicate or type they name. A report reads its graph once for it."""
    p = F.col("p")
    named = F.when((p == RDF_TYPE) | ((p == RDF_PREDICATE) & (F.col("o_kind") == "iri")), F.col("o")).alias("named")
    return cut(triples.groupBy(p, named).agg(F.count("*").alias("n")))


def report_of_counts(
    source: DataFrame, cleaned: DataFrame, groups: DataFrame, unused: DataFrame, vocab: Vocabulary, base: str, folded: DataFrame | None = None,
) -> DataFrame:
    """One row of counts before and after each pass.

    source, cleaned, folded: ``triple_counts``, in parts if need be; without ``folded`` it is what the vocabulary makes of the source.
    groups(labels, entities): of each merged entity; unused(canonical, kept): unmentioned entities.
    """
    p, n = F.col("p"), F.col("n")

    def total(counts: DataFrame) -> Column:
        return counts.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()

    def entities(counts: DataFrame) -> Column:
        return total(counts.filter((p == RDF_TYPE) & (F.col("named") == base + "Entity")))

    def predicates(counts: DataFrame) -> DataFrame:
        return counts.filter((p == RDF_PREDICATE) & F.col("named").isNotNull()).select(F.col("named").alias("p")).distinct()

    def rows(df: DataFrame) -> Column:
        return df.agg(F.count("*")).scalar()

    known = canonical_predicates(predicates(source), vocab)
    canonical = F.when(F.col("controlled"), F.concat(F.lit(base + "rel/"), "canonical")).otherwise(p).alias("canonical")
    after = known.select(canonical).distinct() if folded is None else predicates(folded)
    old = F.when((p == RDF_PREDICATE) & F.col("named").isNotNull(), F.col("named")).when(p.startswith(base + "relprop/"), p)
    changing = known.select(p.alias("old"), canonical).filter("old <> canonical").select("old")
    rewritten = source.select(old.alias("old"), n).join(changing, "old", "left_semi")
    return groups.filter("entities > 1").agg(
        F.count_if(F.col("labels") == 1).alias("label_groups_merged"),
        F.count_if(F.col("labels") > 1).alias("alias_groups_merged"),
    ).select(
        total(source).alias("graph_triples"),
        total(cleaned).alias("clean_triples"),
        rows(known).alias("predicates_before"),
        rows(after).alias("predicates_after"),
        total(rewritten).alias("predicate_edges_rewritten"),
        rows(known.filter(~F.col("controlled"))).alias("predicates_uncontrolled"),
        entities(source).alias("entities_before"),
        entities(cleaned).alias("entities_after"),
        "label_groups_merged", "alias_groups_merged",
        rows(unused.filter("NOT kept")).alias("entities_dropped"),
        rows(unused.filter("kept")).alias("entities_flagged"),
    )


def clean_report(stages: CleanStages, vocab: Vocabulary, base: str, cut=cut_lineage) -> DataFrame:
    """One row of counts before and after each pass; every stage is read once for its counts."""
    groups = entity_groups(stages.folded, vocab, base).groupBy("group_key").agg(
        F.count("*").alias("entities"), F.count_distinct("label_iri").alias("labels"))
    unused = cut(orphan_entities(stages.merged, base).withColumn("kept", F.lit(False)).unionByName(
        flagged_entities(stages.merged, base).withColumn("kept", F.lit(True))))
    source, folded, cleaned = (triple_counts(t, cut) for t in (stages.source, stages.folded, stages.cleaned))
    return report_of_counts(source, cleaned, groups, unused, vocab, base, folded)

"""Entities and relations of documents: the plug-in point and the built-in gazetteer."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beleg.functions.text import is_blank, tokens
from beleg.operators.annotate import with_mention_counts

Extractor = Callable[[str], tuple[set[str], set[tuple[str, str, str]]]]

_RELATION = "array<struct<s:string,p:string,o:string>>"


def extract_with(docs: DataFrame, extractor: Extractor, model: str, max_chars: int = 0) -> DataFrame:
    """Extractions of every non-blank document by a text -> (entities, relations) function.

    A document whose extractor fails is logged and left out; the others are unaffected.
    ``max_chars`` 0 passes the whole text.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                try:
                    entities, relations = extractor(text[:max_chars] if max_chars else text)
                except Exception:
                    logging.getLogger(__name__).exception("extraction failed for %s, skipped", doc_id)
                    continue
                rows.append((doc_id, sorted(entities), [{"s": s, "p": p, "o": o} for s, p, o in sorted(relations)]))
            yield pd.DataFrame(rows, columns=["doc_id", "entities", "relations"])

    texts = docs.filter(~is_blank(F.col("text"))).select("doc_id", "text")
    found = texts.mapInPandas(run, f"doc_id string, entities array<string>, relations {_RELATION}")
    return _finish(found, docs, model)


def _finish(found: DataFrame, docs: DataFrame, model: str) -> DataFrame:
    """Model, time, and mention counts of entities and endpoints over the whole text."""
    ends = F.flatten(F.transform("relations", lambda r: F.array(r["s"], r["o"])))
    labelled = found.join(docs.select("doc_id", "text"), "doc_id").withColumn("labels", F.array_union("entities", ends))
    return with_mention_counts(labelled).select(
        "doc_id", "entities", "relations", F.lit(model).alias("model"), F.current_timestamp().alias("extracted_at"), "mention_counts"
    )


def _anchored(keyed: DataFrame) -> DataFrame:
    """(label, words, anchor, at): each label with its word that the fewest labels hold (of equal ones the longest), and its place."""
    held = keyed.dropDuplicates(["words"]).select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("held"))
    each = keyed.dropDuplicates(["words"]).select("words", F.posexplode("words").alias("at", "word")).join(held, "word")
    chosen = each.groupBy("words").agg(F.min(F.struct("held", (-F.length("word")).alias("shorter"), "at", "word")).alias("best"))
    return keyed.join(chosen, "words").select("label", "words", F.col("best.word").alias("anchor"), F.col("best.at").alias("at"))


def gazetteer_mentions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, position, label): where known labels occur, by equi-join on one rare word of each label.

    Every word of a text is one row with the words around it that the longest label could reach; where it is the anchor of a
    label, the label is compared in place. No n-grams are written, and a word that many labels share is the anchor of those
    only that have no other.
    """
    keyed = labels.select("label", tokens(F.col("label")).alias("words")).filter(F.size("words") > 0)
    reach = (keyed.agg(F.max(F.size("words"))).first()[0] or 1) - 1
    # Outer: an inner generator infers a filter that would cut the text a second time.
    words = docs.select("doc_id", tokens(F.col("text")).alias("_t")).select("doc_id", "_t", F.posexplode_outer("_t").alias("place", "anchor"))
    if reach == 0:  # labels of one word are their own anchors
        alone = keyed.select("label", F.get("words", F.lit(0)).alias("anchor"))
        return words.drop("_t").join(alone, "anchor").select("doc_id", F.col("place").alias("position"), "label")
    before = F.least("place", F.lit(reach))
    around = words.select("doc_id", "place", "anchor", before.alias("before"), F.slice("_t", F.col("place") - before + 1, F.lit(2 * reach + 1)).alias("around"))
    met = around.join(_anchored(keyed), "anchor")
    # A label that would start before the text is none; slice takes no place below 1.
    same = F.when(F.col("before") >= F.col("at"), F.slice("around", F.col("before") - F.col("at") + 1, F.size("words")) == F.col("words"))
    return met.filter(F.coalesce(same, F.lit(False))).select("doc_id", (F.col("place") - F.col("at")).alias("position"), "label")


def extract_with_gazetteer(docs: DataFrame, labels: DataFrame, model: str = "gazetteer") -> DataFrame:
    """Known labels as entities; labels that follow each other in a text as co-mentions.

    A document's mentions form one window: bounded by its length, however common a label is.
    """
    mentions = gazetteer_mentions(docs, labels)
    counts = mentions.groupBy("doc_id", "label").agg(F.count("*").alias("n")).groupBy("doc_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("mention_counts")
    )
    following = Window.partitionBy("doc_id").orderBy("position", "label")
    steps = mentions.withColumn("_next", F.lead("label").over(following)).filter(F.col("_next") != F.col("label"))
    relations = steps.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct(
        F.col("label").alias("s"), F.lit("mentioned with").alias("p"), F.col("_next").alias("o")))).alias("relations"))
    found = docs.filter(~is_blank(F.col("text"))).select("doc_id").join(counts, "doc_id", "left").join(relations, "doc_id", "left")
    return found.select(
        "doc_id", F.coalesce(F.map_keys("mention_counts"), F.array().cast("array<string>")).alias("entities"),
        F.coalesce("relations", F.array().cast(_RELATION)).alias("relations"), F.lit(model).alias("model"),
        F.current_timestamp().alias("extracted_at"),
        F.coalesce("mention_counts", F.create_map().cast("map<string,bigint>")).alias("mention_counts"),
    )

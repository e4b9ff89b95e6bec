"""Documents on the way in: text choice, chunks, pending work, latest records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beleg.functions import markers as M
from beleg.functions.text import is_blank, strip


def choose_extraction(
    docs: DataFrame, primary: str = "primary_text", fallback: str = "fallback_text", max_chars: int | None = None,
) -> DataFrame:
    """Keep the primary text when it is long enough, else the longer one; warn when there is none.

    Adds ``text`` and ``text_truncated`` and extends ``properties``; the two candidates go.
    """
    first, second = F.coalesce(F.col(primary), F.lit("")), F.coalesce(F.col(fallback), F.lit(""))
    length = F.length(strip(first))
    raw = F.when(
        (length >= M.MIN_CHARS_BEFORE_FALLBACK) | (F.length(strip(second)) <= length), first
    ).otherwise(second)
    cut = F.lit(False) if max_chars is None else F.length("_raw") > max_chars
    text = F.col("_raw") if max_chars is None else F.substring("_raw", 1, max_chars)
    warning = F.create_map(F.lit("extractionWarning"), F.lit(M.NO_TEXT_WARNING))
    own = F.coalesce(F.col("properties"), F.create_map().cast("map<string,string>"))
    return (
        docs.withColumn("_raw", raw)
        .withColumns({"text": text, "text_truncated": cut})
        .withColumn("properties", F.when(
            is_blank(F.col("text")) & ~F.map_contains_key(own, "extractionWarning"), F.map_concat(own, warning)
        ).otherwise(own))
        .drop("_raw", primary, fallback)
    )


def chunk_pattern(size: int) -> str:
    """Longest run up to ``size`` that ends the text or a sentence; a longer sentence is cut hard."""
    return rf"(?s).{{1,{size}}}\z|.{{1,{size}}}(?<=[.!?]\s)|.{{1,{size}}}"


def chunks(text: Column, size: int = M.CHUNK_CHARS) -> Column:
    """Pieces of at most ``size`` characters on sentence boundaries; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(chunk_pattern(size)), F.lit(0))


def chunk_documents(
    docs: DataFrame, size: int = M.CHUNK_CHARS, max_chars: int = 0, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """One row per chunk: (doc_id, chunk_no, text). ``max_chars`` 0 means the whole document."""
    if size < 1 or max_chars < 0:
        raise ValueError("size must be positive and max_chars must not be negative")
    whole = F.col(text) if max_chars == 0 else F.substring(text, 1, max_chars)
    pieces = docs.select(doc_id, F.posexplode_outer(chunks(whole, size)).alias("chunk_no", "text"))
    return pieces.filter(F.col("chunk_no").isNotNull())


def latest_by_id(records: DataFrame, key: str = "doc_id", seq: str = "ingest_seq") -> DataFrame:
    """The last record of every id: one partial-merging aggregate, no window over all versions."""
    kept = [c for c in records.columns if c != key]
    latest = records.groupBy(key).agg(F.max_by(F.struct(*kept), F.col(seq)).alias("_row"))
    return latest.select(key, "_row.*").select(*records.columns)


def pending_objects(objects: DataFrame, docs: DataFrame, root: str = "") -> DataFrame:
    """Objects with no document at their uri, or one with another (non-null) etag."""
    known = docs.select(F.col("source_uri").alias("_uri"), F.col("etag").alias("_etag"))
    done = (F.concat(F.lit(root), F.col("key")) == F.col("_uri")) & (
        F.col("_etag").isNull() | (F.col("_etag") == F.col("etag"))
    )
    return objects.join(known, done, "left_anti")


def pending_by_manifest(objects: DataFrame, manifest: DataFrame) -> DataFrame:
    """Objects absent from the manifest or recorded there with another etag."""
    return objects.join(manifest.select("key", "etag"), ["key", "etag"], "left_anti").select(*objects.columns)


def pending_extractions(docs: DataFrame, extractions: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Documents without an extraction, optionally only those on an allow-list of uris."""
    waiting = docs.join(extractions.select("doc_id"), "doc_id", "left_anti")
    return waiting if allowed is None else waiting.join(allowed.select("source_uri"), "source_uri", "left_semi")


def summarize_by_extension(objects: DataFrame) -> DataFrame:
    """Count and bytes per extension, and the grand total (extension ``(total)``)."""
    named = objects.select(
        F.when(F.coalesce("extension", F.lit("")) == "", "(none)").otherwise(F.col("extension")).alias("extension"), "size"
    )
    rolled = named.rollup("extension").agg(
        F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.grouping("extension").alias("_all")
    )
    return rolled.select(
        F.when(F.col("_all") == 1, "(total)").otherwise(F.col("extension")).alias("extension"), "objects", "bytes"
    ).orderBy(F.col("bytes").desc(), "extension")


def build_summary(docs: DataFrame, extractions: DataFrame) -> DataFrame:
    """One row: documents, extracted documents, label forms, entities, relations, PDFs without text."""
    from beleg.operators.graph_build import graph_entities, graph_labels, graph_relations

    doc_counts = docs.agg(
        F.count("*").alias("documents"),
        F.count_if((F.col("content_type") == "application/pdf") & is_blank(F.col("text"))).alias("pdfs_without_text"),
    )
    return doc_counts.select(
        "documents",
        "pdfs_without_text",
        extractions.agg(F.count_distinct("doc_id")).scalar().alias("documents_with_extractions"),
        graph_labels(extractions, "").agg(F.count("*")).scalar().alias("label_forms"),
        graph_entities(extractions, "").agg(F.count("*")).scalar().alias("entities"),
        graph_relations(extractions, "").agg(F.count("*")).scalar().alias("relations"),
    )


def retrieval_coverage(hits: DataFrame, graph_docs: DataFrame) -> DataFrame:
    """How many retrieved uris exist as documents of the graph; hits without uri are skipped."""
    known = graph_docs.select(F.col("source_uri").alias("uri")).distinct().withColumn("_known", F.lit(True))
    return hits.filter(F.coalesce(F.col("uri"), F.lit("")) != "").join(known, "uri", "left").agg(
        F.count("*").alias("checked"), F.count_if(F.col("_known")).alias("matched")
    )


def endpoint_coverage(extractions: DataFrame) -> DataFrame:
    """Per document: distinct relation endpoints, and those missing from the entity list."""
    ends = F.array_distinct(F.flatten(F.transform("relations", lambda r: F.array(r["s"], r["o"]))))
    return extractions.select("doc_id", ends.alias("_ends"), "entities").select(
        "doc_id",
        F.size("_ends").alias("endpoints"),
        F.size(F.array_except("_ends", "entities")).alias("missing"),
    ).filter(F.col("endpoints") > 0)

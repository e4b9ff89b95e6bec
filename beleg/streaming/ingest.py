"""Incremental ingestion and extraction: only what is new or changed, saved as it is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beleg.operators.documents import latest_by_id, pending_extractions, pending_objects
from beleg.sources.objects import attach_sidecar, ingest_text, list_objects, objects_from_listing, read_bodies, read_sidecars, text_objects
from beleg.sources.records import DOCUMENT_SCHEMA, EXTRACTION_SCHEMA, append_log, read_log
from beleg.streaming.buckets import BUCKETS, State, buckets_of, read_buckets, state_of, upsert
from beleg.streaming.jobs import run_available

_DOCUMENT_COLUMNS = ("doc_id", "source_uri", "content_type", "size_bytes", "text", "text_truncated", "properties", "etag")

Hook = Callable[[DataFrame, int], None]


def records_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log's records; none before its first commit."""
    try:
        return read_log(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def next_sequence(log: DataFrame) -> Column:
    """Number of the next run: later runs supersede earlier ones on replay."""
    last = log.agg(F.max("ingest_seq")).first()[0]
    return F.lit(0 if last is None else last + 1).cast("bigint")


def _saved(spark: SparkSession, path: str, schema: str, seq: Column) -> DataFrame:
    """What a run has saved, read back from the log rather than computed again."""
    return read_log(spark, path, schema).filter(F.col("ingest_seq") == seq)


def ingest_pending(spark: SparkSession, source_root: str, docs_path: str, prefix: str = "", listing: DataFrame | None = None) -> None:
    """One batch: list without bodies, read pending text objects, append their records.

    ``listing`` (as of ``list_objects``) stands in for a listing of the root. Files older than the oldest pending one are
    not opened; when nothing is pending, none is.
    """
    log = records_or_empty(spark, docs_path, DOCUMENT_SCHEMA)
    known = latest_by_id(log.select("doc_id", "source_uri", "etag", "ingest_seq"))
    root = source_root.rstrip("/") + "/"
    listing = list_objects(spark, source_root, prefix) if listing is None else listing
    pending = text_objects(pending_objects(listing, known, root))
    oldest = pending.agg(F.min("last_modified")).first()[0]
    if oldest is None:
        return
    bodies = read_bodies(spark, source_root, oldest)
    docs = attach_sidecar(ingest_text(pending.join(bodies, "key"), root), read_sidecars(spark, source_root))
    append_log(docs.select(*_DOCUMENT_COLUMNS).withColumn("ingest_seq", next_sequence(log)), docs_path)


KNOWN_SCHEMA = "source_uri string, etag string, ingest_seq bigint"


def known_path(docs_path: str) -> str:
    """Where the etags of a log's documents are kept, by uri."""
    return f"{docs_path.rstrip('/')}.known"


def _known_state(spark: SparkSession, docs_path: str, buckets: int) -> State:
    """The state beside the log; made of the log's etags where there is none yet."""
    state = state_of(spark, known_path(docs_path))
    if state.version is not None:
        return state
    log = records_or_empty(spark, docs_path, DOCUMENT_SCHEMA).select("source_uri", "etag", "ingest_seq")
    return upsert(known_path(docs_path), KNOWN_SCHEMA, log, "log", 0, "source_uri", buckets=buckets)


def incremental_ingest(
    objects: DataFrame, docs_path: str, checkpoint: str, root: str = "", on_document: Hook | None = None, buckets: int = BUCKETS,
) -> None:
    """A stream of objects with content: each micro-batch appends its pending documents.

    What is done is known from a small table of etags in buckets by uri (``known_path``): a micro-batch reads the buckets of its
    own objects and rewrites those of what it appended; the log itself is read only where that table is missing.

    A batch that is replayed after a failure finds its objects done, or appends equal records;
    both replay to the same state. A side-car counts for the documents of its own batch. Objects that hold no text
    (see ``text_objects``) are left to the caller's extractor. ``on_document`` sees every batch of saved records.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = _known_state(spark, docs_path, buckets)
        newest = batch.groupBy("key").agg(F.max_by(F.struct("*"), F.struct("last_modified", "etag")).alias("o")).select("o.*")
        listed = objects_from_listing(newest)
        asked = buckets_of(listed.select(F.concat(F.lit(root), F.col("key")).alias("uri")), "uri", state.buckets or buckets)
        known = read_buckets(spark, known_path(docs_path), KNOWN_SCHEMA, asked, state)
        pending = text_objects(pending_objects(listed, known, root)).join(newest.select("key", "content"), "key")
        seq = F.lit(0 if state.top is None else state.top + 1).cast("bigint")
        docs = attach_sidecar(ingest_text(pending, root), newest.select("key", "content")).persist()
        try:
            append_log(docs.select(*_DOCUMENT_COLUMNS).withColumn("ingest_seq", seq), docs_path)
            upsert(known_path(docs_path), KNOWN_SCHEMA, docs.select("source_uri", "etag").withColumn("ingest_seq", seq), checkpoint, batch_id, "source_uri", buckets=buckets)
        finally:
            docs.unpersist()
        if on_document is not None:
            on_document(_saved(spark, docs_path, DOCUMENT_SCHEMA, seq), batch_id)

    run_available(objects, save, checkpoint)


def incremental_extract(
    docs: DataFrame, extractions_path: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame],
    on_graph: Hook | None = None,
) -> None:
    """A stream of documents: each micro-batch appends the extractions that are still missing."""
    def save(batch: DataFrame, batch_id: int) -> None:
        done = records_or_empty(batch.sparkSession, extractions_path, EXTRACTION_SCHEMA)
        seq = next_sequence(done)
        # Of several versions in one batch only the last is extracted.
        newest = latest_by_id(batch) if "ingest_seq" in batch.columns else batch.dropDuplicates(["doc_id"])
        append_log(extract(pending_extractions(newest, done)).withColumn("ingest_seq", seq), extractions_path)
        if on_graph is not None:
            on_graph(_saved(batch.sparkSession, extractions_path, EXTRACTION_SCHEMA, seq), batch_id)

    run_available(docs, save, checkpoint)


def upsert_latest(records: DataFrame, table_path: str, checkpoint: str, schema: str, buckets: int = BUCKETS) -> None:
    """A stream of records to a table of the latest record per id, one version per batch.

    Records are hashed to buckets and a batch rewrites only the buckets it touches (see ``buckets.upsert``). Each version starts
    from the last finished one, also under a new checkpoint. ``latest_version`` reads the newest.
    """
    run_available(records, lambda batch, batch_id: upsert(table_path, schema, batch, checkpoint, batch_id, buckets=buckets), checkpoint)


def latest_version(spark: SparkSession, table_path: str, schema: str) -> DataFrame:
    """The newest finished table of ``upsert_latest``."""
    return read_buckets(spark, table_path, schema)

"""Object listings and text ingestion with side-car metadata."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beleg.functions.ids import document_id
from beleg.functions.text import strip

SIDECAR_SUFFIX = ".metadata.json"


def extension_of(key: Column) -> Column:
    """Lower-case suffix of the last path segment without its dot; dot files have none."""
    name = F.substring_index(key, "/", -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def objects_from_listing(listing: DataFrame) -> DataFrame:
    """D1 from a raw listing (key, size, etag, last_modified); side-cars are no objects."""
    return listing.filter(~F.col("key").endswith(SIDECAR_SUFFIX)).select(
        "key", F.col("size").cast("bigint").alias("size"), F.trim(F.col("etag"), F.lit('"')).alias("etag"),
        F.col("last_modified").cast("timestamp").alias("last_modified"), extension_of(F.col("key")).alias("extension"),
    )


def _files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)


def _key(path: Column, root: str) -> Column:
    """Path below the root; ``file:`` and ``s3:`` spellings of the root are both recognised."""
    bare = root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    return F.substring(path, F.locate(bare, path) + len(bare), F.length(path))


def list_objects(spark: SparkSession, root: str, prefix: str = "", etag_from_content: bool = False) -> DataFrame:
    """Keys, sizes and times of the files under a root; bodies are read only for a content etag."""
    files = _files(spark, root)
    etag = F.sha2("content", 256) if etag_from_content else F.concat_ws("-", "length", F.unix_micros("modificationTime"))
    listing = files.select(
        _key(F.col("path"), root).alias("key"), F.col("length").alias("size"), etag.alias("etag"),
        F.col("modificationTime").alias("last_modified"),
    )
    return objects_from_listing(listing.filter(F.col("key").startswith(prefix)))


def read_bodies(spark: SparkSession, root: str, modified_since: datetime | None = None) -> DataFrame:
    """(key, content). The time filter is pushed to the source: older files are never opened."""
    files = _files(spark, root)
    if modified_since is not None:
        files = files.filter(F.col("modificationTime") >= F.lit(modified_since))
    return files.select(_key(F.col("path"), root).alias("key"), "content")


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(key, content) of the side-car files only."""
    return _files(spark, root, f"*{SIDECAR_SUFFIX}").select(_key(F.col("path"), root).alias("key"), "content")


def decode(content: Column) -> Column:
    """UTF-8 text, bad bytes replaced."""
    return F.make_valid_utf8(content.cast("string"))


_FRONT_MATTER = r"(?s)^\s*---[ \t]*\r?\n(.*?)(?:\r?\n)?---[ \t]*(?:\r?\n|\z)(.*)"
_NO_PROPERTIES = "map<string,string>"


def no_properties() -> Column:
    return F.create_map().cast(_NO_PROPERTIES)


def front_matter(text: Column) -> tuple[Column, Column]:
    """(properties, body) of a flat ``key: value`` front-matter block; without one, no properties."""
    head = F.regexp_extract(text, _FRONT_MATTER, 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda line: line.rlike(r"^[^\s#:][^:]*:(\s|$)"))
    entries = F.transform(lines, lambda line: F.struct(
        strip(F.regexp_extract(line, r"^([^:]*):", 1)).alias("key"),
        F.regexp_replace(strip(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)), r"^(['\"])(.*)\1$", "$2").alias("value"),
    ))
    has = text.rlike(_FRONT_MATTER)
    properties = F.when(has, F.map_from_entries(entries)).otherwise(no_properties())
    return properties, F.when(has, strip(F.regexp_extract(text, _FRONT_MATTER, 2))).otherwise(text)


def _is_nested(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return kind.startswith("OBJECT") | kind.startswith("ARRAY")


def _scalar_text(value: Column) -> Column:
    """A variant as text; nested values keep their JSON spelling."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return F.when(kind == "BOOLEAN", F.initcap(text)).when(kind == "VOID", F.lit("None")).otherwise(text)


def _object_map(text: Column) -> Column:
    """Top-level members of a JSON object as map<string, variant>; null for anything else."""
    parsed = F.try_parse_json(text)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed).cast("map<string,variant>")


def json_scalars(text: Column) -> Column:
    """Top-level scalars of a JSON object; bad JSON and other values give no properties."""
    scalars = F.map_filter(_object_map(text), lambda k, v: ~_is_nested(v))
    return F.coalesce(F.transform_values(scalars, lambda k, v: _scalar_text(v)), no_properties())


def sidecar_properties(text: Column) -> Column:
    """Flat properties of side-car JSON: typed attribute values are unwrapped; invalid gives none."""
    top = _object_map(text)
    wrapped = F.try_variant_get(F.element_at(top, "metadataAttributes"), "$", "map<string,variant>")
    attributes = F.when(F.map_contains_key(top, "metadataAttributes"), wrapped).otherwise(top)

    def flat(value: Column) -> Column:
        return F.coalesce(
            F.try_variant_get(value, "$.value.stringValue", "string"),
            F.try_variant_get(value, "$.value.numberValue", "string"),
            F.initcap(F.try_variant_get(value, "$.value.booleanValue", "string")),
            _scalar_text(F.coalesce(F.try_variant_get(value, "$.value", "variant"), value)),
        )

    return F.coalesce(F.transform_values(attributes, lambda k, v: flat(v)), no_properties())


# Content type by extension.
CONTENT_TYPES = {"md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "json": "application/json"}


def text_objects(objects: DataFrame) -> DataFrame:
    """Objects whose bytes are their text; the text of others (PDF) comes from an extractor through ``choose_extraction``."""
    return objects.filter(F.col("extension").isin(*CONTENT_TYPES))


def ingest_text(objects: DataFrame, root: str = "") -> DataFrame:
    """Document records of text objects (D1 plus ``content``).

    Markdown gives its front matter as properties and the rest as text; JSON gives its
    top-level scalars and its raw text; anything else is raw text.
    """
    extension, text = F.col("extension"), F.col("_text")
    properties, body = front_matter(text)
    markdown = extension.isin("md", "markdown")
    content_type = F.lit("text/plain")
    for name, value in CONTENT_TYPES.items():
        content_type = F.when(extension == name, F.lit(value)).otherwise(content_type)
    uri = F.concat(F.lit(root), F.col("key"))
    return objects.withColumn("_text", decode(F.col("content"))).select(
        document_id(uri).alias("doc_id"), uri.alias("source_uri"), content_type.alias("content_type"),
        F.col("size").alias("size_bytes"), F.when(markdown, body).otherwise(text).alias("text"),
        F.lit(False).alias("text_truncated"),
        F.when(markdown, properties).when(extension == "json", json_scalars(text)).otherwise(no_properties()).alias("properties"),
        "etag", "key",
    )


def attach_sidecar(docs: DataFrame, listing: DataFrame) -> DataFrame:
    """Merge ``<key>.metadata.json`` into the properties; the side-car wins.

    ``listing(key, content)`` holds the side-cars. Only their JSON is shuffled by key.
    """
    sidecars = listing.filter(F.col("key").endswith(SIDECAR_SUFFIX)).select(
        F.regexp_replace("key", r"\.metadata\.json$", "").alias("key"),
        sidecar_properties(decode(F.col("content"))).alias("_sidecar"),
    )
    # The side-car's members are appended last; duplicates are dropped here so that the
    # result does not depend on the session's duplicate-key policy.
    own = F.map_filter("properties", lambda k, v: ~F.map_contains_key(F.col("_sidecar"), k))
    merged = F.when(F.col("_sidecar").isNull(), F.col("properties")).otherwise(F.map_concat(own, F.col("_sidecar")))
    return docs.join(sidecars, "key", "left").withColumn("properties", merged).drop("_sidecar").select(*docs.columns)

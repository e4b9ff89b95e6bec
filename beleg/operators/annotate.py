"""What a passage's numbers mean: bases, years, truncation, projection, method.

Everything is a row-local column expression, so annotating is one narrow stage without a
shuffle, and only the columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beleg.functions import markers as M
from beleg.functions.pyregex import WORD, java_pattern
from beleg.functions.text import is_blank, null_if_empty, squeeze, strip


def bases(text: Column) -> Column:
    """Array of (basis, evidence) in fixed class order; empty when nothing is said."""
    haystack = F.translate(F.coalesce(text, F.lit("")), "_", " ")
    found = []
    for basis, patterns in M.BASIS_PATTERNS.items():
        spelled = [java_pattern(p, ignore_case=True) for p in patterns]
        any_of = "(?Ui)" + "|".join(p.removeprefix("(?Ui)") for p in spelled)
        # One scan rejects the common case of no evidence; the ordered scans run on hits only.
        evidence = F.when(
            haystack.rlike(any_of),
            squeeze(F.coalesce(*(null_if_empty(F.regexp_extract(haystack, p, 0)) for p in spelled))),
        )
        found.append(F.struct(F.lit(basis).alias("basis"), evidence.alias("evidence")))
    return F.filter(F.array(*found), lambda entry: entry["evidence"].isNotNull())


def span(years: Column) -> Column:
    """Struct of min, max and the sorted distinct years; null when there are none."""
    ordered = F.array_sort(F.array_distinct(years))
    return F.when(
        F.size(ordered) > 0,
        F.struct(F.array_min(ordered).alias("min"), F.array_max(ordered).alias("max"), ordered.alias("years")),
    )


def years_covered(text: Column) -> Column:
    """Years the text itself mentions as data points."""
    scannable = F.regexp_replace(F.coalesce(text, F.lit("")), java_pattern(M.PROGRAMME_NAME, ignore_case=True), " ")
    found = F.regexp_extract_all(scannable, F.lit(java_pattern(M.YEAR, ignore_case=True)), F.lit(1))
    numbers = F.transform(found, lambda y: y.cast("int"))
    return span(F.filter(numbers, lambda y: y.between(M.FIRST_YEAR, M.LAST_YEAR)))


def truncation_reasons(text: Column) -> Column:
    """Why a passage looks severed; empty when it does not (or is blank)."""
    stripped = strip(text)
    dangling = stripped.rlike(java_pattern(M.DANGLING_VALUE))
    unbalanced = F.regexp_count(text, F.lit("<data>")) != F.regexp_count(text, F.lit("</data>"))
    reasons = F.filter(
        F.array(
            F.when(stripped.rlike(java_pattern(M.OPENS_WITH_CLOSING_TAG)), F.lit(M.REASON_ORPHAN_TAG)),
            F.when(unbalanced, F.lit(M.REASON_UNBALANCED)),
            F.when(dangling, F.lit(M.REASON_DANGLING)).when(
                ~stripped.rlike(java_pattern(M.CLEAN_ENDING)), F.lit(M.REASON_MID_TOKEN)
            ),
        ),
        lambda reason: reason.isNotNull(),
    )
    return F.when(is_blank(text), F.array().cast("array<string>")).otherwise(reasons)


def is_projection(text: Column) -> Column:
    return F.coalesce(text.rlike(java_pattern(M.PROJECTION, ignore_case=True)), F.lit(False))


def extraction_method(text: Column, precision: Column) -> Column:
    """chart_visual_read, chart_label, table or null when the text does not say."""
    image_type = F.regexp_extract(text, java_pattern(M.IMAGE_TYPE, ignore_case=True, dotall=True), 1)
    return (
        F.when(text.isNull() | (text == ""), F.lit(None).cast("string"))
        .when(text.rlike(java_pattern(M.VISUAL_HINT, ignore_case=True)), F.lit("chart_visual_read"))
        .when(text.rlike(java_pattern(M.LABEL_HINT, ignore_case=True)), F.lit("chart_label"))
        .when(image_type.rlike(java_pattern(M.TABLE_HINT, ignore_case=True)), F.lit("table"))
        .when(precision == "estimated", F.lit("chart_visual_read"))
    )


def mention_count(text: Column, label: Column) -> Column:
    """Case-insensitive literal occurrences of a label, not inside a word, over the whole text."""
    wanted = strip(label)
    literal = F.concat(F.lit(r"\Q"), F.replace(wanted, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))
    # The literal is looked for first: most positions fail at its first letter, before the costlier look-behind.
    pattern = F.concat(F.lit("(?Ui)(?="), literal, F.lit(rf")(?<!{WORD})"), literal, F.lit(rf"(?!{WORD})"))
    return F.when(
        is_blank(label) | F.coalesce(text == "", F.lit(True)), F.lit(0)
    ).otherwise(F.regexp_count(text, pattern)).cast("bigint")


def published_at(title: Column) -> Column:
    return null_if_empty(F.regexp_extract(F.coalesce(title, F.lit("")), java_pattern(M.DOCUMENT_NAME, ignore_case=True), 1))


def title_slug(title: Column) -> Column:
    found = F.regexp_extract(F.coalesce(title, F.lit("")), java_pattern(M.DOCUMENT_NAME, ignore_case=True), 2)
    return F.translate(null_if_empty(found), "-", " ")


def is_glossary_candidate(label: Column) -> Column:
    """Could a person plausibly add this label to a glossary?"""
    text = strip(label)
    words = F.size(F.filter(F.split(squeeze(label), " "), lambda w: w != ""))
    return (
        (F.length(text) >= 3)
        & (words <= 8)
        & ~text.rlike(java_pattern(M.MEASUREMENT))
        & ~text.rlike(java_pattern(M.LEADING_NUMBER))
        & text.rlike(r"\p{L}")
    )


def with_document_name(df: DataFrame, title: str = "title") -> DataFrame:
    """Publication date and spaced-out slug read from ``<date>_<slug>.pdf``; else nulls."""
    return df.withColumns({"published_at": published_at(F.col(title)), "slug": title_slug(F.col(title))})


def with_bases(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("bases", bases(F.col(text)))


def with_years_covered(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("years_covered", years_covered(F.col(text)))


def with_truncation(df: DataFrame, text: str = "text") -> DataFrame:
    flagged = df.withColumn("truncation_reasons", truncation_reasons(F.col(text)))
    return flagged.withColumn("is_truncated", F.size("truncation_reasons") > 0)


def with_projection_flag(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("is_projection", is_projection(F.col(text)))


def with_extraction_method(df: DataFrame, text: str = "text", precision: str = "precision") -> DataFrame:
    return df.withColumn("extraction_method", extraction_method(F.col(text), F.col(precision)))


def annotate_passages(df: DataFrame, text: str = "text") -> DataFrame:
    """The annotations every returned passage carries."""
    return with_truncation(with_projection_flag(with_bases(with_years_covered(df, text), text), text), text)


def with_mention_counts(df: DataFrame, text: str = "text", labels: str = "labels") -> DataFrame:
    """Map of label to occurrences for the labels found in the same row's text.

    The labels belong to the row, so counting needs no join: the text is scanned where it is.
    """
    counted = F.transform(
        F.array_distinct(F.col(labels)),
        lambda label: F.struct(label.alias("key"), mention_count(F.col(text), label).alias("value")),
    )
    return df.withColumn("mention_counts", F.map_from_entries(counted))


def with_document_flags(docs: DataFrame) -> DataFrame:
    """Whether a document has text, and was cut; the body itself is dropped."""
    return docs.withColumn("has_text", ~is_blank(F.col("text"))).withColumn(
        "text_truncated", F.coalesce(F.col("text_truncated"), F.lit(False))
    ).drop("text")


def with_dated_key(docs: DataFrame, source_uri: str = "source_uri") -> DataFrame:
    """Publication date and title from the last path segment of the object key."""
    key = F.substring_index(F.col(source_uri), "/", -1)
    pattern = java_pattern(M.DATED_KEY)
    return docs.withColumns({
        "publication_date": null_if_empty(F.regexp_extract(key, pattern, 1)),
        "title": F.translate(null_if_empty(F.regexp_extract(key, pattern, 2)), "-", " "),
    })


def filter_glossary_candidates(labels: DataFrame, text: str = "label_text") -> DataFrame:
    return labels.filter(is_glossary_candidate(F.col(text)))


def project_source(source: Column, source_fields: str = "core") -> Column:
    """Short or full form of a source record as a map of the fields that are shown.

    Null fields are left out of the short form, except the download link: a null there says
    the document could not be matched.
    """
    if source_fields not in ("core", "all"):
        raise ValueError("source_fields must be 'core' or 'all'")
    names = M.CORE_SOURCE_FIELDS if source_fields == "core" else M.SOURCE_FIELDS
    entries = F.map_from_arrays(
        F.array(*(F.lit(n) for n in names)), F.array(*(source[n].cast("string") for n in names))
    )
    if source_fields == "all":
        return entries
    return F.map_filter(entries, lambda k, v: v.isNotNull() | (k == M.ALWAYS_SOURCE_FIELD))


def source_json(source: Column, source_fields: str = "core") -> Column:
    """The projected source record as JSON text with nulls kept where they are shown."""
    return F.to_json(project_source(source, source_fields), {"ignoreNullFields": "false"})


def project_passages(df: DataFrame, detail: str = "full") -> DataFrame:
    """Index level drops the verbatim text and keeps every annotation."""
    if detail not in ("index", "full"):
        raise ValueError("detail must be 'index' or 'full'")
    return df.drop("text") if detail == "index" else df



"""Number series out of chart transcriptions: passage table -> chart table -> cell table.

A block, its rows and its cells are parsed inside one row as nested arrays, so precision,
years and bases come from higher-order functions; nothing is shuffled until the caller
ranks charts. ``chart_cells`` unfolds to the long form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beleg.functions import markers as M
from beleg.functions.pyregex import java_pattern
from beleg.functions.text import is_blank, null_if_empty, strip
from beleg.operators.annotate import bases, extraction_method, is_projection, span

_ROW_MARK = "\u0001"
# What the mark, and the sign that stands for it, are while rows are marked: no word characters, so word boundaries stay.
_STAND_INS = (("\u0002", "\u0002?"), ("\u0001", "\u0002!"))


def data_blocks(text: Column) -> Column:
    """Array of (content, is_truncated): closed blocks, then a non-empty unterminated tail."""
    closed = F.transform(
        F.regexp_extract_all(text, F.lit("(?s)<data>(.*?)</data>"), F.lit(1)),
        lambda block: F.struct(strip(block).alias("content"), F.lit(False).alias("is_truncated")),
    )
    tail = F.substring_index(text, "<data>", -1)
    dangling = text.contains("<data>") & ~tail.contains("</data>") & ~is_blank(tail)
    open_block = F.struct(strip(tail).alias("content"), F.lit(True).alias("is_truncated"))
    return F.when(dangling, F.concat(closed, F.array(open_block))).otherwise(closed)


def extract_blocks(passages: DataFrame, text: str = "text") -> DataFrame:
    """One row per block with its position in the passage."""
    # Outer, then filtered: an inner explode infers a filter that parses the text once more.
    found = passages.select("*", F.posexplode_outer(data_blocks(F.col(text))).alias("block_pos", "block"))
    return found.filter(F.col("block_pos").isNotNull()).select(
        "*", F.col("block.content").alias("raw_block"), F.col("block.is_truncated").alias("is_truncated")
    ).drop("block")


def chart_title(text: Column) -> Column:
    return null_if_empty(strip(F.regexp_extract(text, "(?s)<title>(.*?)</title>", 1)))


def extract_title(passages: DataFrame, text: str = "text") -> DataFrame:
    return passages.withColumn("title", chart_title(F.col(text)))


def _number_repeats(columns: Column) -> Column:
    """The second and later copies of a column name get `` (2)``, `` (3)``..."""
    def numbered(name: Column, index: Column) -> Column:
        earlier = F.size(F.filter(F.slice(columns, F.lit(1), index), lambda other: other == name))
        return F.when(earlier == 0, name).otherwise(F.concat(name, F.lit(" ("), (earlier + 1).cast("string"), F.lit(")")))

    return F.transform(columns, numbered)


def split_block(blocks: DataFrame, block: str = "raw_block") -> DataFrame:
    """Note, columns and raw row texts; blocks without a column or a row are dropped."""
    raw = F.col(block)
    body = F.regexp_replace(raw, java_pattern(rf"{M.PROSE_MARKER}.*\z", dotall=True), "")
    masked, unmasked = body, lambda part: part
    for sign, stand_in in _STAND_INS:
        masked = F.replace(masked, F.lit(sign), F.lit(stand_in))
        unmasked = lambda part, back=unmasked, s=sign, t=stand_in: back(F.replace(part, F.lit(t), F.lit(s)))
    parts = F.transform(F.split(F.regexp_replace(masked, java_pattern(M.ROW_START), _ROW_MARK + "$0"), _ROW_MARK), lambda part: unmasked(part))
    names = F.filter(F.transform(F.split(F.element_at("_parts", 1), ","), strip), lambda c: c != "")
    note = strip(F.substring(raw, F.length("_body") + 1, F.length(raw)))
    return (
        blocks.withColumn("_body", body)
        .withColumn("_parts", parts)
        .withColumn("_names", names)
        .filter((F.size("_parts") > 1) & (F.size("_names") > 0))
        .withColumns({
            "note": F.when(F.length("_body") < F.length(raw), note),
            "columns": _number_repeats(F.col("_names")),
            "row_texts": F.slice("_parts", F.lit(2), F.size("_parts")),
        })
        .drop("_body", "_parts", "_names")
    )


def classify_cell(raw: Column) -> Column:
    """Struct (raw, value, min, max, kind): exact number, range or opaque text."""
    number = F.replace(strip(raw), F.lit("'"), F.lit(""))
    range_pattern = java_pattern(rf"^{M.NUMBER_RANGE}\z")
    exact = number.rlike(java_pattern(rf"^{M.EXACT_NUMBER}\z"))
    ranged = number.rlike(range_pattern)
    low = F.when(ranged, F.regexp_extract(number, range_pattern, 1)).try_cast("double")
    high = F.when(ranged, F.regexp_extract(number, range_pattern, 2)).try_cast("double")
    return F.struct(
        raw.alias("raw"),
        F.when(exact, number).try_cast("double").alias("value"),
        low.alias("min"),
        high.alias("max"),
        F.when(exact, "exact").when(ranged, "range").otherwise("text").alias("kind"),
    )


def split_rows(blocks: DataFrame) -> DataFrame:
    """Rows as arrays of classified cells, cut or padded to the number of columns."""
    width = F.size("columns")

    def cells(row: Column) -> Column:
        found = F.transform(F.split(row, ","), strip)
        missing = F.greatest(width - F.size(found), F.lit(0))
        padded = F.concat(F.slice(found, F.lit(1), width), F.array_repeat(F.lit(""), missing))
        return F.transform(padded, classify_cell)

    return blocks.withColumn("rows", F.transform("row_texts", cells)).drop("row_texts")


def chart_precision(rows: Column, block: Column) -> Column:
    """exact, estimated or mixed over the data cells; a disclosed estimate outranks their shape."""
    kinds = F.filter(
        F.flatten(F.transform(rows, lambda r: F.transform(F.slice(r, F.lit(2), F.size(r)), lambda c: c["kind"]))),
        lambda kind: kind != "text",
    )
    disclosed = block.rlike(java_pattern(M.ESTIMATION_WORDS, ignore_case=True)) & ~block.rlike(
        java_pattern(M.EXACTNESS_CLAIM, ignore_case=True)
    )
    return (
        F.when(F.size(kinds) == 0, "mixed")
        .when(F.forall(kinds, lambda k: k == "exact"), F.when(disclosed, "estimated").otherwise("exact"))
        .when(F.forall(kinds, lambda k: k == "range"), "estimated")
        .otherwise("mixed")
    )


def with_precision(charts: DataFrame) -> DataFrame:
    return charts.withColumn("precision", chart_precision(F.col("rows"), F.col("raw_block"))).withColumn(
        "is_estimate", F.col("precision") != "exact"
    )


def with_column_bases(charts: DataFrame, text: str = "text") -> DataFrame:
    """Per column what it measures: none for the label column, else header, else passage.

    The passage speaks for a column only when there is exactly one data column.
    """
    nothing = F.array().cast("array<struct<basis:string,evidence:string>>")
    fallback = F.when(F.size("columns") == 2, bases(F.col(text))).otherwise(nothing)

    def entry(name: Column, index: Column) -> Column:
        own = bases(name)
        chosen = F.when(index == 0, nothing).when(F.size(own) > 0, own).otherwise(F.col("_fallback"))
        return F.struct(name.alias("key"), chosen.alias("value"))

    return (
        charts.withColumn("_fallback", fallback)
        .withColumn("column_bases", F.map_from_entries(F.transform("columns", entry)))
        .drop("_fallback")
    )


def with_years_from_rows(charts: DataFrame) -> DataFrame:
    """Years of the label column only: a four-digit value never widens the span."""
    labels = F.transform("rows", lambda r: F.element_at(r, 1))
    yearlike = F.filter(
        labels,
        lambda c: (c["kind"] == "exact")
        & (c["value"] == F.floor(c["value"]))
        & c["value"].between(M.FIRST_YEAR, M.LAST_YEAR),
    )
    return charts.withColumn("years_covered", span(F.transform(yearlike, lambda c: c["value"].cast("int"))))


def charts_from_passages(passages: DataFrame, text: str = "text") -> DataFrame:
    """Every parsed chart of every passage with its annotations."""
    parsed = split_rows(split_block(extract_blocks(extract_title(passages, text), text)))
    annotated = with_years_from_rows(with_column_bases(with_precision(parsed), text))
    whole = F.concat_ws("\n", F.col(text), F.col("raw_block"))
    return annotated.withColumns({
        "extraction_method": extraction_method(whole, F.col("precision")),
        "is_projection": is_projection(whole),
        "row_count": F.size("rows"),
    })


def chart_cells(charts: DataFrame, *keys: str) -> DataFrame:
    """Long form: one row per cell with row and column position."""
    rows = charts.select(*keys, "columns", F.posexplode_outer("rows").alias("row_idx", "cells"))
    cells = rows.select(*keys, "columns", "row_idx", F.posexplode_outer("cells").alias("col_idx", "cell"))
    return cells.select(
        *keys, "row_idx", "col_idx", F.element_at("columns", F.col("col_idx") + 1).alias("column"), "cell.*"
    )

"""Publication catalogue entries out of saved listing pages."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from beleg.functions import markers as M
from beleg.functions.pyregex import java_pattern
from beleg.functions.text import null_if_empty, strip

_PAGE_ITEMS = 1 << 31  # position of an item = page number, then item number (an int), in one decimal


@F.pandas_udf(StringType())
def unescape_entities(text: pd.Series) -> pd.Series:
    """HTML entities to characters; Spark has no built-in for the full entity table."""
    return text.map(html.unescape, na_action="ignore")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def listing_items(pages: DataFrame) -> DataFrame:
    """(page_id, item_pos, block) for every listing block; pages without any give nothing."""
    pattern = java_pattern(M.LISTING_ITEM, dotall=True)
    return pages.filter(F.col("html").contains('<div class="list-group-item">')).select(
        "page_id", F.posexplode_outer(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("item_pos", "block")
    ).filter(F.col("block").isNotNull())


def read_catalogue_pages(pages: DataFrame) -> DataFrame:
    """(pub_id, title, pub_date, file_type, page_pos); blocks without title or link are dropped.

    Only the title text crosses to Python, and only of blocks that survive the drop.
    """
    block = F.col("block")
    title_pattern = java_pattern(M.LISTING_TITLE, dotall=True)
    date_pattern = java_pattern(M.LISTING_DATE)
    parts = [F.regexp_extract(block, date_pattern, group) for group in (3, 2, 1)]
    found = listing_items(pages).filter(
        block.rlike(title_pattern) & block.rlike(java_pattern(M.LISTING_DOWNLOAD))
    ).select(
        F.regexp_extract(block, java_pattern(M.LISTING_DOWNLOAD), 1).alias("pub_id"),
        strip_tags(F.regexp_extract(block, title_pattern, 1)).alias("_title"),
        F.when(block.rlike(date_pattern), F.concat_ws("-", *parts)).alias("pub_date"),
        F.upper(null_if_empty(F.regexp_extract(block, java_pattern(M.LISTING_FILE_TYPE), 1))).alias("file_type"),
        (F.col("page_id").cast("decimal(19,0)") * F.lit(_PAGE_ITEMS).cast("decimal(10,0)") + F.col("item_pos")).alias("page_pos"),
    )
    return found.select(
        "pub_id", strip(unescape_entities("_title")).alias("title"), "pub_date", "file_type", "page_pos"
    )

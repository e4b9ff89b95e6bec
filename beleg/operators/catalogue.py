"""Matching stored document names to entries of the public catalogue.

Score = F1 of the title token sets + 0.5 for the same date + 0.25 for a PDF; the best entry
at or above 0.65 wins, the first in page order among equals. Entries must share a token
with the name, as in a catalogue search; agreement of date and type alone is no match.

Both sides are reduced to distinct token sets first: titles repeat, and the score of a pair
depends on nothing else but date and type, so a set keeps one entry per date and one best
entry overall. Candidates then come from two equi-joins that together lose no acceptable pair:

* same date and a shared token (any overlap may be enough with the date bonus);
* whatever the date, between distinct token sets only, a shared *prefix* token: without the
  date bonus acceptance needs F1 >= 0.65 - 0.25, and in a fixed order of tokens (long ones
  first) two sets that similar share a token within their first
  ``n - ceil(n t / (2 - t)) + 1`` tokens, so the common short words at the end of the order
  are not join keys.

Every join here grows on both sides and is a sort-merge join: rows of repeated words compress so well in an
exchange that its size says nothing about the memory a broadcast of them would take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beleg.functions import markers as M
from beleg.functions.text import fold
from beleg.operators.annotate import published_at, title_slug

_OTHER_DATE_F1 = M.MATCH_THRESHOLD - M.PDF_BONUS


def title_tokens(text: Column) -> Column:
    """Distinct folded tokens of more than two letters without function words, long ones first."""
    words = F.array_distinct(F.split(fold(text), " "))
    kept = F.filter(words, lambda t: (F.length(t) > 2) & ~t.isin(*M.TITLE_STOPWORDS))
    ordered = F.array_sort(F.transform(kept, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.transform(ordered, lambda pair: pair["t"])


def similarity(wanted: Column, candidate: Column) -> Column:
    """F1 over two token sets."""
    shared = F.size(F.array_intersect(wanted, candidate)).cast("double")
    precision, recall = shared / F.size(candidate), shared / F.size(wanted)
    return F.when(shared == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def _prefix(tokens: Column) -> Column:
    size = F.size(tokens)
    needed = F.ceil(size * (_OTHER_DATE_F1 / (2 - _OTHER_DATE_F1)) - 1e-9)
    return F.slice(tokens, F.lit(1), (size - F.greatest(needed, F.lit(1)) + 1).cast("int"))


def _once(*columns: Column) -> Column:
    """Several columns behind a generator, so that later uses refer to them instead of
    repeating the folding they come from."""
    return F.inline_outer(F.array(F.struct(*columns)))


def _wanted(doc_names: DataFrame, title: str) -> tuple[DataFrame, DataFrame]:
    """Distinct titles with date and token set, and the distinct (date, token set) pairs."""
    titles = doc_names.select(F.col(title).alias("title")).filter(F.col("title").isNotNull()).distinct()
    names = titles.select("title", _once(
        published_at(F.col("title")).alias("doc_date"), title_tokens(title_slug(F.col("title"))).alias("wanted")
    ))
    named = names.filter(F.size("wanted") > 0).withColumn("wanted_key", F.concat_ws(" ", "wanted"))
    return named.select("title", "doc_date", "wanted_key"), named.select("doc_date", "wanted_key", "wanted").dropDuplicates(
        ["doc_date", "wanted_key"]
    )


def _entries(publications: DataFrame, *keys: str) -> DataFrame:
    """Best entry (PDF first, then page order) of every token set, or of every set and date."""
    is_pdf = F.coalesce(F.col("file_type") == "PDF", F.lit(False))
    entries = publications.select(
        F.col("pub_id").cast("string").alias("pub_id"), "pub_date", "page_pos", is_pdf.alias("pdf"),
        _once(title_tokens(F.coalesce("title", F.lit(""))).alias("held")),
    ).filter(F.size("held") > 0)
    best = F.max_by(F.struct("pub_id", "page_pos", "pdf", "held"), F.struct(F.col("pdf"), -F.col("page_pos")))
    return entries.withColumn("held_key", F.concat_ws(" ", "held")).groupBy("held_key", *keys).agg(
        best.alias("entry")
    ).select("held_key", *keys, "entry.*")


def _hits(pairs: DataFrame, bonus: float, *keys: str, keep: Column | None = None) -> DataFrame:
    """Best acceptable entry per key as a struct that orders by preference.

    A pair may come once per shared token; the maximum does not mind, so no distinct is needed.
    """
    f1 = similarity(F.col("wanted"), F.col("held"))
    score = f1 + F.lit(bonus) + F.when(F.col("pdf"), F.lit(M.PDF_BONUS)).otherwise(F.lit(0.0))
    whole = F.lit(True) if keep is None else F.size(F.array_except("wanted", "held")) == 0
    kept = pairs if keep is None else pairs.filter(keep)
    hit = F.struct(whole.alias("whole"), F.col("score"), (-F.col("page_pos")).alias("order"), "pub_id")
    return kept.withColumn("score", score).filter(F.col("score") >= M.MATCH_THRESHOLD).groupBy(*keys).agg(F.max(hit).alias("hit"))


def _match(
    doc_names: DataFrame, publications: DataFrame, title: str, wanted_keys: Column, prefix_keys: Column, held_keys: Column,
    held_prefix: Column, keep: Column | None = None,
) -> DataFrame:
    names, wanted = _wanted(doc_names, title)
    same_date = (
        wanted.filter(F.col("doc_date").isNotNull()).withColumn("token", F.explode(wanted_keys))
        .join(_entries(publications, "pub_date").withColumn("token", F.explode(held_keys)).withColumnRenamed("pub_date", "doc_date").hint("merge"),
              ["doc_date", "token"])
    )
    any_date = (
        wanted.select("wanted_key", "wanted").dropDuplicates(["wanted_key"]).withColumn("token", F.explode(prefix_keys))
        .join(_entries(publications).withColumn("token", F.explode(held_prefix)).hint("merge"), "token")
    )
    dated = _hits(same_date, M.DATE_BONUS, "doc_date", "wanted_key", keep=keep)
    undated = _hits(any_date, 0.0, "wanted_key", keep=keep)
    linked = names.join(dated.withColumnRenamed("hit", "_dated").hint("merge"), ["doc_date", "wanted_key"], "left").join(
        undated.withColumnRenamed("hit", "_undated").hint("merge"), "wanted_key", "left"
    ).withColumn("hit", F.greatest("_dated", "_undated"))
    return linked.select(
        "title", F.col("hit.pub_id").alias("pub_id"), F.round("hit.score", 6).alias("score"),
        F.concat(F.lit(M.DOWNLOAD_URL_PREFIX), F.col("hit.pub_id")).alias("download_url"),
    )


def match_publications(doc_names: DataFrame, publications: DataFrame, title: str = "title") -> DataFrame:
    """(title, pub_id, score, download_url) for every usable distinct title; nulls when unmatched."""
    return _match(doc_names, publications, title, F.col("wanted"), _prefix(F.col("wanted")), F.col("held"), _prefix(F.col("held")))


def match_with_fallback(doc_names: DataFrame, publications: DataFrame, title: str = "title") -> DataFrame:
    """As a conjunctive search: entries holding the whole slug first, else its three longest tokens.

    Both searches require the longest token, so joining on it alone serves both.
    """
    anchor = F.slice("wanted", 1, 1)
    holds_longest = F.size(F.array_except(F.slice("wanted", 1, 3), F.col("held"))) == 0
    return _match(doc_names, publications, title, anchor, anchor, F.col("held"), F.col("held"), holds_longest)


def attach_download_urls(
    results: DataFrame, publications: DataFrame, title: str = "title", matcher=match_with_fallback
) -> DataFrame:
    """Public link of every returned row; call it after the limit so that only those are resolved."""
    links = matcher(results, publications, title).select(F.col("title").alias("_title"), "download_url")
    return results.join(links, results[title] == links["_title"], "left").drop("_title")

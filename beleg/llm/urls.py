"""URL filter: rules first, else naive Bayes over segmented host names and path tokens.

A rule is a host and a path prefix, with allow or block; it fits its host and all subdomains, and the longest fitting rule
wins (of equal length the one that sorts first). Rules are a table, joined on host suffixes, so a list may be long.

Host labels are cut into words by Viterbi over unigram counts of all words in the pages' texts: each piece of letters is
joined, as its substrings of up to ``MAX_WORD`` letters, with the counts, so the vocabulary is never sent anywhere; a
substring that is no word costs log(10 / (N 10^length)). Multinomial naive Bayes with add-one smoothing learns from the URLs
that rules decide and scores the words of the others: block if the log odds are over zero. Tokens not seen in learning are
ignored; where only one class was seen, or none, the others are allowed.

Each distinct (host, path) is judged once and joined back, so repeated URLs cost nothing.

Defined results: a null URL, or one without ``://``, has empty host and path; the method judges it by the class frequencies. Null
page_ids are kept. Repeated rows are judged alike. An empty table gives an empty result; null html counts no words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beleg.llm.tables import cut_lineage, map_rows

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MAX_WORD = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path")


def ruled(urls: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """urls (host, path) with rule and its verdict, both null where none fits."""
    rows = [(v, r, *r.split("/", 1), r.split("/", 1)[0].count(".") + 1) for v, r in rules]
    table = urls.sparkSession.createDataFrame([(v, r, h, "/" + p) for v, r, h, p, _ in rows], "r_verdict string, r_rule string, r_host string, r_path string")
    labels = max((r[4] for r in rows), default=1)
    # Only suffixes with as many labels as some rule has can match one.
    parts = F.reverse(F.slice(F.reverse(F.split("host", r"\.")), 1, labels))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, labels), "."))
    order = F.struct((-F.length("r_rule")).alias("n"), "r_rule", "r_verdict")
    best = (
        urls.select("host", "path", F.explode(suffixes).alias("r_host")).join(table, "r_host").filter(F.expr("startswith(path, r_path)"))
        .groupBy("host", "path").agg(F.min(order).alias("best")).select("host", "path", F.col("best.r_rule").alias("rule"), F.col("best.r_verdict").alias("rule_verdict"))
    )
    return urls.join(best, ["host", "path"], "left")


def unigrams(pages: DataFrame) -> DataFrame:
    """(word, n) of the words of letters in all texts, markup left out."""
    text = F.lower(F.regexp_replace("html", r"<[^>]*>", " "))
    words = F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{N}}])[a-z]{{1,{MAX_WORD}}}(?![\p{{L}}\p{{N}}])"), F.lit(0))
    return pages.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def segment(piece: str, costs: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """The most probable words: costs of known substrings (start, stop) and of unknown text for each letter, plus one base."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for stop in range(1, len(piece) + 1):
        best.append(max(
            (best[start][0] + costs.get((start, stop), unknown - (stop - start) * math.log(10)), start)
            for start in range(max(0, stop - MAX_WORD), stop)))
    out, stop = [], len(piece)
    while stop:
        start = best[stop][1]
        out.append(piece[start:stop])
        stop = start
    return out[::-1]


def segmented(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """(piece, words) of distinct pieces of letters."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    spans = pieces.select("piece", F.explode(F.sequence(F.lit(0), F.length("piece") - 1)).alias("start"))
    spans = spans.select("piece", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("start") + MAX_WORD, F.length("piece")))).alias("stop"))
    known = spans.withColumn("word", F.expr("substring(piece, start + 1, stop - start)")).join(counts, "word")
    known = known.groupBy("piece").agg(F.collect_list(F.struct("start", "stop", F.log(F.col("n") / total).alias("cost"))).alias("known"))
    unknown = math.log(10 / total)

    def run(names: list, known: list) -> Iterator[dict[str, list]]:
        words = [segment(p, {(k["start"], k["stop"]): k["cost"] for k in ks or ()}, unknown) for p, ks in zip(names, known)]
        yield {"piece": names, "words": words}

    return map_rows(pieces.join(known, "piece", "left"), "piece string, words array<string>", run, "piece", "known")


def tokens(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """urls (host, path, ...) with host_words, and with tokens: host words as h:word and path tokens as p:token, digits as 0."""
    cut = F.regexp_extract_all("host", F.lit(r"[a-z]+|[0-9]+|[^a-z0-9.-]+"), F.lit(0))
    hosts = urls.select("host").distinct().select("host", F.posexplode(cut).alias("at", "piece"))
    pieces = hosts.filter(F.col("piece").rlike("^[a-z]+$")).select("piece").distinct()
    words = hosts.join(segmented(pieces, counts), "piece", "left").select("host", "at", F.coalesce("words", F.array(F.regexp_replace("piece", "[0-9]+", "0"))).alias("words"))
    of_host = words.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("host_words"))
    of_path = F.regexp_extract_all(F.regexp_replace(F.lower("path"), "[0-9]+", "0"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    none = F.array().cast("array<string>")
    out = urls.join(of_host, "host", "left").withColumn("host_words", F.coalesce("host_words", none))
    return out.withColumn("tokens", F.concat(F.transform("host_words", lambda w: F.concat(F.lit("h:"), w)), F.transform(of_path, lambda w: F.concat(F.lit("p:"), w))))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, host_words, log_odds (null where a rule decides)."""
    counts = cut_lineage(unigrams(pages), "unigrams")
    rows = pages.select("page_id", *host_and_path(F.col("url")))
    urls = cut_lineage(tokens(ruled(rows.select("host", "path").distinct(), rules), counts), "urls")
    exploded = urls.select("host", "path", "rule_verdict", F.explode("tokens").alias("token"))
    is_block = F.col("rule_verdict") == "block"
    known = exploded.filter("rule_verdict IS NOT NULL").groupBy("token").agg(F.count_if(is_block).alias("b"), F.count_if(~is_block).alias("a"))
    known = cut_lineage(known, "tokens")
    n = known.agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count("*").alias("v")).first()
    d = urls.agg(F.count_if(is_block).alias("b"), F.count_if(~is_block).alias("a")).first()
    learned = bool(d["b"] and d["a"])
    if learned:
        odds = F.log((F.col("b") + 1) / (n["b"] + n["v"])) - F.log((F.col("a") + 1) / (n["a"] + n["v"]))
        scores = exploded.filter("rule_verdict IS NULL").join(known.select("token", odds.alias("odds")), "token").groupBy("host", "path").agg(F.sum("odds").alias("odds"))
        prior = math.log(d["b"] / d["a"])
    else:
        scores = urls.select("host", "path", F.lit(0.0).alias("odds")).limit(0)
        prior = -1.0
    log_odds = F.when(F.col("rule").isNull(), F.coalesce("odds", F.lit(0.0)) + prior)
    verdict = F.coalesce("rule_verdict", F.when(log_odds > 0, "block").otherwise("allow"))
    judged = urls.join(scores, ["host", "path"], "left").select("host", "path", "rule", verdict.alias("verdict"), F.array_join("host_words", " ").alias("host_words"), log_odds.alias("log_odds"))
    return rows.join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "host_words", "log_odds")

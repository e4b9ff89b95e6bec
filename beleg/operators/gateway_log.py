"""Analytics over the gateway's request log (batch or stream)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beleg.functions.text import null_if_empty

WINDOW = "5 minutes"
PERCENTILES = (0.5, 0.9, 0.99)


def parse_requests(log: DataFrame) -> DataFrame:
    """Tool calls with tool name and argument text.

    The request is map-style text whose last three braces close arguments, params and the
    envelope; the capture is greedy so that nested braces stay inside.
    """
    request = F.col("request_body")
    return log.filter(request.contains("method=tools/call")).withColumns({
        "tool": null_if_empty(F.regexp_extract(request, r"name=([^,}]+)", 1)),
        "args": F.when(request.rlike(r"(?s)arguments=\{.*\}\}\}"), F.regexp_extract(request, r"(?s)arguments=\{(.*)\}\}\}", 1)),
    })


def is_failure() -> Column:
    """Gateway error present, a tool that reported one, or a log line that speaks of one."""
    return (
        F.col("gateway_error").isNotNull()
        | F.coalesce(F.col("response_body").contains("isError=true"), F.lit(False))
        | F.coalesce(F.col("log").contains("rror"), F.lit(False))
    )


def failures(log: DataFrame) -> DataFrame:
    return log.filter(is_failure())


def filter_failures(log: DataFrame, limit: int = 100) -> DataFrame:
    """The newest failures. Equal times are ordered by request."""
    return failures(log).orderBy(F.col("ts").desc(), "request_id").limit(limit)


def questions_asked(log: DataFrame, limit: int = 200) -> DataFrame:
    """The newest questions."""
    return parse_requests(log).select("ts", "tool", "args", "request_id").orderBy(F.col("ts").desc(), "request_id").limit(limit)


def questions_ranked(log: DataFrame, limit: int = 100) -> DataFrame:
    """Questions by how often they were asked, with first and last time seen."""
    return parse_requests(log).groupBy("tool", "args").agg(
        F.count("*").alias("asked"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    ).orderBy(F.col("asked").desc(), "tool", "args").limit(limit)


def _by_window(log: DataFrame, *keys: str) -> DataFrame:
    return log.groupBy(F.window("ts", WINDOW), *keys)


def request_counts(log: DataFrame) -> DataFrame:
    """Calls by method per five minutes; on a stream give the log a watermark first."""
    return _by_window(log, "method").agg(F.count("*").alias("calls")).select(
        F.col("window.start").alias("window_start"), "method", "calls"
    )


def error_counts(log: DataFrame) -> DataFrame:
    """User errors, system errors, throttles and rejected sign-ins per five minutes."""
    status = F.col("status")
    return _by_window(log).agg(
        F.count_if((status >= 400) & (status < 500) & ~status.isin(401, 403, 429)).alias("user_errors"),
        F.count_if(status >= 500).alias("system_errors"),
        F.count_if(status == 429).alias("throttles"),
        F.count_if(status.isin(401, 403)).alias("auth_failures"),
    ).select(F.col("window.start").alias("window_start"), "user_errors", "system_errors", "throttles", "auth_failures")


def latency_percentiles(log: DataFrame) -> DataFrame:
    """Exact p50, p90 and p99 per five minutes in batch.

    Equal latencies are counted before the exchange; what a window's task sees is a histogram
    of distinct values, walked in order by a running sum that spills, not a list of requests.
    """
    from pyspark.sql import Window

    counts = log.filter(F.col("latency_ms").isNotNull()).groupBy(
        F.window("ts", WINDOW).getField("start").alias("window_start"), "latency_ms"
    ).agg(F.count("*").alias("n"))
    ordered = Window.partitionBy("window_start").orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("window_start")
    ranked = counts.withColumns({"upto": F.sum("n").over(ordered), "total": F.sum("n").over(whole)})

    def at(position: Column) -> Column:
        """Value at a zero-based position: the smallest with more rows up to it."""
        return F.min(F.when(F.col("upto") > position, F.col("latency_ms")))

    aggregates = []
    for percentile in PERCENTILES:
        exact = F.lit(percentile) * (F.col("total") - 1)
        low, high = F.floor(exact), F.ceil(exact)
        name = f"p{round(percentile * 100)}"
        aggregates += [at(low).alias(f"{name}_low"), at(high).alias(f"{name}_high"), F.max(exact - low).alias(f"{name}_part")]
    return ranked.groupBy("window_start").agg(*aggregates).select(
        "window_start",
        *(
            F.round(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part"), 6).alias(n)
            for n in (f"p{round(p * 100)}" for p in PERCENTILES)
        ),
    )


def streaming_percentiles(log: DataFrame, exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """The same as one streaming aggregate; ``exact=False`` bounds the state of a busy window."""
    values = list(PERCENTILES)
    measure = F.percentile("latency_ms", values) if exact else F.percentile_approx("latency_ms", values, accuracy)
    return _by_window(log).agg(measure.alias("p")).select(
        F.col("window.start").alias("window_start"),
        *(F.round(F.col("p")[i], 6).alias(f"p{round(v * 100)}") for i, v in enumerate(values)),
    )

"""Usage rollups over a request log.

A request leaves one log row per round or tool call and a closing row, the only
one with a status: (ts, request_id, iteration, input_tokens, output_tokens,
tool_name, duration_ms, method, route, status); fields that do not apply to a row
are NULL. Only requests that succeed have a duration. Tokens and tools are summed
over all rows; figures of requests first fold their rows by request_id (rows
without one belong to no request). Every rollup is a grouped aggregate, combined
before its shuffle. ``Rollup`` holds the ones that a stream can keep up.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.functions.columns import cost_usd

MINUTE = "1 minute"


def usage_totals(log: DataFrame) -> DataFrame:
    """Tokens in and out, and their cost."""
    return log.agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    ).withColumn("cost_usd", cost_usd(F.col("input_tokens"), F.col("output_tokens")))


def usage_tools(log: DataFrame) -> DataFrame:
    """Calls per tool."""
    return (
        log.where(F.col("tool_name").isNotNull())
        .groupBy("tool_name")
        .agg(F.count(F.lit(1)).alias("calls"))
    )


def usage_tool_calls(log: DataFrame) -> DataFrame:
    """Calls of all tools."""
    return log.agg(F.count("tool_name").alias("calls"))


@dataclass(frozen=True)
class Rollup:
    """A windowed figure in two steps: sums, which add up over any split of the log
    in any order, and the figures that follow from the sums of a window."""

    keys: tuple[str, ...]
    sums: Callable[[DataFrame], DataFrame]
    figures: Callable[[DataFrame], DataFrame]

    def __call__(self, log: DataFrame) -> DataFrame:
        return self.figures(self.sums(log))


def _by_window(df: DataFrame, time: str, window: str, keys: list[str], *sums: Column) -> DataFrame:
    grouped = df.groupBy(F.window(time, window).alias("_window"), *keys).agg(*sums)
    return grouped.select(F.col("_window.start").alias("window_start"), *keys, *grouped.columns[1 + len(keys) :])


def rates(window: str = MINUTE, seconds: int = 60) -> Rollup:
    """Tokens per second in and out, and cost per minute, by time window."""

    def sums(log: DataFrame) -> DataFrame:
        return _by_window(
            log, "ts", window, [],
            F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"),
        )

    def figures(sums: DataFrame) -> DataFrame:
        tokens_in, tokens_out = F.col("tokens_in"), F.col("tokens_out")
        return sums.select(
            "window_start",
            (tokens_in / seconds).alias("input_per_second"),
            (tokens_out / seconds).alias("output_per_second"),
            (cost_usd(tokens_in, tokens_out) / seconds * 60).alias("cost_per_minute"),
        )

    return Rollup(("window_start",), sums, figures)


def routes(window: str = MINUTE, seconds: int = 60) -> Rollup:
    """Requests per second by method and route: a request counts once, when it closes."""
    keys = ["method", "route"]

    def sums(log: DataFrame) -> DataFrame:
        closing = log.where(F.col("status").isNotNull())
        return _by_window(closing, "ts", window, keys, F.count(F.lit(1)).alias("requests"))

    def figures(sums: DataFrame) -> DataFrame:
        per_second = (F.col("requests") / seconds).alias("requests_per_second")
        return sums.select("window_start", *keys, per_second)

    return Rollup(("window_start", *keys), sums, figures)


def usage_rates(log: DataFrame, window: str = MINUTE, seconds: int = 60) -> DataFrame:
    return rates(window, seconds)(log)


def usage_routes(log: DataFrame, window: str = MINUTE, seconds: int = 60) -> DataFrame:
    return routes(window, seconds)(log)


def requests(log: DataFrame) -> DataFrame:
    """One row per request: when it started and closed (NULL while open), its rounds,
    duration (NULL if it failed or is open), method and route."""
    closed = F.when(F.col("status").isNotNull(), F.col("ts"))
    return (
        log.where(F.col("request_id").isNotNull())
        .groupBy("request_id")
        .agg(
            F.min("ts").alias("started"),
            F.max(closed).alias("closed"),
            F.max("iteration").alias("rounds"),
            F.max("duration_ms").alias("duration_ms"),
            F.max("method").alias("method"),
            F.max("route").alias("route"),
        )
    )


#: Changes of requests: with weight 1 what a request adds to the figures, with -1 what it takes back.
CHANGED = (
    "request_id string, weight int, started timestamp, closed timestamp, rounds int, duration_ms double, "
    "expired boolean"
)


def _as_changes(log: DataFrame) -> DataFrame:
    """Every request of a whole log, once."""
    return requests(log).select("*", F.lit(1).alias("weight"), F.lit(False).alias("expired"))


def means(window: str = MINUTE) -> Rollup:
    """Mean duration and mean rounds of the requests that closed in a window, from ``CHANGED``.

    Failed requests have rounds but no duration, and count for the rounds alone.
    """

    def sums(changes: DataFrame) -> DataFrame:
        weight = F.col("weight")
        return _by_window(
            changes.where(F.col("closed").isNotNull() & ~F.col("expired")), "closed", window, [],
            F.sum(weight * F.col("duration_ms")).alias("duration"),
            F.sum(F.when(F.col("duration_ms").isNotNull(), weight)).alias("durations"),
            F.sum(weight * F.col("rounds")).alias("rounds"),
            F.sum(F.when(F.col("rounds").isNotNull(), weight)).alias("counted"),
            F.sum(weight).alias("requests"),
        )

    def figures(sums: DataFrame) -> DataFrame:
        return sums.where("requests > 0").select(
            "window_start",
            F.try_divide("duration", "durations").alias("mean_duration_ms"),
            F.try_divide("rounds", "counted").alias("mean_iterations"),
        )

    return Rollup(("window_start",), sums, figures)


def active(window: str = MINUTE) -> Rollup:
    """Requests still open at the end of each window in which one starts or ends, from ``CHANGED``.

    Starts and ends are summed up per window before anything is ordered, so the
    running total sees one row per window and not one per request. It runs within
    a day, on top of the total of the days before; days are few.
    """

    def sums(changes: DataFrame) -> DataFrame:
        moments = changes.select(
            "weight",
            F.inline(
                F.array(
                    F.struct(F.col("started").alias("at"), F.lit(1).alias("step")),
                    F.struct(F.col("closed").alias("at"), F.lit(-1).alias("step")),
                )
            ),
        ).where(F.col("at").isNotNull())
        return _by_window(
            moments, "at", window, [],
            F.sum(F.col("weight") * F.col("step")).alias("change"), F.sum("weight").alias("moments"),
        )

    def figures(sums: DataFrame) -> DataFrame:
        changes = sums.where("moments > 0").withColumn("day", F.to_date("window_start"))
        within = Window.partitionBy("day").orderBy("window_start").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
        days = (
            changes.groupBy("day")
            .agg(F.sum("change").alias("day_change"))
            .select("day", F.coalesce(F.sum("day_change").over(before), F.lit(0)).alias("carried"))
        )
        return changes.join(days, "day").select(
            "window_start", (F.col("carried") + F.sum("change").over(within)).alias("active")
        )

    return Rollup(("window_start",), sums, figures)


def expired(window: str = MINUTE) -> Rollup:
    """Open requests that a stream gave up, by the window of their last row, from ``CHANGED``."""

    def sums(changes: DataFrame) -> DataFrame:
        return _by_window(changes.where("expired"), "closed", window, [], F.sum("weight").alias("expired"))

    return Rollup(("window_start",), sums, lambda sums: sums.where("expired > 0"))


def usage_means(log: DataFrame, window: str = MINUTE) -> DataFrame:
    """Mean duration and mean rounds of the requests that closed in a window."""
    return means(window)(_as_changes(log))


def usage_active(log: DataFrame, window: str = MINUTE) -> DataFrame:
    """Requests still open at the end of each window."""
    return active(window)(_as_changes(log))


def active_at(log: DataFrame, cut: Column) -> DataFrame:
    """Requests open at one moment, per route."""
    closed = F.col("closed")
    open_now = (F.col("started") <= cut) & (closed.isNull() | (closed > cut))
    return requests(log).groupBy("route").agg(F.count(F.when(open_now, 1)).alias("active"))

"""Lookups and pages over the marts.

Every limit follows a total order: the metric of the page, then the ids. NULLs
sort last. ``orderBy().limit()`` keeps n rows per task and merges those.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.functions.columns import (
    contains,
    fenced_sql_text,
    or_unknown,
    rounded,
)

# Limits and thresholds of the lookups and pages.
MIN_MARGIN = 50.0
TOP = 20
SNAPSHOT_ROWS = 10
SEARCH_ROWS = 10
PAGE_ROWS = 200
HISTORY_ROWS = 500
SQL_ROWS = 20
CHART_BARS = 20

FILES_AS_TABLES = "spark.sql.runSQLOnFiles"

IDS = ("item_id", "world_id", "is_hq", "sale_date")


# The order in which a whole mart is shown; stored marts have none.
MART_ORDER = {
    "hq_premium": "hq_premium_pct",
    "arbitrage": "profit_margin_pct",
    "velocity": "sale_date",
    "price_history": "sale_date",
}


def ordered(df: DataFrame, metric: str) -> DataFrame:
    """Greatest metric first, ties broken by the ids."""
    ties = [F.col(c).asc_nulls_last() for c in IDS if c in df.columns and c != metric]
    return df.orderBy(F.col(metric).desc_nulls_last(), *ties)


def whole_mart(mart: DataFrame, name: str) -> DataFrame:
    """All rows of a mart in the order in which it is shown; a sort over ranges, no single task."""
    return ordered(mart, MART_ORDER[name])


def top(df: DataFrame, metric: str, limit: int) -> DataFrame:
    return ordered(df, metric).limit(limit)


def top_arbitrage(mart: DataFrame, min_margin: float = MIN_MARGIN, limit: int = TOP) -> DataFrame:
    rows = mart.where(F.col("profit_margin_pct") >= F.lit(float(min_margin)))
    return top(rows, "profit_margin_pct", limit).select(
        "item_name", "world_name", "is_hq", "min_price",
        "cheapest_price", "priciest_price", "profit_margin_pct",
    )


def price_lookup(mart: DataFrame, name: str, limit: int = TOP) -> DataFrame:
    """Price summaries of the items whose name contains ``name``."""
    return top(mart.where(contains(F.col("item_name"), name)), "listing_count", limit).select(
        "item_name", "world_name", "is_hq", "listing_count",
        rounded(F.col("avg_price")).alias("avg_price"), "min_price", "max_price",
    )


def market_snapshot(mart: DataFrame, name: str, limit: int = SNAPSHOT_ROWS) -> DataFrame:
    return price_lookup(mart, name, limit)


def top_velocity(mart: DataFrame, limit: int = TOP) -> DataFrame:
    return top(mart, "sale_count", limit).select(
        "item_name", "world_name", "sale_date", "sale_count", "total_volume",
        rounded(F.col("avg_price")).alias("avg_price"),
    )


def item_search(items: DataFrame, query: str, limit: int = SEARCH_ROWS) -> DataFrame:
    return (
        items.where(contains(F.col("item_name"), query))
        .orderBy("item_id")
        .limit(limit)
        .select("item_id", "item_name")
    )


def arbitrage_page(mart: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    return top_arbitrage(mart, min_margin, PAGE_ROWS)


def arbitrage_metrics(page: DataFrame) -> DataFrame:
    return page.agg(F.count(F.lit(1)).alias("opportunities"))


def price_page(mart: DataFrame) -> DataFrame:
    return top(mart, "listing_count", PAGE_ROWS).select(
        "item_name", "world_name", "is_hq", "listing_count",
        rounded(F.col("avg_price")).alias("avg_price"), "min_price", "max_price", "total_quantity",
    )


def price_metrics(page: DataFrame) -> DataFrame:
    """Figures of the page shown, not of the whole mart."""
    return page.agg(
        F.countDistinct("item_name").alias("unique_items"),
        F.sum("listing_count").alias("total_listings"),
    )


def premium_page(mart: DataFrame) -> DataFrame:
    return top(mart, "hq_premium_pct", PAGE_ROWS).select(
        "item_id", "world_id", "item_name", "world_name",
        rounded(F.col("hq_avg_price")).alias("hq_avg_price"),
        rounded(F.col("nq_avg_price")).alias("nq_avg_price"),
        "hq_listings", "nq_listings", "hq_premium_pct",
    )


def premium_metrics(page: DataFrame) -> DataFrame:
    return page.agg(
        F.median("hq_premium_pct").alias("median_premium"), F.count(F.lit(1)).alias("hq_rows")
    )


def premium_bars(page: DataFrame, bars: int = CHART_BARS) -> DataFrame:
    """The first rows of the page, labelled for a chart."""
    return top(page, "hq_premium_pct", bars).select(
        or_unknown(F.col("item_name")).alias("label"), "hq_premium_pct"
    )


def velocity_page(mart: DataFrame) -> DataFrame:
    return top_velocity(mart, PAGE_ROWS)


def velocity_metrics(page: DataFrame) -> DataFrame:
    return page.agg(
        F.sum("sale_count").alias("total_sales"), F.sum("total_volume").alias("total_volume")
    )


def history_page(mart: DataFrame) -> DataFrame:
    """The latest days, with a label for rows without an item name."""
    return top(mart, "sale_date", HISTORY_ROWS).select(
        "item_id", "world_id", "item_name", "world_name", "is_hq", "sale_date", "sale_count",
        rounded(F.col("avg_price")).alias("avg_price"), "min_price", "max_price", "total_volume",
        or_unknown(F.col("item_name")).alias("label"),
    )


def history_labels(page: DataFrame) -> DataFrame:
    return page.select("label").distinct().orderBy("label")


def history_series(page: DataFrame, label: str) -> DataFrame:
    """The rows of one label on the page, by day."""
    ties = [F.col(c).asc_nulls_last() for c in ("item_id", "world_id", "is_hq")]
    return (
        page.where(F.col("label") == label)
        .orderBy("sale_date", *ties)
        .select("sale_date", "avg_price")
    )


# The functions that call any method of the JVM.
JVM_CALLS = ("reflect", "java_method", "try_reflect")

# Between a function's name and its parenthesis only space, a back quote or a comment can stand.
JVM_CALL = re.compile(rf"\b(?:{'|'.join(JVM_CALLS)})[`\s]*(?:\(|/\*|--)", re.IGNORECASE)


def select_only(spark: SparkSession, text: str) -> DataFrame:
    """The result of a query given as text, or as text with a fenced SQL block.

    The query runs as a subquery, so that a statement that would change anything
    does not parse. It sees tables and views of the session only: files named by
    path do not resolve, and functions that call JVM methods are refused (by
    their text, also where it stands in a literal).
    """
    query = fenced_sql_text(text).rstrip().rstrip(";")
    if JVM_CALL.search(query):
        raise ValueError(f"not allowed in a query: {', '.join(JVM_CALLS)}")
    before = spark.conf.get(FILES_AS_TABLES)
    spark.conf.set(FILES_AS_TABLES, "false")
    try:
        return spark.sql(f"SELECT * FROM (\n{query}\n)")
    finally:
        spark.conf.set(FILES_AS_TABLES, before)


def run_sql(spark: SparkSession, text: str, max_rows: int = SQL_ROWS) -> dict:
    """First rows and full row count of a query; an error comes back as data.

    Only a result of more than ``max_rows`` rows is run again, to be counted, which
    needs neither its order nor most of its columns.
    """
    sql = fenced_sql_text(text)
    try:
        result = select_only(spark, sql)
        head = result.limit(max_rows + 1).collect()
        rows = len(head) if len(head) <= max_rows else result.count()
        data = [row.asDict(recursive=True) for row in head[:max_rows]]
        return {"sql": sql, "rows": rows, "data": data, "error": None}
    except Exception as error:
        return {"sql": sql, "rows": 0, "data": [], "error": str(error)}

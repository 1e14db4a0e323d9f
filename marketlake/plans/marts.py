"""The five marts.

Each groups on ids first and joins names to the aggregated rows, so the facts
cross one shuffle, already combined per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.functions.columns import percent_change
from marketlake.operators.bounds import price_band, price_bounds
from marketlake.operators.joins import with_names
from marketlake.session import materialize

PRICE = "price_per_unit"


def price_summary(listings: DataFrame, items: DataFrame, worlds: DataFrame) -> DataFrame:
    """Listing count, prices and quantity per item, world and quality."""
    grouped = listings.groupBy("item_id", "world_id", "is_hq").agg(
        F.count(F.lit(1)).alias("listing_count"),
        F.avg(PRICE).alias("avg_price"),
        F.min(PRICE).alias("min_price"),
        F.max(PRICE).alias("max_price"),
        F.sum("quantity").alias("total_quantity"),
    )
    return with_names(grouped, items, worlds).select(
        "item_id", "item_name", "world_id", "world_name", "is_hq",
        "listing_count", "avg_price", "min_price", "max_price", "total_quantity",
    )


def hq_premium(listings: DataFrame, items: DataFrame, worlds: DataFrame) -> DataFrame:
    """Mean price of high quality against normal, where a world lists both.

    One pass with filtered aggregates. Rows with a NULL id are left out, as a
    join of the two qualities would do.
    """
    hq, nq = F.col("is_hq"), ~F.col("is_hq")
    grouped = (
        listings.where(
            F.col("is_hq").isNotNull()
            & F.col("item_id").isNotNull()
            & F.col("world_id").isNotNull()
        )
        .groupBy("item_id", "world_id")
        .agg(
            F.avg(F.when(hq, F.col(PRICE))).alias("hq_avg_price"),
            F.avg(F.when(nq, F.col(PRICE))).alias("nq_avg_price"),
            F.count(F.when(hq, 1)).alias("hq_listings"),
            F.count(F.when(nq, 1)).alias("nq_listings"),
        )
        .where(
            (F.col("hq_listings") > 0) & (F.col("nq_listings") > 0) & (F.col("nq_avg_price") > 0)
        )
        .withColumn("hq_premium_pct", percent_change(F.col("hq_avg_price"), F.col("nq_avg_price")))
    )
    return with_names(grouped, items, worlds).select(
        "item_id", "item_name", "world_id", "world_name",
        "hq_avg_price", "nq_avg_price", "hq_listings", "nq_listings", "hq_premium_pct",
    )


def premium_of(summary: DataFrame) -> DataFrame:
    """``hq_premium`` from a stored price summary: the same means and counts."""
    hq, nq = F.col("is_hq"), ~F.col("is_hq")
    return (
        summary.where(
            F.col("is_hq").isNotNull()
            & F.col("item_id").isNotNull()
            & F.col("world_id").isNotNull()
        )
        .groupBy("item_id", "item_name", "world_id", "world_name")
        .agg(
            F.max(F.when(hq, F.col("avg_price"))).alias("hq_avg_price"),
            F.max(F.when(nq, F.col("avg_price"))).alias("nq_avg_price"),
            F.sum(F.when(hq, F.col("listing_count"))).alias("hq_listings"),
            F.sum(F.when(nq, F.col("listing_count"))).alias("nq_listings"),
        )
        .where((F.col("hq_listings") > 0) & (F.col("nq_avg_price") > 0))
        .withColumn("hq_premium_pct", percent_change(F.col("hq_avg_price"), F.col("nq_avg_price")))
    )


def world_prices(listings: DataFrame, bounds: DataFrame) -> DataFrame:
    """Lowest price inside the band per item, world and quality."""
    return (
        price_band(listings, bounds)
        .groupBy("item_id", "world_id", "is_hq")
        .agg(F.min(PRICE).alias("min_price"))
    )


def arbitrage(
    listings: DataFrame,
    items: DataFrame,
    worlds: DataFrame,
    bounds: DataFrame | None = None,
    **bound_options,
) -> DataFrame:
    """Price spread of an item across worlds, one row per world.

    The bounds are written out first: one row per item and quality, whose file
    size tells the planner whether to broadcast them to the listings or shuffle.
    """
    if bounds is None:
        bounds = materialize(price_bounds(listings, **bound_options), "price_bounds")
    # At most one row per world in a window partition.
    across = Window.partitionBy("item_id", "is_hq")
    spread = (
        world_prices(listings, bounds)
        .where(F.col("min_price") > 0)
        .withColumn("cheapest_price", F.min("min_price").over(across))
        .withColumn("priciest_price", F.max("min_price").over(across))
        .withColumn(
            "profit_margin_pct", percent_change(F.col("priciest_price"), F.col("cheapest_price"))
        )
    )
    return with_names(spread, items, worlds).select(
        "item_id", "item_name", "world_id", "world_name", "is_hq",
        "min_price", "cheapest_price", "priciest_price", "profit_margin_pct",
    )


def price_history(sales: DataFrame, items: DataFrame, worlds: DataFrame) -> DataFrame:
    """Daily sales per item, world and quality."""
    grouped = sales.groupBy("item_id", "world_id", "is_hq", "sale_date").agg(
        F.count(F.lit(1)).alias("sale_count"),
        F.avg(PRICE).alias("avg_price"),
        F.min(PRICE).alias("min_price"),
        F.max(PRICE).alias("max_price"),
        F.sum("quantity").alias("total_volume"),
    )
    return with_names(grouped, items, worlds).select(
        "item_id", "item_name", "world_id", "world_name", "is_hq", "sale_date",
        "sale_count", "avg_price", "min_price", "max_price", "total_volume",
    )


def velocity_of(history: DataFrame) -> DataFrame:
    """Market velocity is the price history without its extremes."""
    return history.select(
        "item_id", "item_name", "world_id", "world_name", "is_hq", "sale_date",
        "avg_price", "sale_count", "total_volume",
    )


def velocity(sales: DataFrame, items: DataFrame, worlds: DataFrame) -> DataFrame:
    """Mean price, sales and volume per item, world, quality and day."""
    return velocity_of(price_history(sales, items, worlds))

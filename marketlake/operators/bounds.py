"""Exact price percentiles per (item, quality), without gathering a large group.

Groups of up to ``HOT_ROWS`` listings take Spark's exact ``percentile``, whose
buffer then has at most that many prices. Larger ones, each maybe a third of all
listings, are split instead:

1. count the listings of each distinct price (combined before the shuffle);
2. add the counts up into price ranges of ``RANGE_WIDTH``;
3. running totals over the ranges of a group tell which ranges hold the ranks
   the percentiles need, four ranges at most;
4. only the prices of those ranges get a running total of their own.

Step 3 sorts at most ``max price / RANGE_WIDTH`` rows per group and step 4 at
most ``RANGE_WIDTH``: both about 2**15 or 2**16 for prices up to 2**31, however
many listings there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.session import materialize

GROUP = ["item_id", "is_hq"]
HOT_ROWS = 200_000
RANGE_BITS = 16
RANGE_WIDTH = 1 << RANGE_BITS


def price_bounds(
    listings: DataFrame,
    lo: float = 0.05,
    hi: float = 0.85,
    min_rows: int = 10,
    approx: bool = False,
    sizes: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(item_id, is_hq, p05, p85) of groups with at least ``min_rows`` listings.

    Linear interpolation between the two nearest prices, bit for bit the same for
    small and for hot groups. Whether there are hot groups is found out at once, by
    one count over the two group columns, or from ``sizes`` (item_id, is_hq, n) if
    those are known. ``approx`` trades exactness for a sketch per group.
    """
    if approx:
        return _pair(listings, F.percentile_approx("price_per_unit", [lo, hi], 10000), min_rows)
    exact = F.percentile("price_per_unit", [lo, hi])
    if sizes is None:
        sizes = listings.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= hot_rows:
        return _pair(listings, exact, min_rows)
    hot = materialize(
        sizes.where(F.col("n") > hot_rows).select(*[F.col(c).alias(f"hot_{c}") for c in GROUP]),
        "hot_groups",
    )
    is_hot = [F.col(c).eqNullSafe(F.col(f"hot_{c}")) for c in GROUP]
    small = listings.join(hot, is_hot, "left_anti")
    large = listings.join(hot, is_hot, "left_semi")
    return _pair(small, exact, min_rows).unionByName(_by_ranges(large, lo, hi, min_rows))


def _pair(listings: DataFrame, percentiles: Column, min_rows: int) -> DataFrame:
    return (
        listings.groupBy(*GROUP)
        .agg(F.count(F.lit(1)).alias("n"), percentiles.alias("p"))
        .where((F.col("n") >= min_rows) & F.col("p").isNotNull())
        .select(
            *GROUP, F.col("p")[0].cast("double").alias("p05"), F.col("p")[1].cast("double").alias("p85")
        )
    )


def _by_ranges(listings: DataFrame, lo: float, hi: float, min_rows: int) -> DataFrame:
    prices = listings.groupBy(*GROUP, "price_per_unit").agg(F.count(F.lit(1)).alias("n"))
    prices = prices.withColumn("range", F.shiftright("price_per_unit", RANGE_BITS))

    whole = Window.partitionBy(*GROUP)
    upto = whole.orderBy(F.col("range").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    priced = F.when(F.col("range").isNotNull(), F.col("range_n"))
    ranges = (
        prices.groupBy(*GROUP, "range")
        .agg(F.sum("n").alias("range_n"))
        .withColumn("range_end", F.sum("range_n").over(upto))
        .withColumn("rows", F.sum("range_n").over(whole))
        .withColumn("priced", F.sum(priced).over(whole))
        .where((F.col("rows") >= min_rows) & F.col("range").isNotNull())
        .withColumn("range_start", F.col("range_end") - F.col("range_n"))
    )

    ranks = {
        "lo_below": F.floor(_position(lo)),
        "lo_above": F.ceil(_position(lo)),
        "hi_below": F.floor(_position(hi)),
        "hi_above": F.ceil(_position(hi)),
    }
    wanted = ranges.where(
        _any(
            (rank >= F.col("range_start")) & (rank < F.col("range_end"))
            for rank in ranks.values()
        )
    ).select(
        *[F.col(c).alias(f"w_{c}") for c in [*GROUP, "range"]], "range_start", "priced"
    )

    # Null-safe on every column: an inner join on plain equality would push a
    # not-null filter into one of the two uses of ``prices``, which then could
    # not share one shuffle.
    same = [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in [*GROUP, "range"]]
    inside = Window.partitionBy(*GROUP, "range").orderBy("price_per_unit").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = (
        prices.join(wanted, same)
        .withColumn("end", F.col("range_start") + F.sum("n").over(inside))
        .withColumn("start", F.col("end") - F.col("n"))
    )

    def price_at(rank: Column) -> Column:
        found = (rank >= F.col("start")) & (rank < F.col("end"))
        return F.max(F.when(found, F.col("price_per_unit")))

    return (
        placed.groupBy(*GROUP)
        .agg(
            F.max("priced").alias("priced"),
            *[price_at(rank).alias(name) for name, rank in ranks.items()],
        )
        .select(
            *GROUP,
            _interpolate("lo_below", "lo_above", lo).alias("p05"),
            _interpolate("hi_below", "hi_above", hi).alias("p85"),
        )
    )


def _position(p: float) -> Column:
    return F.lit(p) * (F.col("priced") - 1)


def _interpolate(below: str, above: str, p: float) -> Column:
    """The weighted form that ``percentile`` uses too, so that both sides agree to the last bit."""
    low, high = F.col(below).cast("double"), F.col(above).cast("double")
    position = _position(p)
    between = (F.ceil(position) - position) * low + (position - F.floor(position)) * high
    return F.when(low == high, low).otherwise(between)


def _any(conditions) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def price_band(listings: DataFrame, bounds: DataFrame) -> DataFrame:
    """Listings priced within the bounds of their group, both ends included."""
    return (
        listings.select(*GROUP, "world_id", "price_per_unit")
        .join(bounds, GROUP)
        .where(F.col("price_per_unit").between(F.col("p05"), F.col("p85")))
        .drop("p05", "p85")
    )

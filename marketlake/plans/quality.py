"""Data-quality checks: each counts failing rows; an ``error`` stops the run."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WARN, ERROR = "warn", "error"


class ChecksFailed(Exception):
    pass


@dataclass(frozen=True)
class Check:
    """``fails`` is a condition on a row; a unique check names its column instead."""

    name: str
    target: str
    severity: str
    fails: str | None = None
    unique: str | None = None


def _not_null(target: str, severity: str, *columns: str) -> list[Check]:
    return [Check(f"not_null_{c}", target, severity, fails=f"{c} IS NULL") for c in columns]


def _unique(target: str, severity: str, *columns: str) -> list[Check]:
    return [Check(f"unique_{c}", target, severity, unique=c) for c in columns]


# The checks of the staging views, the marts and the dimensions.
CHECKS = [
    *_not_null("stg_listings", WARN, "listing_id", "item_id", "world_id", "price_per_unit", "quantity"),
    *_unique("stg_listings", WARN, "listing_id"),
    *_not_null("stg_sales", WARN, "item_id", "world_id", "price_per_unit", "quantity"),
    *_not_null("price_summary", ERROR, "item_id", "world_id", "item_name", "listing_count", "min_price"),
    *_not_null("arbitrage", ERROR, "item_id", "world_id", "profit_margin_pct"),
    *_not_null("hq_premium", ERROR, "item_id", "hq_avg_price", "nq_avg_price"),
    *_not_null("velocity", ERROR, "item_id", "sale_count", "total_volume"),
    *_not_null("price_history", ERROR, "item_id", "sale_date", "sale_count"),
    *_not_null("item_names", ERROR, "item_id", "item_name"),
    *_unique("item_names", ERROR, "item_id"),
    *_not_null("world_names", ERROR, "world_id", "world_name"),
    *_unique("world_names", ERROR, "world_id", "world_name"),
    Check("margin_not_negative", "arbitrage", ERROR, "profit_margin_pct < 0"),
    Check("cheapest_not_above_priciest", "arbitrage", ERROR, "cheapest_price > priciest_price"),
    Check("both_prices_positive", "hq_premium", ERROR, "hq_avg_price <= 0 OR nq_avg_price <= 0"),
    Check("price_not_negative", "stg_listings", WARN, "price_per_unit < 0"),
    Check("quantity_positive", "stg_listings", WARN, "quantity <= 0"),
    Check(
        "total_is_price_times_quantity", "stg_sales", WARN,
        "abs(total - price_per_unit * quantity) > 1",
    ),
]


def failing_rows(df: DataFrame, check: Check) -> DataFrame:
    """The rows, or for a unique check the repeated values, that fail."""
    if check.unique is None:
        return df.where(check.fails)
    return (
        df.where(F.col(check.unique).isNotNull())
        .groupBy(check.unique)
        .agg(F.count(F.lit(1)).alias("n_records"))
        .where(F.col("n_records") > 1)
    )


def run_checks(tables: dict[str, DataFrame], checks: list[Check] = CHECKS) -> DataFrame:
    """(check, target, severity, failures, status), one row per check.

    All row checks of a table take one pass over it, whatever their number.
    """
    parts = []
    for target, df in tables.items():
        mine = [c for c in checks if c.target == target]
        by_row = [c for c in mine if c.unique is None]
        if by_row:
            counts = df.agg(
                *[F.count_if(F.expr(c.fails)).alias(f"c{i}") for i, c in enumerate(by_row)]
            )
            results = [
                F.struct(*_labels(c), F.col(f"c{i}").alias("failures"))
                for i, c in enumerate(by_row)
            ]
            parts.append(counts.select(F.inline(F.array(*results))))
        for check in mine:
            if check.unique is not None:
                count = failing_rows(df, check).agg(F.count(F.lit(1)).alias("failures"))
                parts.append(count.select(*_labels(check), "failures"))
    report = reduce(DataFrame.unionByName, parts)
    return report.withColumn(
        "status", F.when(F.col("failures") == 0, "pass").otherwise(F.col("severity"))
    )


def _labels(check: Check):
    return [
        F.lit(check.name).alias("check"),
        F.lit(check.target).alias("target"),
        F.lit(check.severity).alias("severity"),
    ]


def require(report: DataFrame) -> None:
    """Raise if a check of severity ``error`` has failures; the report has one row per check."""
    failed = report.where(F.col("status") == ERROR).collect()
    if failed:
        lines = [f"{r['check']} on {r['target']}: {r['failures']} failures" for r in failed]
        raise ChecksFailed("; ".join(lines))

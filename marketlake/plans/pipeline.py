"""The scheduled run: dimensions, staging, marts, checks, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.operators.bounds import price_bounds
from marketlake.plans import marts, quality
from marketlake.plans.publish import new_run, publish
from marketlake.sources import dims
from marketlake.sources.catalog import register_views
from marketlake.sources.lake import CODEC, LakeTable
from marketlake.plans.staging import stg_listings, stg_sales


def store(df: DataFrame, path: str) -> DataFrame:
    """Write one table in full and go on from the stored form."""
    df.write.mode("overwrite").parquet(path, compression=CODEC)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_marts(
    listings: DataFrame, sales: DataFrame, items: DataFrame, worlds: DataFrame, out: str
) -> dict[str, DataFrame]:
    """Write every mart under ``out``, a folder of its own per run.

    The listings are read three times: for the summary, the bounds and the band.
    The premium follows from the stored summary, and velocity from the stored
    history, both far smaller than the facts.
    """
    summary = store(marts.price_summary(listings, items, worlds), f"{out}/price_summary")
    premium = store(marts.premium_of(summary), f"{out}/hq_premium")
    sizes = summary.groupBy("item_id", "is_hq").agg(F.sum("listing_count").alias("n"))
    bounds = store(price_bounds(listings, sizes=sizes), f"{out}/price_bounds")
    spread = store(marts.arbitrage(listings, items, worlds, bounds), f"{out}/arbitrage")
    history = store(marts.price_history(sales, items, worlds), f"{out}/price_history")
    velocity = store(marts.velocity_of(history), f"{out}/velocity")
    return {
        "price_summary": summary,
        "hq_premium": premium,
        "arbitrage": spread,
        "velocity": velocity,
        "price_history": history,
    }


def run(
    raw_listings: DataFrame,
    raw_sales: DataFrame,
    items: DataFrame,
    worlds: DataFrame,
    out: str,
    strict: bool = True,
    database: str | None = None,
) -> DataFrame:
    """Rebuild all marts and return the check report.

    With ``strict`` a failing check of severity error raises, and the views keep
    showing the run before. With ``database`` the marts, names and report are published
    there for other sessions.
    """
    staged = {"stg_listings": stg_listings(raw_listings), "stg_sales": stg_sales(raw_sales)}
    seeds = {
        "item_names": store(items, f"{out}/item_names"),
        "world_names": store(worlds, f"{out}/world_names"),
    }
    built = build_marts(*staged.values(), *seeds.values(), out)
    report = store(quality.run_checks({**staged, **built, **seeds}), f"{out}/check_report")
    if strict:
        quality.require(report)
    register_views({**staged, **seeds, **built})
    if database:
        spark = report.sparkSession
        names = [*seeds, *built, "check_report"]
        publish(spark, database, new_run(), {name: f"{out}/{name}" for name in names})
    return report


def run_pipeline(
    spark: SparkSession,
    listings: LakeTable,
    sales: LakeTable,
    item_seed: str,
    world_seed: str,
    out: str,
    strict: bool = True,
    raw: bool = False,
    database: str | None = None,
) -> DataFrame:
    """``run`` over the lake tables and the CSV seeds.

    New batches are compacted first, so that every mart scans a base that needs no
    merge. ``raw`` reads all versions instead, without deduplication.
    """
    if not raw:
        for table in (listings, sales):
            table.compact(spark)
    tables = [t.read_raw(spark) if raw else t.read(spark) for t in (listings, sales)]
    return run(
        *tables,
        dims.read_item_names(spark, item_seed),
        dims.read_world_names(spark, world_seed),
        out,
        strict,
        database,
    )

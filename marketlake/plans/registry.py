"""Every query by name, over the given test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake import testdata
from marketlake.functions import columns as fx
from marketlake.operators import documents, flatten, joins, usage
from marketlake.operators.bounds import price_band, price_bounds
from marketlake.operators.latest import LISTING_KEY, SALE_KEY, latest
from marketlake.plans import marts, pipeline, quality, serving, staging
from marketlake.plans.publish import published
from marketlake.schemas import RAW_SALES
from marketlake.session import configure, materialize, work_path
from marketlake.sources import dims, lake, topics
from marketlake.sources.catalog import register_views
from marketlake.streaming import ingest
from marketlake.streaming.requests import read_request_figures, start_request_figures
from marketlake.streaming.usage import fold_rollup, read_rollup, start_rollup


class Market:
    """The market tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return testdata.table(self.spark, self.dir, name)

    @cached_property
    def raw_listings(self):
        return testdata.raw_listings(self.spark, self.dir)

    @cached_property
    def raw_sales(self):
        return testdata.raw_sales(self.spark, self.dir)

    @cached_property
    def listings(self):
        return staging.stg_listings(self.raw_listings)

    @cached_property
    def sales(self):
        return staging.stg_sales(self.raw_sales)

    @cached_property
    def sales_fine(self):
        return staging.stg_sales(testdata.raw_sales_fine(self.spark, self.dir))

    @cached_property
    def items(self):
        return testdata.items(self.spark, self.dir)

    @cached_property
    def worlds(self):
        return testdata.worlds(self.spark, self.dir)

    @cached_property
    def centers(self):
        return testdata.centers(self.spark, self.dir)

    @cached_property
    def price_summary(self):
        return marts.price_summary(self.listings, self.items, self.worlds)

    @cached_property
    def hq_premium(self):
        return marts.hq_premium(self.listings, self.items, self.worlds)

    @cached_property
    def arbitrage(self):
        return marts.arbitrage(self.listings, self.items, self.worlds)

    @cached_property
    def velocity(self):
        return marts.velocity(self.sales, self.items, self.worlds)

    @cached_property
    def price_history(self):
        return marts.price_history(self.sales, self.items, self.worlds)

    @cached_property
    def request_log(self):
        return testdata.request_log(self.spark, self.dir)


def partition_scan(m: Market) -> DataFrame:
    path = work_path(m.spark, "raw_sales")
    lake.write_partitioned(m.raw_sales.withColumn("item", F.col("item").cast("int")), path)
    raw = lake.read_partitioned(m.spark, path, RAW_SALES)
    return raw.where(
        (F.col("world") == 3)
        & F.col("dt").between(F.lit("2024-01-08").cast("date"), F.lit("2024-01-21").cast("date"))
    ).select("item", "world", "dt", "pricePerUnit", "quantity")


def dim_items(m: Market) -> DataFrame:
    name = F.concat(F.lit("  "), "p_name", F.lit(" "))
    return dims.item_names(m.table("part").select(F.col("p_partkey").alias("#"), name.alias("Name")))


def dim_worlds(m: Market) -> DataFrame:
    source = m.table("supplier").select(
        (F.col("s_suppkey") * 40).alias("id"), F.col("s_name").alias("name")
    )
    return dims.world_names(source)


def dim_worlds_file(m: Market) -> DataFrame:
    """Suppliers as worlds in files of one JSON array over many lines each, read back."""
    path = work_path(m.spark, "world_files")
    world = F.struct((F.col("s_suppkey") * 40).alias("id"), F.col("s_name").alias("name"))
    arrays = m.table("supplier").groupBy(F.expr("s_suppkey div 1000").alias("part")).agg(
        F.to_json(F.collect_list(world), {"pretty": "true"}).alias("value")  # 1000 rows at most
    )
    arrays.write.partitionBy("part").text(path)
    return dims.world_names(dims.read_world_source(m.spark, path))


def dim_centers(m: Market) -> DataFrame:
    """Nations as centers, each supplier row listing itself and its trade name."""
    source = m.table("supplier").join(m.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return dims.center_rows(
        source.select(
            F.col("n_name").alias("data_center"),
            F.col("n_nationkey").alias("center_position"),
            F.array("s_name", F.concat("s_name", F.lit(" II"))).alias("worlds"),
        )
    )


def region_worlds(m: Market) -> DataFrame:
    suppliers = m.table("supplier")
    centers = (
        suppliers.join(m.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(m.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("r_name").alias("region"), F.array("s_suppkey").alias("worlds"))
    )
    worlds = suppliers.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return dims.region_worlds(centers, worlds, "AMERICA")


def route_channels(m: Market) -> DataFrame:
    routed = flatten.with_topic(
        testdata.channel_events(m.spark, m.dir),
        {"events/click": "raw.click", "events/purchase": "raw.purchase"},
    )
    return routed.groupBy("topic").agg(F.count(F.lit(1)).alias("events"))


def topic_messages(m: Market) -> DataFrame:
    """The sink side: rows as JSON messages, read back from the topic's folder."""
    path = work_path(m.spark, "messages")
    rows = m.table("events").select("event_id", "user_id", "value", F.lit("raw.events").alias("topic"))
    topics.as_messages(rows).write.partitionBy("topic").text(path)
    return (
        m.spark.read.text(f"{path}/topic=raw.events")
        .select(F.from_json("value", "event_id BIGINT, user_id BIGINT, value DOUBLE").alias("e"))
        .select("e.*")
    )


def formatted_arbitrage(m: Market) -> DataFrame:
    """The top of the arbitrage mart as the texts of its table view."""

    def money(name: str):
        return F.concat(fx.thousands(F.col(name)), F.lit(" gil")).alias(name)

    return serving.top_arbitrage(m.arbitrage).select(
        "item_name", "world_name", fx.quality(F.col("is_hq"), high="★ HQ").alias("quality"),
        money("min_price"), money("cheapest_price"), money("priciest_price"),
        fx.one_decimal(F.col("profit_margin_pct")).alias("margin"),
    )


def fenced_sql(m: Market) -> DataFrame:
    fenced = F.concat(F.lit("Here it is:\n```sql\n"), "text", F.lit("\n```\nDone."))
    text = F.when(F.col("doc_id") % 2 == 0, fenced).otherwise(F.col("text"))
    return m.table("documents").select("doc_id", F.md5(fx.fenced_sql(text)).alias("sql_md5"))


SQL_ANSWER = """Total listings by world:
```sql
SELECT world_name, sum(listing_count) AS listings, max(max_price) AS highest
FROM price_summary GROUP BY world_name ORDER BY world_name
```"""


def sql_rows(m: Market) -> DataFrame:
    register_views({"price_summary": m.price_summary})
    return serving.select_only(m.spark, SQL_ANSWER).limit(serving.SQL_ROWS)


def live_quotes(m: Market) -> DataFrame:
    docs = testdata.quote_docs(m.listings, m.items, m.worlds)
    quotes = documents.live_quotes(docs.withColumn("item_name", F.concat_ws(" #", "item_name", "item_id")))
    return quotes.select(
        "item_name", "world",
        F.size("listings").alias("listings"), F.size("recent_sales").alias("recent_sales"), "report",
    )


def item_details(m: Market) -> DataFrame:
    return documents.item_details(testdata.item_docs(m.spark, m.dir)).withColumn(
        "description", F.md5("description")
    )


# The test pages carry their list items without classes, as plain links.
PAGE_OPTIONS = {"lists": None, "titles": (*documents.TITLES, "a")}


def usage_means(m: Market) -> DataFrame:
    return usage.usage_means(m.request_log).select(
        "window_start", F.round("mean_duration_ms", 4).alias("mean_duration_ms"), "mean_iterations"
    )


FILE_EVENTS = 300_000


def _write_events(events: DataFrame, path: str) -> None:
    # A compressed file is read by one task, so files are cut for many tasks.
    events.write.mode("append").option("maxRecordsPerFile", FILE_EVENTS).text(path, compression="gzip")


def _ingest(m: Market, root: str, name: str) -> lake.LakeTable:
    """One event stream, from a folder of JSON lines into a fresh lake table."""
    events, table, parse = {
        "listings": (testdata.listing_events, lake.listings_table, flatten.parse_listings),
        "sales": (testdata.sale_events, lake.sales_table, flatten.parse_sales),
    }[name]
    _write_events(events(m.spark, m.dir), f"{root}/in/{name}")
    target = table(f"{root}/{name}")
    raw = topics.read_topic_files(m.spark, f"{root}/in/{name}")
    ingest.start_ingest(
        raw, target, parse, f"{root}/checkpoint/{name}", interval=None
    ).awaitTermination()
    return target


def stream_ingest(m: Market) -> DataFrame:
    table = _ingest(m, work_path(m.spark, "ingest"), "listings")
    table.compact(m.spark)
    return table.read(m.spark)


BATCHES = 5


def stream_upsert(m: Market) -> DataFrame:
    """Listings over several batches, versions of a key in any of them: one
    compaction on the way, another onto that base, and a tail merged on reading.
    Events are dealt to the batches by the line items, so that no text is shuffled."""
    root = work_path(m.spark, "upsert")
    table = lake.listings_table(f"{root}/listings")
    for batch in range(BATCHES):
        events = testdata.listing_events(m.spark, m.dir, batch, BATCHES)
        _write_events(events, f"{root}/in")
        raw = topics.read_topic_files(m.spark, f"{root}/in")
        ingest.start_ingest(
            raw, table, flatten.parse_listings, f"{root}/checkpoint", interval=None, compact_every=2
        ).awaitTermination()
    return table.read(m.spark)


def stream_latest(m: Market) -> DataFrame:
    table = _ingest(m, work_path(m.spark, "ingest"), "sales")
    return table.read(m.spark).groupBy("world", "dt").agg(F.count(F.lit(1)).alias("sales"))


def stream_rates(m: Market) -> DataFrame:
    """The rollup over six files, one a batch: each has rows of all days, so that all
    but the first bring rows far later than what was seen before. A fold comes between."""
    root = work_path(m.spark, "rates")
    files = m.table("events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.length("event_type").cast("bigint").alias("input_tokens"),
        F.lit(2).cast("bigint").alias("output_tokens"),
    )
    rollup = usage.rates()
    for start in (0, 1):
        half = files.where(F.hour("ts") % 2 == start)
        half.repartition(3).write.mode("append").parquet(f"{root}/in")
        log = m.spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        start_rollup(log, rollup, f"{root}/out", f"{root}/checkpoint", interval=None).awaitTermination()
        if start == 0:
            fold_rollup(m.spark, f"{root}/out", rollup)
    rates = read_rollup(m.spark, f"{root}/out", rollup)
    return rates.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _live_figures(m: Market, name: str) -> DataFrame:
    """Request figures of a stream over six files, one a batch, with a restart after three.

    The closing rows come in the last three, and each file has rows of all days, so that requests
    stay open over several batches and change long after later ones have closed.
    """
    root = work_path(m.spark, "requests")
    late = F.col("status").isNotNull() | (F.crc32(F.concat("request_id", F.coalesce("iteration", F.lit(0)))) % 5 == 0)
    rows = m.request_log.withColumn("ts", F.col("ts").cast("timestamp"))
    for half in (~late, late):
        rows.where(half).repartition(3).write.mode("append").parquet(f"{root}/in")
        log = m.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        start_request_figures(log, f"{root}/out", f"{root}/checkpoint", interval=None).awaitTermination()
    figures = read_request_figures(m.spark, f"{root}/out", name)
    return figures.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_means(m: Market) -> DataFrame:
    return _live_figures(m, "means").select(
        "window_start", F.round("mean_duration_ms", 4).alias("mean_duration_ms"), "mean_iterations"
    )


def stream_active(m: Market) -> DataFrame:
    return _live_figures(m, "active")


def price_bounds_hot(m: Market) -> DataFrame:
    """Bounds with groups of over 20 listings taken by ranges, and whether both forms agree."""
    hot = materialize(price_bounds(m.listings, hot_rows=20), "bounds")
    plain = materialize(price_bounds(m.listings), "bounds").withColumnsRenamed({"p05": "q05", "p85": "q85"})
    same = F.col("p05").eqNullSafe(F.col("q05")) & F.col("p85").eqNullSafe(F.col("q85"))
    return hot.join(plain, ["item_id", "is_hq"], "full").select(
        "item_id", "is_hq", F.round("p05", 6).alias("p05"), F.round("p85", 6).alias("p85"), same.alias("same")
    )


def dq_report(m: Market) -> DataFrame:
    out = work_path(m.spark, "marts")
    return pipeline.run(m.raw_listings, m.raw_sales, m.items, m.worlds, out, strict=False)


def published_pages(m: Market) -> DataFrame:
    """Pages and lookups of a second session, from the marts that a run has published."""
    database = f"market_{uuid.uuid4().hex}"
    out = work_path(m.spark, "marts")
    pipeline.run(m.raw_listings, m.raw_sales, m.items, m.worlds, out, strict=False, database=database)
    reader = configure(m.spark.newSession())
    found = published(reader, database)
    pages = {
        "top_arbitrage": (serving.top_arbitrage(found["arbitrage"]), "profit_margin_pct"),
        "price_lookup": (serving.price_lookup(found["price_summary"], "RED_W%t"), "listing_count"),
        "top_velocity": (serving.top_velocity(found["velocity"]), "sale_count"),
        "hq_premium": (found["hq_premium"], "hq_premium_pct"),
        "price_summary": (found["price_summary"], "listing_count"),
        "arbitrage": (found["arbitrage"], "profit_margin_pct"),
    }
    rows = [
        page.select(F.lit(name).alias("page"), "item_name", "world_name", F.col(figure).cast("double").alias("figure"))
        for name, (page, figure) in pages.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def pipeline_run(m: Market) -> DataFrame:
    root = work_path(m.spark, "pipeline")
    m.items.write.csv(f"{root}/items", header=True)
    m.worlds.write.csv(f"{root}/worlds", header=True)
    tables = [_ingest(m, root, name) for name in ("listings", "sales")]
    return pipeline.run_pipeline(
        m.spark, *tables, f"{root}/items", f"{root}/worlds", f"{root}/out", strict=False
    )


def check(name: str, target: str) -> quality.Check:
    return next(c for c in quality.CHECKS if (c.name, c.target) == (name, target))


QUERIES: dict[str, Callable[[Market], DataFrame]] = {
    # Staging, scans and dimensions
    "stg_listings": lambda m: m.listings,
    "stg_sales": lambda m: m.sales,
    "listings_latest": lambda m: latest(m.listings, LISTING_KEY, ["last_review_time"]),
    "sales_latest": lambda m: latest(
        testdata.sales_arrivals(m.spark, m.dir), SALE_KEY, ["arrival"]
    ),
    "partition_scan": partition_scan,
    "lake_peek": lambda m: lake.peek(m.raw_listings),
    "dim_items": dim_items,
    "dim_worlds": dim_worlds,
    "dim_worlds_file": dim_worlds_file,
    "dim_centers": dim_centers,
    "region_worlds": region_worlds,
    # Events
    "parse_listings": lambda m: flatten.parse_listings(
        testdata.listing_events(m.spark, m.dir)
    )[0].drop("_pos"),
    "parse_sales": lambda m: flatten.parse_sales(testdata.sale_events(m.spark, m.dir))[0].drop("_pos"),
    "route_channels": route_channels,
    "topic_messages": topic_messages,
    # Marts
    "price_summary": lambda m: m.price_summary,
    "hq_premium": lambda m: m.hq_premium,
    "price_bounds": lambda m: price_bounds(m.listings).select(
        "item_id", "is_hq", F.round("p05", 6).alias("p05"), F.round("p85", 6).alias("p85")
    ),
    "price_bounds_hot": price_bounds_hot,
    "price_band": lambda m: price_band(m.listings, materialize(price_bounds(m.listings), "bounds")),
    "arbitrage": lambda m: m.arbitrage,
    "velocity": lambda m: m.velocity,
    "price_history": lambda m: m.price_history,
    "velocity_fine": lambda m: marts.velocity(m.sales_fine, m.items, m.worlds),
    "price_history_fine": lambda m: marts.price_history(m.sales_fine, m.items, m.worlds),
    "mart_order": lambda m: serving.whole_mart(m.arbitrage, "arbitrage"),
    # Lookups
    "top_arbitrage": lambda m: serving.top_arbitrage(m.arbitrage),
    "top_velocity": lambda m: serving.top_velocity(m.velocity),
    "price_lookup": lambda m: serving.price_lookup(m.price_summary, "RED_W%t"),
    "market_snapshot": lambda m: serving.market_snapshot(m.price_summary, "Bolt"),
    "item_search": lambda m: serving.item_search(m.items, "ring"),
    "center_worlds": lambda m: joins.center_worlds(
        testdata.suppliers_by_nation(m.spark, m.dir), "Nation_7"
    ).select("data_center", "world_name"),
    "center_prices": lambda m: joins.in_center(m.price_summary, m.centers, "asia"),
    "formatted_arbitrage": formatted_arbitrage,
    # Pages
    "page_arbitrage_metrics": lambda m: serving.arbitrage_metrics(serving.arbitrage_page(m.arbitrage)),
    "page_prices": lambda m: serving.price_page(m.price_summary),
    "page_price_metrics": lambda m: serving.price_metrics(serving.price_page(m.price_summary)),
    "page_premium": lambda m: serving.premium_page(m.hq_premium),
    "page_premium_metrics": lambda m: serving.premium_metrics(serving.premium_page(m.hq_premium)),
    "page_premium_bars": lambda m: serving.premium_bars(serving.premium_page(m.hq_premium)),
    "page_velocity_metrics": lambda m: serving.velocity_metrics(serving.velocity_page(m.velocity)),
    "page_history": lambda m: serving.history_page(m.price_history),
    "history_labels": lambda m: serving.history_labels(serving.history_page(m.price_history)),
    "history_series": lambda m: serving.history_series(
        serving.history_page(m.price_history), "small ring"
    ),
    # Free-form SQL
    "sql_rows": sql_rows,
    "fenced_sql": fenced_sql,
    # Checks
    "dq_report": dq_report,
    "dq_duplicate_listings": lambda m: quality.failing_rows(
        m.listings, check("unique_listing_id", "stg_listings")
    ),
    "dq_sale_totals": lambda m: quality.failing_rows(
        m.sales_fine, check("total_is_price_times_quantity", "stg_sales")
    ),
    # Documents
    "snapshot_items": lambda m: documents.snapshot_items(
        testdata.snapshot_docs(m.listings, m.worlds)
    ),
    "live_quotes": live_quotes,
    "item_details": item_details,
    "page_headlines": lambda m: documents.page_headlines(m.table("pages"), **PAGE_OPTIONS),
    "page_headline_reports": lambda m: documents.headline_report(m.table("pages"), **PAGE_OPTIONS),
    # Usage
    "usage_totals": lambda m: usage.usage_totals(testdata.token_log(m.spark, m.dir)),
    "usage_tools": lambda m: usage.usage_tools(m.request_log),
    "usage_tool_calls": lambda m: usage.usage_tool_calls(m.request_log),
    "usage_rates": lambda m: usage.usage_rates(m.request_log),
    "usage_means": usage_means,
    "usage_routes": lambda m: usage.usage_routes(m.request_log),
    "usage_active": lambda m: usage.usage_active(m.request_log),
    "usage_active_at": lambda m: usage.active_at(
        m.request_log, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    ),
    # Streams and the scheduled run
    "stream_ingest": stream_ingest,
    "stream_upsert": stream_upsert,
    "stream_latest": stream_latest,
    "stream_rates": stream_rates,
    "stream_means": stream_means,
    "stream_active": stream_active,
    "pipeline_run": pipeline_run,
    "published_pages": published_pages,
}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[name](Market(configure(spark), sf_dir))

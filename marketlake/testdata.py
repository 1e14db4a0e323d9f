"""The market tables as views over the given test tables (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlake.functions.columns import epoch_seconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ supplier in the shape of the raw listings table."""
    lines = table(spark, sf_dir, "lineitem")
    suppliers = table(spark, sf_dir, "supplier")
    price, tax = F.col("l_extendedprice"), F.col("l_tax")
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_partkey").alias("item"),
        epoch_seconds(F.col("l_shipdate")).alias("lastReviewTime"),
        F.floor(price / F.col("l_quantity")).cast("bigint").alias("pricePerUnit"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (F.col("l_returnflag") == "R").alias("hq"),
        (F.col("l_linestatus") == "F").alias("isCrafted"),
        F.col("s_name").alias("retainerName"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("listingID"),
        F.floor(price).cast("bigint").alias("total"),
        F.floor(price * tax).cast("bigint").alias("tax"),
        F.col("s_nationkey").alias("world"),
        F.col("l_shipdate").cast("date").alias("dt"),
    )


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events in the shape of the raw sales table."""
    k = F.get_json_object("props", "$.k").cast("int")
    price = F.floor(F.col("value") * 100).cast("bigint")
    return (
        table(spark, sf_dir, "events")
        .select("*", k.alias("k"), price.alias("price"))
        .select(
            (F.col("user_id") % 10).alias("item"),
            (F.col("k") % 2 == 0).alias("hq"),
            F.col("price").alias("pricePerUnit"),
            (1 + F.col("k") % 3).alias("quantity"),
            epoch_seconds(F.col("ts")).alias("ts"),
            (F.col("price") * (1 + F.col("k") % 3)).alias("total"),
            F.concat(F.lit("user-"), "user_id").alias("buyerName"),
            (F.col("event_type") == "error").alias("onMannequin"),
            (F.col("k") % 5).alias("world"),
            F.col("ts").cast("date").alias("dt"),
        )
    )


def raw_sales_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ supplier ⋈ orders ⋈ customer as sales: about one row per daily group."""
    lines = table(spark, sf_dir, "lineitem")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("l_partkey").alias("item"),
            (F.col("l_returnflag") == "R").alias("hq"),
            F.floor(F.col("l_extendedprice") / F.col("l_quantity"))
            .cast("bigint")
            .alias("pricePerUnit"),
            F.col("l_quantity").cast("int").alias("quantity"),
            epoch_seconds(F.col("l_shipdate")).alias("ts"),
            F.floor("l_extendedprice").cast("bigint").alias("total"),
            F.col("c_name").alias("buyerName"),
            (F.col("l_linestatus") == "F").alias("onMannequin"),
            F.col("s_nationkey").alias("world"),
            F.col("l_shipdate").cast("date").alias("dt"),
        )
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_name")
    )


def worlds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("world_id"), F.col("n_name").alias("world_name")
    )


def centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region → its nations, as data centers and their worlds."""
    return (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("r_name").alias("data_center"),
            F.col("r_regionkey").alias("center_position"),
            F.col("n_name").alias("world_name"),
            F.col("n_nationkey").alias("position"),
        )
    )


def suppliers_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation → its suppliers, as data centers and their worlds."""
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("data_center"),
            F.col("n_nationkey").alias("center_position"),
            F.col("s_name").alias("world_name"),
            F.col("s_suppkey").alias("position"),
        )
    )


def sales_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sales with their place in the order of arrival."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        (F.col("user_id") % 10).alias("item_id"),
        (k % 5).alias("world_id"),
        epoch_seconds(F.date_trunc("hour", "ts").cast("timestamp_ntz")).alias("sale_timestamp"),
        F.floor(F.col("value") * 100).cast("bigint").alias("price_per_unit"),
        F.col("event_id").alias("arrival"),
    )


def listing_events(spark: SparkSession, sf_dir: str, part: int = 0, parts: int = 1) -> DataFrame:
    """JSON listing events, one per line item, of zero to two listings.

    Review times fall on five days and differ between versions of a listing.
    Flags that are false are left out, as is everything the parser must default.
    Line items are dealt to ``parts`` in turn, as they lie in their files.
    """
    lines = table(spark, sf_dir, "lineitem")
    if parts > 1:
        lines = lines.where(F.col("_metadata.row_index") % parts == part)
    suppliers = table(spark, sf_dir, "supplier")
    price, world = F.col("l_extendedprice"), F.col("s_nationkey")
    days = F.datediff("l_shipdate", F.lit("1970-01-01").cast("date")).cast("bigint")
    review = F.lit(1704067200) + F.pmod(F.col("l_partkey") * 7919 + days * 104729, F.lit(432000))

    def listing(j: int):
        return F.struct(
            review.alias("lastReviewTime"),
            F.floor(price / F.col("l_quantity")).cast("bigint").alias("pricePerUnit"),
            (F.col("l_quantity").cast("int") + j - 1).alias("quantity"),
            F.when(F.col("l_returnflag") == "R", True).alias("hq"),
            F.when(F.col("l_linestatus") == "F", True).alias("isCrafted"),
            F.col("s_name").alias("retainerName"),
            F.concat_ws("-", "l_orderkey", "l_linenumber", F.lit(j)).alias("listingID"),
            F.floor(price).cast("bigint").alias("total"),
            F.floor(price * F.col("l_tax")).cast("bigint").alias("tax"),
            (world + 1000).alias("worldID"),
        )

    both = F.array(listing(1), listing(2))
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.to_json(
            F.struct(
                F.lit("listings/add").alias("event"),
                F.col("l_partkey").alias("item"),
                world.alias("world"),
                F.slice(both, 1, F.col("l_linenumber") % 3).alias("listings"),
            )
        ).alias("value")
    )


def sale_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON sale events, one per event, of zero to two sales; some without a buyer."""
    k = F.get_json_object("props", "$.k").cast("int")
    price = F.floor(F.col("value") * 100).cast("bigint")

    def sale(j: int):
        return F.struct(
            F.when(F.col("k") % 2 == 0, True).alias("hq"),
            F.col("price").alias("pricePerUnit"),
            (F.col("k") % 3).alias("quantity"),
            (epoch_seconds(F.col("ts")) + j).alias("timestamp"),
            (F.col("price") * (F.col("k") % 3)).alias("total"),
            F.when(F.col("k") % 7 != 0, F.concat(F.lit("user-"), "user_id")).alias("buyerName"),
            F.when(F.col("event_type") == "error", True).alias("onMannequin"),
        )

    return (
        table(spark, sf_dir, "events")
        .select("*", k.alias("k"), price.alias("price"))
        .select(
            F.to_json(
                F.struct(
                    F.lit("sales/add").alias("event"),
                    F.col("user_id").alias("item"),
                    (F.col("k") % 5).alias("world"),
                    F.slice(F.array(sale(1), sale(2)), 1, F.col("k") % 3).alias("sales"),
                )
            ).alias("value")
        )
    )


def channel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as JSON messages of the channel they came from."""
    return table(spark, sf_dir, "events").select(
        F.to_json(
            F.struct(
                F.concat(F.lit("events/"), "event_type").alias("event"), "event_id", "value"
            )
        ).alias("value")
    )


def snapshot_docs(listings: DataFrame, worlds: DataFrame) -> DataFrame:
    """Market snapshots as JSON, of up to 30 items each, as one request asks for."""
    stats = listings.groupBy("item_id", "world_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("price_per_unit").alias("price"),
        F.sum("quantity").alias("sold"),
    )
    entry = F.struct(
        F.col("item_id").cast("string").alias("key"),
        F.struct(
            (F.col("n") >= 2).alias("hasData"),
            F.col("n").alias("listingsCount"),
            F.col("price").alias("averagePrice"),
            (F.col("sold") / 7).alias("regularSaleVelocity"),
        ).alias("value"),
    )
    return (
        stats.join(worlds, "world_id")
        .groupBy("world_name", F.floor(F.col("item_id") / 30).alias("request"))
        .agg(F.map_from_entries(F.collect_list(entry)).alias("items"))
        .select(F.to_json(F.struct(F.col("world_name").alias("worldName"), "items")).alias("doc"))
    )


def quote_docs(listings: DataFrame, items: DataFrame, worlds: DataFrame) -> DataFrame:
    """Quotes as JSON per (item, world): the eight cheapest listings, five latest sales.

    The two ranks bound a document, and are applied in each task before rows move.
    """
    key = ["item_id", "world_id"]
    total = ["listing_id", "listed_date", "quantity", "total", "tax", "retainer_name", "is_hq", "is_crafted"]
    cheap = Window.partitionBy(*key).orderBy("price_per_unit", *total)
    recent = Window.partitionBy(*key).orderBy(F.desc("listed_date"), "price_per_unit", *total)

    def nested(window, limit: int, fields: list, name: str) -> DataFrame:
        ranked = listings.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)
        ordered = F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("e"))))
        return ranked.groupBy(*key).agg(F.transform(ordered, lambda x: x["e"]).alias(name))

    shown = [
        F.col("is_hq").alias("hq"),
        "quantity",
        F.col("price_per_unit").alias("pricePerUnit"),
    ]
    docs = nested(cheap, 8, [*shown, "total"], "listings").join(
        nested(recent, 5, shown, "recentHistory"), key
    )
    return (
        docs.join(items, "item_id")
        .join(worlds, "world_id")
        .select(
            "item_id",
            "item_name",
            F.col("world_name").alias("world"),
            F.to_json(F.struct("listings", "recentHistory")).alias("doc"),
        )
    )


def item_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item details as JSON in the shapes that occur: nested or flat, category as
    object or text, fields absent, descriptions of any length."""
    parts = table(spark, sf_dir, "part")
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    nested = F.col("p_partkey") % 2 == 0
    body = F.struct(
        F.when(F.col("p_partkey") % 5 != 0, F.struct(F.col("p_type").alias("Name"))).alias(
            "ItemUICategory"
        ),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("LevelItem"),
        F.col("p_size").alias("LevelEquip"),
        (F.col("p_size") > 25).alias("CanBeHq"),
        F.col("text").alias("Description"),
    )
    plain = F.struct(
        F.col("p_brand").alias("ItemUICategory"),
        F.col("p_size").alias("LevelItem"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_size").cast("string")).alias("LevelEquip"),
        F.when(F.col("p_size") > 10, F.col("p_size") % 2).alias("CanBeHq"),
        F.col("text").alias("Description"),
    )
    return parts.join(texts, F.col("p_partkey") == F.col("doc_id"), "left").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("item_name"),
        F.when(nested, F.to_json(F.struct(body.alias("fields"))))
        .otherwise(F.to_json(plain))
        .alias("doc"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a request log: four rows a request, the last of them closes it.

    Every fifth request stays open, every seventh fails and has no duration.
    Method and route stand on the first row and the closing one.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    request, row = F.floor(F.col("event_id") / 4), F.col("event_id") % 4
    closing = (row == 3) & (request % 5 != 0)
    ends = (row == 0) | closing
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", k)
        .select(
            "ts",
            request.cast("string").alias("request_id"),
            F.when(row != 0, row.cast("int")).alias("iteration"),
            (F.col("k").cast("bigint") * 10).alias("input_tokens"),
            (F.col("k").cast("bigint") + 1).alias("output_tokens"),
            F.when(F.col("event_type") != "view", F.col("event_type")).alias("tool_name"),
            F.when(closing & (request % 7 != 0), F.col("value") * 10000).alias("duration_ms"),
            F.when(ends, F.when(request % 2 == 0, "GET").otherwise("POST")).alias("method"),
            F.when(ends, F.concat(F.lit("/route"), (request % 3).cast("string"))).alias("route"),
            F.when(closing, F.when(request % 7 == 0, 500).otherwise(200)).alias("status"),
        )
    )


def token_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as a token log: words of a turn, in or out by its role."""
    words = F.regexp_count("text", F.lit(r"\S+")).cast("bigint")
    answer = F.col("role") == "assistant"
    return table(spark, sf_dir, "conversations").select(
        F.when(~answer, words).alias("input_tokens"),
        F.when(answer, words).alias("output_tokens"),
    )

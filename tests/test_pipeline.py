import pytest
from pyspark.sql import functions as F

from marketlake import session
from marketlake.plans import pipeline, publish, quality, serving
from marketlake.schemas import RAW_LISTINGS, RAW_SALES
from marketlake.sources import lake
from tests.test_lake import T0, listing, sale


@pytest.fixture
def parts(spark):
    items = spark.createDataFrame([(1, "ore"), (2, "bow")], "item_id int, item_name string")
    worlds = spark.createDataFrame([(1, "w1"), (2, "w2")], "world_id int, world_name string")
    listings = spark.createDataFrame(
        [listing(f"k{i}", T0, 10 + i % 3, world=1 + i % 2) for i in range(12)], RAW_LISTINGS
    )
    sales = spark.createDataFrame([sale(T0 + i, 5) for i in range(4)], RAW_SALES)
    return listings, sales, items, worlds


def failures(report):
    return {(r["target"], r["check"]): (r["failures"], r["status"]) for r in report.collect() if r["failures"]}


def test_forty_checks():
    checks = quality.CHECKS
    assert len(checks) == 40
    assert sum(c.name.startswith(("not_null", "unique")) for c in checks) == 34
    assert len({(c.name, c.target) for c in checks}) == 40


def test_all_pass(spark, parts, tmp_path):
    report = pipeline.run(*parts, str(tmp_path))
    assert report.count() == 40 and failures(report) == {}
    assert spark.table("price_summary").count() == 2 and spark.table("velocity").count() == 1


def test_warnings_are_counted(spark, parts, tmp_path):
    listings, sales, items, worlds = parts
    odd = [listing("k0", T0, -5), listing(None, T0, 7)]
    wrong_total = sale(T0 + 100, 5)[:5] + (7,) + sale(T0 + 100, 5)[6:]
    near_total = sale(T0 + 200, 5)[:5] + (6,) + sale(T0 + 200, 5)[6:]
    listings = listings.union(spark.createDataFrame(odd, RAW_LISTINGS)).withColumn(
        "quantity", F.when(F.col("listingID") == "k3", 0).otherwise(F.col("quantity"))
    )
    sales = sales.union(spark.createDataFrame([wrong_total, near_total], RAW_SALES))
    report = pipeline.run(listings, sales, items, worlds, str(tmp_path))
    assert failures(report) == {
        ("stg_listings", "price_not_negative"): (1, "warn"),
        ("stg_listings", "not_null_listing_id"): (1, "warn"),
        ("stg_listings", "unique_listing_id"): (1, "warn"),
        ("stg_listings", "quantity_positive"): (1, "warn"),
        ("stg_sales", "total_is_price_times_quantity"): (1, "warn"),
    }


def test_unknown_item_fails_the_run(spark, parts, tmp_path):
    listings, sales, items, worlds = parts
    strange = spark.createDataFrame([listing("z", T0, item=99)], RAW_LISTINGS)
    with pytest.raises(quality.ChecksFailed, match="not_null_item_name on price_summary: 1"):
        pipeline.run(listings.union(strange), sales, items, worlds, str(tmp_path))


def test_published_marts(spark, parts, tmp_path):
    """A second session reads stored marts; a failing run changes nothing; a reader keeps its run."""
    listings, sales, items, worlds = parts
    database = "published_test"
    reader = spark.newSession()
    assert publish.published(reader, database) == {}
    pipeline.run(*parts, f"{tmp_path}/one", database=database)
    first = publish.published(reader, database)
    assert set(first) == {
        "price_summary", "hq_premium", "arbitrage", "velocity", "price_history", "item_names", "world_names",
        "check_report",
    }
    assert first["check_report"].count() == 40
    before = first["price_summary"].orderBy("world_id").collect()
    strange = spark.createDataFrame([listing("z", T0, item=99)], RAW_LISTINGS)
    with pytest.raises(quality.ChecksFailed):
        pipeline.run(listings.union(strange), sales, items, worlds, f"{tmp_path}/bad", database=database)
    assert publish.published(reader, database)["price_summary"].orderBy("world_id").collect() == before
    more = listings.union(spark.createDataFrame([listing("new", T0, 99)], RAW_LISTINGS))
    pipeline.run(more, sales, items, worlds, f"{tmp_path}/two", database=database)
    now = publish.published(reader, database)["price_summary"].agg(F.sum("listing_count")).first()[0]
    assert now == 13 and first["price_summary"].agg(F.sum("listing_count")).first()[0] == 12
    assert serving.run_sql(reader, f"SELECT SUM(listing_count) AS n FROM {database}.price_summary")["data"] == [{"n": 13}]
    assert len(publish.retire(spark, database, keep=1)) == 1
    assert publish.published(reader, database)["arbitrage"].count() >= 0 and publish.retire(spark, database) == []
    spark.sql(f"DROP DATABASE {database} CASCADE")


def test_duplicate_in_a_dimension_fails_the_run(spark, parts, tmp_path):
    listings, sales, items, worlds = parts
    twice = worlds.union(spark.createDataFrame([(3, "w1")], worlds.schema))
    with pytest.raises(quality.ChecksFailed, match="unique_world_name on world_names: 1"):
        pipeline.run(listings, sales, items, twice, str(tmp_path))


def test_from_lake_and_seeds(spark, parts, tmp_path):
    listings, sales, items, worlds = parts
    tables = lake.listings_table(f"{tmp_path}/l").create(spark), lake.sales_table(f"{tmp_path}/s").create(spark)
    tables[0].append(listings, 0)
    tables[0].append(listings, 1)
    tables[1].append(sales, 0)
    items.write.csv(f"{tmp_path}/items", header=True)
    worlds.write.csv(f"{tmp_path}/worlds", header=True)
    seeds = f"{tmp_path}/items", f"{tmp_path}/worlds"
    report = pipeline.run_pipeline(spark, *tables, *seeds, f"{tmp_path}/out")
    assert failures(report) == {}
    raw = pipeline.run_pipeline(spark, *tables, *seeds, f"{tmp_path}/raw", raw=True)
    assert failures(raw) == {("stg_listings", "unique_listing_id"): (12, "warn")}


def test_work_folder(spark):
    assert session.work_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert session.work_path(spark, "x") != session.work_path(spark, "x")


def test_object_store_conf():
    conf = session.object_store_conf("http://store:9000", "key", "secret")
    assert conf["spark.hadoop.fs.s3a.path.style.access"] == "true"
    assert conf["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "false"

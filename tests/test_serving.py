import pytest
from pyspark.sql import functions as F

from marketlake.functions import columns as fx
from marketlake.operators import joins
from marketlake.plans import serving
from marketlake.sources import catalog, dims


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def found(spark, query):
    items = spark.createDataFrame(
        [(1, "Iron Ore"), (2, "iron_bar"), (3, "100% Wool"), (4, "O'Neil \\ Bow"), (5, None)],
        "item_id int, item_name string",
    )
    return [r["item_id"] for r in serving.item_search(items, query).collect()]


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ("IRON", [1, 2]), ("n_b", [2]), ("i%o", [1, 2, 4]), ("0%", [3]), ("'", [4]),
        ("' OR 1=1 --", []), ("\\", [4]), ("", [1, 2, 3, 4]),
    ],
)
def test_contains(spark, query, ids):
    assert found(spark, query) == ids


def test_search_limit(spark):
    items = spark.range(50).select(F.col("id").alias("item_id"), F.lit("x").alias("item_name"))
    assert [r["item_id"] for r in serving.item_search(items, "X").collect()] == list(range(10))


def mart(spark):
    rows = [(i, f"n{i}", w, f"w{w}", q, (i * w) % 5, 10.5, 1, 2, 3) for i in range(9) for w in range(4) for q in (True, False)]
    return spark.createDataFrame(
        rows,
        "item_id int, item_name string, world_id int, world_name string, is_hq boolean, "
        "listing_count bigint, avg_price double, min_price bigint, max_price bigint, total_quantity bigint",
    )


def test_top_is_a_total_order(spark):
    first = serving.price_page(mart(spark)).collect()
    again = serving.price_page(mart(spark).repartition(7)).collect()
    assert first == again and first[0]["avg_price"] == 11.0
    counts = [r["listing_count"] for r in first]
    assert counts == sorted(counts, reverse=True)


def test_top_k_keeps_k_rows_per_task(spark):
    plan = serving.price_lookup(mart(spark), "n")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_nulls_sort_last(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "item_id int, m int")
    assert [r["item_id"] for r in serving.top(df, "m", 3).collect()] == [3, 2, 1]


def test_center(spark):
    centers = dims.data_centers(spark)
    assert centers.count() == 81
    assert centers.select("data_center").distinct().count() == 11
    (line,) = joins.center_line(centers, "dynamis").collect()
    assert line["line"] == "Dynamis: Halicarnassus, Maduin, Marilith, Seraph"
    (line,) = joins.center_line(centers, "Nowhere").collect()
    assert line["line"].startswith("Unknown data center 'Nowhere'. Available: Aether, Primal, ")


def test_run_sql(spark):
    mart(spark).createOrReplaceTempView("price_summary")
    answer = serving.run_sql(spark, "Sure:\n```sql\nSELECT * FROM price_summary ORDER BY item_id;\n```")
    assert answer["rows"] == 72 and len(answer["data"]) == 20 and answer["error"] is None
    assert answer["sql"].startswith("SELECT")
    few = serving.run_sql(spark, "WITH a AS (SELECT 1 AS x) SELECT x FROM a UNION SELECT 2 -- done")
    assert few["rows"] == 2 and sorted(r["x"] for r in few["data"]) == [1, 2]
    broken = serving.run_sql(spark, "SELECT nothing FROM nowhere")
    assert broken["error"] and broken["data"] == [] and broken["rows"] == 0


@pytest.mark.parametrize(
    "statement",
    ["DROP VIEW price_summary", "CREATE TABLE t AS SELECT 1", "INSERT INTO price_summary SELECT 1", "SELECT 1) t; DROP VIEW price_summary; SELECT * FROM (SELECT 1",
     "SELECT java_method('java.lang.Integer', 'toString', 7)", "SELECT `Reflect` ('java.lang.Integer', 'toString', 7)",
     "SELECT * FROM (SELECT try_reflect/* x */('java.lang.Integer', 'toString', 7))", "(DROP VIEW price_summary)"],
)
def test_only_queries_run(spark, statement):
    mart(spark).createOrReplaceTempView("price_summary")
    assert serving.run_sql(spark, statement)["error"]
    assert spark.table("price_summary").count() == 72


def test_no_files_by_path(spark, tmp_path):
    path = str(tmp_path / "secret")
    spark.range(1).write.parquet(path)
    assert spark.sql(f"SELECT * FROM parquet.`{path}`").count() == 1
    assert serving.run_sql(spark, f"SELECT * FROM parquet.`{path}`")["error"]
    assert spark.sql(f"SELECT * FROM parquet.`{path}`").count() == 1
    assert serving.run_sql(spark, "SELECT 'reflect' AS x")["data"] == [{"x": "reflect"}]


def test_table_columns(spark):
    spark.sql("CREATE TABLE IF NOT EXISTS base_t (b INT, a STRING) USING parquet")
    spark.range(1).createOrReplaceTempView("some_view")
    try:
        rows = [tuple(r) for r in catalog.table_columns(spark).collect()]
        assert rows == [("base_t", "b", "int", 1), ("base_t", "a", "string", 2)]
        names = {r[0] for r in catalog.table_columns(spark, include_views=True).collect()}
        assert {"base_t", "some_view"} <= names
    finally:
        spark.sql("DROP TABLE base_t")


def test_texts(spark):
    assert one(spark, fx.thousands(F.lit(1234567))) == "1,234,567"
    assert one(spark, fx.one_decimal(F.lit(12.34))) == "12.3%"
    assert one(spark, fx.quality(F.lit(None).cast("boolean"))) == "NQ"
    assert one(spark, fx.cost_usd(F.lit(1_000_000), F.lit(1_000_000))) == 6.0
    assert one(spark, fx.percent_change(F.lit(1), F.lit(0))) is None
    assert one(spark, fx.percent_change(F.lit(4641.0), F.lit(4000.0))) == 16.02
    assert one(spark, fx.percent_change(F.lit(-3.0), F.lit(2.0))) == -250.0
    assert len(one(spark, fx.shorten(F.lit("x" * 300)))) == 300
    assert one(spark, fx.shorten(F.lit("é" * 301))) == "é" * 300 + "..."


@pytest.mark.parametrize(
    "text", ["```sql\nSELECT 1\n```", "a ```sql SELECT 2``` b ```sql SELECT 3```", "  plain  ", "```sql\n\n```", "```SELECT 4```"]
)
def test_fenced_sql_column_equals_text(spark, text):
    assert one(spark, fx.fenced_sql(F.lit(text))) == fx.fenced_sql_text(text)


def test_whole_mart_order(spark):
    rows = [(2, 5.0), (1, 5.0), (3, None), (4, 9.5), (None, 5.0)]
    mart = spark.createDataFrame(rows, "item_id int, profit_margin_pct double").repartition(3)
    shown = serving.whole_mart(mart, "arbitrage").collect()
    assert [r.item_id for r in shown] == [4, 1, 2, None, 3]
    assert serving.whole_mart(mart.where("false"), "arbitrage").count() == 0

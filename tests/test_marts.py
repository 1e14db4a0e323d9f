import random
from statistics import mean

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlake.operators import bounds as b
from marketlake.plans import marts

LISTING = "item_id int, world_id int, is_hq boolean, price_per_unit bigint, quantity int"


@pytest.fixture(scope="module")
def dims(spark):
    items = spark.createDataFrame([(i, f"item {i}") for i in range(1, 20)], "item_id int, item_name string")
    worlds = spark.createDataFrame([(i, f"world {i}") for i in range(1, 6)], "world_id int, world_name string")
    return items, worlds


def listings(spark, rows):
    return spark.createDataFrame(rows, LISTING)


def test_summary_keeps_null_groups_and_unknown_names(spark, dims):
    rows = [(1, 1, None, 10, 1), (None, 1, True, 20, 2), (99, 1, True, 30, 3), (1, 1, None, 20, 4)]
    got = {
        (r["item_id"], r["is_hq"]): (r["item_name"], r["listing_count"], r["avg_price"], r["total_quantity"])
        for r in marts.price_summary(listings(spark, rows), *dims).collect()
    }
    assert got == {
        (1, None): ("item 1", 2, 15.0, 5),
        (None, True): (None, 1, 20.0, 2),
        (99, True): (None, 1, 30.0, 3),
    }


def test_premium_needs_both_qualities(spark, dims):
    rows = [
        (1, 1, True, 150, 1), (1, 1, False, 100, 1), (1, 1, False, 100, 1),
        (2, 1, True, 150, 1), (3, 1, False, 150, 1),
        (4, 1, True, 5, 1), (4, 1, False, 0, 1),
        (None, 1, True, 5, 1), (None, 1, False, 5, 1), (5, 1, None, 5, 1),
    ]
    df = listings(spark, rows)
    direct = marts.hq_premium(df, *dims).collect()
    assert [(r["item_id"], r["hq_listings"], r["nq_listings"], r["hq_premium_pct"]) for r in direct] == [
        (1, 1, 2, 50.0)
    ]
    summary = marts.price_summary(df, *dims)
    assert marts.premium_of(summary).collect() == direct


def brute_bounds(rows, lo=0.05, hi=0.85, min_rows=10):
    groups = {}
    for item, _, hq, price, _ in rows:
        groups.setdefault((item, hq), []).append(price)
    result = {}
    for key, prices in groups.items():
        known = [p for p in prices if p is not None]
        if len(prices) >= min_rows and known:
            result[key] = tuple(np.percentile(np.array(known, dtype=float), [lo * 100, hi * 100]))
    return result


@pytest.mark.parametrize("hot_rows", [0, 150, b.HOT_ROWS])
@pytest.mark.parametrize("spread", [3, 5_000, 2**31, 2**45])
def test_bounds_are_exact(spark, spread, hot_rows):
    rng = random.Random(spread)
    rows = [
        (rng.choice([1, 1, 1, 2, 3, None]), 1, rng.choice([True, False, None]), rng.randrange(-spread // 10, spread), 1)
        for _ in range(1500)
    ]
    rows += [(4, 1, True, 7, 1)] * 9 + [(5, 1, True, 7, 1)] * 10 + [(6, 1, True, None, 1)] * 4 + [(6, 1, True, 8, 1)] * 6
    got = {(r["item_id"], r["is_hq"]): (r["p05"], r["p85"]) for r in b.price_bounds(listings(spark, rows), hot_rows=hot_rows).collect()}
    expected = brute_bounds(rows)
    assert got.keys() == expected.keys()
    for key, pair in expected.items():
        assert got[key] == pytest.approx(pair, rel=1e-12)
    assert (4, True) not in got and got[(5, True)] == (7.0, 7.0)


def test_bounds_do_not_depend_on_the_size_switch(spark):
    rng = random.Random(11)
    df = listings(spark, [(i, 1, True, rng.randrange(1, 10**6), 1) for i in range(60) for _ in range(10 + 7 * i)])
    forms = [sorted(map(tuple, b.price_bounds(df, hot_rows=n).collect())) for n in (0, 150, b.HOT_ROWS)]
    assert forms[0] == forms[1] == forms[2] and len(forms[0]) == 60


def test_bounds_reuse_one_shuffle_of_the_prices(spark):
    df = listings(spark, [(1, 1, True, p, 1) for p in range(50)])
    result = b.price_bounds(df, hot_rows=0)
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_approximate_bounds(spark):
    rows = [(1, 1, True, p, 1) for p in range(1000)]
    (r,) = b.price_bounds(listings(spark, rows), approx=True).collect()
    assert abs(r["p05"] - 50) <= 2 and abs(r["p85"] - 850) <= 2


def arbitrage(spark, dims, rows):
    return {
        (r["item_id"], r["world_id"], r["is_hq"]): r for r in marts.arbitrage(listings(spark, rows), *dims).collect()
    }


def test_arbitrage(spark, dims):
    base = [(1, w, True, p, 1) for w, p in [(1, 100), (1, 120), (2, 150), (2, 160), (3, 110)] for _ in range(4)]
    got = arbitrage(spark, dims, base + [(1, 4, True, 1, 1), (1, 5, True, 10**6, 1)])
    assert {k[1]: r["min_price"] for k, r in got.items()} == {1: 100, 2: 150, 3: 110}
    assert {(r["cheapest_price"], r["priciest_price"], r["profit_margin_pct"]) for r in got.values()} == {
        (100, 150, 50.0)
    }


def test_price_at_a_bound_is_kept(spark, dims):
    rows = [(1, 1, False, 50, 1)] * 10 + [(1, 2, False, 50, 1)]
    assert {k[1] for k in arbitrage(spark, dims, rows)} == {1, 2}


def test_threshold_single_world_and_zero_price(spark, dims):
    rows = [(1, 1, True, 10, 1)] * 9 + [(2, 1, True, 10, 1)] * 10
    rows += [(3, 1, True, 0, 1)] * 10 + [(3, 2, True, 30, 1)] * 10 + [(3, 3, True, 60, 1)] * 10
    rows += [(None, 1, True, 10, 1)] * 20 + [(7, 1, None, 10, 1)] * 20
    got = arbitrage(spark, dims, rows)
    assert set(got) == {(2, 1, True), (3, 2, True), (3, 3, True)}
    assert got[(2, 1, True)]["profit_margin_pct"] == 0.0
    assert got[(3, 2, True)]["cheapest_price"] == 30


def test_arbitrage_properties(spark, dims):
    rng = random.Random(3)
    rows = [(rng.randrange(1, 6), rng.randrange(1, 6), rng.random() < 0.5, rng.randrange(1, 500), 1) for _ in range(800)]
    got = arbitrage(spark, dims, rows)
    pairs = {(i, w, q) for i, w, q, _, _ in rows}
    assert set(got) <= pairs
    for r in got.values():
        assert r["cheapest_price"] <= r["min_price"] <= r["priciest_price"] and r["profit_margin_pct"] >= 0


def test_hot_item(spark, dims):
    rng = random.Random(5)
    rows = [(1 if rng.random() < 0.5 else rng.randrange(2, 19), rng.randrange(1, 6), True, rng.randrange(10**9), 1) for _ in range(6000)]
    got = {(r["item_id"], r["is_hq"]): (r["p05"], r["p85"]) for r in b.price_bounds(listings(spark, rows), hot_rows=1000).collect()}
    for key, pair in brute_bounds(rows).items():
        assert got[key] == pytest.approx(pair, rel=1e-12)


def test_history_and_velocity(spark, dims):
    sales = spark.createDataFrame(
        [(1, 1, True, "2024-01-01", 10, 2), (1, 1, True, "2024-01-01", 30, 3), (1, 1, True, "2024-01-02", 5, 1)],
        "item_id int, world_id int, is_hq boolean, sale_date string, price_per_unit bigint, quantity int",
    ).withColumn("sale_date", F.col("sale_date").cast("date"))
    history = marts.price_history(sales, *dims)
    first = history.orderBy("sale_date").first()
    assert (first["sale_count"], first["avg_price"], first["min_price"], first["max_price"], first["total_volume"]) == (
        2, mean([10, 30]), 10, 30, 5,
    )
    velocity = marts.velocity(sales, *dims)
    assert sorted(velocity.collect()) == sorted(marts.velocity_of(history).collect())
    assert velocity.columns == [
        "item_id", "item_name", "world_id", "world_name", "is_hq", "sale_date", "avg_price", "sale_count", "total_volume",
    ]

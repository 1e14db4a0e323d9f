import datetime
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from marketlake.operators.flatten import parse_listings, parse_sales, route, with_topic
from marketlake.schemas import RAW_LISTINGS, RAW_SALES
from pyspark.sql import Observation


def raw(spark, *events):
    texts = [e if isinstance(e, str) else json.dumps(e) for e in events]
    return spark.createDataFrame([(t,) for t in texts], "value string")


def listing(**fields):
    full = {
        "lastReviewTime": 1704067199, "pricePerUnit": 100, "quantity": 2, "hq": True,
        "isCrafted": True, "retainerName": "r", "listingID": "a", "total": 200, "tax": 10,
    }
    return {k: v for k, v in {**full, **fields}.items() if v != "absent"}


def rows_of(df):
    return [r.asDict() for r in df.drop("_pos").collect()]


def test_schema(spark):
    rows, _ = parse_listings(raw(spark, {"item": 1, "world": 2, "listings": []}))
    assert [(f.name, f.dataType) for f in rows.drop("_pos").schema] == [
        (f.name, f.dataType) for f in RAW_LISTINGS
    ]
    rows, _ = parse_sales(raw(spark, {"item": 1, "world": 2, "sales": []}))
    assert [(f.name, f.dataType) for f in rows.drop("_pos").schema] == [
        (f.name, f.dataType) for f in RAW_SALES
    ]


def test_unknown_fields_and_envelope(spark):
    event = {
        "event": "listings/add", "item": 7, "world": 40, "extra": {"x": 1},
        "listings": [listing(worldID=99, worldName="other", stainID=3), listing(listingID="b")],
    }
    rows, bad = parse_listings(raw(spark, event))
    got = rows_of(rows)
    assert [(r["item"], r["world"], r["listingID"]) for r in got] == [(7, 40, "a"), (7, 40, "b")]
    assert bad.count() == 0


def test_defaults(spark):
    absent = dict.fromkeys(("pricePerUnit", "quantity", "hq", "isCrafted", "retainerName", "tax"), "absent")
    rows, _ = parse_listings(raw(spark, {"item": 1, "world": 2, "listings": [listing(**absent)]}))
    (r,) = rows_of(rows)
    assert (r["pricePerUnit"], r["quantity"], r["hq"], r["isCrafted"], r["tax"]) == (0, 0, False, False, 0)
    assert r["retainerName"] is None
    sale = {"pricePerUnit": 5, "timestamp": 0}
    rows, _ = parse_sales(raw(spark, {"item": 1, "world": 2, "sales": [sale]}))
    (r,) = rows_of(rows)
    assert r["buyerName"] is None and r["onMannequin"] is False and r["dt"] == datetime.date(1970, 1, 1)


def test_day_boundary_is_utc(spark):
    event = {
        "item": 1, "world": 2,
        "listings": [listing(lastReviewTime=1704067199), listing(lastReviewTime=1704067200)],
    }
    rows, _ = parse_listings(raw(spark, event))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        days = [r["dt"] for r in rows_of(rows)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert days == [datetime.date(2023, 12, 31), datetime.date(2024, 1, 1)]


def test_empty_array(spark):
    rows, bad = parse_listings(raw(spark, {"item": 1, "world": 2, "listings": []}))
    assert rows.count() == 0 and bad.count() == 0


@pytest.mark.parametrize(
    ("event", "reason"),
    [
        ("{broken", "bad json"),
        ('{"item": 1, "world": 2}', "no array"),
        ('{"world": 2, "listings": []}', "no item"),
        ('{"item": 1, "listings": []}', "no world"),
    ],
)
def test_quarantine(spark, event, reason):
    good = {"item": 1, "world": 2, "listings": [listing()]}
    bad_count = Observation()
    rows, bad = parse_listings(raw(spark, good, event), bad_count)
    assert rows.count() == 1
    assert [(r["value"], r["reason"]) for r in bad.collect()] == [(event, reason)]


@pytest.mark.parametrize("field", ["item", "quantity"])
def test_number_out_of_range(spark, field):
    event = {"item": 1, "world": 2, "listings": [listing()]}
    target = event if field == "item" else event["listings"][0]
    target[field] = 3_000_000_000
    rows, bad = parse_listings(raw(spark, event))
    assert rows.count() == 0 and bad.count() == 1


def test_element_without_key(spark):
    event = {"item": 1, "world": 2, "listings": [listing(listingID="absent"), None, listing()]}
    counted = Observation()
    rows, bad = parse_listings(raw(spark, event), counted)
    assert [r["listingID"] for r in rows_of(rows)] == ["a"]
    assert [r["reason"] for r in bad.collect()] == ["element without key"]
    assert counted.get["bad"] == 1


def test_route(spark):
    events = raw(spark, {"event": "listings/add"}, {"event": "sales/add"}, {"event": "sales/remove"}, {})
    branches = route(events)
    assert {k: v.count() for k, v in branches.items()} == {"raw.listings_add": 1, "raw.sales_add": 1}
    assert sorted(r["topic"] for r in with_topic(events).collect()) == ["raw.listings_add", "raw.sales_add"]


sales = st.fixed_dictionaries(
    {
        "hq": st.booleans(),
        "pricePerUnit": st.integers(0, 2**40),
        "quantity": st.integers(0, 999),
        "timestamp": st.integers(0, 2**32),
        "total": st.integers(0, 2**45),
        "buyerName": st.one_of(st.none(), st.text(st.characters(codec="utf-8"), max_size=8)),
        "onMannequin": st.booleans(),
    }
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.lists(sales, max_size=4)), max_size=5))
def test_flatten_undoes_nesting(spark, events):
    nested = [{"item": i, "world": w, "sales": s} for i, w, s in events]
    expected = sorted(
        (i, w, s["timestamp"], s["pricePerUnit"], s["buyerName"] or "", s["hq"])
        for i, w, each in events
        for s in each
    )
    rows, bad = parse_sales(raw(spark, *nested))
    got = sorted(
        (r["item"], r["world"], r["ts"], r["pricePerUnit"], r["buyerName"] or "", r["hq"])
        for r in rows.collect()
    )
    assert got == expected and bad.count() == 0

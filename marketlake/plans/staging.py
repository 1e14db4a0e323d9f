"""Staging: renames of the raw lake columns, nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Staged name -> raw name.
LISTING_COLUMNS = {
    "item_id": "item",
    "world_id": "world",
    "listed_date": "dt",
    "listing_id": "listingID",
    "price_per_unit": "pricePerUnit",
    "quantity": "quantity",
    "total": "total",
    "tax": "tax",
    "is_hq": "hq",
    "is_crafted": "isCrafted",
    "retainer_name": "retainerName",
    "last_review_time": "lastReviewTime",
}
SALE_COLUMNS = {
    "item_id": "item",
    "world_id": "world",
    "sale_date": "dt",
    "sale_timestamp": "ts",
    "price_per_unit": "pricePerUnit",
    "quantity": "quantity",
    "total": "total",
    "is_hq": "hq",
    "buyer_name": "buyerName",
    "is_mannequin": "onMannequin",
}


def stg_listings(raw: DataFrame) -> DataFrame:
    return raw.select(*[F.col(old).alias(new) for new, old in LISTING_COLUMNS.items()])


def stg_sales(raw: DataFrame) -> DataFrame:
    return raw.select(*[F.col(old).alias(new) for new, old in SALE_COLUMNS.items()])

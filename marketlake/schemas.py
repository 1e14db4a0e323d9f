"""Fixed schemas: events on the wire, lake tables, dimensions, documents."""

from __future__ import annotations

from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

INT, LONG, DOUBLE = T.IntegerType(), T.LongType(), T.DoubleType()
TEXT, FLAG, DATE = T.StringType(), T.BooleanType(), T.DateType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Fields of the wire format that the lake keeps; others are ignored when parsing.
LISTING_ELEMENT = _struct(
    lastReviewTime=LONG, pricePerUnit=LONG, quantity=INT, hq=FLAG, isCrafted=FLAG,
    retainerName=TEXT, listingID=TEXT, total=LONG, tax=LONG,
)
SALE_ELEMENT = _struct(
    hq=FLAG, pricePerUnit=LONG, quantity=INT, timestamp=LONG, total=LONG,
    buyerName=TEXT, onMannequin=FLAG,
)
LISTING_EVENT = _struct(
    item=INT, world=INT, listings=T.ArrayType(LISTING_ELEMENT), **{CORRUPT: TEXT}
)
SALE_EVENT = _struct(item=INT, world=INT, sales=T.ArrayType(SALE_ELEMENT), **{CORRUPT: TEXT})

RAW_LISTINGS = _struct(
    item=INT, lastReviewTime=LONG, pricePerUnit=LONG, quantity=INT, hq=FLAG, isCrafted=FLAG,
    retainerName=TEXT, listingID=TEXT, total=LONG, tax=LONG, world=INT, dt=DATE,
)
RAW_SALES = _struct(
    item=INT, hq=FLAG, pricePerUnit=LONG, quantity=INT, ts=LONG, total=LONG,
    buyerName=TEXT, onMannequin=FLAG, world=INT, dt=DATE,
)

ITEM_NAMES = _struct(item_id=INT, item_name=TEXT)
WORLD_NAMES = _struct(world_id=INT, world_name=TEXT)
WORLD_FILE = _struct(id=INT, name=TEXT)

SNAPSHOT_DOC = _struct(
    worldName=TEXT,
    items=T.MapType(
        TEXT,
        _struct(hasData=FLAG, listingsCount=INT, averagePrice=DOUBLE, regularSaleVelocity=DOUBLE),
    ),
)
QUOTE_DOC = _struct(
    listings=T.ArrayType(_struct(hq=FLAG, quantity=INT, pricePerUnit=LONG, total=LONG)),
    recentHistory=T.ArrayType(_struct(hq=FLAG, quantity=INT, pricePerUnit=LONG)),
)
# As text, a category may be a bare value or an object, and a level any value.
_ITEM_FIELDS = dict.fromkeys(
    ("ItemUICategory", "LevelItem", "LevelEquip", "CanBeHq", "Description"), TEXT
)
ITEM_DOC = _struct(fields=_struct(**_ITEM_FIELDS), **_ITEM_FIELDS)
REQUEST_LOG = _struct(
    ts=T.TimestampType(), request_id=TEXT, iteration=INT, input_tokens=LONG,
    output_tokens=LONG, tool_name=TEXT, duration_ms=DOUBLE, method=TEXT, route=TEXT, status=INT,
)

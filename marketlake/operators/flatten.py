"""Market events: tolerant parse, quarantine, flatten, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlake.functions.columns import epoch_date
from marketlake.schemas import CORRUPT, LISTING_EVENT, RAW_LISTINGS, RAW_SALES, SALE_EVENT

# The event names that are kept, and their topics.
CHANNEL_TOPICS = {
    "listings/add": "raw.listings_add",
    "sales/add": "raw.sales_add",
}

# Columns that place a row in the order of arrival, where the source has them.
ARRIVAL = ["_arrived", "_partition", "_offset", "_pos"]


def parse_listings(raw: DataFrame, bad: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of listing events in the string column ``value``."""
    return _parse(
        raw, LISTING_EVENT, "listings", RAW_LISTINGS, {}, "lastReviewTime", "listingID", bad
    )


def parse_sales(raw: DataFrame, bad: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of sale events in the string column ``value``."""
    renamed = {"ts": "timestamp"}
    return _parse(raw, SALE_EVENT, "sales", RAW_SALES, renamed, "timestamp", None, bad)


def _parse(
    raw: DataFrame,
    event: T.StructType,
    array: str,
    row: T.StructType,
    renamed: dict[str, str],
    epoch: str,
    key: str | None,
    bad: Observation | None,
) -> tuple[DataFrame, DataFrame]:
    """Parse and flatten in one stage without a shuffle.

    Item and world come from the envelope. In an element an absent number counts
    as 0, an absent flag as false, an absent text as NULL. Events that do not
    parse, or lack item, world or array, go to quarantine whole; elements that
    are null or have no record key stay out of the rows and take their event to
    quarantine too. ``bad`` counts the quarantined events while the rows are
    computed, so that a batch without any need not be parsed a second time.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json("value", event, options)

    def unusable(e: Column) -> Column:
        return e.isNull() if key is None else e.isNull() | e[key].isNull()

    def broken(e: Column) -> Column:
        return (
            F.when(e.isNull() | e[CORRUPT].isNotNull(), "bad json")
            .when(e["item"].isNull(), "no item")
            .when(e["world"].isNull(), "no world")
            .when(e[array].isNull(), "no array")
        )

    def reason(e: Column) -> Column:
        return F.coalesce(
            broken(e), F.when(F.exists(e[array], unusable), "element without key")
        )

    carried = [c for c in ARRIVAL if c in raw.columns]
    element = F.col("_element")
    fields = {f.name: f for f in event[array].dataType.elementType}

    def column(f: T.StructField) -> Column:
        if f.name in ("item", "world"):
            return F.col(f.name)
        if f.name == "dt":
            return epoch_date(F.coalesce(element[epoch], F.lit(0))).alias("dt")
        source = fields[renamed.get(f.name, f.name)]
        value = element[source.name]
        if isinstance(source.dataType, T.BooleanType):
            value = F.coalesce(value, F.lit(False))
        elif isinstance(source.dataType, (T.IntegerType, T.LongType)):
            value = F.coalesce(value, F.lit(0).cast(source.dataType))
        return value.alias(f.name)

    # No filter stands between the parse and the explode: it would be pushed
    # below the parse and parse the text again for every field it looks at.
    events = raw.select(*carried, parsed.alias("_event"))
    if bad is not None:
        events = events.observe(bad, F.count(reason(F.col("_event"))).alias("bad"))
    usable = F.when(broken(F.col("_event")).isNull(), F.col(f"_event.{array}"))
    rows = (
        events.select(*carried, "_event.item", "_event.world", usable.alias("_usable"))
        .select(*carried, "item", "world", F.posexplode_outer("_usable").alias("_pos", "_element"))
        .where(~unusable(element))
        .select(*[column(f) for f in row], *carried, "_pos")
    )
    # As a function of one array element, the parse is written out only once.
    why = F.transform(F.array(parsed), reason)[0]
    quarantine = raw.select("value", why.alias("reason")).where(F.col("reason").isNotNull())
    return rows, quarantine


def channel(raw: DataFrame) -> Column:
    return F.get_json_object("value", "$.event")


def route(raw: DataFrame, topics: dict[str, str] = CHANNEL_TOPICS) -> dict[str, DataFrame]:
    """One branch per topic; events of other channels are in none."""
    return {topic: raw.where(channel(raw) == name) for name, topic in topics.items()}


def with_topic(raw: DataFrame, topics: dict[str, str] = CHANNEL_TOPICS) -> DataFrame:
    """Each event with its topic in a column ``topic``; other channels dropped.

    The form a topic sink takes: one pass, however many topics there are.
    """
    name = channel(raw)
    topic = F.lit(None).cast("string")
    for event, target in topics.items():
        topic = F.when(name == event, target).otherwise(topic)
    return raw.withColumn("topic", topic).where(F.col("topic").isNotNull())

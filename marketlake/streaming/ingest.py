"""Event streams into lake tables.

Stateless: no watermark, nothing late is dropped. Which version of a key counts
is decided when the table is read or compacted, so the stream keeps no state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql.streaming import StreamingQuery

from marketlake.operators.flatten import parse_listings, parse_sales
from marketlake.sources.lake import COMPACT_EVERY, LakeTable

# Fixed value: how often a batch is committed.
COMMIT_INTERVAL = "60 seconds"


def start_ingest(
    raw: DataFrame,
    table: LakeTable,
    parse: Callable[[DataFrame, Observation], tuple[DataFrame, DataFrame]],
    checkpoint: str,
    interval: str | None = COMMIT_INTERVAL,
    compact_every: int | None = COMPACT_EVERY,
) -> StreamingQuery:
    """Start one stream. Without ``interval`` it takes what is there and ends.

    ``compact_every=None`` leaves compaction to a job of its own, which may run
    beside the stream.
    """
    table.create(raw.sparkSession)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # The adaptive planner sizes the files of the batch.
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        if not table.has(spark, batch_id):
            bad = Observation()
            rows, quarantine = parse(batch, bad)
            n = table.write(rows, batch_id)
            if bad.get.get("bad", 0):
                quarantine.write.mode("overwrite").parquet(
                    f"{table.quarantine}/batch_id={batch_id}"
                )
            table.commit(spark, batch_id, n)
        if compact_every and (batch_id + 1) % compact_every == 0:
            table.compact(spark)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        raw.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def start_market_ingest(
    listings: DataFrame,
    sales: DataFrame,
    listings_table: LakeTable,
    sales_table: LakeTable,
    checkpoint: str,
    interval: str | None = COMMIT_INTERVAL,
) -> list[StreamingQuery]:
    """Both streams in one session; wait with ``spark.streams.awaitAnyTermination``."""
    return [
        start_ingest(listings, listings_table, parse_listings, f"{checkpoint}/listings", interval),
        start_ingest(sales, sales_table, parse_sales, f"{checkpoint}/sales", interval),
    ]

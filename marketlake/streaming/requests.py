"""Live figures of requests: mean duration and rounds by the minute of closing, and open requests.

The stream holds every request in its state. Its first row opens it, its row with a status
closes it, and a timer removes it ``KEEP`` after its last row came. While it is there,
rows count in any order: each batch writes what it changes, the old contribution of a request
with weight -1 and the new one with +1, so that the sums of all batches are the sums over
requests, as a batch job has them. An open request whose timer runs out is taken to have
ended at its last row: it is active no longer, counts for no mean, and is counted as expired. A
row that comes later still opens a request of its own.

Rows are folded by request in each map task before they are dealt, so a request with very
many rows costs a row per Arrow batch. Requests share ``BUCKETS`` entries of state by hash, each
a table that a batch updates with column operations, as a call per request takes milliseconds.
The timer of a bucket is the earliest of its requests. A batch rewrites the buckets it touches.
The state has ``PARTITIONS`` partitions at most, however many the session's shuffles have.
Layout under the path of the figures:

    changes/batch_id=N     what batch N changed, until its sums are in
    means, active, expired the rollups of the changes (``streaming.usage``)
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marketlake.operators.usage import CHANGED, Rollup, active, expired, means
from marketlake.session import remove
from marketlake.streaming.usage import add_batch, open_rollup, read_rollup

#: How long after its last row a request is kept, in milliseconds of processing time.
KEEP = 24 * 3600 * 1000

#: Requests share entries of state by hash. Fixed for the life of a checkpoint.
BUCKETS = 256

#: Partitions of the state at most, fixed for the life of a checkpoint too. Each writes files in every
#: batch, whatever it holds, which takes longer than the update of its buckets.
PARTITIONS = 24

EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"

ADAPTIVE = "spark.sql.adaptive.enabled"

SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"

#: No time, no round: state has numbers only.
NONE = -1

_FOLDED = "request_id string, started long, closed long, last long, rounds int, duration double"
_STATE = "requests binary"
_CHANGES = "request_id string, weight int, started long, closed long, rounds int, duration double, expired boolean"

#: What is kept of a request, and when (processing time) its last row came; the state of a bucket is a table of these.
_HELD = pa.schema(
    {
        "request_id": pa.string(), "started": pa.int64(), "closed": pa.int64(), "last": pa.int64(),
        "rounds": pa.int32(), "duration": pa.float64(), "seen": pa.int64(),
    }
)
_VALUES = ["started", "closed", "last", "rounds", "duration"]

#: The row of a request in the table before.
PLACE = "_place"

ROLLUPS: dict[str, Rollup] = {"means": means(), "active": active(), "expired": expired()}


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per request of each Arrow batch."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        folded = table.group_by("request_id").aggregate(
            [("ts", "min"), ("closed", "max"), ("ts", "max"), ("rounds", "max"), ("duration", "max")]
        )
        columns = [folded[c] for c in ("request_id", "ts_min", "closed_max", "ts_max", "rounds_max", "duration_max")]
        duration = pc.fill_null(columns.pop(), math.nan)
        names = ["request_id", "started", "closed", "last", "rounds", "duration"]
        yield from pa.table([*columns, duration], names=names).combine_chunks().to_batches()


class Requests:
    """The update of one bucket of requests; ``keep`` in milliseconds."""

    def __init__(self, keep: int):
        self.keep = keep

    def __call__(self, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        held = _read(state.get[0]) if state.exists else _HELD.empty_table()
        came = _HELD.empty_table()
        for frame in [] if state.hasTimedOut else rows:
            new = pa.Table.from_pandas(frame.assign(seen=now)[_HELD.names], _HELD, preserve_index=False)
            came = _merge([came, new])
        place = pa.array(range(len(held)), pa.int64())
        both = _merge([held.append_column(PLACE, place), came.append_column(PLACE, pa.nulls(len(came), pa.int64()))])
        before = held.take(both[PLACE])
        # NULL, and so changed, for a request without a place.
        same = [_same(both[c], before[c]) for c in _VALUES]
        changed = pc.invert(pc.fill_null(reduce(pc.and_, same), False))
        # A request that rows came for in this batch has a new timer.
        due = pc.less(pc.add(both["seen"], self.keep), now)
        given_up = both.filter(pc.and_(due, pc.equal(both["closed"], NONE)))
        ended = given_up.set_column(given_up.schema.get_field_index("closed"), "closed", given_up["last"])
        changes = [
            _changes(before.filter(pc.and_(changed, pc.is_valid(both[PLACE]))), -1),
            _changes(both.filter(changed), 1),
            _changes(given_up, -1),
            _changes(ended, 1, expired=True),
        ]
        kept = both.filter(pc.invert(due)).select(_HELD.names)
        if len(kept):
            state.update((_written(kept),))
            state.setTimeoutDuration(max(1, pc.min(kept["seen"]).as_py() + self.keep - now))
        elif state.exists:
            state.remove()
        yield pa.concat_tables(changes).to_pandas()


def _merge(tables: list[pa.Table]) -> pa.Table:
    """One row per request of tables of alike columns."""
    table = pa.concat_tables(tables)
    wanted = [(c, "min" if c == "started" else "max") for c in table.column_names if c != "request_id"]
    merged = table.group_by("request_id").aggregate(wanted)
    columns = [merged["request_id"], *(merged[f"{c}_{how}"] for c, how in wanted)]
    return pa.table(columns, names=["request_id", *(c for c, _ in wanted)]).select(table.column_names)


def _same(a: pa.ChunkedArray, b: pa.ChunkedArray) -> pa.ChunkedArray:
    """Whether two values agree; no duration, NULL or NaN, agrees with none."""
    if not pa.types.is_floating(a.type):
        return pc.equal(a, b)
    a, b = pc.fill_null(a, math.nan), pc.fill_null(b, math.nan)
    return pc.or_(pc.equal(a, b), pc.and_(pc.is_nan(a), pc.is_nan(b)))


def _changes(requests: pa.Table, weight: int, expired: bool = False) -> pa.Table:
    n = len(requests)
    columns = {
        "request_id": requests["request_id"],
        "weight": pa.repeat(pa.scalar(weight, pa.int32()), n),
        **{c: requests[c] for c in ("started", "closed", "rounds", "duration")},
        "expired": pa.repeat(expired, n),
    }
    return pa.table(columns)


def _written(requests: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _HELD) as writer:
        writer.write_table(requests)
    return sink.getvalue().to_pybytes()


def _read(held: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(held))).read_all()


def request_changes(log: DataFrame, keep: int = KEEP) -> DataFrame:
    """What a stream of log rows changes in its requests, in the columns of ``usage.CHANGED``.

    Rows without request_id or time belong to no request.
    """
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = log.where(F.col("request_id").isNotNull() & F.col("ts").isNotNull()).select(
        "request_id",
        ts.alias("ts"),
        F.when(F.col("status").isNotNull(), ts).otherwise(NONE).alias("closed"),
        F.coalesce("iteration", F.lit(NONE)).cast("int").alias("rounds"),
        F.col("duration_ms").cast("double").alias("duration"),
    )
    changes = (
        rows.mapInArrow(_fold, _FOLDED)
        .withColumn("bucket", F.pmod(F.xxhash64("request_id"), F.lit(BUCKETS)).cast("int"))
        .groupBy("bucket")
        .applyInPandasWithState(
            Requests(keep), _CHANGES, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
        )
    )
    known = lambda c: F.when(F.col(c) != NONE, F.col(c))
    return changes.select(
        "request_id",
        "weight",
        F.timestamp_micros("started").alias("started"),
        F.timestamp_micros(known("closed")).alias("closed"),
        known("rounds").alias("rounds"),
        F.when(~F.isnan("duration"), F.col("duration")).alias("duration_ms"),
        "expired",
    )


def start_request_figures(
    log: DataFrame, path: str, checkpoint: str, interval: str | None = "60 seconds", keep: int = KEEP
) -> StreamingQuery:
    """Start the stream; without ``interval`` it takes what is there and ends, and timers run out
    in batches with rows only.

    The changes of a batch are written once and added to every rollup; a batch that is
    already in a rollup is left alone.
    """
    spark = log.sparkSession
    nothing = spark.createDataFrame([], CHANGED)
    for name, rollup in ROLLUPS.items():
        open_rollup(nothing, rollup, f"{path}/{name}")

    def write(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        staged = f"{path}/changes/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(staged)
        changes = own.read.schema(CHANGED).parquet(staged)
        # The adaptive planner sizes the sums; the stream's own plan, with state by partition, must not have it.
        own.conf.set(ADAPTIVE, "true")
        try:
            for name, rollup in ROLLUPS.items():
                add_batch(changes, rollup, f"{path}/{name}", batch_id)
        finally:
            own.conf.set(ADAPTIVE, "false")
        remove(own, staged)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    # With timers a batch without rows is always due, so a stream that is to end must not wait for one.
    own = {
        EMPTY_BATCHES: str(interval is not None).lower(),
        SHUFFLE_PARTITIONS: str(min(PARTITIONS, int(spark.conf.get(SHUFFLE_PARTITIONS)))),
    }
    before = {key: spark.conf.get(key) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        return (
            request_changes(log, keep)
            .writeStream.foreachBatch(write)
            .outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def read_request_figures(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The figures ``means``, ``active`` or ``expired`` of every window, over all batches so far."""
    return read_rollup(spark, f"{path}/{name}", ROLLUPS[name])

"""Usage rollups kept up to date by a stream.

Each micro-batch adds the sums of its own rows; a window is the total of its sums.
The stream keeps no state and has no watermark, so a row counts however late it
comes, and batch and stream agree. Layout of a rollup:

    sums/batch_id=N      sums of the windows that batch N touched
    commits/batch_id=N   that they are complete
    base/upto=N          sums of all batches up to N, in one table
    folds/upto=N         that it is complete
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketlake.operators.usage import Rollup
from marketlake.session import exists, remove
from marketlake.sources.lake import record, recorded


def start_rollup(
    log: DataFrame, rollup: Rollup, path: str, checkpoint: str, interval: str | None = "60 seconds"
) -> StreamingQuery:
    """Start the stream; without ``interval`` it takes what is there and ends.

    A batch that is already in is left alone.
    """
    open_rollup(log.sparkSession.createDataFrame([], log.schema), rollup, path)

    def write(batch: DataFrame, batch_id: int) -> None:
        add_batch(batch, rollup, path, batch_id)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        log.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def open_rollup(nothing: DataFrame, rollup: Rollup, path: str) -> None:
    """Write the empty base of a rollup unless it has one; ``nothing`` has the columns of its input."""
    if not _folds(nothing.sparkSession, path):
        _write_base(rollup.sums(nothing), path, -1)


def add_batch(batch: DataFrame, rollup: Rollup, path: str, batch_id: int) -> None:
    """Add the sums of one batch; a batch that is already in is left alone."""
    commit = f"{path}/commits/batch_id={batch_id}"
    if not recorded(batch.sparkSession, commit):
        rollup.sums(batch).write.mode("overwrite").parquet(f"{path}/sums/batch_id={batch_id}")
        record(batch.sparkSession, commit, "overwrite", batch=batch_id)


def read_rollup(spark: SparkSession, path: str, rollup: Rollup) -> DataFrame:
    """The figures of every window, over all batches so far."""
    return rollup.figures(_sums(spark, path, rollup))


def fold_rollup(spark: SparkSession, path: str, rollup: Rollup) -> int:
    """Add the new batches to the base, so that readers open few folders; returns the last batch.

    May run beside the stream, one at a time. What the fold before had replaced is
    removed: a reader has until the next fold to finish.
    """
    before = _last(spark, path)
    new = _batches(spark, path, before)
    if not new:
        return before
    _write_base(_sums(spark, path, rollup), path, max(new))
    for batch in _batches(spark, path, -1):
        if batch <= before:
            remove(spark, f"{path}/sums/batch_id={batch}")
            remove(spark, f"{path}/commits/batch_id={batch}")
    for upto in _folds(spark, path):
        if upto < before:
            remove(spark, f"{path}/folds/upto={upto}")
            remove(spark, f"{path}/base/upto={upto}")
    return max(new)


def _write_base(sums: DataFrame, path: str, upto: int) -> None:
    sums.write.mode("overwrite").parquet(f"{path}/base/upto={upto}")
    record(sums.sparkSession, f"{path}/folds/upto={upto}", "overwrite", last=upto)


def _sums(spark: SparkSession, path: str, rollup: Rollup) -> DataFrame:
    last = _last(spark, path)
    base = f"{path}/base/upto={last}"
    parts = [f"{path}/sums/batch_id={b}" for b in sorted(_batches(spark, path, last))]
    schema = spark.read.parquet(base).schema
    added = [F.sum(c).alias(c) for c in schema.names if c not in rollup.keys]
    return spark.read.schema(schema).parquet(base, *parts).groupBy(*rollup.keys).agg(*added)


def _folds(spark: SparkSession, path: str) -> list[int]:
    return _numbers(spark, f"{path}/folds", "last")


def _last(spark: SparkSession, path: str) -> int:
    return max(_folds(spark, path))


def _batches(spark: SparkSession, path: str, after: int) -> list[int]:
    return [b for b in _numbers(spark, f"{path}/commits", "batch") if b > after]


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the records of a folder; few, as folds remove old ones."""
    if not exists(spark, path):
        return []
    return [r[0] for r in spark.read.schema(f"{name} BIGINT").json(f"{path}/*").collect()]

"""Upsertable lake tables on plain Parquet.

A table keeps an append log and a compacted base:

    appends/batch_id=N              rows of micro-batch N, as they came
    log/batch_id=N/world=W/dt=D     the same of earlier tables, which are still read
    commits/batch_id=N              that N is complete, and its number of rows
    base/version=V/world=W/dt=D     one row per key, as of compaction V
    parts/snapshot=V                which version holds each (world, dt)
    snapshots/version=V             the last batch that compaction V includes
    quarantine/batch_id=N           events of batch N that were set aside

Nothing that may be read is overwritten. A batch or compaction counts from the
moment its small record is written, so a lost driver or executor leaves no
half-written state behind: a repeated batch replaces its own folder, a repeated
compaction writes a new one.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlake.operators.flatten import ARRIVAL
from marketlake.operators.latest import latest, merge_latest
from marketlake.schemas import RAW_LISTINGS, RAW_SALES
from marketlake.session import exists, materialize

# Fixed value: batches between two compactions.
COMPACT_EVERY = 5

# Up to this many keys, at some 100 bytes each, are sent to every executor.
BROADCAST_ROWS = 1_000_000

# Of log and base, each written once and read many times.
CODEC = "zstd"

PARTITION = ["world", "dt"]

# Order of arrival; no two rows of a table agree on all of it.
ORDER = ["batch_id", *ARRIVAL]


@dataclass(frozen=True)
class LakeTable:
    """``precombine`` decides between versions of a key, then the order of arrival.

    ``key_fixes_partition`` says that all versions of a key share (world, dt), so
    that a compaction need not look for older versions elsewhere.
    """

    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    precombine: str
    key_fixes_partition: bool = False

    @property
    def stored(self) -> T.StructType:
        fields = T.StructType(list(self.schema.fields))
        return (
            fields.add("batch_id", T.LongType())
            .add("_arrived", T.TimestampType())
            .add("_partition", T.IntegerType())
            .add("_offset", T.LongType())
            .add("_pos", T.IntegerType())
        )

    @property
    def quarantine(self) -> str:
        return f"{self.path}/quarantine"

    @property
    def appends(self) -> str:
        return f"{self.path}/appends"

    @property
    def order(self) -> list[str]:
        return [c for c in [self.precombine, *ORDER] if c not in self.keys]

    def create(self, spark: SparkSession) -> LakeTable:
        """Write the empty table unless it is there."""
        record(spark, f"{self.path}/commits/batch_id=-1", "ignore", rows=0)
        record(spark, f"{self.path}/snapshots/version=0", "ignore", last_batch=-1)
        return self

    # Writing

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Add one micro-batch; a batch that is already in is left alone."""
        if not self.has(rows.sparkSession, batch_id):
            self.commit(rows.sparkSession, batch_id, self.write(rows, batch_id))

    def has(self, spark: SparkSession, batch_id: int) -> bool:
        """Whether a batch is committed; looks at its own record, not at all of them."""
        return recorded(spark, f"{self.path}/commits/batch_id={batch_id}")

    def write(self, rows: DataFrame, batch_id: int) -> int:
        """Write the rows of a batch, unseen by readers until it is committed."""
        counted = Observation()
        # No shuffle: a reader takes a batch as a whole, and the compaction lays it out by (world, dt).
        (
            _with_arrival(rows)
            .observe(counted, F.count(F.lit(1)).alias("rows"))
            .write.mode("overwrite")
            .parquet(f"{self.appends}/batch_id={batch_id}", compression=CODEC)
        )
        return counted.get.get("rows", 0)

    def commit(self, spark: SparkSession, batch_id: int, rows: int) -> None:
        record(spark, f"{self.path}/commits/batch_id={batch_id}", "overwrite", rows=rows)

    def compact(self, spark: SparkSession) -> int:
        """Fold the new batches into the base; returns the snapshot version.

        Only the (world, dt) that hold a new row, or an old version of one, are
        rewritten. The others keep their files. Every attempt writes to a version
        of its own, so compactions may overlap: each leaves a whole snapshot.
        """
        version, last_batch = self._snapshot(spark)
        batches = self._new_batches(spark, last_batch)
        if not batches:
            return version
        new = time.time_ns()
        target = f"{self.path}/base/version={new}"
        log = self._log(spark, batches)
        merged, kept = self._latest(log), None
        if version > 0:
            touched = self._touched(spark, version, log)
            kept = self._parts(spark, version).join(touched, PARTITION, "left_anti")
            merged = self._merged(self._base(spark, version, touched), log, batches)
        # Rebalancing gives a (world, dt) one file instead of one per task, and
        # splits the (world, dt) that is too large for one.
        merged.hint("rebalance", *PARTITION).write.partitionBy(*PARTITION).parquet(target, compression=CODEC)
        written = spark.read.schema(self.stored).parquet(target).select(*PARTITION).distinct()
        parts = written.withColumn("version", F.lit(new).cast("bigint"))
        parts = parts if kept is None else kept.unionByName(parts)
        parts.write.parquet(f"{self.path}/parts/snapshot={new}")
        record(spark, f"{self.path}/snapshots/version={new}", "error", last_batch=max(batches))
        return new

    def _touched(self, spark: SparkSession, version: int, fresh: DataFrame) -> DataFrame:
        """The (world, dt) that hold a new row or an older version of one.

        Older versions are looked for only where no new row is, as all else is rewritten
        anyway. ``fresh`` is a written table, so the planner knows its bytes and
        broadcasts the keys only below its threshold.
        """
        touched = materialize(fresh.select(*PARTITION).distinct(), "touched")
        if self.key_fixes_partition:
            return touched
        others = self._parts(spark, version).join(touched, PARTITION, "left_anti").select(*PARTITION)
        if others.isEmpty():
            return touched
        keys = fresh.select(*self.keys).distinct()
        older = self._base(spark, version, others).join(keys, list(self.keys), "left_semi")
        return materialize(touched.unionByName(older.select(*PARTITION).distinct()), "touched")

    # Reading

    def read(self, spark: SparkSession) -> DataFrame:
        """The latest version of every key."""
        version, last_batch = self._snapshot(spark)
        batches = self._new_batches(spark, last_batch)
        log = self._log(spark, batches)
        if version == 0:
            rows = self._latest(log)
        elif not batches:
            rows = self._base(spark, version)
        else:
            rows = self._merged(self._base(spark, version), log, batches)
        return rows.select(*self.schema.names)

    def read_raw(self, spark: SparkSession) -> DataFrame:
        """Every version ever written, without deduplication."""
        commits = self._commits(spark)
        if commits.where(F.col("batch_id") >= 0).isEmpty():
            return spark.createDataFrame([], self.schema)
        roots = [r for r in (self.appends, f"{self.path}/log") if exists(spark, r)]
        log = reduce(DataFrame.unionByName, [self._rows(spark, r, [r]) for r in roots])
        return log.join(commits, "batch_id", "left_semi").select(*self.schema.names)

    def read_quarantine(self, spark: SparkSession) -> DataFrame:
        """(value, reason, batch_id) of the events that ingest set aside."""
        schema = "value STRING, reason STRING, batch_id BIGINT"
        if exists(spark, self.quarantine):
            return spark.read.schema(schema).parquet(self.quarantine)
        return spark.createDataFrame([], schema)

    def _merged(self, base: DataFrame, log: DataFrame, batches: dict[int, int]) -> DataFrame:
        """The latest of base rows and of the batches after them."""
        n = sum(batches.values())
        return merge_latest(base, log, self.keys, self.order, n <= BROADCAST_ROWS, total=True, fresh_rows=n)

    def _latest(self, rows: DataFrame) -> DataFrame:
        return latest(rows, self.keys, self.order, total=True)

    def _commits(self, spark: SparkSession) -> DataFrame:
        schema = "rows BIGINT, batch_id BIGINT"
        return spark.read.schema(schema).json(f"{self.path}/commits")

    def _new_batches(self, spark: SparkSession, after: int) -> dict[int, int]:
        commits = self._commits(spark).where(F.col("batch_id") > after)
        return {r["batch_id"]: r["rows"] for r in commits.collect()}

    def _snapshot(self, spark: SparkSession) -> tuple[int, int]:
        record = (
            spark.read.schema("last_batch BIGINT, version BIGINT")
            .json(f"{self.path}/snapshots")
            .agg(F.max(F.struct("last_batch", "version")).alias("s"))
            .first()["s"]
        )
        return record["version"], record["last_batch"]

    def _log(self, spark: SparkSession, batches: dict[int, int]) -> DataFrame:
        if not batches:
            return spark.createDataFrame([], self.stored)
        paths: dict[str, list[str]] = {}
        for folder in (f"batch_id={b}" for b in sorted(batches)):
            root = self.appends if exists(spark, f"{self.appends}/{folder}") else f"{self.path}/log"
            paths.setdefault(root, []).append(f"{root}/{folder}")
        return reduce(DataFrame.unionByName, [self._rows(spark, *found) for found in paths.items()])

    def _rows(self, spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
        reader = spark.read.schema(self.stored).option("basePath", root)
        return reader.parquet(*paths).select(*self.stored.names)

    def _parts(self, spark: SparkSession, version: int) -> DataFrame:
        schema = "version BIGINT, world INT, dt DATE, snapshot BIGINT"
        parts = spark.read.schema(schema).parquet(f"{self.path}/parts")
        return parts.where(F.col("snapshot") == version).select(*PARTITION, "version")

    def _base(
        self, spark: SparkSession, version: int, only: DataFrame | None = None
    ) -> DataFrame:
        """Current base rows, of all or of the given (world, dt).

        One join, on partition columns alone, with a side that is filtered: this
        lets Spark skip the files of other partitions and versions.
        """
        schema = T.StructType(list(self.stored.fields)).add("version", T.LongType())
        base = spark.read.schema(schema).parquet(f"{self.path}/base")
        parts = self._parts(spark, version)
        if only is not None:
            parts = parts.join(only, PARTITION, "left_semi")
        return base.join(parts, [*PARTITION, "version"], "left_semi").select(*self.stored.names)


def listings_table(path: str) -> LakeTable:
    return LakeTable(path, RAW_LISTINGS, ("listingID",), "lastReviewTime")


def sales_table(path: str) -> LakeTable:
    return LakeTable(path, RAW_SALES, ("item", "world", "ts"), "ts", key_fixes_partition=True)


def read_partitioned(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A raw table laid out as ``path/world=W/dt=D/*.parquet``; filters on both prune."""
    return spark.read.schema(schema).parquet(path)


def write_partitioned(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a raw table in that layout."""
    rows.hint("rebalance", *PARTITION).write.mode(mode).partitionBy(*PARTITION).parquet(path)


# The columns and rows of a look into the lake.
PEEK_COLUMNS = ("item", "world", "pricePerUnit", "quantity", "hq", "retainerName")
PEEK_ROWS = 20


def peek(raw: DataFrame, rows: int = PEEK_ROWS) -> DataFrame:
    """The first rows in the order of their columns, so that the result is defined."""
    return raw.select(*PEEK_COLUMNS).orderBy(*PEEK_COLUMNS).limit(rows)


def _with_arrival(rows: DataFrame) -> DataFrame:
    """Rows with all columns of arrival; rows without an offset get one."""
    if "_offset" not in rows.columns:
        rows = rows.withColumn("_offset", F.monotonically_increasing_id())
    defaults = {"_arrived": "timestamp", "_partition": "int", "_pos": "int"}
    for name, kind in defaults.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows


def recorded(spark: SparkSession, path: str) -> bool:
    """Whether a record was written in full; a folder that a lost driver left empty does not count."""
    return exists(spark, path) and not spark.read.schema("_any STRING").json(path).isEmpty()


def record(spark: SparkSession, path: str, mode: str, **values: int) -> None:
    schema = ", ".join(f"{name} BIGINT" for name in values)
    row = spark.createDataFrame([tuple(values.values())], schema)
    row.coalesce(1).write.mode(mode).json(path)

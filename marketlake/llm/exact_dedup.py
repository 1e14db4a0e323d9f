"""Exact duplicates by a streaming job with disk-backed keyed state.

The stream reads one small row per document: identifier, digest and length of the
normalised text, and the locator of the content (file and row). Its state has one
entry per digest, kept by RocksDB on the executors' disks and in the checkpoint,
and never expires: digest, identifier that stays, its content locator, size of the
group. A restarted stream goes on from its checkpoint, and documents that come later
meet all earlier ones. On a hit the full bytes are read by locator and compared;
rows whose bytes differ in spite of equal digests form groups of their own.

Everything is expressed with DataFrame functions. A digest that many rows share is
counted before the shuffle, and joins on it are left to adaptive skew handling.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm.common import located, located_freely, lower_ascii, materialize, work_path

STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Many small stores: no disk space in advance.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # All stores of an executor share this much memory; the rest of the state is on disk.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "150",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
}
#: Keys for which a stream that begins plans a store, at most as many as shuffle partitions.
STORE = 100_000
KEYS = "doc_id long, digest binary, n_bytes long, file string, row long"
ENTRIES = (
    "digest binary, n_bytes long, stays struct<doc_id: long, file: string, row: long>, group_size long"
)


def normalised(column: str = "text") -> Column:
    """NULL counts as empty; A-Z in lower case."""
    return F.coalesce(lower_ascii(F.col(column)), F.lit(""))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def keys(rows: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """What the state takes in, from rows with a place."""
    text = normalised()
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        digest(text).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.col("_file").alias("file"),
        F.col("_row").alias("row"),
    )


def take_in(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    """Take the key files of ``folder`` that are new since the last run into the state.

    Each batch writes the entries it changed to a folder of its own below ``out``;
    a batch that is run again replaces that folder.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = spark.read.schema(KEYS).parquet(folder).count()
    # A checkpoint keeps the number of stores that it began with.
    stores = min(partitions, max(16, -(-n // STORE)))
    settings = STATE | {"spark.sql.shuffle.partitions": str(stores)}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        (
            spark.readStream.schema(KEYS)
            .parquet(folder)
            .groupBy("digest", "n_bytes")
            .agg(
                F.max(F.struct("doc_id", "file", "row")).alias("stays"),
                F.count("*").alias("group_size"),
            )
            .writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(
                lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
            )
            .start()
            .awaitTermination()
        )
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def entries(spark: SparkSession, out: str) -> DataFrame:
    """The state as the batches wrote it. Identifiers and counts only grow, so the
    largest of each is the latest."""
    return (
        spark.read.schema(f"{ENTRIES}, batch long")
        .parquet(out)
        .groupBy("digest", "n_bytes")
        .agg(F.max("stays").alias("stays"), F.max("group_size").alias("group_size"))
    )


def _is(place: str) -> Column:
    return (F.col("file") == F.col(f"{place}.file")) & (F.col("row") == F.col(f"{place}.row"))


def _decided(rows: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """For each place of ``rows`` (doc_id, text, _file, _row) the row that stays and its group's size."""
    spark = rows.sparkSession
    root = work_path(spark, "dedup-stream")
    keys(rows, digest).write.parquet(f"{root}/keys")
    known = spark.read.schema(KEYS).parquet(f"{root}/keys")
    take_in(spark, f"{root}/keys", f"{root}/entries", f"{root}/checkpoint")
    # Written, so that both sides of each join are plain shuffles, whose hot digests split.
    state = materialize(entries(spark, f"{root}/entries"), "dedup-state")
    groups = known.join(state, ["digest", "n_bytes"])

    # Hits: the full bytes of a row against those of the row that stays.
    hits = materialize(
        rows.select(
            F.col("_file").alias("file"),
            F.col("_row").alias("row"),
            F.col("doc_id").cast("long").alias("doc_id"),
            normalised().alias("text"),
        )
        .withColumn("digest", digest(F.col("text")))
        .withColumn("n_bytes", F.octet_length("text").cast("long"))
        .join(
            state.where("group_size > 1").select("digest", "n_bytes", "stays"), ["digest", "n_bytes"]
        ),
        "dedup-hits",
    )
    first = hits.where(_is("stays")).select("digest", "n_bytes", F.col("text").alias("stays_text"))
    odd = materialize(
        hits.join(first, ["digest", "n_bytes"])
        .where("text <> stays_text")
        .select("digest", "n_bytes", "doc_id", "file", "row", "text"),
        "dedup-odd",
    )
    if odd.isEmpty():
        return groups
    by_text = odd.groupBy("digest", "n_bytes", "text").agg(
        F.max(F.struct("doc_id", "file", "row")).alias("own_stays"), F.count("*").alias("own_size")
    )
    own = odd.join(by_text, ["digest", "n_bytes", "text"]).select("file", "row", "own_stays", "own_size")
    less = odd.groupBy("digest", "n_bytes").agg(F.count("*").alias("less"))
    return (
        groups.join(less, ["digest", "n_bytes"], "left")
        .join(own, ["file", "row"], "left")
        .withColumn(
            "group_size",
            F.coalesce("own_size", F.col("group_size") - F.coalesce("less", F.lit(0))),
        )
        .withColumn("stays", F.coalesce("own_stays", "stays"))
        .drop("less", "own_size", "own_stays")
    )


def groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Of equal texts the row with the largest doc_id stays; of repeated rows with that
    doc_id, the last by place. NULL counts as an empty text, and empty texts are one
    group. A NULL doc_id ranks below all others; keep_id is NULL if a group has no
    other. Other columns, whatever their names, are not read. An empty table gives
    an empty result. ``digest`` maps a text to binary; the result holds for any.
    """
    return _decided(located(docs.select("doc_id", "text")), digest).select(
        "doc_id",
        F.col("stays.doc_id").alias("keep_id"),
        "group_size",
        _is("stays").alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    rows, file, row = located_freely(docs)
    decided = _decided(
        rows.select("doc_id", "text", F.col(file).alias("_file"), F.col(row).alias("_row")), digest
    )
    gone = decided.where(~_is("stays")).select(F.col("file").alias(file), F.col("row").alias(row))
    return rows.join(gone, [file, row], "left_anti").select(*[f"`{c}`" for c in docs.columns])

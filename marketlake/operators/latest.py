"""Latest version per record key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LISTING_KEY = ["listing_id"]
SALE_KEY = ["item_id", "world_id", "sale_timestamp"]


def latest(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], total: bool = False
) -> DataFrame:
    """One row per key: the greatest by ``order_by``, then by all other columns.

    The further columns make the order total, so the result does not depend on
    which task saw a row first. With ``total`` the order already is, and a reader
    of a few columns then scans and shuffles only those.

    ``row_number() = 1`` keeps one row per key in each map task before the
    shuffle, so a hot key never moves as a whole. Keys must not be NULL; ingest
    sends such rows to quarantine.
    """
    rest = [] if total else [c for c in df.columns if c not in keys and c not in order_by]
    window = Window.partitionBy(*keys).orderBy(
        *[F.col(c).desc_nulls_last() for c in [*order_by, *rest]]
    )
    return (
        df.withColumn("_version", F.row_number().over(window))
        .where(F.col("_version") == 1)
        .drop("_version")
    )


def merge_latest(
    base: DataFrame,
    fresh: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    fresh_is_small: bool,
    total: bool = False,
    fresh_rows: int | None = None,
) -> DataFrame:
    """``latest(base ∪ fresh)`` for a base that already has one row per key.

    With few fresh rows only the base rows they may replace are compared; the
    rest of the base passes through unshuffled. The caller knows the number of
    fresh rows from the commit records, so the broadcast is of a checked size.
    With ``fresh_rows`` the same holds for more rows: a bitmap of the hashes of their
    keys is broadcast, of 64 MB at most, which passes no base row that they may replace.
    """
    if fresh_is_small:
        touched = F.broadcast(fresh.select(*keys).distinct())
        hit = base.join(touched, list(keys), "left_semi")
        kept = base.join(touched, list(keys), "left_anti")
    elif fresh_rows is not None and fresh_rows * 2 <= MOST_KEY_BITS:
        marked = _marked(base, fresh, keys, key_bits(fresh_rows))
        hit, kept = (marked.where(F.col("_hit") == wanted).drop("_hit") for wanted in (1, 0))
    else:
        return latest(base.unionByName(fresh), keys, order_by, total)
    return kept.unionByName(latest(hit.unionByName(fresh), keys, order_by, total))


# Of the bitmap of all keys, of one row of ``bitmap_construct_agg``, and of one row of the broadcast.
MOST_KEY_BITS = 2**29
BUCKET_BITS = 2**15
CHUNK_BITS = 2**11


def key_bits(rows: int) -> int:
    """Bits for the keys of so many rows: 8 to 16 each, as far as the bitmap goes."""
    return min(MOST_KEY_BITS, max(BUCKET_BITS, 1 << (8 * rows - 1).bit_length()))


def _marked(base: DataFrame, fresh: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """``base`` with ``_hit``: 1 for each row whose key is in ``fresh`` and a few more, else 0."""
    bit = F.pmod(F.xxhash64(*keys), F.lit(bits))
    per_bucket = BUCKET_BITS // CHUNK_BITS
    chunk, size = F.explode(F.sequence(F.lit(0), F.lit(per_bucket - 1))), CHUNK_BITS // 8
    # Buckets count from 1 for the numbers from 1.
    bitmap = (
        fresh.select((bit + 1).alias("_bit"))
        .groupBy((F.bitmap_bucket_number("_bit") - 1).alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits"))
        .select("_bucket", "_bits", chunk.alias("_part"))
        .select(
            (F.col("_bucket") * per_bucket + F.col("_part")).alias("_chunk"),
            F.substring("_bits", F.col("_part") * size + 1, F.lit(size)).alias("_bits"),
        )
    )
    place = F.col("_bit") % CHUNK_BITS
    byte = F.substring("_bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))
    hit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (place % 8).cast("int"))
    return (
        base.withColumn("_bit", bit)
        .withColumn("_chunk", F.shiftright("_bit", CHUNK_BITS.bit_length() - 1))
        .join(F.broadcast(bitmap), "_chunk", "left")
        .withColumn("_hit", F.coalesce(hit.cast("int"), F.lit(0)))
        .select(*base.columns, "_hit")
    )

"""Joins to the dimensions.

No side carries a broadcast hint. A dimension is broadcast when its size is under
``spark.sql.autoBroadcastJoinThreshold`` (by file size, or by the size AQE has
measured); beyond that the join shuffles and AQE splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.functions.columns import same_text


def with_names(facts: DataFrame, items: DataFrame, worlds: DataFrame) -> DataFrame:
    """Left-join item and world names; unknown and NULL ids get NULL names."""
    return facts.join(items.select("item_id", "item_name"), "item_id", "left").join(
        worlds.select("world_id", "world_name"), "world_id", "left"
    )


def center_worlds(centers: DataFrame, name: str) -> DataFrame:
    """The worlds of one data center, its name compared without case."""
    return centers.where(same_text(F.col("data_center"), name))


def center_line(centers: DataFrame, name: str) -> DataFrame:
    """One line of text: the worlds of a center, or the known centers if it is unknown.

    For the fixed map of centers: a center there holds a handful of worlds.
    """
    by_center = centers.groupBy("data_center").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("position", "world_name"))),
                lambda w: w["world_name"],
            ),
            ", ",
        ).alias("worlds"),
        F.min("center_position").alias("center_position"),
    )
    hit = same_text(F.col("data_center"), name)
    return by_center.agg(
        F.coalesce(
            F.max(F.when(hit, F.concat("data_center", F.lit(": "), "worlds"))),
            F.concat(
                F.lit(f"Unknown data center '{name}'. Available: "),
                F.array_join(
                    F.transform(
                        F.array_sort(F.collect_list(F.struct("center_position", "data_center"))),
                        lambda c: c["data_center"],
                    ),
                    ", ",
                ),
            ),
        ).alias("line")
    )


def in_center(mart: DataFrame, centers: DataFrame, name: str) -> DataFrame:
    """Rows of a mart whose world belongs to the center."""
    return mart.join(center_worlds(centers, name).select("world_name"), "world_name", "left_semi")

"""Reading tables, safe inputs, and connected components, shared by the operators."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlake.session import materialize, work_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A worker outlives its task: what a task has freed goes back to the system.
WORKERS = {
    "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_MMAP_THRESHOLD_": "1048576",
    "ARROW_DEFAULT_MEMORY_POOL": "system", "OPENBLAS_NUM_THREADS": "1",
}
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from the driver's path, and give back memory.

    Enough where workers share the driver's files; elsewhere ship the package
    with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment
    known.update(WORKERS)
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known.get("PYTHONPATH")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def located(docs: DataFrame, file: str = "_file", row: str = "_row") -> DataFrame:
    """``docs`` with its place in two columns; rows that come from no file are written first.

    The names of the two must be free. A column ``_metadata`` of ``docs`` does not matter.
    """
    for rows in (docs, None):
        rows = materialize(docs, "content") if rows is None else rows
        try:
            place = rows.metadataColumn("_metadata")
            return rows.select("*", place["file_path"].alias(file), place["row_index"].alias(row))
        except AnalysisException:
            pass
    raise AnalysisException("written rows have no place")


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``docs`` has no such column in any case."""
    taken = {column.lower() for column in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def located_freely(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``located`` rows with all columns of ``docs``, and the names of the columns of the place."""
    file, row = free_name(docs, "_file"), free_name(docs, "_row")
    return located(docs, file, row), file, row


def numbered(
    rows: DataFrame,
    *order: Column | str,
    name: str = "rank",
    through: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """``rows`` with their place in a total order, from 0.

    ``through`` may add columns to the sorted rows of a task, keeping each of them.

    Rows are dealt by ranges of ``order`` and written sorted; a table with a row per
    partition says how many rows stand before each. No task sees more than a range.
    """
    placed = materialize(
        through(
            rows.repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .withColumn(name, F.monotonically_increasing_id())
        ),
        "numbered",
    )
    part = F.shiftright(name, 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = sizes.select(
        F.col("_part").alias("_of"),
        (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"),
    )
    inside = F.col(name).bitwiseAND((1 << 33) - 1)
    return (
        placed.join(F.broadcast(before), part == F.col("_of"))  # a row per partition
        .withColumn(name, F.col("_before") + inside)
        .drop("_of", "_before")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node
    it is linked with, directly or not.

    Large-star and small-star steps, alternating until nothing changes: edges
    move to smaller neighbours, so the number of rounds grows with the logarithm
    of the largest component, and no step gathers a component in one place.
    Every round is written to the shared folder. NULL ends are ignored.
    """
    links = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        links = materialize(_small_star(_large_star(links)), "components")
        seen = links.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if seen == before:
            break
        before = seen
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select("b", "b").distinct()
    )


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    links = links.distinct()
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", "m")).distinct()


__all__ = [
    "DOCUMENT", "components", "free_name", "importable", "located", "located_freely", "lower_ascii", "materialize",
    "numbered", "table", "work_path",
]

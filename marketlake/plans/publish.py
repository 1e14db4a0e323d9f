"""Marts as catalog tables that other sessions read.

A run's marts become tables ``<mart>__<run>`` over the run's own folder. Readers learn the
current run from one view, ``current_run``, which is replaced in one statement after
all tables are there; so a reader sees all marts of a run or all of the run before. The
plain views ``<mart>`` serve free-form SQL. Nothing is moved or overwritten: a reader
that has opened a run goes on reading it until ``retire`` drops it.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

CURRENT = "current_run"


def new_run() -> int:
    """A number for a run, greater than those of earlier runs."""
    return time.time_ns()


def publish(spark: SparkSession, database: str, run: int, paths: dict[str, str]) -> None:
    """Make the stored tables of a run the current ones; ``paths`` gives the Parquet folder of each."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, path in paths.items():
        spark.catalog.createTable(_table(database, name, run), path=path, source="parquet")
    # The one statement that counts; the views after it only follow.
    spark.sql(
        f"CREATE OR REPLACE VIEW `{database}`.`{CURRENT}` AS "
        f"SELECT CAST({run} AS BIGINT) AS run, '{','.join(paths)}' AS tables"
    )
    for name in paths:
        spark.sql(f"CREATE OR REPLACE VIEW `{database}`.`{name}` AS SELECT * FROM {_table(database, name, run)}")


def published(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """The tables of the current run, all of the same run; empty before the first."""
    current = _current(spark, database)
    if current is None:
        return {}
    return {name: spark.table(_table(database, name, current["run"])) for name in current["tables"].split(",")}


def retire(spark: SparkSession, database: str, keep: int = 2) -> list[int]:
    """Drop the tables of all but the newest ``keep`` runs; the current one always stays. Returns
    the runs dropped, whose folders may then be removed."""
    current = _current(spark, database)
    if current is None:
        return []
    tables: dict[int, list[str]] = {}
    for table in spark.catalog.listTables(database):
        name, found, run = table.name.rpartition("__")
        if found and run.isdigit():
            tables.setdefault(int(run), []).append(name)
    old = sorted(run for run in tables if run < current["run"])
    gone = old[: max(len(old) - max(keep - 1, 0), 0)]
    for run in gone:
        for name in tables[run]:
            spark.sql(f"DROP TABLE {_table(database, name, run)}")
    return gone


def _table(database: str, name: str, run: int) -> str:
    return f"`{database}`.`{name}__{run}`"


def _current(spark: SparkSession, database: str):
    try:
        return spark.table(f"`{database}`.`{CURRENT}`").first()
    except AnalysisException:
        return None

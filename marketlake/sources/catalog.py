"""Tables of the session: lookup by name and the column catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def table_columns(
    spark: SparkSession, database: str | None = None, include_views: bool = False
) -> DataFrame:
    """(table_name, column_name, data_type, position) of the base tables.

    Reads the catalog only, whose size does not depend on the data.
    """
    rows = []
    for table in spark.catalog.listTables(database):
        if not include_views and table.tableType in ("VIEW", "TEMPORARY"):
            continue
        name = table.name if table.isTemporary else ".".join([*(table.namespace or []), table.name])
        for position, column in enumerate(spark.catalog.listColumns(name), 1):
            rows.append((table.name, column.name, column.dataType, position))
    schema = "table_name string, column_name string, data_type string, position int"
    return spark.createDataFrame(rows, schema).orderBy("table_name", "position")

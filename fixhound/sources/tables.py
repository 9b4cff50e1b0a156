"""Reading tables with declared schemas, and the report sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_tables(
    spark: SparkSession, folder: str, schemas: dict[str, StructType], suffix: str = ""
) -> dict[str, DataFrame]:
    """Parquet tables `<folder>/<name><suffix>` by name."""
    return {
        name: spark.read.schema(schema).parquet(f"{folder}/{name}{suffix}")
        for name, schema in schemas.items()
    }


def jdbc_options(
    url: str, name: str, split: dict[str, str] | None = None, **options: str
) -> dict[str, str]:
    """Reader options of one table; a split needs its column, both bounds and a number of parts."""
    needed = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"}
    if split and set(split) != needed:
        raise ValueError(f"a split of {name} needs {', '.join(sorted(needed))}")
    return {"url": url, "dbtable": name, **options, **{k: str(v) for k, v in (split or {}).items()}}


def read_jdbc_tables(
    spark: SparkSession,
    url: str,
    names: list[str],
    partitions: dict[str, dict[str, str]] | None = None,
    **options: str,
) -> dict[str, DataFrame]:
    """The same tables from a live database.

    `partitions` gives a table's partitionColumn, lowerBound, upperBound and numPartitions,
    without which one task reads it. Filters and columns are pushed to the database. The
    driver jar must be on the class path.
    """
    split = partitions or {}
    return {
        name: spark.read.format("jdbc").options(**jdbc_options(url, name, split.get(name), **options)).load()
        for name in names
    }


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, table in tables.items():
        table.createOrReplaceTempView(name)


def read_sheet(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet"
) -> DataFrame:
    """A sheet as a table. Row numbers are a column: files have no order to count by."""
    reader = spark.read.schema(schema).option("header", "true")
    if fmt == "csv":
        reader = reader.option("multiLine", "true").option("escape", '"')
    return reader.format(fmt).load(path)


def write_report(report: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the report: a header, no index."""
    writer = report.write.mode("overwrite").option("header", "true")
    if fmt == "csv":
        writer = writer.option("escape", '"')
    writer.format(fmt).save(path)

"""Table scans: Parquet with projection, CSV with a schema, inline values, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDERS = "order_id string, customer_id string, amount double"
CUSTOMERS = "customer_id string, customer_name string, segment string"


def scan_parquet(
    spark: SparkSession, path: str, columns: list[str | Column], where: Column | None = None
) -> DataFrame:
    """A scan whose filter and column list reach the Parquet reader."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns)


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header line; types come from the schema and bad rows fail the read."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)
        .csv(path)
    )


def inline_values(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A small relation written in the query text."""

    def literal(value) -> str:
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "NULL" if value is None else str(value)

    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS inline_rows({', '.join(columns)})")


def in_full_order(df: DataFrame) -> DataFrame:
    """All rows ordered by all columns, nulls last."""
    return df.orderBy(*[F.asc_nulls_last(c) for c in df.columns])


def table_inventory(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per readable table with its ordered column names."""
    spark = next(iter(frames.values())).sparkSession
    rows = [(name, list(df.columns)) for name, df in frames.items()]
    return spark.createDataFrame(rows, "table_name string, columns array<string>")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def missing_tables(wanted: DataFrame, inventory: DataFrame) -> DataFrame:
    return wanted.join(inventory.select("table_name"), "table_name", "left_anti")

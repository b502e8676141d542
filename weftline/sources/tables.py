"""Parquet tables of a folder as views, and rows of small tables page by page."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def register(spark: SparkSession, folder: str, names: list[str] = TABLES) -> dict[str, DataFrame]:
    """Reads the tables and names them for SQL."""
    out = {}
    for name in names:
        out[name] = spark.read.parquet(f"{folder}/{name}.parquet")
        out[name].createOrReplaceTempView(name)
    return out


def pages(df: DataFrame, rows: int = 64) -> Iterator[list[Row]]:
    """Rows in pages, fetched partition by partition; stopping early fetches no more."""
    page: list[Row] = []
    for row in df.toLocalIterator():
        page.append(row)
        if len(page) == rows:
            yield page
            page = []
    if page:
        yield page

"""Ordinals, pages and chunks over a total order, without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; below the warehouse only where it names none (on a cluster a local one is an error)."""
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    named = given or context.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if named.startswith(("file:", "/")) and not given and not context.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a shared folder")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder of the session, so that later jobs see the same partitions."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def with_ordinals(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """Adds consecutive numbers in the given order: ranges are numbered side by side, then shifted.

    ``order`` should have no ties; rows that tie get numbers in any order.
    """
    # rows are sorted within their range before they are written; an id of Spark's then holds range and place, so no second shuffle is needed
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__ordinal_at", F.monotonically_increasing_id())
    ranged = settled(ranged)
    part, own = F.shiftright("__ordinal_at", 33), F.col("__ordinal_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    shifts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    numbered = ranged.join(F.broadcast(shifts), part == F.col("__part"))
    return numbered.withColumn(name, (own + F.col("__shift") + start).cast("long")).drop("__part", "__ordinal_at", "__shift")


def after_key(df: DataFrame, key: str, last: object | None, n: int) -> DataFrame:
    """Keyset page: the next ``n`` rows behind a key."""
    rest = df if last is None else df.filter(F.col(key) > F.lit(last))
    return rest.orderBy(key).limit(n)


def chunks(df: DataFrame, ordinal: str, size: int) -> DataFrame:
    """Adds the number of the contiguous chunk that a row with a 0-based ordinal belongs to."""
    return df.withColumn("chunk", F.floor(F.col(ordinal) / size).cast("long"))


def check_contiguous(df: DataFrame, ordinal: str) -> None:
    """Ordinals must be 0, 1, 2, ... each once."""
    n, low, high, distinct = df.agg(F.count("*"), F.min(ordinal), F.max(ordinal), F.count_distinct(ordinal)).first()
    if n and (low != 0 or high != n - 1 or distinct != n):
        raise ValueError(f"ordinals are not contiguous: {n} rows, {distinct} ordinals from {low} to {high}")


def bounded_page(df: DataFrame, ordinal: str, size: Column, max_rows: int, max_bytes: int, after: int = -1) -> DataFrame:
    """The next rows by ordinal while they are at most ``max_rows`` and their sizes sum to at most ``max_bytes``.

    A first row that alone is too large is an error.  At most ``max_rows`` rows are ever ordered.
    """
    page = df.filter(F.col(ordinal) > after).withColumn("__size", size).orderBy(ordinal).limit(max_rows)
    upto = Window.orderBy(ordinal).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a page of rows
    summed = page.withColumn("__sum", F.sum("__size").over(upto)).withColumn("__n", F.row_number().over(Window.orderBy(ordinal)))
    fits = F.assert_true(~((F.col("__n") == 1) & (F.col("__size") > max_bytes)), "the first row of a page is too large").isNull()
    return summed.filter(fits & (F.col("__sum") <= max_bytes)).drop("__size", "__sum", "__n")

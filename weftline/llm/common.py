"""Pieces that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: between them lie space, and tab to carriage return.
WORD_RE = r"[^\x20\x09-\x0D]+"

#: A side may be broadcast if it measures at most this much.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a warehouse folder only where it names none (on a cluster a local one is an error)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        if named.startswith(("file:", "/")) and not context.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a shared folder")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there: lineage ends, lost executors don't matter."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a side whose measured bytes stay under the bound; beyond it Spark shuffles both sides.

    ``df`` is read to be measured: it should be materialised or cheap.
    """
    size = F.lit(16)
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(column), F.lit(0))
        elif kind.startswith("array<struct"):
            size = size + 64 * F.greatest(F.size(column), F.lit(0))
        elif kind == "array<string>":
            size = size + F.coalesce(F.aggregate(column, F.lit(0), lambda n, x: n + 16 + F.coalesce(F.octet_length(x), F.lit(0))), F.lit(0))
        elif kind.startswith("array"):
            size = size + 16 * F.greatest(F.size(column), F.lit(0))
        else:
            size = size + 8
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def n_partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session: the unit in which keyed work is dealt out."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once.

    The optimizer may copy a projected column into every place that uses it, lambdas included; a lambda's own
    variable it leaves alone.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bounded_sample(rows: DataFrame, class_col: str, id_col: str, per_class: int, salt: str) -> DataFrame:
    """About ``per_class`` rows of each class, chosen by a hash of the id: the same rows each time.

    Classes are collected with their counts; there must be few of them.
    """
    counts = rows.groupBy(class_col).count().collect()
    place = F.xxhash64(F.lit(salt), F.col(id_col).cast("string")).bitwiseAND(F.lit((1 << 40) - 1))
    chosen = F.lit(False)
    for value, n in counts:
        share = min(1.0, per_class / n)
        chosen = chosen | (F.col(class_col).eqNullSafe(F.lit(value)) & (place < int(share * (1 << 40))))
    return rows.filter(chosen)


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of an id written as text, modulo n; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(n))


#: Bits of the map of ``possible``: 2 MB, whatever is joined.
_MAP_BITS = 24


def possible(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, name: str = "__maybe") -> DataFrame:
    """Adds ``name``: false where no row of ``wanted`` has the key (a 64-bit hash), true where one has, and for some others.

    The map behind it has a fixed size, so a scan can tell most rows that a join cannot need before they are shuffled.
    """
    place = wanted.select(F.pmod(wanted_key, F.lit(1 << _MAP_BITS)).alias("p"))
    marks = place.groupBy(F.shiftright("p", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("__marks"))
    # at most 2^18 rows: a proven bound
    met = rows.withColumn("__p", F.pmod(key, F.lit(1 << _MAP_BITS))).join(F.broadcast(marks), F.shiftright("__p", 6) == F.col("__word"), "left")
    return met.withColumn(name, F.coalesce(F.expr("shiftrightunsigned(__marks, int(__p & 63)) & 1 = 1"), F.lit(False))).drop("__p", "__word", "__marks")

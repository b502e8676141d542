"""Running values over keys of any length: rows are dealt out by ranges of key and order, and a range carries on where the one before ended.

A window by key puts all rows of a key into one task.  Here rows are range-partitioned by key and order, so a hot key
lies in many ranges; each range runs by itself, and what the earlier ranges of its key end with is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ordinals import settled

LAST, SUM, COUNT, LARGEST, SMALLEST = "last", "sum", "count", "max", "min"


def _over(kind: str, value: Column) -> Column:
    return F.last(value, ignorenulls=True) if kind == LAST else {SUM: F.sum, COUNT: F.count, LARGEST: F.max, SMALLEST: F.min}[kind](value)


def _joined(kind: str, carried: Column, own: Column) -> Column:
    if kind == LAST:
        return F.coalesce(own, carried)
    if kind in (SUM, COUNT):
        both = F.coalesce(carried, F.lit(0)) + F.coalesce(own, F.lit(0))
        return F.when(carried.isNotNull() | own.isNotNull(), both) if kind == SUM else both
    return (F.greatest if kind == LARGEST else F.least)(carried, own)


def with_running(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, tuple[str, Column]], current: bool = True) -> DataFrame:
    """Adds, for each name, a running value of its key in ``order``: the last that is not null, sum, count, max or min.

    ``current`` says whether a row counts for itself.  ``order`` should have no ties within a key.  The rows are
    written once to the checkpoint folder: select what is needed before.  Null keys are one key.
    """
    bad = sorted({kind for kind, _ in values.values()} - {LAST, SUM, COUNT, LARGEST, SMALLEST})
    if bad:
        raise ValueError(f"unknown kinds: {', '.join(bad)}")
    named = df.withColumns({f"__v_{n}": v for n, (_, v) in values.items()})
    ranged = settled(named.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    own = ranged.withColumns({f"__o_{n}": _over(kind, F.col(f"__v_{n}")).over(inside) for n, (kind, _) in values.items()})

    # what each range ends with: a row for each key in it, most of them in one range only
    def at_end(n: str, kind: str) -> Column:
        value = F.col(f"__v_{n}")
        return (F.max_by(value, F.when(value.isNotNull(), F.col("__at"))) if kind == LAST else _over(kind, value)).alias(f"__e_{n}")

    edge = Window.partitionBy("__part", *keys).orderBy(*order)
    counted = ranged.withColumn("__at", F.row_number().over(edge)) if any(k == LAST for k, _ in values.values()) else ranged
    ends = counted.groupBy("__part", *keys).agg(*[at_end(n, kind) for n, (kind, _) in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("__part", *keys, F.count("*").over(earlier).alias("__n"), *[(F.sum if kind == COUNT else lambda v, k=kind: _over(k, v))(F.col(f"__e_{n}")).over(earlier).alias(f"__c_{n}") for n, (kind, _) in values.items()])
    carried = carried.filter("__n > 0").drop("__n").withColumnsRenamed({k: f"__k_{k}" for k in keys}).withColumnRenamed("__part", "__p")
    on = own["__part"] == carried["__p"]
    for k in keys:
        on = on & own[k].eqNullSafe(carried[f"__k_{k}"])
    met = own.join(carried, on, "left")
    return met.withColumns({n: _joined(kind, F.col(f"__c_{n}"), F.col(f"__o_{n}")) for n, (kind, _) in values.items()}).select(*df.columns, *values)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str, columns: list[str], strict: bool = False) -> DataFrame:
    """Each row of ``left`` with ``columns`` of the last row of ``right`` of its keys before it (or, unless ``strict``, at it).

    Both sides are laid into one order and passed once; nothing is joined, and a hot key is split.  Right rows that tie
    should not differ.  A row without one before it gets nulls; null keys meet null keys.
    """
    clash = sorted(set(columns) & set(left.columns))
    if clash:
        raise ValueError(f"{', '.join(clash)} are columns of both sides")
    value = F.struct(*[F.col(c) for c in columns])
    a = left.select(*keys, F.col(left_order).alias("__at"), F.lit(0 if strict else 2).alias("__side"), F.struct(*left.columns).alias("__row"))
    b = right.select(*keys, F.col(right_order).alias("__at"), F.lit(1).alias("__side"), value.alias("__value"))
    both = a.unionByName(b, allowMissingColumns=True)
    found = with_running(both, keys, [F.col("__at"), F.col("__side")], {"__last": (LAST, F.col("__value"))})
    return found.filter("__side <> 1").select("__row.*", *[F.col("__last")[c].alias(c) for c in columns])

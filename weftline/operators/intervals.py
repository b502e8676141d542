"""Joins of overlapping intervals by bins, in place of comparing all pairs.

Every interval has a level: the power of two, times a base width, that holds its length.  Two intervals meet on the coarser of
their levels, whose bins are ``1 / FINE`` of its width, so each is written to the bins of its own level and of the coarser levels
that occur on either side: at most ``FINE + 1`` rows a level, however long any interval is.  On a level only pairs are compared of which
one has that level for its own; shorter ones never meet there.  The levels that occur are measured first; there are at most ``LEVELS``.

Where many intervals overlap the pairs are many by nature: bins with more than ``PAIRS`` of them are measured and dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.ordinals import settled

#: Levels above the base width; the last one holds everything longer.
LEVELS = 40
#: Bins to the width of a level.
FINE = 8
#: Pairs of one bin that a task compares; of a bin with more, the larger side is dealt out and the other goes with each part.
PAIRS = 4_000_000


def _level(length: Column, base: float) -> Column:
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(length, F.lit(base)) / base)), F.lit(0)), F.lit(LEVELS)).cast("int")


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[Column, Column], right_span: tuple[Column, Column], keys: list[str] = (), base: float | None = None) -> DataFrame:
    """Pairs of rows whose spans (from, to; both ends belong to them) overlap, and whose ``keys`` are equal.

    Ends are numbers; a point is a span from itself to itself.  A span with a null end, or whose end lies before its start, meets
    nothing.  ``base`` is the width of the narrowest bins; by default the median length of the spans of the side that has any.
    Columns of the two sides must have different names, but for the keys.
    """
    clash = sorted((set(left.columns) & set(right.columns)) - set(keys))
    if clash:
        raise ValueError(f"{', '.join(clash)} are columns of both sides")

    def spans(df: DataFrame, span: tuple[Column, Column], side: str) -> DataFrame:
        ends = df.withColumns({f"__{side}_from": span[0].cast("double"), f"__{side}_to": span[1].cast("double")})
        return ends.filter(F.col(f"__{side}_from") <= F.col(f"__{side}_to"))

    a, b = spans(left, left_span, "a"), spans(right, right_span, "b")
    if base is None:
        lengths = [df.agg(F.percentile_approx(F.col(f"__{s}_to") - F.col(f"__{s}_from"), 0.5)).first()[0] for df, s in ((a, "a"), (b, "b"))]
        base = max([x for x in lengths if x] or [1.0])
    a, b = (df.withColumn(f"__{s}_own", _level(F.col(f"__{s}_to") - F.col(f"__{s}_from"), base)) for df, s in ((a, "a"), (b, "b")))
    levels = sorted({r[0] for df, s in ((a, "a"), (b, "b")) for r in df.select(f"__{s}_own").distinct().collect()})  # at most LEVELS + 1 rows

    def width(level: Column) -> Column:
        return F.lit(base / FINE) * F.pow(F.lit(2.0), level)

    def binned(df: DataFrame, s: str) -> DataFrame:
        coarser = F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= F.col(f"__{s}_own"))
        rows = df.withColumn(f"__{s}_level", F.explode(coarser))
        first, last = (F.floor(F.col(f"__{s}_{end}") / width(F.col(f"__{s}_level"))).cast("long") for end in ("from", "to"))
        rows = rows.withColumn(f"__{s}_bin", F.explode(F.sequence(first, last)))
        # turn 0: the left one is on its own level; turn 1: the right one is, and the left one is shorter
        own = F.col(f"__{s}_own") == F.col(f"__{s}_level")
        turns = F.when(own, F.array(F.lit(0))).otherwise(F.array(F.lit(1))) if s == "a" else F.when(own, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return rows.withColumn(f"__{s}_turn", F.explode(turns))

    renamed = {k: f"__b_{k}" for k in keys}
    x, y = binned(a, "a"), binned(b.withColumnsRenamed(renamed), "b")
    of_a, of_b = ["__a_level", "__a_bin", "__a_turn", *keys], ["__b_level", "__b_bin", "__b_turn", *renamed.values()]
    names = [f"__g{i}" for i in range(len(of_a))]

    def counted(df: DataFrame, on: list[str], n: str) -> DataFrame:
        return df.groupBy(*[F.col(f"`{c}`").alias(g) for c, g in zip(on, names)]).agg(F.count("*").alias(n))

    pairs = counted(x, of_a, "__na").join(counted(y, of_b, "__nb"), names)
    crowded = pairs.filter(F.col("__na").cast("double") * F.col("__nb") > PAIRS)
    crowded = settled(crowded.withColumn("__shares", F.ceil(F.col("__na").cast("double") * F.col("__nb") / PAIRS).cast("int")))

    def dealt(df: DataFrame, s: str, on: list[str]) -> DataFrame:
        """Adds the share: of a crowded bin the larger side's rows have one each, the other's have all."""
        larger = F.col("__na") >= F.col("__nb") if s == "a" else F.col("__na") < F.col("__nb")
        place = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]), F.col("__shares")).cast("int")
        share = F.when(F.col("__shares").isNull(), F.array(F.lit(0))).when(larger, F.array(place)).otherwise(F.sequence(F.lit(0), F.col("__shares") - 1))
        same = [F.col(f"`{c}`") == F.col(g) for c, g in zip(on, names)]
        return df.join(crowded, same, "left").withColumn(f"__{s}_share", F.explode(share)).drop(*names, "__na", "__nb", "__shares")

    if not crowded.isEmpty():
        x, y = dealt(x, "a", of_a), dealt(y, "b", of_b)
        of_a, of_b = [*of_a, "__a_share"], [*of_b, "__b_share"]
    start = F.greatest("__a_from", "__b_from")
    on = F.lit(True)
    for p, q in zip(of_a, of_b):
        on = on & (F.col(f"`{p}`") == F.col(f"`{q}`"))
    # a pair is kept in the bin where the overlap begins
    on = on & (F.col("__a_from") <= F.col("__b_to")) & (F.col("__b_from") <= F.col("__a_to"))
    on = on & (F.col("__a_bin") == F.floor(start / width(F.col("__a_level"))).cast("long"))
    met = x.join(y, on)
    return met.select(*left.columns, *[c for c in right.columns if c not in keys])

"""Mixing sources to target weights by Pareto order sampling (operator 8), with DataFrame functions only.

A budget of words is shared among sources by weight.  A source whose share passes ``max_repeats`` times its
own size stops there, and the excess goes to the others by weight.  Each document first gets the whole copies
that its expected number of copies c makes certain; the fraction pi of c left over is its inclusion
probability.  With a keyed uniform u, documents are ranked by the odds u / (1 - u) over pi / (1 - pi) (Rosen's
Pareto order sampling), and the lowest ranks are taken until the source's remaining words are used up, at the
boundary that comes nearest.  With ``weight_col`` the expected copies of the documents of a source are in proportion to
their weights, up to the cap.

The boundary is found without ordering a source in one task: a histogram of ranks finds the bucket in which
the words run out, and only the rows of that bucket are ordered.

Defined cases: a null text has size 0 and takes 0 words; a null source is a source of its own, last in order;
rows that share a doc_id share their rank and are taken or left together; an empty table gives no rows; a
source of size 0 has target 0.  Columns of other names pass through ``with_copies``; the result columns replace
columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, maybe_broadcast, word_count

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MAX_REPEATS = 2.0
BUCKETS = 4096
SEED = "mix-1"


def _uniform(id_col: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the seed and the id alone: 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, total_share: float = TOTAL_SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """One row per source: source, source_size, target.  ``sizes`` has source and source_size.

    A source is capped if the common rate (words per unit of weight) reaches its cap over its weight.  In
    ascending order of that ratio the capped sources are a prefix, so running sums give the rate directly.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)) + 1)
    weighed = sizes.withColumn("__w", weight).withColumn("__cap", F.lit(max_repeats) * F.col("source_size"))
    weighed = weighed.withColumn("__at", F.col("__cap") / F.col("__w"))
    everything = Window.partitionBy()
    before = Window.orderBy("__at", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.lit(total_share) * F.sum("source_size").over(everything)
    left = budget - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    weight_left = F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    rated = weighed.withColumn("__rate", left / weight_left)
    free = F.col("__rate") < F.col("__at")
    rated = rated.withColumn("__common", F.max(F.when(free, F.struct(-F.col("__at"), F.col("__rate")))).over(everything)["__rate"])
    target = F.when(F.col("__common").isNull() | (F.col("__at") <= F.col("__common")), F.col("__cap")).otherwise(F.col("__w") * F.col("__common"))
    return rated.select("source", "source_size", target.alias("target"))


def _scaled(targets: DataFrame, by_weight: DataFrame, max_repeats: float) -> DataFrame:
    """Adds __scale and __most: a document of weight w has min(__most, __scale * w) copies, which use up the target.

    In descending order of weight the documents at the cap are a prefix, so running sums give the scale directly.  Rows
    are one per source and weight.
    """
    held = by_weight.withColumnRenamed("source", "__of")
    joined = targets.join(held, F.col("__source").eqNullSafe(F.col("__of")), "left").withColumn("__used", F.col("__size") * F.col("__weight"))
    heavier = Window.partitionBy("__source").orderBy(F.col("__weight").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("__source").orderBy(F.col("__weight").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("target") - F.lit(float(max_repeats)) * F.coalesce(F.sum("__size").over(heavier), F.lit(0))
    scale = F.try_divide(left, F.sum("__used").over(rest))
    tried = joined.withColumn("__try", scale)
    fits = F.col("__try") * F.col("__weight") <= max_repeats
    found = F.max_by(F.col("__try"), F.when(fits & (F.col("__weight") > 0), F.col("__weight")))
    every = F.try_divide(F.lit(float(max_repeats)), F.min(F.when(F.col("__weight") > 0, F.col("__weight"))))
    grouped = tried.groupBy("__source", "source_size", "target").agg(F.coalesce(found, every).alias("__scale"))
    return grouped.withColumn("__most", F.lit(float(max_repeats)))


def _rank(u: Column, pi: Column) -> Column:
    """Pareto rank q mapped to q / (1 + q), which lies in (0, 1) and keeps the order."""
    q = (u * (1 - pi)) / ((1 - u) * pi)
    return q / (1 + q)


def _placed(docs: DataFrame, per_source: DataFrame) -> DataFrame:
    """Adds whole copies, the fraction left over and the rank."""
    same = docs["source"].eqNullSafe(per_source["__source"])
    copies = F.least(F.coalesce(F.col("__scale") * F.col("__weight"), F.lit(0.0)), F.col("__most"))
    joined = docs.join(per_source, same, "left").drop("__source").withColumn("__c", copies)
    joined = joined.withColumn("__whole", F.floor("__c")).withColumn("__pi", F.col("__c") - F.col("__whole"))
    rank = F.when(F.col("__pi") > 0, _rank(F.col("__u"), F.col("__pi"))).otherwise(F.lit(1.0))
    return joined.withColumn("__v", rank)


def plan(sized: DataFrame, seed: str = SEED, weights: tuple = WEIGHTS, total_share: float = TOTAL_SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """One row per source with its target and the last rank that is taken.

    ``sized`` has doc_id, source, size and __weight, and is read several times: it should be materialised.
    """
    by_weight = cut(sized.groupBy("source", "__weight").agg(F.sum("size").alias("__size")))
    totals = by_weight.groupBy("source").agg(F.sum("__size").alias("source_size"))
    targets = source_targets(totals, weights, total_share, max_repeats).withColumnRenamed("source", "__source")
    targets = cut(_scaled(targets, by_weight, max_repeats))
    placed = _placed(sized.withColumn("__u", _uniform(F.col("doc_id"), seed)), maybe_broadcast(targets))
    placed = placed.filter((F.col("__pi") > 0) & (F.col("size") > 0)).withColumn("__bucket", F.floor(F.col("__v") * BUCKETS))
    certain = _placed(sized.withColumn("__u", F.lit(0.5)), maybe_broadcast(targets)).groupBy("source").agg(F.sum(F.col("__whole") * F.col("size")).alias("__sure"))
    certain = certain.withColumnRenamed("source", "__of")
    wanted = targets.join(certain, F.col("__source").eqNullSafe(F.col("__of")), "left").drop("__of")
    wanted = cut(wanted.withColumn("__rest", F.col("target") - F.coalesce("__sure", F.lit(0))))

    # the bucket in which the words run out
    filled = placed.groupBy("source", "__bucket").agg(F.sum("size").alias("__words"))
    upto = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.withColumn("__before", F.coalesce(F.sum("__words").over(upto), F.lit(0)))
    rest = maybe_broadcast(wanted.select("__source", "__rest"))
    reached = filled.join(rest, F.col("source").eqNullSafe(F.col("__source"))).filter(F.col("__before") < F.col("__rest"))
    edge = reached.groupBy("__source").agg(F.max_by(F.struct("__bucket", "__before", "__rest"), "__bucket").alias("__edge"))
    edge = cut(edge.select("__source", "__edge.*").withColumnRenamed("__bucket", "__edge_bucket"))

    # rows of that bucket alone are ordered
    on = placed["source"].eqNullSafe(edge["__source"]) & (placed["__bucket"] == edge["__edge_bucket"])
    inside = placed.select("source", "doc_id", "size", "__v", "__bucket").join(maybe_broadcast(edge), on)
    order = Window.partitionBy("__source").orderBy("__v", "doc_id")
    ahead = F.coalesce(F.sum("size").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)) - F.sum("size").over(Window.partitionBy("__source", "__v", "doc_id"))
    own = F.sum("size").over(Window.partitionBy("__source", "__v", "doc_id"))
    taken = inside.withColumn("__mid", F.col("__before") + ahead + own / 2.0).filter(F.col("__mid") < F.col("__rest"))
    last = taken.groupBy("__source").agg(F.max(F.struct("__v", "doc_id")).alias("__last")).withColumnRenamed("__source", "__of")
    # a source whose edge bucket gives no row still takes all earlier buckets
    out = wanted.join(edge.select(F.col("__source").alias("__e"), "__edge_bucket"), F.col("__source").eqNullSafe(F.col("__e")), "left").drop("__e")
    out = out.join(last, F.col("__source").eqNullSafe(F.col("__of")), "left").drop("__of")
    return cut(out.select("__source", "source_size", "target", "__scale", "__most", "__edge_bucket", F.col("__last.__v").alias("__last_v"), F.col("__last.doc_id").alias("__last_id")))


def _take(docs: DataFrame, planned: DataFrame, seed: str) -> DataFrame:
    """Adds source_size, target and copies; needs source, doc_id and __weight."""
    placed = _placed(docs.withColumn("__u", _uniform(F.col("doc_id"), seed)), maybe_broadcast(planned))
    placed = placed.withColumn("__bucket", F.floor(F.col("__v") * BUCKETS))
    at_edge = F.struct(F.col("__v"), F.col("doc_id").alias("id")) <= F.struct(F.col("__last_v"), F.col("__last_id").alias("id"))
    extra = (F.col("__pi") > 0) & ((F.col("__bucket") < F.col("__edge_bucket")) | ((F.col("__bucket") == F.col("__edge_bucket")) & F.col("__last_v").isNotNull() & at_edge))
    copies = F.col("__whole") + F.when(extra, F.lit(1)).otherwise(F.lit(0))
    return placed.withColumn("copies", copies.cast("long")).drop("__u", "__c", "__whole", "__pi", "__v", "__bucket", "__edge_bucket", "__last_v", "__last_id", "__weight", "__scale", "__most")


def mix(docs: DataFrame, text_col: str = "text", weight_col: str | None = None, seed: str = SEED, weights: tuple = WEIGHTS, total_share: float = TOTAL_SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words)."""
    sized = cut(_sized(docs, text_col, weight_col))
    out = _take(sized, plan(sized, seed, weights, total_share, max_repeats), seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def with_copies(docs: DataFrame, text_col: str = "text", weight_col: str | None = None, seed: str = SEED, weights: tuple = WEIGHTS, total_share: float = TOTAL_SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, all their columns, and ``copies``; the texts are not shuffled."""
    sized = cut(_sized(docs, text_col, weight_col))
    planned = plan(sized, seed, weights, total_share, max_repeats)
    weight = F.lit(1.0) if weight_col is None else F.col(weight_col).cast("double")
    kept = [c for c in docs.columns if c.lower() not in ("copies", "target", "source_size")]
    out = _take(docs.select(*kept).withColumn("__weight", weight), planned, seed)
    return out.filter(F.col("copies") > 0).select(*kept, "target", "copies")


def _sized(docs: DataFrame, text_col: str, weight_col: str | None) -> DataFrame:
    weight = F.lit(1.0) if weight_col is None else F.col(weight_col).cast("double")
    return docs.select("doc_id", "source", word_count(F.col(text_col)).alias("size"), weight.alias("__weight"))

"""Files that carry changes: bundles as JSON lines, notifications as event-stream text, snapshots as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.changes import KEY

ROW = "struct<schema:string,table:string,key:string,op:string,row_version:bigint,payload:string>"
BUNDLE = f"bundle_seq bigint, source_id string, source_bundle_id bigint, rows array<{ROW}>"
#: Longest line and event of a notification stream.
MAX_EVENT = 1 << 20


def bundle_rows(bundles: DataFrame) -> DataFrame:
    """Bundles to one row per change."""
    flat = bundles.select("bundle_seq", F.posexplode("rows").alias("row_ordinal", "r"))
    return flat.select("bundle_seq", F.col("row_ordinal").cast("long").alias("row_ordinal"), F.col("r.schema").alias(KEY[0]), F.col("r.table").alias(KEY[1]), F.col("r.key").alias(KEY[2]), "r.op", "r.row_version", "r.payload")


def read_bundles(spark: SparkSession, path: str, after_seq: int = 0) -> DataFrame:
    """Changes of the bundles behind a sequence number; a file that does not fit the schema is an error."""
    found = spark.read.schema(BUNDLE).option("mode", "FAILFAST").json(path)
    return bundle_rows(found.filter(F.col("bundle_seq") > after_seq))


def stream_bundles(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of new files."""
    return bundle_rows(spark.readStream.schema(BUNDLE).json(path))


def write_bundles(changes: DataFrame, path: str) -> None:
    """Changes (bundle_seq, row_ordinal, KEY, op, row_version, payload) as JSON lines, one bundle a line."""
    row = F.struct(F.col(KEY[0]).alias("schema"), F.col(KEY[1]).alias("table"), F.col(KEY[2]).alias("key"), "op", "row_version", "payload")
    rows = F.sort_array(F.collect_list(F.struct(F.col("row_ordinal").alias("o"), row.alias("r"))))
    bundles = changes.groupBy("bundle_seq").agg(F.transform(rows, lambda x: x["r"]).alias("rows"))
    bundles.select("bundle_seq", F.lit("spark").alias("source_id"), F.col("bundle_seq").alias("source_bundle_id"), "rows").write.mode("append").json(path)


def notifications(texts: DataFrame, column: str = "value") -> DataFrame:
    """Event-stream texts to (event, data): fields by line, events by empty line, comments left out.

    An event longer than MAX_EVENT is an error.
    """
    plain = F.regexp_replace(F.col(column), r"\r\n?", "\n")
    # an event counts once the empty line behind it has come
    complete = F.regexp_extract(plain, r"(?s)\A(.*)\n\n", 1)
    block = texts.select(F.explode(F.split(complete, r"\n\n+")).alias("block")).filter("block <> ''")
    lines = F.split("block", "\n")
    value = lambda name: F.transform(F.filter(lines, lambda x: x.startswith(f"{name}:")), lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
    out = block.select(F.coalesce(F.element_at(F.when(F.size(value("event")) > 0, value("event")), -1), F.lit("message")).alias("event"), F.array_join(value("data"), "\n").alias("data"), F.octet_length("block").alias("__n"))
    fits = F.assert_true(F.col("__n") <= MAX_EVENT, "an event is too long").isNull()
    return out.filter(fits & (F.col("data") != "")).drop("__n")

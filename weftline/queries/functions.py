"""Scalar functions and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import codec, compat
from weftline.queries.registry import query


@query(
    "f1_text",
    "SELECT c_custkey, CAST(length(c_name) AS integer) AS n_chars, CAST(strlen(c_name) AS integer) AS n_bytes, lower(c_mktsegment) AS segment, lower(hex(c_name)) AS hexed, printf('%04d-%02d-01', c_custkey % 10000, c_nationkey) AS made, 'x' || CAST(NULL AS varchar) AS nothing, coalesce(nullif(c_mktsegment, 'BUILDING'), '-') AS other FROM customer",
)
def f1_text(spark, t):
    name = F.col("c_name")
    return t["customer"].select(
        "c_custkey",
        F.length(name).alias("n_chars"),
        compat.byte_length(name).alias("n_bytes"),
        F.lower("c_mktsegment").alias("segment"),
        compat.hex_lower(name).alias("hexed"),
        F.format_string("%04d-%02d-01", F.col("c_custkey") % 10000, F.col("c_nationkey")).alias("made"),
        F.concat(F.lit("x"), F.lit(None).cast("string")).alias("nothing"),
        F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("-")).alias("other"),
    )


@query(
    "f2_numbers",
    "SELECT o_orderkey, o_orderkey // 7 AS whole, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey / (o_orderkey % 5) END AS quotient, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey // (o_orderkey % 3) END AS cut, o_orderkey % 2 <> 0 AS odd, CAST(o_orderkey % 2 <> 0 AS integer) AS odd_flag FROM orders",
)
def f2_numbers(spark, t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t["orders"].select(
        "o_orderkey",
        compat.int_div(k, F.lit(7)).alias("whole"),
        compat.divide(c.cast("double"), (k % 5).cast("double")).alias("quotient"),
        compat.int_div(c, k % 3).alias("cut"),
        compat.to_bool(k % 2).alias("odd"),
        compat.from_bool(compat.to_bool(k % 2)).alias("odd_flag"),
    )


@query(
    "f3_dates",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS instant, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(epoch(o_orderdate) AS bigint) AS seconds, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS next_day FROM orders",
)
def f3_dates(spark, t):
    at = F.col("o_orderdate")
    day = F.date_format(at, compat.DATE)
    return t["orders"].select("o_orderkey", compat.rfc3339(at).alias("instant"), day.alias("day"), F.unix_timestamp(at.cast("timestamp")).alias("seconds"), F.date_add(compat.parse_date(day), 1).cast("string").alias("next_day"))


@query(
    "f4_json",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS bigint) AS k, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\",\"none\":null}' AS made FROM events",
)
def f4_json(spark, t):
    return t["events"].select(
        "event_id",
        F.from_json("props", "k bigint")["k"].alias("k"),
        compat.json_object(id=F.col("event_id"), type=F.col("event_type"), none=F.lit(None).cast("string")).alias("made"),
    )


@query("f5_hash", "SELECT o_orderkey, sha256('[' || o_orderkey || ',\"' || o_orderstatus || '\"]') AS digest, o_orderstatus AS status_again FROM orders")
def f5_hash(spark, t):
    text = F.concat(F.lit("["), F.col("o_orderkey").cast("string"), F.lit(',"'), F.col("o_orderstatus"), F.lit('"]'))
    packed = F.base64(F.encode("o_orderstatus", "utf-8"))
    return t["orders"].select("o_orderkey", codec.sha256_hex(text).alias("digest"), F.decode(codec.wire_blob(packed), "utf-8").alias("status_again"))


@query("f6_canonical_json", "SELECT event_id, '{\"a\":\"' || event_type || '\",\"k\":' || json_extract_string(props, '$.k') || ',\"z\":null}' AS canonical FROM events")
def f6_canonical_json(spark, t):
    text = F.format_string('{"z": null, "k" : %s.0, "a":"%s"}', F.from_json("props", "k bigint")["k"], F.col("event_type"))
    return t["events"].select("event_id", codec.canonical(text).alias("canonical"))


@query(
    "f7_exact_numbers",
    "SELECT o_orderkey, CAST(CAST(o_orderkey AS varchar) AS bigint) AS key_again, CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '0' END AS flag, CAST(o_orderkey AS varchar) || '.5' AS half FROM orders",
)
def f7_exact_numbers(spark, t):
    k = F.col("o_orderkey")
    return t["orders"].select("o_orderkey", codec.int64_text(k.cast("string")).alias("key_again"), codec.bool_text(k % 2 == 0).alias("flag"), codec.real_text(k.cast("double") + 0.5).alias("half"))


@query("f8_enum", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' WHEN 'P' THEN 'Pending' END AS status FROM orders")
def f8_enum(spark, t):
    return t["orders"].select("o_orderkey", compat.enum_by_value(F.col("o_orderstatus"), {"F": "Finished", "O": "Open", "P": "Pending"}).alias("status"))


@query("f9_uuid", "SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id, h AS again FROM (SELECT c_custkey, md5(c_name) AS h FROM customer)")
def f9_uuid(spark, t):
    text = codec.uuid_text(F.unhex(F.md5("c_name")))
    return t["customer"].select("c_custkey", text.alias("id"), compat.hex_lower(codec.wire_uuid(text)).alias("again"))

"""Aggregates.  Money is summed as decimals, so the order of addition cannot show."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import compat
from weftline.queries.registry import query, sql_query

sql_query("g1_counts", "SELECT count(*) AS n, count(nullif(o_orderstatus, 'F')) AS n_open, count(DISTINCT o_custkey) AS n_customers FROM orders")
sql_query("g7_g8_min_max", "SELECT o_orderstatus, max(o_totalprice) AS most, min(o_totalprice) AS least, coalesce(max(o_orderkey), 0) + 1 AS next_key FROM orders GROUP BY o_orderstatus")
sql_query("g9_group_by", "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS decimal(18, 2))) AS double) AS quantity, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql_query("g10_aggregate_view", "WITH v AS (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS decimal(18, 2))) AS double) AS spent FROM orders GROUP BY o_custkey) SELECT c_name, n, spent FROM customer JOIN v ON o_custkey = c_custkey")
sql_query("g12_having_filter", "SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_done, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_custkey HAVING count(*) > 8")
sql_query(
    "g13_grouping_sets",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
)
sql_query(
    "tpch_pricing_summary",
    "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS decimal(18, 2))) AS double) AS sum_qty, CAST(sum(CAST(l_extendedprice AS decimal(18, 2)) * (1 - CAST(l_discount AS decimal(18, 2)))) AS double) AS revenue, count(*) AS n"
    " FROM lineitem WHERE l_shipdate <= CAST('2001-09-02 00:00:00' AS timestamp) GROUP BY l_returnflag, l_linestatus",
)
sql_query(
    "tpch_region_revenue",
    "SELECT n_name, CAST(sum(CAST(l_extendedprice AS decimal(18, 2)) * (1 - CAST(l_discount AS decimal(18, 2)))) AS double) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey"
    " JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 2 GROUP BY n_name",
)


@query(
    "g2_sum_total_avg",
    "SELECT c_nationkey, sum(CAST(c_custkey AS double)) AS key_sum, coalesce(sum(CASE WHEN c_acctbal > 9900 THEN CAST(c_custkey AS double) END), 0.0::double) AS rich_total, sum(CASE WHEN c_acctbal > 9900 THEN CAST(c_custkey AS double) END) AS rich_sum, avg(CAST(c_custkey AS double)) AS key_avg FROM customer GROUP BY c_nationkey",
)
def g2_sum_total_avg(spark, t):
    rich = F.when(F.col("c_acctbal") > 9900, F.col("c_custkey"))
    return t["customer"].groupBy("c_nationkey").agg(compat.real_sum(F.col("c_custkey")).alias("key_sum"), compat.total(rich).alias("rich_total"), compat.real_sum(rich).alias("rich_sum"), F.avg(F.col("c_custkey").cast("double")).alias("key_avg"))


@query("g3_average_length", "SELECT c_mktsegment, avg(length(c_name)) AS mean_length, CAST(max(length(c_mktsegment)) AS integer) AS longest FROM customer GROUP BY c_mktsegment")
def g3_average_length(spark, t):
    return t["customer"].groupBy("c_mktsegment").agg(F.avg(F.length("c_name")).alias("mean_length"), F.max(F.length("c_mktsegment")).alias("longest"))


@query("g4_group_concat", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names, string_agg(CAST(n_nationkey AS varchar), ',' ORDER BY n_nationkey DESC) AS keys FROM nation GROUP BY n_regionkey")
def g4_group_concat(spark, t):
    return t["nation"].groupBy("n_regionkey").agg(compat.group_concat(F.col("n_name"), "; ").alias("names"), compat.group_concat(F.col("n_nationkey"), ",", -F.col("n_nationkey")).alias("keys"))


@query(
    "g5_json_groups",
    "SELECT n_regionkey, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_nationkey) || ']' AS names, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS keys FROM nation GROUP BY n_regionkey",
)
def g5_json_groups(spark, t):
    return t["nation"].groupBy("n_regionkey").agg(compat.json_group_array(F.col("n_name"), F.col("n_nationkey")).alias("names"), compat.json_group_object(F.col("n_name"), F.col("n_nationkey")).alias("keys"))


@query("g11_ordered_lists", "SELECT o_custkey, CAST(len(list(o_orderkey)) AS integer) AS n, array_to_string(list(o_orderkey ORDER BY o_orderdate, o_orderkey), ',') AS keys FROM orders GROUP BY o_custkey")
def g11_ordered_lists(spark, t):
    pairs = F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    return t["orders"].groupBy("o_custkey").agg(pairs.alias("p")).select("o_custkey", F.size("p").alias("n"), F.array_join(F.col("p.o_orderkey").cast("array<string>"), ",").alias("keys"))


@query("g6_count_big", "SELECT o_orderstatus, count(*) AS n, count(CASE WHEN o_totalprice > 300000 THEN 1 END) AS n_large FROM orders GROUP BY o_orderstatus")
def g6_count_big(spark, t):
    return t["orders"].groupBy("o_orderstatus").agg(compat.count_big().alias("n"), compat.count_big(F.when(F.col("o_totalprice") > 300000, 1)).alias("n_large"))

"""Nested results, flattened to sizes and joined keys where SQL is to check them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.nesting import Nested, inherit, nest, nest_children, nest_chunks, nest_rows, prefixed
from weftline.plans.query import Query
from weftline.queries.registry import query
from weftline.sources.tables import register


def _keys(array: str, name: str) -> Column:
    return F.array_join(F.transform(array, lambda e: F.coalesce(e[name].cast("string"), F.lit("null"))), ",")


ORDERS = Nested("orders", "collection", {"key": "o_orderkey", "price": "o_totalprice", "placed": "o_orderdate"}, key="o_orderkey")


def customers_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: each customer with nation, orders, and the lines of each order."""
    register(spark, sf_dir)
    return Query.load("customer.with_orders").run(spark, max_key=1_000_000_000)


@query(
    "m1_collection",
    "SELECT c_custkey, c_name, CAST(count(o_orderkey) AS integer) AS n_orders, coalesce(string_agg(CAST(o_orderkey AS varchar), ',' ORDER BY o_orderdate, o_orderkey), '') AS order_keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name",
)
def m1_collection(spark, t):
    joined = t["customer"].select("c_custkey", "c_name").join(t["orders"].select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), F.col("o_custkey") == F.col("c_custkey"), "left").drop("o_custkey")
    found = nest(joined, "c_custkey", [ORDERS], [F.col("o_orderdate"), F.col("o_orderkey")], sort=False)
    return found.select("c_custkey", "c_name", F.size("orders").alias("n_orders"), _keys("orders", "key").alias("order_keys"))


@query(
    "m2_empty_elements",
    "SELECT c_custkey, CAST(count(o_orderkey) AS integer) AS n_orders, coalesce(string_agg(CAST(o_orderkey AS varchar), ',' ORDER BY o_orderkey), '') AS order_keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 350000 GROUP BY c_custkey",
)
def m2_empty_elements(spark, t):
    large = t["orders"].filter("o_totalprice > 350000").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    joined = t["customer"].select("c_custkey").join(large, F.col("o_custkey") == F.col("c_custkey"), "left").drop("o_custkey")
    found = nest(joined, "c_custkey", [ORDERS], [F.col("o_orderkey")], sort=False)
    return found.select("c_custkey", F.size("orders").alias("n_orders"), _keys("orders", "key").alias("order_keys"))


M3_SQL = """
WITH o AS (SELECT o_custkey AS k, CAST(count(*) AS integer) AS n_orders, string_agg(CAST(o_orderkey AS varchar), ',' ORDER BY o_orderkey) AS order_keys FROM orders GROUP BY 1),
s AS (SELECT k, CAST(count(*) AS integer) AS n_events, string_agg(CAST(event_id AS varchar), ',' ORDER BY event_id) AS event_keys FROM (SELECT user_id AS k, event_id FROM events) GROUP BY 1)
SELECT c_custkey, coalesce(n_orders, 0) AS n_orders, coalesce(order_keys, '') AS order_keys, coalesce(n_events, 0) AS n_events, coalesce(event_keys, '') AS event_keys
FROM customer LEFT JOIN o ON o.k = c_custkey LEFT JOIN s ON s.k = c_custkey
"""


@query("m3_sibling_collections", M3_SQL)
def m3_sibling_collections(spark, t):
    """Two collections in one join: each repeats for each element of the other, and distinct keys undo it."""
    joined = (
        t["customer"].select("c_custkey")
        .join(t["orders"].select("o_custkey", "o_orderkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(t["events"].select("user_id", "event_id"), F.col("user_id") == F.col("c_custkey"), "left")
        .drop("o_custkey", "user_id")
    )
    fields = [Nested("orders", "collection", {"key": "o_orderkey"}, key="o_orderkey"), Nested("events", "collection", {"id": "event_id"}, key="event_id")]
    found = nest(joined, "c_custkey", fields, [F.col("o_orderkey"), F.col("event_id")], sort=False)
    return found.select("c_custkey", F.size("orders").alias("n_orders"), _keys("orders", "key").alias("order_keys"), F.size("events").alias("n_events"), _keys("events", "id").alias("event_keys"))


@query("m3_collected_before_joining", M3_SQL)
def m3_collected_before_joining(spark, t):
    """The same without multiplying rows."""
    found = nest_children(
        t["customer"].select("c_custkey"),
        "c_custkey",
        {"orders": (t["orders"], "o_custkey", ["o_orderkey"], [F.col("o_orderkey")]), "events": (t["events"], "user_id", ["event_id"], [F.col("event_id")])},
    )
    return found.select("c_custkey", F.size("orders").alias("n_orders"), _keys("orders", "o_orderkey").alias("order_keys"), F.size("events").alias("n_events"), _keys("events", "event_id").alias("event_keys"))


@query(
    "m5_nested_collections",
    """
WITH l AS (SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || ':' || l_partkey, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS lines FROM lineitem GROUP BY 1)
SELECT c_custkey, CAST(count(o_orderkey) AS integer) AS n_orders, CAST(coalesce(sum(l.n), 0) AS bigint) AS n_lines, coalesce(string_agg(o_orderkey || '[' || coalesce(l.lines, '') || ']', ';' ORDER BY o_orderkey), '') AS tree
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY c_custkey""",
)
def m5_nested_collections(spark, t):
    lines = t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    joined = (
        t["customer"].select("c_custkey")
        .join(t["orders"].select("o_custkey", "o_orderkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .drop("o_custkey", "l_orderkey")
    )
    inner = Nested("lines", "collection", {"number": "l_linenumber", "part": "l_partkey", "supplier": "l_suppkey", "quantity": "l_quantity"})
    outer = Nested("orders", "collection", {"key": "o_orderkey"}, key="o_orderkey", children=(inner,))
    found = nest(joined, "c_custkey", [outer], [F.col(c) for c in ("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")], sort=False)
    line = lambda x: F.concat_ws(":", x["number"].cast("string"), x["part"].cast("string"))
    order = lambda o: F.concat(o["key"].cast("string"), F.lit("["), F.array_join(F.transform(o["lines"], line), " "), F.lit("]"))
    n_lines = F.aggregate(F.col("orders"), F.lit(0).cast("long"), lambda a, o: a + F.size(o["lines"]))
    return found.select("c_custkey", F.size("orders").alias("n_orders"), n_lines.alias("n_lines"), F.array_join(F.transform("orders", order), ";").alias("tree"))


@query("m6_per_row", "SELECT s_suppkey, n_nationkey IS NULL AS homeless, n_name AS nation_name, r_name AS region_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 15 LEFT JOIN region ON r_regionkey = n_regionkey")
def m6_per_row(spark, t):
    joined = t["supplier"].select("s_suppkey", "s_nationkey").join(t["nation"].filter("n_nationkey < 15"), F.col("n_nationkey") == F.col("s_nationkey"), "left").join(t["region"], F.col("r_regionkey") == F.col("n_regionkey"), "left")
    region = Nested("region", "per_row", {"key": "r_regionkey", "name": "r_name"})
    nation = Nested("nation", "per_row", {"key": "n_nationkey", "name": "n_name"}, children=(region,))
    found = nest_rows(joined, [nation, Nested("note", "default", default="none")])
    return found.select("s_suppkey", F.col("nation").isNull().alias("homeless"), F.col("nation.name").alias("nation_name"), F.col("nation.region.name").alias("region_name"))


@query("m7_entity", "SELECT c_custkey AS id, c_name AS name, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey")
def m7_entity(spark, t):
    joined = t["customer"].select("c_custkey", "c_name", "c_nationkey").join(t["nation"].select("n_nationkey", "n_name"), F.col("n_nationkey") == F.col("c_nationkey"))
    found = nest_rows(joined, [Nested("main", "entity", {"id": "c_custkey", "name": "c_name"}, not_null=True), Nested("nation", "per_row", {"name": "n_name"}, not_null=True)])
    return found.select("main.id", "main.name", F.col("nation.name").alias("nation"))


@query(
    "m8_first_present_row",
    "SELECT c_custkey, CAST(count(o_orderkey) AS integer) AS n_orders, arg_min(k, o_orderkey) FILTER (WHERE k IS NOT NULL) AS first_large FROM (SELECT c_custkey, o_orderkey, CASE WHEN o_totalprice > 300000 THEN o_orderkey END AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey) GROUP BY c_custkey",
)
def m8_first_present_row(spark, t):
    """A single related row inside a collection query comes from the first row that has one."""
    orders = t["orders"].select("o_custkey", "o_orderkey", F.when(F.col("o_totalprice") > 300000, F.col("o_orderkey")).alias("large__key"))
    joined = t["customer"].select("c_custkey").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").drop("o_custkey")
    fields = [Nested("orders", "collection", {"key": "o_orderkey"}, key="o_orderkey"), Nested("large", "per_row", prefixed(joined, "large__"))]
    found = nest(joined, "c_custkey", fields, [F.col("o_orderkey")], sort=False)
    return found.select("c_custkey", F.size("orders").alias("n_orders"), F.col("large.key").alias("first_large"))


@query(
    "m16_limit_before_nesting",
    "SELECT c_custkey, CAST(count(o_orderkey) AS integer) AS n_orders FROM (SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey ORDER BY c_custkey, o_orderkey LIMIT 40 OFFSET 5) GROUP BY c_custkey",
)
def m16_limit_before_nesting(spark, t):
    joined = t["customer"].select("c_custkey").join(t["orders"].select("o_custkey", "o_orderkey"), F.col("o_custkey") == F.col("c_custkey"), "left").drop("o_custkey")
    page = joined.orderBy("c_custkey", "o_orderkey").offset(5).limit(40)
    found = nest(page, "c_custkey", [Nested("orders", "collection", {"key": "o_orderkey"}, key="o_orderkey")], [F.col("c_custkey"), F.col("o_orderkey")], sort=False)
    return found.select("c_custkey", F.size("orders").alias("n_orders"))


@query(
    "m17_many_to_many",
    "SELECT s_suppkey, CAST(count(DISTINCT l_partkey) AS integer) AS n_parts, string_agg(DISTINCT CAST(l_partkey AS varchar), ',' ORDER BY CAST(l_partkey AS varchar)) AS parts FROM supplier LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 40) ON l_suppkey = s_suppkey GROUP BY s_suppkey",
)
def m17_many_to_many(spark, t):
    """Suppliers with their parts through lines; of repeated parts the first counts."""
    joined = (
        t["supplier"].select("s_suppkey", "s_name")
        .join(t["lineitem"].filter("l_quantity > 40").select("l_suppkey", "l_partkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .join(t["part"].select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"), "left")
        .drop("l_suppkey", "l_partkey")
    )
    found = nest(joined, "s_suppkey", [Nested("parts", "collection", {"key": "p_partkey", "name": "p_name"}, key="p_partkey")], [F.col("p_partkey").cast("string")], sort=False)
    keys = _keys("parts", "key")
    return found.select("s_suppkey", F.size("parts").alias("n_parts"), F.when(keys != "", keys).alias("parts"))


@query(
    "m13_inherited_fields",
    "SELECT c_custkey, n_name AS nation_name, r_name AS region_name, CAST(count(o_orderkey) AS integer) AS n_orders FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY 1, 2, 3",
)
def m13_inherited_fields(spark, t):
    """A query over a view takes over the view's nested fields; its own collection brings the orders."""
    view = t["customer"].select("c_custkey", "c_nationkey").join(t["nation"].select("n_nationkey", "n_name", "n_regionkey"), F.col("n_nationkey") == F.col("c_nationkey")).join(t["region"].select("r_regionkey", "r_name"), F.col("r_regionkey") == F.col("n_regionkey"))
    of_view = [Nested("nation", "per_row", {"name": "n_name"}), Nested("region", "per_row", {"name": "r_name"}), Nested("orders", "collection", {"key": "o_orderkey"}, key="o_orderkey")]
    large = t["orders"].filter("o_totalprice > 200000").select("o_custkey", "o_orderkey", "o_totalprice")
    joined = view.select("c_custkey", "n_name", "r_name").join(large, F.col("o_custkey") == F.col("c_custkey"), "left").drop("o_custkey")
    fields = inherit(of_view, [Nested("orders", "collection", {"key": "o_orderkey", "price": "o_totalprice"})])
    found = nest(joined, "c_custkey", fields, [F.col("o_orderkey")], sort=False)
    return found.select("c_custkey", F.col("nation.name").alias("nation_name"), F.col("region.name").alias("region_name"), F.size("orders").alias("n_orders"))


@query(
    "flagship_customers",
    """WITH l AS (SELECT l_orderkey, CAST(sum(l_quantity) AS bigint) AS q, string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS lines FROM lineitem GROUP BY 1),
o AS (SELECT o_custkey, count(*) AS n, CAST(sum(coalesce(q, 0)) AS bigint) AS quantity, string_agg(o_orderkey || o_orderstatus || '[' || coalesce(lines, '') || ']', ';' ORDER BY o_orderkey) AS tree FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey AS id, c_name AS name, CAST(coalesce(o.n, 0) AS integer) AS n_orders, n_name AS nation, r_name AS region, coalesce(quantity, 0) AS quantity, coalesce(tree, '') AS tree
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN o ON o.o_custkey = c_custkey""",
)
def flagship_customers(spark, t):
    """All customers, with every field of their orders and lines spelled out."""
    found = Query.load("customer.with_orders").run(spark, max_key=1 << 62)
    line = lambda x: F.concat_ws(":", x["number"].cast("string"), x["part"].cast("string"), x["supplier"].cast("string"))
    order = lambda o: F.concat(o["key"].cast("string"), o["status"], F.lit("["), F.array_join(F.transform(o["lines"], line), " "), F.lit("]"))
    quantity = F.aggregate("orders", F.lit(0).cast("long"), lambda a, o: a + F.aggregate(o["lines"], F.lit(0).cast("long"), lambda b, x: b + x["quantity"].cast("long")))
    return found.select("id", "name", F.size("orders").alias("n_orders"), F.col("nation.name").alias("nation"), F.col("nation.region").alias("region"), quantity.alias("quantity"), F.array_join(F.transform("orders", order), ";").alias("tree"))


@query(
    "m1_chunked_collection",
    """SELECT l_suppkey, (n - 1) // 64 AS chunk, count(*) AS n, string_agg(l_orderkey || ':' || l_linenumber || ':' || CAST(CAST(l_quantity AS bigint) AS varchar), ';' ORDER BY n) AS lines
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS n FROM lineitem) GROUP BY 1, 2""",
)
def m1_chunked_collection(spark, t):
    """Suppliers' lines in collections of at most 64, numbered in their order."""
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")]
    found = nest_chunks(t["lineitem"], "l_suppkey", ["l_orderkey", "l_linenumber", "l_quantity"], order, 64)
    line = lambda x: F.concat_ws(":", x["l_orderkey"].cast("string"), x["l_linenumber"].cast("string"), x["l_quantity"].cast("long").cast("string"))
    return found.select("l_suppkey", "chunk", F.size("elements").cast("long").alias("n"), F.array_join(F.transform("elements", line), ";").alias("lines"))

"""Nested results and parameters resolved from where columns come from; the SQL spells out every field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.operators.tables import register_views
from weftline.plans.lineage import attach, nest_noted, noted, tagged
from weftline.plans.nesting import Nested, nest
from weftline.plans.query import Query
from weftline.queries.registry import query

MONEY = "decimal(15,2)"


def _spelled(array: str, *parts) -> Column:
    """The elements of an array as text: parts by ``:``, elements by ``;``."""
    return F.array_join(F.transform(array, lambda e: F.concat_ws(":", *[p(e) for p in parts])), ";")


def _text(name: str, kind: str | None = None):
    return lambda e: (e[name].cast(kind) if kind else e[name]).cast("string")


def _day(name: str):
    return lambda e: F.date_format(e[name], "yyyy-MM-dd")


ORDER_TEXT = "o_orderkey || ':' || o_orderstatus || ':' || CAST(CAST(o_totalprice AS decimal(15,2)) AS varchar) || ':' || strftime(o_orderdate, '%Y-%m-%d')"


@query(
    "m17_key_lookup",
    f"SELECT c_custkey AS customer, c_name AS who, coalesce(string_agg({ORDER_TEXT}, ';' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2",
)
def m17_key_lookup(spark, t):
    """Keys by source and column, in any case, although both columns appear under other names."""
    customers = tagged(t["customer"].select("c_custkey", "c_name"), "c")
    orders = tagged(t["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"), "o")
    joined = attach(customers, orders, {"c_custkey": "o_custkey"}).drop("o_custkey")
    joined = joined.withColumnsRenamed({"c_custkey": "customer", "c_name": "who", "o_orderkey": "id", "o_orderstatus": "status", "o_totalprice": "price", "o_orderdate": "placed"})
    found = nest_noted(joined, [{"name": "orders", "mapping": "collection", "source": "O", "key": "o.O_ORDERKEY"}], [F.col("id")], key="C.c_custkey", sort=False)
    return found.select("customer", "who", _spelled("orders", _text("id"), _text("status"), _text("price", MONEY), _day("placed")).alias("orders"))


@query(
    "m10_alias_assignment",
    f"""SELECT c_custkey, c_mktsegment, n_nationkey AS nation_key, n_name AS nation_name, r_name AS region_name, 'none' AS remark,
coalesce(string_agg({ORDER_TEXT}, ';' ORDER BY o_orderkey), '') AS orders
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4, 5""",
)
def m10_alias_assignment(spark, t):
    """Columns go to nested fields by the alias of their source, those of a computed column by prefix."""
    c = tagged(t["customer"].select("c_custkey", "c_mktsegment", "c_nationkey"), "c")
    n = tagged(t["nation"], "n", {"n_nationkey": {"name": "key"}, "n_name": {"name": "name"}})
    r = tagged(t["region"].select("r_regionkey", "r_name"), "r")
    o = tagged(t["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"), "o")
    joined = attach(attach(attach(c, n, {"c_nationkey": "n_nationkey"}), r, {"n_regionkey": "r_regionkey"}), o, {"c_custkey": "o_custkey"})
    joined = joined.withColumn("region__name", F.concat("r_name", F.lit(""))).drop("c_nationkey", "n_regionkey", "o_custkey", "r_regionkey", "r_name")
    fields = [
        {"name": "nation", "mapping": "per_row", "source": "n"},
        {"name": "region", "mapping": "per_row", "source": "r", "alias_prefix": "region__"},
        {"name": "orders", "mapping": "collection", "source": "o", "key": "o_orderkey"},
        {"name": "remark", "default": "none"},
    ]
    found = nest_noted(joined, fields, [F.col("o_orderkey")], key="c.c_custkey", sort=False)
    orders = _spelled("orders", _text("o_orderkey"), _text("o_orderstatus"), _text("o_totalprice", MONEY), _day("o_orderdate"))
    return found.select("c_custkey", "c_mktsegment", F.col("nation.key").alias("nation_key"), F.col("nation.name").alias("nation_name"), F.col("region.name").alias("region_name"), "remark", orders.alias("orders"))


@query(
    "j4_grouping_from_joins",
    """WITH l AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey || ':' || CAST(CAST(l_quantity AS bigint) AS varchar), ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS lines FROM lineitem GROUP BY 1)
SELECT c_custkey, c_name, coalesce(string_agg(o_orderkey || o_orderstatus || '[' || coalesce(lines, '') || ']', ';' ORDER BY o_orderkey), '') AS orders
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1, 2""",
)
def j4_grouping_from_joins(spark, t):
    """No key is stated: customers and orders are grouped by the columns that their collections are joined to."""
    c = tagged(t["customer"].select("c_custkey", "c_name"), "c")
    o = tagged(t["orders"].select("o_orderkey", "o_custkey", "o_orderstatus"), "o")
    l = tagged(t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "l")  # noqa: E741
    joined = attach(attach(c, o, {"c_custkey": "o_custkey"}), l, {"o_orderkey": "l_orderkey"}).drop("o_custkey", "l_orderkey")
    fields = [{"name": "orders", "mapping": "collection", "source": "o", "children": [{"name": "lines", "mapping": "collection", "source": "l"}]}]
    found = nest_noted(joined, fields, [F.col(x) for x in ("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")], sort=False)
    line = lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), x["l_quantity"].cast("long").cast("string"))
    order = lambda x: F.concat(x["o_orderkey"].cast("string"), x["o_orderstatus"], F.lit("["), F.array_join(F.transform(x["lines"], line), ","), F.lit("]"))
    return found.select("c_custkey", "c_name", F.array_join(F.transform("orders", order), ";").alias("orders"))


@query(
    "j4_grouping_on_two_columns",
    """SELECT l_orderkey AS order_key, l_linenumber AS line, max(l_partkey) AS part_of_line, coalesce(string_agg(o_orderkey || ':' || o_orderpriority || ':' || shift, ';' ORDER BY shift), '') AS found
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) LEFT JOIN (SELECT o_orderkey, o_orderpriority, o_orderkey % 4 + 1 + s.x AS place, s.x AS shift FROM orders, (SELECT unnest(range(3)) AS x) s) ON o_orderkey = l_orderkey AND place = l_linenumber GROUP BY 1, 2""",
)
def j4_grouping_on_two_columns(spark, t):
    """No key is stated, and the collection is joined on two columns: every line of an order is a root of its own."""
    lines = t["lineitem"].groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    marks = t["orders"].select("o_orderkey", "o_orderpriority", F.explode(F.array(*[F.lit(x) for x in range(3)])).alias("shift"))
    marks = marks.withColumn("at", F.col("o_orderkey") % 4 + 1 + F.col("shift"))
    joined = attach(tagged(lines, "l"), tagged(marks, "m"), {"l_orderkey": "o_orderkey", "l_linenumber": "at"})
    joined = joined.withColumnsRenamed({"l_orderkey": "order_key", "l_linenumber": "line", "l_partkey": "part_of_line"})
    found = nest_noted(joined, [{"name": "found", "mapping": "collection", "source": "m"}], [F.col("shift")], sort=False)
    return found.select("order_key", "line", "part_of_line", _spelled("found", _text("o_orderkey"), _text("o_orderpriority"), _text("shift")).alias("found"))


@query(
    "l5_precedence",
    "SELECT o_orderkey AS id, lower(o_orderstatus) AS state, CAST(CAST(o_totalprice AS decimal(15,2)) AS varchar) AS price, CASE WHEN o_totalprice > 200000 THEN o_orderpriority ELSE 'unknown' END AS priority FROM orders",
)
def l5_precedence(spark, t):
    """Notes of a table, of a view on it and of a query on the view: each level overrides single members."""
    table = tagged(
        t["orders"],
        "orders",
        {
            "o_orderkey": {"name": "order_key", "not_null": True},
            "o_orderstatus": {"name": "status", "adapter": "lower"},
            "o_totalprice": {"name": "price", "type": "double"},
            "o_orderpriority": {"name": "priority", "default": "none"},
        },
    )
    table.createOrReplaceTempView("noted_orders")
    view = spark.sql("SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_totalprice > 200000 THEN o_orderpriority END AS o_orderpriority FROM noted_orders")
    view = noted(view, {"o_orderkey": {"name": "key"}, "o_totalprice": {"type": MONEY}, "o_orderpriority": {"name": "priority", "default": "none"}})
    view.createOrReplaceTempView("noted_orders_view")
    own = noted(spark.sql("SELECT * FROM noted_orders_view"), {"o_orderkey": {"name": "id"}, "o_orderstatus": {"name": "state", "type": None}, "o_orderpriority": {"default": "unknown"}})
    found = nest_noted(own, [], [], adapters={"lower": F.lower})
    return found.withColumn("price", F.col("price").cast("string"))


@query(
    "m2_null_key",
    "SELECT c_custkey, coalesce(string_agg(o_orderkey || ':' || o_orderstatus, ';' ORDER BY o_orderkey) FILTER (WHERE o_totalprice > 200000), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
)
def m2_null_key(spark, t):
    """The other rule for elements: one without a key is none, though its other columns hold values."""
    orders = t["orders"].select("o_custkey", "o_orderkey", F.when(F.col("o_totalprice") > 200000, F.col("o_orderkey")).alias("large_key"), "o_orderstatus")
    joined = t["customer"].select("c_custkey").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").drop("o_custkey")
    fields = [Nested("orders", "collection", {"key": "large_key", "status": "o_orderstatus"}, key="large_key", null_key_drops=True)]
    found = nest(joined.withColumn("place", F.col("o_orderkey")), "c_custkey", fields, [F.col("place")], sort=False)
    return found.select("c_custkey", _spelled("orders", _text("key"), _text("status")).alias("orders"))


@query(
    "m2_payload_then_key",
    """WITH j AS (SELECT c_custkey, o_orderkey, CASE WHEN o_totalprice > 200000 THEN o_orderstatus END AS k, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS id, CASE WHEN o_totalprice > 250000 THEN o_orderkey END AS big FROM customer LEFT JOIN orders ON o_custkey = c_custkey),
e AS (SELECT *, row_number() OVER (PARTITION BY c_custkey, k ORDER BY o_orderkey) AS r FROM j WHERE k IS NOT NULL OR id IS NOT NULL),
l AS (SELECT c_custkey, string_agg(coalesce(k, '-') || ':' || coalesce(CAST(id AS varchar), '-'), ';' ORDER BY o_orderkey) AS s FROM e WHERE r = 1 GROUP BY 1),
b AS (SELECT c_custkey, min(big) AS big FROM j GROUP BY 1)
SELECT c_custkey, coalesce(s, '') AS elements, CAST(big AS bigint) AS first_big FROM customer LEFT JOIN l USING (c_custkey) LEFT JOIN b USING (c_custkey)""",
)
def m2_payload_then_key(spark, t):
    """Rows that hold something, then of each key (null is one) the first; a single row from the first of all that hold it."""
    price, id_ = F.col("o_totalprice"), F.col("o_orderkey").cast("long")
    orders = t["orders"].select("o_custkey", id_.alias("place"), F.when(price > 200000, F.col("o_orderstatus")).alias("k"), F.when(id_ % 3 != 0, id_).alias("id"), F.when(price > 250000, id_).alias("big"))
    joined = t["customer"].select("c_custkey").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").drop("o_custkey")
    fields = [Nested("elements", "collection", {"k": "k", "id": "id"}, key="k"), Nested("first", "per_row", {"big": "big"})]
    found = nest(joined, "c_custkey", fields, [F.col("place")], sort=False)
    known = lambda name: lambda e: F.coalesce(e[name].cast("string"), F.lit("-"))
    return found.select("c_custkey", _spelled("elements", known("k"), known("id")).alias("elements"), F.col("first.big").alias("first_big"))


@query(
    "l3_types",
    """SELECT c_custkey, coalesce(string_agg(CAST((o_orderkey % 1000) * 2 AS varchar) || ':' || CAST(CAST(o_totalprice AS decimal(15,2)) AS varchar), ';' ORDER BY o_orderkey), '') AS orders
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
)
def l3_types(spark, t):
    """A text column read as a number before its adapter, and the type of a whole collection."""
    customers = tagged(t["customer"].select("c_custkey"), "c")
    digits = t["orders"].select("o_orderkey", "o_custkey", F.format_string("%s", F.col("o_orderkey") % 1000).alias("digits"), "o_totalprice")
    orders = tagged(digits, "o", {"digits": {"sql_type": "bigint", "adapter": "twice", "type": "string"}})
    joined = attach(customers, orders, {"c_custkey": "o_custkey"}).drop("o_custkey").withColumn("place", F.col("o_orderkey") + 0)
    spec = {"name": "orders", "mapping": "collection", "source": "o", "key": "o_orderkey", "type": f"array<struct<id: bigint, twice: string, price: {MONEY}>>"}
    found = nest_noted(joined, [spec], [F.col("place")], key="c_custkey", adapters={"twice": lambda c: c * 2}, sort=False)
    return found.select("c_custkey", _spelled("orders", _text("twice"), _text("price")).alias("orders"))


@query(
    "a4_column_parameters",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus IN ('F', 'P') AND o_custkey <> 7",
)
def a4_column_parameters(spark, t):
    """Parameters take the types of the columns they are compared with, through a view on a view."""
    register_views(spark, {"a4_outer": "SELECT *, price AS amount FROM a4_inner", "a4_inner": "SELECT o_orderkey, o_custkey AS buyer, o_orderstatus, o_totalprice AS price FROM orders"})
    text = """/*@ {"params": {"least": "a4_outer.Amount", "states": "array<a4_outer.o_orderstatus>", "not_buyer": "a4_outer.buyer"}} */
    SELECT o_orderkey, o_orderstatus, price AS o_totalprice FROM a4_outer WHERE amount > :least AND array_contains(:states, o_orderstatus) AND buyer <> :not_buyer"""
    return Query.parse("a4", text).run(spark, least=200000, states=["F", "P"], not_buyer=7)

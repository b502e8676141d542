"""Scans, predicates, parameters, joins, order and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import compat
from weftline.operators import running
from weftline.operators.intervals import overlap_join
from weftline.operators.ordinals import after_key, bounded_page, with_ordinals
from weftline.operators.pages import page_index
from weftline.operators.running import as_of
from weftline.operators.tables import register_views, star
from weftline.plans.query import Query
from weftline.queries.registry import query, sql_query

sql_query("s1_table_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
sql_query("s3_without_from", "SELECT 42 AS constant_int, CAST(3.5 AS double) AS constant_real, 'text' AS constant_text")
sql_query("s4_derived_table", "SELECT d.c_nationkey, d.n FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) d WHERE d.n > 1")
sql_query("p1_alias", "SELECT c_custkey AS id, c_name AS name FROM customer")
sql_query("p3_constants", "SELECT c_custkey, 42 AS constant_int, CAST(NULL AS varchar(10)) AS constant_null, CAST(1.5 AS double) AS constant_real FROM customer")
sql_query("p4_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
sql_query(
    "p5_compare",
    '/*@ {"params": {"low": "double", "segment": "string"}} */ SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= :low AND c_mktsegment <> :segment',
    {"low": 100.0, "segment": "MACHINERY"},
)
sql_query(
    "p6_between",
    '/*@ {"params": {"a": "string", "b": "string"}} */ SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN CAST(:a AS timestamp) AND CAST(:b AS timestamp)',
    {"a": "1997-01-01 00:00:00", "b": "1997-06-30 00:00:00"},
)
sql_query("p9_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
sql_query("p10_null_tests", "SELECT c_custkey FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NULL AND c_name IS NOT NULL")
sql_query("p11_and_or_not", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 200000) AND (o_custkey < 500 OR o_orderpriority = '1-URGENT')")
sql_query(
    "p12_exists",
    "SELECT c_custkey, 'has' AS kind FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)"
    " UNION ALL SELECT c_custkey, 'none' AS kind FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)",
)
sql_query("p13_scalar_subquery", "SELECT n_name, coalesce((SELECT max(c_acctbal) FROM customer c WHERE c.c_nationkey = n.n_nationkey), 0) AS best, (SELECT count(*) FROM region) AS n_regions FROM nation n")
sql_query("p14_case", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_totalprice > 250000 THEN 'large' ELSE 'open' END AS kind FROM orders")
sql_query("p15_cast", '/*@ {"params": {"n": "string"}} */ SELECT o_orderkey, CAST(o_totalprice AS bigint) AS cents FROM orders WHERE o_totalprice > CAST(:n AS bigint)', {"n": "500"}, "SELECT o_orderkey, CAST(trunc(o_totalprice) AS bigint) AS cents FROM orders WHERE o_totalprice > 500")
sql_query(
    "p17_cte",
    '/*@ {"params": {"a": "string"}} */ WITH bounds AS (SELECT CAST(:a AS timestamp) AS since) SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT since FROM bounds)',
    {"a": "2000-01-01 00:00:00"},
)
sql_query("p18_recursive", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 50) SELECT n FROM r")
sql_query("p19_regexp", "SELECT p_partkey, p_name FROM part WHERE regexp_like(p_name, '^(red|blue) ')", None, "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue) ')")
sql_query(
    "a1_named_parameters",
    '/*@ {"params": {"k": "long", "status": "string"}} */ SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey = :k OR o_orderkey = :k) AND o_orderstatus <> :status AND \':k\' <> :status',
    {"k": 77, "status": "P"},
    "SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey = 77 OR o_orderkey = 77) AND o_orderstatus <> 'P'",
)
sql_query(
    "a7_limit_offset",
    '/*@ {"params": {"n": "int", "skip": "int"}} */ SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT :n OFFSET :skip',
    {"n": 25, "skip": 10},
)
sql_query("j1_inner", "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
sql_query(
    "j2_left_chain",
    "SELECT s.s_suppkey, p.p_partkey, n.n_name FROM supplier s LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey AND l.l_quantity > 45 LEFT JOIN part p ON p.p_partkey = l.l_partkey LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey",
)
sql_query("j6_semi", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql_query("j7_anti", "SELECT p.p_partkey FROM part p LEFT JOIN lineitem l ON l.l_partkey = p.p_partkey AND l.l_discount > 0.09 WHERE l.l_orderkey IS NULL")
sql_query(
    "j8_full_and_cross",
    "SELECT coalesce(a.c_nationkey, b.s_nationkey) AS nation, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey) a"
    " FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) b ON a.c_nationkey = b.s_nationkey",
)
sql_query("j8_right", "SELECT n_name, c.c_custkey, c.c_acctbal FROM (SELECT * FROM customer WHERE c_acctbal > 9500) c RIGHT JOIN nation ON n_nationkey = c.c_nationkey")
sql_query("j9_range", "SELECT r.r_name, n.n_name FROM region r JOIN nation n ON n.n_nationkey >= r.r_regionkey * 5 AND n.n_nationkey < r.r_regionkey * 5 + 7")
sql_query("o1_order", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
sql_query("o7_union", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey AS nation FROM supplier")
sql_query("o8_set_operations", "(SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey AS nation FROM supplier) EXCEPT SELECT n_nationkey AS nation FROM nation WHERE n_regionkey = 0")
sql_query(
    "w1_windows",
    "SELECT o_orderkey, CAST(row_number() OVER w AS bigint) AS place, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS bigint) AS status_rank, lag(o_totalprice) OVER w AS before_price,"
    " max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent_max FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
)


@query("s2_view_on_view", "SELECT n_name, r_name, customers FROM (SELECT n_name, r_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey) d JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY c_nationkey) c ON c.c_nationkey = d.n_nationkey WHERE customers > 2")
def s2_view_on_view(spark, t):
    register_views(
        spark,
        {
            "nation_customers": "SELECT n_name, r_name, customers FROM nation_detail d JOIN customer_counts c ON c.c_nationkey = d.n_nationkey",
            "customer_counts": "SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY c_nationkey",
            "nation_detail": "SELECT n_name, r_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey",
        },
    )
    return spark.sql("SELECT * FROM nation_customers WHERE customers > 2")


@query("s5_array_parameter", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)")
def s5_array_parameter(spark, t):
    text = '/*@ {"params": {"segments": "array<string>", "keys": "array<long>"}} */ SELECT c_custkey, c_mktsegment FROM customer WHERE array_contains(:segments, c_mktsegment) AND array_contains(:keys, c_custkey)'
    return Query.parse("s5", text).run(spark, segments=["BUILDING", "MACHINERY", "BUILDING"], keys=[1, 2, 3, 5, 8, 13, 21, 34, 55, 89])


@query("p8_in_list_json", "SELECT o_orderkey FROM orders WHERE o_custkey IN (3, 5, 8, 900)")
def p8_in_list_json(spark, t):
    wanted = spark.range(1).select(compat.json_each(F.lit("[3, 5, 8, 900, 900]"), "bigint").alias("k"))
    return t["orders"].join(F.broadcast(wanted), F.col("o_custkey") == F.col("k"), "left_semi").select("o_orderkey")


@query("p8_empty_list", "SELECT o_orderkey FROM orders WHERE false")
def p8_empty_list(spark, t):
    return Query.parse("p8", '/*@ {"params": {"keys": "array<long>"}} */ SELECT o_orderkey FROM orders WHERE array_contains(:keys, o_custkey)').run(spark, keys=[])


@query(
    "p2_star_without_repeats",
    "SELECT a.name, a.nation, a.balance, b.suppliers FROM (SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer) a JOIN (SELECT s_nationkey AS nation, count(*) AS suppliers, max(s_name) AS name FROM supplier GROUP BY s_nationkey) b ON a.nation = b.nation",
)
def p2_star_without_repeats(spark, t):
    """Both sides have a name and a nation: of columns that repeat, the first side's stays."""
    a = t["customer"].select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    b = t["supplier"].groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"), F.max("s_name").alias("name"))
    return star(a, b, a["nation"] == b["nation"])


@query("p7_like_without_case", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%' OR p_name ILIKE 's_all%'")
def p7_like_without_case(spark, t):
    return t["part"].filter(compat.like(F.col("p_name"), "%RED%") | compat.like(F.col("p_name"), "S!_ALL%", "!") | compat.like(F.col("p_name"), "s_ALL%")).select("p_partkey", "p_name")


@query("j5_view_to_view", "SELECT n_name, s_name, r_name FROM (SELECT s_name, s_nationkey FROM supplier WHERE s_acctbal > 0) s LEFT JOIN (SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey) n ON n_nationkey = s_nationkey")
def j5_view_to_view(spark, t):
    register_views(
        spark,
        {
            "supplier_nation": "SELECT n_name, s_name, r_name FROM rich_suppliers LEFT JOIN nation_region ON n_nationkey = s_nationkey",
            "rich_suppliers": "SELECT s_name, s_nationkey FROM supplier WHERE s_acctbal > 0",
            "nation_region": "SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
        },
    )
    return spark.table("supplier_nation")


@query(
    "j10_as_of",
    "SELECT p.event_id, max_by(v.event_id, v.event_id) AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = p.user_id AND v.event_id < p.event_id GROUP BY p.event_id",
)
def j10_as_of(spark, t):
    """The last view of a user before each purchase: one pass over users and events, ranges of which carry on from each other."""
    bought = t["events"].filter("event_type = 'purchase'").select("user_id", "event_id")
    views = t["events"].filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("event_id").alias("at"))
    return as_of(bought, views, ["user_id"], "event_id", "at", ["view_id"], strict=True).select("event_id", "view_id")


HOT = "SELECT event_id, CASE WHEN user_id % 10 < 9 THEN 0 ELSE user_id END AS user_id, event_type, ts, CAST(round(value * 100) AS bigint) AS cents FROM events"


@query(
    "j10_as_of_hot_key",
    f"SELECT p.event_id, v.event_id AS view_id, v.cents FROM (SELECT * FROM ({HOT}) WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM ({HOT}) WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.event_id >= v.event_id",
)
def j10_as_of_hot_key(spark, t):
    """As-of with one user who has nine tenths of all events: that user's events lie in many ranges."""
    hot = t["events"].select("event_id", F.when(F.col("user_id") % 10 < 9, 0).otherwise(F.col("user_id")).alias("user_id"), "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    bought = hot.filter("event_type = 'purchase'").select("user_id", "event_id")
    views = hot.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), "cents")
    return as_of(bought, views, ["user_id"], "event_id", "view_id", ["view_id", "cents"]).select("event_id", "view_id", "cents")


@query(
    "w1_running_hot_key",
    f"SELECT event_id, user_id, CAST(sum(cents) OVER w AS bigint) AS spent, count(*) OVER w AS n, max(cents) OVER w AS most, min(cents) OVER w AS least, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER w AS last_view FROM ({HOT}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
)
def w1_running_hot_key(spark, t):
    """Running sum, count, extremes and last value, where one user has nine tenths of all events."""
    hot = t["events"].select("event_id", F.when(F.col("user_id") % 10 < 9, 0).otherwise(F.col("user_id")).alias("user_id"), "event_type", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"))
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    values = {"spent": (running.SUM, F.col("cents")), "n": (running.COUNT, F.lit(1)), "most": (running.LARGEST, F.col("cents")), "least": (running.SMALLEST, F.col("cents")), "last_view": (running.LAST, view)}
    found = running.with_running(hot, ["user_id"], [F.col("ts"), F.col("event_id")], values)
    return found.select("event_id", "user_id", *values)


#: A supplier's offers hold for some days; a few hold for years.
OFFERS = "SELECT s_suppkey, (s_suppkey * 37) % 2400 AS first_day, (s_suppkey * 37) % 2400 + CASE WHEN s_suppkey % 20 = 0 THEN 1500 ELSE s_suppkey % 6 END AS last_day FROM supplier"
PLACED = "SELECT o_orderkey, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS date)) AS day FROM orders"


@query(
    "j9_orders_in_offers",
    f"SELECT s_suppkey, count(*) AS orders, CAST(sum(o_orderkey) AS bigint) AS keys, min(day) AS first_order, max(day) AS last_order FROM ({OFFERS}) s JOIN ({PLACED}) o ON day BETWEEN first_day AND last_day GROUP BY s_suppkey",
)
def j9_orders_in_offers(spark, t):
    """Orders within the days of each offer, by bins of the days: orders of one day are added up before they meet offers."""
    start = (F.col("s_suppkey") * 37) % 2400
    offers = t["supplier"].select("s_suppkey", start.alias("first_day"), (start + F.when(F.col("s_suppkey") % 20 == 0, 1500).otherwise(F.col("s_suppkey") % 6)).alias("last_day"))
    placed = t["orders"].select("o_orderkey", F.date_diff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long").alias("day"))
    days = placed.groupBy("day").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("sum_of_keys"))
    met = overlap_join(days, offers, (F.col("day"), F.col("day")), (F.col("first_day"), F.col("last_day")))
    return met.groupBy("s_suppkey").agg(F.sum("n").alias("orders"), F.sum("sum_of_keys").alias("keys"), F.min("day").alias("first_order"), F.max("day").alias("last_order"))


@query(
    "j9_overlapping_offers",
    f"SELECT a.s_suppkey, b.s_suppkey AS other FROM ({OFFERS}) a JOIN ({OFFERS}) b ON a.s_suppkey < b.s_suppkey AND a.first_day <= b.last_day AND b.first_day <= a.last_day AND a.s_suppkey % 3 = b.s_suppkey % 3",
)
def j9_overlapping_offers(spark, t):
    """Offers that overlap, short and long ones, of suppliers of one kind."""
    start = (F.col("s_suppkey") * 37) % 2400
    offers = t["supplier"].select("s_suppkey", (F.col("s_suppkey") % 3).alias("kind"), start.alias("first_day"), (start + F.when(F.col("s_suppkey") % 20 == 0, 1500).otherwise(F.col("s_suppkey") % 6)).alias("last_day"))
    others = offers.select(F.col("s_suppkey").alias("other"), "kind", F.col("first_day").alias("first_other"), F.col("last_day").alias("last_other"))
    met = overlap_join(offers, others, (F.col("first_day"), F.col("last_day")), (F.col("first_other"), F.col("last_other")), keys=["kind"])
    return met.filter("s_suppkey < other").select("s_suppkey", "other")


@query("o3_keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def o3_keyset_page(spark, t):
    return after_key(t["orders"].select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 50)


@query(
    "o3_page_index",
    "SELECT p AS page, min(n) AS first_ordinal, count(*) AS n, min(o_orderkey) FILTER (WHERE n % 700 = 0) AS first_key, arg_max(o_orderkey, n) AS last_key FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS n, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 700 AS p FROM orders) GROUP BY p",
)
def o3_page_index(spark, t):
    """The bounds of all pages of orders by day."""
    found = page_index(t["orders"], ["o_orderdate", "o_orderkey"], 700)
    return found.bounds.select("page", "first_ordinal", "n", F.col("first.o_orderkey").alias("first_key"), F.col("last.o_orderkey").alias("last_key"))


@query(
    "o3_pages_by_bounds",
    "SELECT o_orderkey, n // 700 AS page FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS n, count(*) OVER () AS m FROM orders) WHERE n // 700 IN (0, 1, (m - 1) // 700)",
)
def o3_pages_by_bounds(spark, t):
    """The first two pages and the last one, each read by its bounds."""
    found = page_index(t["orders"], ["o_orderdate", "o_orderkey"], 700)
    last = found.bounds.agg(F.max("page")).first()[0]
    out = None
    for page in sorted({0, 1, last} & set(range(last + 1))):
        rows = found.read(t["orders"], page).select("o_orderkey", F.lit(page).cast("long").alias("page"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "o4_bounded_page",
    "SELECT event_id, props FROM (SELECT *, sum(strlen(props)) OVER (ORDER BY event_id) AS s, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_id > 20) WHERE s <= 400 AND n <= 64",
)
def o4_bounded_page(spark, t):
    return bounded_page(t["events"].select("event_id", "props"), "event_id", compat.byte_length(F.col("props")), 64, 400, after=20)


@query("w2_first_per_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def w2_first_per_group(spark, t):
    first = F.min_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey"))
    return t["orders"].groupBy("o_custkey").agg(first.alias("f")).select("o_custkey", "f.*")


@query("w3_ordinals", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS ordinal FROM orders")
def w3_ordinals(spark, t):
    return with_ordinals(t["orders"].select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], "ordinal").select("o_orderkey", "ordinal")


sql_query("j8_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n WHERE n.n_regionkey <> r.r_regionkey")
sql_query("j8_using", "SELECT k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b USING (k)")
sql_query("j8_natural", "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT c_nationkey AS k, max(c_acctbal) AS best FROM customer GROUP BY 1) b")


@query("p19_glob", "SELECT p_partkey, p_name FROM part WHERE p_name GLOB '[b-r]*e[a-m]*'")
def p19_glob(spark, t):
    return t["part"].filter(compat.glob(F.col("p_name"), "[b-r]*e[a-m]*")).select("p_partkey", "p_name")

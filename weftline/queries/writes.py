"""Changes to tables: new versions, returned rows, cascades, constraints, migrations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.operators import dml, manifest
from weftline.operators.ordinals import shared_folder
from weftline.operators.tables import migrate
from weftline.queries.registry import query


@query("u1_insert", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'ATLANTIS', 0 UNION ALL SELECT 101, 'LEMURIA', NULL")
def u1_insert(spark, t):
    rows = spark.createDataFrame([(100, "ATLANTIS")], "n_nationkey int, n_name string")
    first = dml.insert(t["nation"], rows, {"n_regionkey": F.lit(0)})
    rest = spark.createDataFrame([(101, "LEMURIA", None)], "n_nationkey int, n_name string, n_regionkey int")
    return dml.insert(first.table, rest, {"n_regionkey": F.lit(0)}).table


@query("u2_insert_select", "SELECT c_custkey AS k, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier WHERE s_acctbal > 5000")
def u2_insert_select(spark, t):
    base = t["customer"].select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    rich = t["supplier"].filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return dml.insert(base, rich, {"kind": F.lit("supplier")}).table


UPSERTED = """
WITH new AS (SELECT o_custkey AS c_custkey, 'VIP' AS c_mktsegment, CAST(max(o_totalprice) AS double) AS c_acctbal FROM orders WHERE o_totalprice > 400000 GROUP BY o_custkey
             UNION ALL SELECT 90000000, 'NEW', 1.5)
SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN c.c_custkey IS NULL THEN 'unknown' ELSE c.c_name END AS c_name, c.c_nationkey AS c_nationkey,
       CASE WHEN c.c_custkey IS NULL THEN n.c_acctbal WHEN n.c_custkey IS NULL THEN c.c_acctbal ELSE greatest(c.c_acctbal, n.c_acctbal) END AS c_acctbal,
       coalesce(n.c_mktsegment, c.c_mktsegment) AS c_mktsegment
FROM customer c {join} JOIN new n ON n.c_custkey = c.c_custkey
"""


def _upserted(t):
    new = t["orders"].filter("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal")).withColumn("c_mktsegment", F.lit("VIP"))
    extra = new.sparkSession.range(1).select(F.lit(90000000).cast("long").alias("c_custkey"), F.lit(1.5).alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))
    rules = {"c_acctbal": F.greatest, "c_mktsegment": lambda old, given: given}
    return dml.upsert(t["customer"], new.unionByName(extra), ["c_custkey"], rules, {"c_name": F.lit("unknown")})


@query("u3_upsert", UPSERTED.format(join="FULL"))
def u3_upsert(spark, t):
    return _upserted(t).table


@query("u6_upsert_returning", UPSERTED.format(join="RIGHT"))
def u6_upsert_returning(spark, t):
    return _upserted(t).columns()


@query("u3_do_nothing", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 77, 'NOWHERE'")
def u3_do_nothing(spark, t):
    rows = spark.createDataFrame([(1, "OTHER"), (77, "NOWHERE")], "r_regionkey int, r_name string")
    return dml.insert_or_ignore(t["region"], rows, ["r_regionkey"]).table


@query("u4_update", "SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 300000 AND o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 300000 AND o_orderstatus = 'O' THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders")
def u4_update(spark, t):
    orders = t["orders"].drop("o_orderdate")
    return dml.update(orders, (F.col("o_totalprice") > 300000) & (F.col("o_orderstatus") == "O"), {"o_orderstatus": F.lit("F"), "o_totalprice": F.lit(None)}).table


@query("u6_update_returning", "SELECT s_suppkey, s_acctbal + 100 AS s_acctbal FROM supplier WHERE s_nationkey = 3")
def u6_update_returning(spark, t):
    return dml.update(t["supplier"], F.col("s_nationkey") == 3, {"s_acctbal": F.col("s_acctbal") + 100}).columns("s_suppkey", "s_acctbal")


@query("u5_delete", "SELECT p_partkey, p_brand FROM part WHERE NOT coalesce(nullif(p_size, 10) > 25, false)")
def u5_delete(spark, t):
    return dml.delete(t["part"].select("p_partkey", "p_brand", "p_size"), F.nullif("p_size", F.lit(10)) > 25).table.drop("p_size")


@query("u5_delete_returning", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def u5_delete_returning(spark, t):
    keys = t["orders"].filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return dml.delete_matching(t["customer"], keys, ["c_custkey"]).columns("c_custkey", "c_name")


@query(
    "u8_cascade",
    "WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey = 7), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))"
    " SELECT 'customer' AS name, (SELECT count(*) FROM c) AS lost, (SELECT count(*) FROM customer) - (SELECT count(*) FROM c) AS kept"
    " UNION ALL SELECT 'orders', (SELECT count(*) FROM o), (SELECT count(*) FROM orders) - (SELECT count(*) FROM o)"
    " UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)), (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o))",
)
def u8_cascade(spark, t):
    keys = [dml.ForeignKey("orders", "o_custkey", "customer", "c_custkey"), dml.ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey")]
    found = dml.cascade_delete(t, "customer", F.col("c_nationkey") == 7, keys)
    parts = []
    for name, changed in found.items():
        lost, kept = changed.returning.agg(F.count("*").alias("lost")), changed.table.agg(F.count("*").alias("kept"))
        parts.append(lost.crossJoin(kept).select(F.lit(name).alias("name"), "lost", "kept"))  # one row each
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "u9_constraints",
    "SELECT 'lineitem' AS \"table\", 'check:small' AS rule, count(*) AS n FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT 'lineitem', 'unique:l_orderkey,l_linenumber', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"
    " UNION ALL SELECT 'lineitem', 'foreign:l_partkey', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)",
)
def u9_constraints(spark, t):
    return dml.violations(
        t["lineitem"],
        "lineitem",
        not_null=["l_orderkey", "l_partkey"],
        unique=[["l_orderkey", "l_linenumber"]],
        checks={"small": F.col("l_quantity") <= 49, "positive": F.col("l_extendedprice") > 0},
        foreign={"l_partkey": (t["part"].filter("p_size > 3"), "p_partkey")},
    )


@query("u11_migrations", "SELECT r_regionkey, r_name, CAST(NULL AS varchar) AS nickname, 'migrated' AS created_at FROM region UNION ALL SELECT 99, 'ADDED', 'x', 'migrated'")
def u11_migrations(spark, t):
    def nickname(tables):
        return tables | {"region": tables["region"].withColumn("nickname", F.lit(None).cast("string"))}

    def created(tables):
        added = spark.range(1).select(F.lit(99).alias("r_regionkey"), F.lit("ADDED").alias("r_name"), F.lit("x").alias("nickname"))
        changed = dml.insert(tables["region"], added).table
        return tables | {"region": changed.withColumn("created_at", F.lit("migrated"))}

    def never(tables):
        raise AssertionError("already applied")

    tables, version = migrate({"region": t["region"]}, 1, {"0003_created": created, "0002": nickname, "0001_start": never})
    assert version == 3
    return tables["region"]


@query(
    "s7_seed_rows",
    "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 90, 'NORTH' UNION ALL SELECT 91, NULL",
)
def s7_seed_rows(spark, t):
    """A fresh start takes the seed rows, with the types of their table, and no step; a later start would not."""
    seeds = [{"R_REGIONKEY": 90, "r_name": "NORTH"}, {"r_regionkey": 91, "R_NAME": None}]
    base = t["region"].select("r_regionkey", "r_name")
    fresh = lambda: {"region": dml.insert(base, dml.values(base, seeds)).table}
    tables, version = migrate({"region": base}, -1, {"0001_none": lambda ts: {"region": ts["region"].limit(0)}}, fresh)
    again, _ = migrate(tables, version, {"0001_none": lambda ts: {"region": ts["region"].limit(0)}}, fresh)
    return again["region"]


STEPS = """
WITH RECURSIVE new AS (SELECT CASE WHEN o_custkey % 3 = 0 THEN o_custkey + 90000000 ELSE o_custkey END AS k, o_orderkey, o_orderstatus AS status, o_orderpriority AS priority, CAST(round(o_totalprice * 100) AS bigint) AS cents,
             row_number() OVER (PARTITION BY CASE WHEN o_custkey % 3 = 0 THEN o_custkey + 90000000 ELSE o_custkey END ORDER BY o_orderdate, o_orderkey) AS j FROM orders),
old AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, CAST(round(c_acctbal * 100) AS bigint) AS balance, CAST(0 AS bigint) AS spent, CAST(NULL AS varchar) AS priority, CAST(NULL AS bigint) AS largest FROM customer),
state AS (SELECT *, CAST(0 AS bigint) AS j FROM old
  UNION ALL SELECT DISTINCT k, 'new', 'first', CAST(NULL AS bigint), CAST(NULL AS bigint), CAST(NULL AS varchar), CAST(NULL AS bigint), CAST(0 AS bigint) FROM new WHERE k >= 90000000
  UNION ALL SELECT s.k, s.name, n.status, CASE WHEN s.k >= 90000000 AND n.j = 1 THEN n.cents ELSE (s.balance * 3 + n.cents) % 1000003 END, CASE WHEN s.k >= 90000000 AND n.j = 1 THEN n.cents ELSE s.spent + n.cents END,
            CASE WHEN n.priority = '1-URGENT' OR (s.k >= 90000000 AND n.j = 1) THEN n.priority ELSE s.priority END, CASE WHEN s.largest IS NULL OR n.cents > s.largest THEN n.cents ELSE s.largest END, n.j
            FROM state s JOIN new n ON n.k = s.k AND n.j = s.j + 1)
SELECT k, name, segment, balance, spent, priority, largest FROM state QUALIFY row_number() OVER (PARTITION BY k ORDER BY j DESC) = 1
"""


def _stepped(t):
    key = F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey") + 90000000).otherwise(F.col("o_custkey"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    new = t["orders"].select(key.alias("k"), "o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("segment"), cents.alias("balance"), cents.alias("spent"), F.col("o_orderpriority").alias("priority"), cents.alias("largest"))
    old = t["customer"].select(
        F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.round(F.col("c_acctbal") * 100).cast("long").alias("balance"),
        F.lit(0).cast("long").alias("spent"), F.lit(None).cast("string").alias("priority"), F.lit(None).cast("long").alias("largest"),
    )
    update = {
        "segment": dml.LAST,
        "balance": lambda old, given: (old * 3 + given) % 1000003,
        "spent": dml.ADD,
        "priority": lambda old, given: F.when(given == "1-URGENT", given).otherwise(old),
        "largest": dml.LARGEST,
    }
    return dml.upsert(old, new, ["k"], update, {"name": F.lit("new")}, order=["o_orderdate", "o_orderkey"])


@query("u3_upsert_row_by_row", STEPS)
def u3_upsert_row_by_row(spark, t):
    """All orders as rows of one statement: every customer is met about ten times, a third of the keys are new."""
    return _stepped(t).table


@query("u6_upsert_row_by_row_returning", STEPS.replace("QUALIFY", "WHERE k IN (SELECT k FROM new) QUALIFY"))
def u6_upsert_row_by_row_returning(spark, t):
    return _stepped(t).columns()


@query(
    "u14_do_nothing_repeated",
    "SELECT c_custkey AS k, c_name AS name, c_acctbal AS amount FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderpriority, o_totalprice FROM orders WHERE o_custkey % 2 = 1 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1",
)
def u14_do_nothing_repeated(spark, t):
    """Of many new rows with one key the first is inserted; keys that are there already keep their row."""
    held = t["customer"].filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"))
    rows = t["orders"].select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("amount"), (-F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("late"), "o_orderkey")
    return dml.insert_or_ignore(held, rows, ["k"], order=["late", "o_orderkey"]).table


@query(
    "u8_self_reference",
    """WITH RECURSIVE gone AS (SELECT o_orderkey FROM orders WHERE o_orderkey IN (2, 77) UNION SELECT o.o_orderkey FROM orders o JOIN gone g ON o.o_orderkey // 2 = g.o_orderkey AND o.o_orderkey <> 1)
SELECT 'orders' AS name, (SELECT count(*) FROM gone) AS lost, CAST((SELECT sum(o_orderkey) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone)) AS bigint) AS kept
UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM gone)), CAST((SELECT sum(l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone)) AS bigint)""",
)
def u8_self_reference(spark, t):
    """Orders as a hierarchy, an order below that of half its key: a branch goes with all below it, and their lines."""
    orders = t["orders"].select("o_orderkey", F.floor(F.col("o_orderkey") / 2).cast("long").alias("above"))
    orders = orders.withColumn("above", F.when(F.col("o_orderkey") > 1, F.col("above")))
    keys = [dml.ForeignKey("orders", "above", "orders", "o_orderkey"), dml.ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey")]
    found = dml.cascade_delete({"orders": orders, "lineitem": t["lineitem"].select("l_orderkey")}, "orders", F.col("o_orderkey").isin(2, 77), keys)
    parts = []
    for name, column in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        lost, kept = found[name].returning.agg(F.count("*").alias("lost")), found[name].table.agg(F.sum(column).alias("kept"))
        parts.append(lost.crossJoin(kept).select(F.lit(name).alias("name"), "lost", "kept"))  # one row each
    return parts[0].unionByName(parts[1])


@query(
    "s9_manifest",
    "SELECT 0 AS version, n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 1, n_nationkey, CASE WHEN n_regionkey = 2 THEN upper(n_name) || '!' ELSE n_name END, r_name FROM nation JOIN region ON r_regionkey = n_regionkey",
)
def s9_manifest(spark, t):
    """Two published versions of two tables, of which the second changes one; both are read as they were published."""
    path = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    first = manifest.commit(spark, path, {"nation": t["nation"], "region": t["region"]}, -1)
    held = manifest.read(spark, path, first)
    changed = dml.update(held["nation"], F.col("n_regionkey") == 2, {"n_name": F.concat(F.upper("n_name"), F.lit("!"))}).table
    second = manifest.commit(spark, path, {"nation": changed}, first)
    parts = []
    for version in (first, second):
        tables = manifest.read(spark, path, version)
        joined = tables["nation"].join(tables["region"], F.col("r_regionkey") == F.col("n_regionkey"))
        parts.append(joined.select(F.lit(version).alias("version"), "n_nationkey", "n_name", "r_name"))
    return parts[0].unionByName(parts[1])

"""Change capture, push, replay, conflicts, pull and snapshots on logs made from orders and events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import changes
from weftline.operators.ordinals import check_contiguous, settled, shared_folder
from weftline.queries.registry import QUERIES, ORACLES, query
from weftline.sources import wire
from weftline.streaming import stateful
from weftline.streaming.reactive import follow

# Events as a change log of users: an error deletes the user's row, a sign-up of an odd event moves it to a new key.
LOG = """
log AS (SELECT event_id AS ord, '{"id":"' || user_id || '"}' AS key_json, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op,
        CASE WHEN event_type = 'error' THEN NULL ELSE '{"last":"' || event_id || '","type":"' || event_type || '"}' END AS payload, user_id FROM events),
state AS (SELECT '{"id":"' || c_custkey || '"}' AS key_json, c_custkey % 9 + 1 AS row_version, CAST(c_custkey % 4 = 0 AS integer) AS deleted FROM customer WHERE c_custkey % 2 = 0)
"""


def _key(column: str):
    return F.format_string('{"id":"%s"}', F.col(column))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("schema_name", F.lit("main")).withColumn("table_name", F.lit("users"))


def _log(t) -> DataFrame:
    gone = F.col("event_type") == "error"
    payload = F.when(~gone, F.format_string('{"last":"%s","type":"%s"}', F.col("event_id"), F.col("event_type")))
    log = t["events"].select(F.col("event_id").alias("ord"), _key("user_id").alias("key_json"), F.when(gone, "DELETE").otherwise("UPDATE").alias("op"), payload.alias("payload"))
    return _named(log.withColumn("old_key_json", F.lit(None).cast("string")))


def _state(t) -> DataFrame:
    c = t["customer"].filter("c_custkey % 2 = 0")
    return _named(c.select(_key("c_custkey").alias("key_json"), (F.col("c_custkey") % 9 + 1).alias("row_version"), (F.col("c_custkey") % 4 == 0).cast("int").alias("deleted")))


def _nothing_dirty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "schema_name string, table_name string, key_json string, op string, base_row_version long, payload string, dirty_ordinal long")


def _dirty(spark, t) -> DataFrame:
    return settled(changes.fold(_log(t), _state(t), _nothing_dirty(spark)))


FOLDED = f"""WITH {LOG},
last AS (SELECT key_json, arg_max(coalesce(payload, '-'), ord) AS p, arg_max(op, ord) AS last_op, min(ord) AS first FROM log GROUP BY key_json),
dirty AS (SELECT l.key_json, CASE WHEN last_op = 'DELETE' THEN 'DELETE' WHEN deleted = 0 THEN 'UPDATE' ELSE 'INSERT' END AS op, CAST(coalesce(row_version, 0) AS bigint) AS base_row_version, nullif(p, '-') AS payload,
                 row_number() OVER (ORDER BY first) AS dirty_ordinal, deleted FROM last l LEFT JOIN state s ON s.key_json = l.key_json)"""


@query("y1_capture", FOLDED + " SELECT key_json, op, base_row_version, payload, dirty_ordinal FROM dirty")
def y1_capture(spark, t):
    return _dirty(spark, t).drop("schema_name", "table_name")


@query("y3_adopt", "SELECT table_name, key_json, row_number() OVER (ORDER BY place, key_json) AS dirty_ordinal FROM (SELECT 'region' AS table_name, 0 AS place, '{\"id\":\"' || r_regionkey || '\"}' AS key_json FROM region UNION ALL SELECT 'nation', 1, '{\"id\":\"' || n_nationkey || '\"}' FROM nation)")
def y3_adopt(spark, t):
    rows = [t[name].select(F.lit("main").alias("schema_name"), F.lit(name).alias("table_name"), _key(key).alias("key_json"), F.lit("{}").alias("payload")) for name, key in (("nation", "n_nationkey"), ("region", "r_regionkey"))]
    return changes.adopt(rows[0].unionByName(rows[1]), ["region", "nation"]).select("table_name", "key_json", "dirty_ordinal")


PREPARED = FOLDED + """,
kept AS (SELECT *, CASE WHEN payload IS NULL THEN 'DELETE' WHEN deleted = 0 THEN 'UPDATE' ELSE 'INSERT' END AS push_op FROM dirty WHERE NOT (payload IS NULL AND coalesce(deleted, 1) <> 0)),
prepared AS (SELECT key_json, push_op AS op, base_row_version, payload, dirty_ordinal, row_number() OVER (ORDER BY push_op = 'DELETE', dirty_ordinal) - 1 AS row_ordinal FROM kept)"""


@query("y5_prepare_push", PREPARED + " SELECT key_json, op, base_row_version, dirty_ordinal, row_ordinal, row_ordinal // 200 AS chunk FROM prepared")
def y5_prepare_push(spark, t):
    send, _ = changes.prepare_push(_dirty(spark, t), _state(t), ["users"])
    return changes.chunks(send, "row_ordinal", 200).select("key_json", "op", "base_row_version", "dirty_ordinal", "row_ordinal", "chunk")


@query("y5_discarded", FOLDED + " SELECT key_json FROM dirty WHERE payload IS NULL AND coalesce(deleted, 1) <> 0")
def y5_discarded(spark, t):
    return changes.prepare_push(_dirty(spark, t), _state(t), ["users"])[1].select("key_json")


@query(
    "y6_request_hash",
    PREPARED
    + """, rows AS (SELECT row_ordinal, '{"base_row_version":"' || base_row_version || '","key":' || key_json || ',"op":"' || op || '","payload":' || coalesce(payload, 'null') || ',"schema":"main","table":"users"}' AS j FROM prepared),
chunked AS (SELECT row_ordinal // 200 AS chunk, count(*) AS n, sha256('[' || string_agg(j, ',' ORDER BY row_ordinal) || ']') AS h FROM rows GROUP BY 1)
SELECT CAST(sum(n) AS bigint) AS n_rows, sha256(string_agg(h, chr(10) ORDER BY chunk)) AS request_hash, true AS verified FROM chunked""",
)
def y6_request_hash(spark, t):
    send, _ = changes.prepare_push(_dirty(spark, t), _state(t), ["users"])
    frozen = settled(changes.freeze(send))
    check_contiguous(frozen, "row_ordinal")
    return changes.verify_committed(frozen, frozen.orderBy(F.rand(3))).select("n_rows", "request_hash", "verified")


@query(
    "y6_array_hash",
    PREPARED
    + """, rows AS (SELECT row_ordinal, '{"base_row_version":"' || base_row_version || '","key":' || key_json || ',"op":"' || op || '","payload":' || coalesce(payload, 'null') || ',"schema":"main","table":"users"}' AS j FROM prepared)
SELECT count(*) AS n_rows, sha256('[' || string_agg(j, ',' ORDER BY row_ordinal) || ']') AS request_hash FROM rows""",
)
def y6_array_hash(spark, t):
    """The same bundle's hash as that of one JSON array."""
    send, _ = changes.prepare_push(_dirty(spark, t), _state(t), ["users"])
    return changes.array_hash(changes.freeze(send, 50))


@query(
    "y4_managed_order",
    """SELECT * FROM (SELECT 0 AS place, 'region' AS table_name, count(*) AS n FROM region UNION ALL SELECT 1, 'supplier', count(*) FROM supplier UNION ALL SELECT 2, 'nation', count(*) FROM nation
UNION ALL SELECT 3, 'customer', count(*) FROM customer UNION ALL SELECT 4, 'orders', count(*) FROM orders UNION ALL SELECT 5, 'lineitem', count(*) FROM lineitem)""",
)
def y4_managed_order(spark, t):
    """Tables given in another order, in the order of their references, with the rows that a first push would send."""
    refer = lambda table, column, parent, key: changes.Reference(table, (column,), parent, (key,))
    references = [refer("lineitem", "l_orderkey", "orders", "o_orderkey"), refer("Orders", "o_custkey", "CUSTOMER", "c_custkey"), refer("customer", "c_nationkey", "nation", "n_nationkey"), refer("nation", "n_regionkey", "region", "r_regionkey"), refer("nation", "n_nationkey", "nation", "n_nationkey")]
    order = changes.managed_order(["lineitem", "orders", "region", "supplier", "customer", "nation"], references)
    parts = [t[name].agg(F.lit(place).alias("place"), F.lit(name).alias("table_name"), F.count("*").alias("n")) for place, name in enumerate(order)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "y9_replay",
    f"""WITH {LOG},
up AS (SELECT key_json, arg_max(coalesce(payload, '-'), ord) AS p, arg_max(op, ord) AS o FROM log WHERE ord % 2 = 0 GROUP BY key_json),
live AS (SELECT key_json, arg_max(coalesce(payload, '-'), ord) AS p FROM log GROUP BY key_json),
j AS (SELECT up.key_json, CASE WHEN up.o = 'DELETE' THEN 'DELETE' ELSE 'UPDATE' END AS op, nullif(up.p, '-') AS sent, nullif(live.p, '-') AS now FROM up LEFT JOIN live USING (key_json)),
q AS (SELECT *, CASE WHEN op = 'DELETE' THEN CASE WHEN now IS NOT NULL THEN 'INSERT' END WHEN now IS NULL THEN 'DELETE' WHEN now <> sent THEN 'UPDATE' END AS requeue_op FROM j)
SELECT key_json, CASE WHEN requeue_op IS NULL THEN 'AcceptAuthoritative' ELSE 'PreserveLocal' END AS action, requeue_op, CASE WHEN requeue_op IN ('INSERT', 'UPDATE') THEN now END AS requeue_payload FROM q""",
)
def y9_replay(spark, t):
    """Rows of even events were uploaded; odd ones happened meanwhile."""
    last = lambda log: changes.latest_rows(log, changes.KEY, ["ord"])
    sent = last(_log(t).filter("ord % 2 = 0"))
    live = last(_log(t)).filter("payload is not null")
    return changes.replay_plan(sent, _nothing_dirty(spark), live).drop("schema_name", "table_name")


@query(
    "y10_conflicts",
    """WITH held AS (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS v FROM orders GROUP BY 1),
c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'UPDATE' ELSE 'DELETE' END AS op, CASE WHEN n IS NULL THEN 'Missing' WHEN n % 4 = 0 THEN 'Deleted' ELSE 'Present' END AS state,
  CASE c_nationkey % 3 WHEN 0 THEN 'AcceptServer' WHEN 1 THEN 'KeepLocal' ELSE 'KeepMerged' END AS result, v FROM customer LEFT JOIN held ON o_custkey = c_custkey),
e AS (SELECT *, CASE WHEN result = 'KeepMerged' AND (op = 'DELETE' OR c_custkey % 5 = 0) THEN 'bad' WHEN result <> 'AcceptServer' AND op = 'INSERT' AND state = 'Missing' THEN 'bad' WHEN result <> 'AcceptServer' AND op = 'UPDATE' AND state <> 'Present' THEN 'bad' END AS bad FROM c)
SELECT '{"id":"' || c_custkey || '"}' AS key_json, CASE WHEN bad IS NULL THEN CASE WHEN result <> 'AcceptServer' AND op <> 'DELETE' THEN 'Upsert' WHEN result = 'AcceptServer' AND state = 'Present' THEN 'Upsert' ELSE 'Delete' END END AS local_action,
CASE WHEN bad IS NULL THEN CASE WHEN result = 'KeepMerged' THEN '{"id":"m"}' WHEN result = 'KeepLocal' AND op <> 'DELETE' THEN '{"id":"l' || c_custkey || '"}' WHEN result = 'AcceptServer' AND state = 'Present' THEN '{"id":"s' || v || '"}' END END AS new_payload,
CASE WHEN bad IS NULL THEN CASE WHEN result <> 'AcceptServer' AND op <> 'DELETE' THEN CASE WHEN state = 'Present' THEN 'UPDATE' ELSE 'INSERT' END WHEN result <> 'AcceptServer' AND state = 'Present' THEN 'DELETE' END END AS requeue_op,
CASE WHEN bad IS NULL AND state <> 'Missing' THEN CAST(v AS bigint) END AS state_version, bad IS NOT NULL AS invalid FROM e""",
)
def y10_conflicts(spark, t):
    """Customers as local rows against the server's, made of their orders; all cells of the decision table occur."""
    choose = lambda n, names: F.element_at(F.array(*[F.lit(x) for x in names]), (n % 3 + 1).cast("int"))
    held = t["orders"].groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").cast("long").alias("server_version"))
    met = t["customer"].join(held, F.col("o_custkey") == F.col("c_custkey"), "left")
    op = choose(F.col("c_custkey"), ["INSERT", "UPDATE", "DELETE"])
    rows = met.select(
        _key("c_custkey").alias("key_json"),
        op.alias("local_op"),
        F.when(op != "DELETE", F.format_string('{"id":"l%s"}', "c_custkey")).alias("local_payload"),
        F.when(F.col("n").isNull(), "Missing").when(F.col("n") % 4 == 0, "Deleted").otherwise("Present").alias("server_state"),
        "server_version",
        F.format_string('{"id":"s%s"}', "server_version").alias("server_payload"),
        choose(F.col("c_nationkey"), ["AcceptServer", "KeepLocal", "KeepMerged"]).alias("result"),
        F.when(F.col("c_custkey") % 5 == 0, '{"other":"m"}').otherwise('{"id":"m"}').alias("merged_payload"),
    )
    found = changes.resolve_conflicts(_named(rows), ["ID"])
    return found.select("key_json", "local_action", "new_payload", "requeue_op", "state_version", F.col("error").isNotNull().alias("invalid"))


def _bundles(t) -> DataFrame:
    """Ten events a bundle; the version of a row is the number of its event."""
    log = _log(t)
    return log.select("schema_name", "table_name", "key_json", F.when(F.col("op") == "DELETE", "DELETE").otherwise("UPDATE").alias("op"), (F.col("ord") + 1).alias("row_version"), "payload", F.floor(F.col("ord") / 10 + 1).alias("bundle_seq"), (F.col("ord") % 10).alias("row_ordinal"))


PULLED = f"""WITH {LOG},
last AS (SELECT key_json, arg_max(op, ord) AS op, max(ord) + 1 AS v, arg_max(coalesce(payload, '-'), ord) AS p FROM log GROUP BY key_json),
held AS (SELECT key_json, row_version * 300 AS row_version, deleted FROM state),
fresh AS (SELECT l.* FROM last l LEFT JOIN held h USING (key_json) WHERE h.row_version IS NULL OR h.row_version < l.v),
live AS (SELECT key_json, 'old' AS payload FROM held WHERE deleted = 0)"""


@query("y11_pull_rows", PULLED + " SELECT key_json, payload FROM live WHERE key_json NOT IN (SELECT key_json FROM fresh) UNION ALL SELECT key_json, p FROM fresh WHERE op <> 'DELETE'")
def y11_pull_rows(spark, t):
    state = _state(t).withColumn("row_version", F.col("row_version") * 300)
    live = state.filter("deleted = 0").withColumn("payload", F.lit("old"))
    return changes.pull(live, state, _nothing_dirty(spark), _bundles(t))[0].select("key_json", "payload")


@query("y11_pull_state", PULLED + " SELECT key_json, CAST(row_version AS bigint) AS row_version, deleted FROM held WHERE key_json NOT IN (SELECT key_json FROM fresh) UNION ALL SELECT key_json, v, CAST(op = 'DELETE' AS integer) FROM fresh")
def y11_pull_state(spark, t):
    state = _state(t).withColumn("row_version", F.col("row_version") * 300)
    live = state.filter("deleted = 0").withColumn("payload", F.lit("old"))
    return changes.pull(live, state, _nothing_dirty(spark), _bundles(t))[1].select("key_json", "row_version", "deleted")


@query("y11_bundle_problems", "SELECT event_id // 10 + 1 AS bundle_seq, 'bundle_seq is not above the last one applied' AS problem FROM events WHERE event_id < 50 UNION ALL SELECT event_id // 10 + 1, 'bundle_seq is above the stable one' FROM events WHERE event_id >= 2900")
def y11_bundle_problems(spark, t):
    return changes.check_bundles(_bundles(t), 5, 290)


@query("y12_snapshot", "SELECT '{\"id\":\"' || c_custkey || '\"}' AS key_json, c_name AS payload, CAST(c_custkey + 1 AS bigint) AS row_version FROM customer")
def y12_snapshot(spark, t):
    stage = _named(t["customer"].select(_key("c_custkey").alias("key_json"), F.col("c_name").alias("payload"), (F.col("c_custkey") + 1).alias("row_version")))
    live, state = changes.rebuild(stage, t["customer"].count())
    return live.join(state, changes.KEY).select("key_json", "payload", "row_version")


@query(
    "o9_contract_diff",
    """WITH c AS (SELECT 'main.' || lower(c_name) AS t, 'k' || c_custkey % 7 AS k FROM customer),
s AS (SELECT 'main.' || lower(c_name) AS t, 'k' || min(o_orderkey) % 7 AS k FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name UNION ALL SELECT 'main.part ' || p_partkey, 'p' FROM part)
SELECT t AS "table", 'client only' AS problem FROM c WHERE t NOT IN (SELECT t FROM s) UNION ALL SELECT t, 'server only' FROM s WHERE t NOT IN (SELECT t FROM c)
UNION ALL SELECT c.t, 'key differs' FROM c JOIN s ON s.t = c.t AND s.k <> c.k""",
)
def o9_contract_diff(spark, t):
    """Each customer as a table that the client knows; the server knows those with orders, in capitals, and one for each part."""
    held = t["orders"].groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    named = lambda df, schema, table, key: df.select(F.lit(schema).alias("schema_name"), table.alias("table_name"), key.alias("key_columns"))
    client = named(t["customer"], "main", F.col("c_name"), F.format_string("k%s", F.col("c_custkey") % 7))
    known = named(t["customer"].join(held, F.col("o_custkey") == F.col("c_custkey")), "MAIN", F.upper("c_name"), F.format_string("K%s", F.col("first") % 7))
    return changes.contract_diff(client, known.unionByName(named(t["part"], "main", F.format_string("part %s", "p_partkey"), F.lit("p"))))


@query(
    "o9_spec_problems",
    """WITH s AS (SELECT CASE WHEN o_custkey % 50 = 0 THEN '' ELSE 'main' END AS s, CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE 'c' || o_custkey END AS t, CASE o_orderkey % 11 WHEN 0 THEN 'a,b' WHEN 1 THEN 'a,' ELSE 'a' END AS k FROM orders),
g AS (SELECT s, trim(t) AS t, count(*) AS n, count(*) FILTER (WHERE k <> 'a') AS several, count(*) FILTER (WHERE k = 'a,') AS blank FROM s GROUP BY 1, 2)
SELECT s || '.' || t AS "table", problem FROM (SELECT s, t, unnest([CASE WHEN s = '' THEN 'schema is empty' END, CASE WHEN t = '' THEN 'table is empty' END, CASE WHEN blank > 0 THEN 'a key column is empty' END, CASE WHEN several > 0 THEN 'more than one key column' END, CASE WHEN n > 1 THEN 'given twice' END]) AS problem FROM g) WHERE problem IS NOT NULL""",
)
def o9_spec_problems(spark, t):
    """Orders as table specs, some without a name, with two keys or given twice."""
    schema = F.when(F.col("o_custkey") % 50 == 0, "").otherwise("MAIN")
    table = F.when(F.col("o_orderkey") % 9 == 0, " ").otherwise(F.format_string("C%s", "o_custkey"))
    keys = F.when(F.col("o_orderkey") % 11 == 0, "a,b").when(F.col("o_orderkey") % 11 == 1, "a,").otherwise("a")
    return changes.spec_problems(t["orders"].select(schema.alias("schema_name"), table.alias("table_name"), keys.alias("key_columns")))


def r3_stream_of_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a stream: each batch folds into the state before it, and the last state is the result."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema

    def apply(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), "event_id").alias("x"), F.count("*").alias("n")).select("user_id", "x.*", "n")
        if number:
            last = last.unionByName(batch.sparkSession.read.parquet(f"{base}/state/{number - 1}"))
        folded = last.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"), F.sum("n").alias("n"))
        folded.write.mode("overwrite").parquet(f"{base}/state/{number}")

    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    running = follow(events.select("event_id", "user_id", "event_type"), apply, f"{base}/checkpoint")
    running.awaitTermination()
    return spark.read.parquet(f"{base}/state/{running.lastProgress['batchId']}").select("user_id", "event_type", "event_id", "n")


QUERIES["r3_stream_of_changes"] = r3_stream_of_changes
ORACLES["r3_stream_of_changes"] = "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id, count(*) AS n FROM events GROUP BY user_id"


def r6_windowed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type from a stream with a watermark; each batch replaces the table of totals."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("at", F.col("ts").cast("timestamp"))
    counted = events.withWatermark("at", "1 hour").groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    flat = counted.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "last")
    writer = flat.writeStream.outputMode("complete").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/hours"))
    writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/hours")


def y1_stateful_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a stream whose state is kept by Spark, key by key: an error deletes, anything else writes."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    gone = F.col("event_type") == "error"
    log = events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("ord"), F.when(gone, "DELETE").otherwise("WRITE").alias("op"), F.when(~gone, F.col("props")).alias("payload"))
    stateful.start(log, base).awaitTermination()
    return stateful.states(spark.read.parquet(f"{base}/moved"))


QUERIES["y1_stateful_stream"] = y1_stateful_stream
ORACLES["y1_stateful_stream"] = (
    "SELECT CAST(user_id AS varchar) AS key, max(event_id) AS ord, CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'DELETE' ELSE 'WRITE' END AS op,"
    " CASE WHEN arg_max(event_type, event_id) <> 'error' THEN arg_max(props, event_id) END AS payload, count(*) AS changes FROM events GROUP BY user_id"
)


QUERIES["r6_windowed_stream"] = r6_windowed_stream
ORACLES["r6_windowed_stream"] = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1, 2"


@query(
    "y6_push_batches",
    PREPARED.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, rows AS (SELECT row_ordinal, strlen('{"base_row_version":"' || base_row_version || '","key":' || key_json || ',"op":"' || op || '","payload":' || coalesce(payload, 'null') || ',"schema":"main","table":"users"}') AS size FROM prepared),
held AS (SELECT list(size ORDER BY row_ordinal) AS sizes FROM rows),
walk(i, batch, n, bytes, first) AS (SELECT CAST(0 AS bigint), CAST(0 AS bigint), CAST(1 AS bigint), CAST(sizes[1] AS bigint), CAST(0 AS bigint) FROM held WHERE len(sizes) > 0
  UNION ALL SELECT i + 1, CASE WHEN shut THEN batch + 1 ELSE batch END, CASE WHEN shut THEN 1 ELSE n + 1 END, CASE WHEN shut THEN size ELSE bytes + size END, CASE WHEN shut THEN i + 1 ELSE first END
  FROM (SELECT walk.*, CAST(sizes[i + 2] AS bigint) AS size, n + 1 > 50 OR bytes + sizes[i + 2] > 4096 AS shut FROM walk, held WHERE i + 2 <= len(sizes)))
SELECT batch, max(n) AS n, min(first) AS first FROM walk GROUP BY batch""",
)
def y6_push_batches(spark, t):
    send, _ = changes.prepare_push(_dirty(spark, t), _state(t), ["users"])
    batches = changes.push_batches(changes.freeze(send), 50, 4096)
    return batches.groupBy("batch").agg(F.count("*").alias("n"), F.min("row_ordinal").alias("first"))


SYNCED = {"region": ["R_NAME"], "nation": ["n_name"], "customer": ["c_name"], "part": ["p_name"], "events": ["event_type"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"]}


@query(
    "y17_synced_tables",
    " UNION ALL ".join(
        f"SELECT '{name}' AS name, '{key}' AS key_column, CAST(coalesce(sum(n), 0) AS bigint) AS n_rows, CAST(coalesce(sum(n) FILTER (WHERE k IS NULL), 0) AS bigint) AS n_null, count(*) FILTER (WHERE n > 1 AND k IS NOT NULL) AS n_repeated FROM (SELECT {key} AS k, count(*) AS n FROM {name} GROUP BY 1)"
        for name, key in (("region", "r_name"), ("nation", "n_name"), ("customer", "c_name"), ("part", "p_name"), ("events", "event_type"))
    ),
)
def y17_synced_tables(spark, t):
    """Tables whose key is of a kind that may take part, and whether the values in it are a key."""
    out = None
    for name, key in SYNCED.items():
        try:
            column = changes.check_synced(t[name], name, key)
        except ValueError:
            continue
        part = changes.key_state(t[name], column).select(F.lit(name).alias("name"), F.lit(column).alias("key_column"), "n_rows", "n_null", "n_repeated")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "y5_parents_first",
    """WITH log AS (SELECT 'orders' AS table_name, 0 AS place, '{"id":"' || o_orderkey || '"}' AS key_json, o_orderkey * 10 AS ord, o_orderstatus = 'F' AS gone FROM orders
UNION ALL SELECT 'lines', 1, '{"id":"' || l_orderkey || '-' || l_linenumber || '"}', min(l_orderkey) * 10 + min(l_linenumber), bool_or(l_returnflag = 'R') FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT table_name, key_json, CASE WHEN gone THEN 'DELETE' ELSE 'UPDATE' END AS op, row_number() OVER (ORDER BY gone, CASE WHEN gone THEN -place ELSE place END, ord, table_name DESC) - 1 AS row_ordinal FROM log""",
)
def y5_parents_first(spark, t):
    """Orders and their lines in one push: orders are written before lines and deleted after them."""
    orders = t["orders"].select(F.lit("orders").alias("table_name"), _key("o_orderkey").alias("key_json"), (F.col("o_orderkey") * 10).alias("ord"), (F.col("o_orderstatus") == "F").alias("gone"))
    lines = t["lineitem"].groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_returnflag") == "R").alias("gone"))
    lines = lines.select(F.lit("lines").alias("table_name"), F.format_string('{"id":"%s-%s"}', "l_orderkey", "l_linenumber").alias("key_json"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), "gone")
    log = orders.unionByName(lines).withColumn("schema_name", F.lit("main")).withColumn("old_key_json", F.lit(None).cast("string"))
    log = log.withColumn("op", F.when(F.col("gone"), "DELETE").otherwise("UPDATE")).withColumn("payload", F.when(~F.col("gone"), "{}"))
    state = log.select(*changes.KEY, F.lit(1).cast("long").alias("row_version"), F.lit(0).alias("deleted"))
    dirty = settled(changes.fold(log, state, _nothing_dirty(spark)))
    send, _ = changes.prepare_push(dirty, state, ["orders", "lines"])
    return send.select("table_name", "key_json", "op", "row_ordinal")


@query(
    "y13_recovery",
    "SELECT c_custkey, CASE WHEN c_custkey % 97 > 80 THEN 'rebuild: checkpoint ahead' WHEN c_custkey % 97 < 19 THEN 'rebuild: history pruned' ELSE 'pull' END AS step FROM customer",
)
def y13_recovery(spark, t):
    """Clients with different checkpoints against bundles 20 to 80."""
    seq = F.col("c_custkey") % 97
    return t["customer"].select("c_custkey", changes.recovery_step(seq, F.lit(20), F.lit(80)).alias("step"))


@query(
    "y23_counts",
    FOLDED + """, pulled AS (SELECT key_json, max(ord) + 1 AS v, arg_max(op, ord) AS op FROM log GROUP BY key_json),
after AS (SELECT key_json, CASE WHEN p.key_json IS NOT NULL AND (row_version IS NULL OR row_version < p.v) THEN CAST(p.op = 'DELETE' AS integer) ELSE deleted END AS deleted FROM state FULL JOIN pulled p USING (key_json))
SELECT (SELECT count(*) FROM state) AS known_before, (SELECT count(*) FROM state WHERE deleted = 0) AS live_before, (SELECT count(*) FROM dirty) AS dirty_before,
(SELECT count(*) FROM after) AS known_after, (SELECT count(*) FROM after WHERE deleted = 0) AS live_after,
(SELECT count(*) FROM dirty d LEFT JOIN state s USING (key_json) JOIN pulled p USING (key_json) WHERE NOT (s.row_version IS NULL OR s.row_version < p.v)) AS dirty_after""",
)
def y23_counts(spark, t):
    """Rows known, live and waiting before and after a pull of the whole log."""
    state, dirty = _state(t), _dirty(spark, t)
    live = state.filter("deleted = 0").withColumn("payload", F.lit("old"))
    _, new_state, new_dirty = changes.pull(live, state, dirty, _bundles(t))
    return changes.round_counts((state, dirty), (new_state, new_dirty))


@query(
    "y18_strict_decode",
    """SELECT event_id, CASE event_id % 10 WHEN 2 THEN 'duplicate member' WHEN 3 THEN 'row_version is no long' WHEN 4 THEN 'row_version is no long' WHEN 5 THEN 'unknown member'
WHEN 6 THEN 'missing member' WHEN 7 THEN 'duplicate member' WHEN 8 THEN 'too deep' WHEN 9 THEN 'key is no strings' END AS problem,
CASE WHEN event_id % 10 < 2 THEN event_id END AS row_version, CASE WHEN event_id % 10 < 2 THEN 'e' || event_id END AS key_id,
CASE WHEN event_id % 10 < 2 THEN CAST(json_extract_string(props, '$.k') AS bigint) END AS k FROM events""",
)
def y18_strict_decode(spark, t):
    """All events as change rows, each of ten wrong or right in its own way."""
    parts = {
        2: '{"schema":"main","table":"events","key":{"id":"e%d"},"row_version":%d,"payload":%s,"table":"events"}',
        3: '{"schema":"main","table":"events","key":{"id":"e%d"},"row_version":%d.0,"payload":%s}',
        4: '{"schema":"main","table":"events","key":{"id":"e%d"},"row_version":%d00000000000000000000,"payload":%s}',
        5: '{"schema":"main","table":"events","key":{"id":"e%d"},"row_version":%d,"payload":%s,"more":null}',
        6: '{"schema":"main","table":"events","key":{"id":"e%d"},"row_version":%d}',
        7: '{"schema":"main","table":"events","key":{"id":"e%d"},"row_version":%d,"payload":{"a":%s,"b":[{"x":1,"x":1}]}}',
        8: '{"schema":"main","table":"events","key":{"id":"e%d"},"row_version":%d,"payload":{"a":' + "[" * 127 + "%s" + "]" * 127 + "}}",
        9: '{"schema":"main","table":"events","key":{"id":%d},"row_version":%d,"payload":%s}',
    }
    text = F.format_string('{"schema":"main","table":"events","key":{"id":"e%d"},"row_version":%d,"payload":%s}', "event_id", "event_id", "props")
    for case, pattern in parts.items():
        columns = ["event_id", "event_id", "props"] if case != 6 else ["event_id", "event_id"]
        text = F.when(F.col("event_id") % 10 == case, F.format_string(pattern, *columns)).otherwise(text)
    found = wire.decode(t["events"].select("event_id", text.alias("text")))
    return found.select("event_id", "problem", "row.row_version", F.col("row.key")["id"].alias("key_id"), F.get_json_object("row.payload", "$.k").cast("long").alias("k"))


@query(
    "y9_typed_payloads",
    """SELECT event_id, event_id % 5 IN (0, 1) AS typed, event_id % 5 = 0 AND event_id % 2 = 0 AS plain FROM events""",
)
def y9_typed_payloads(spark, t):
    """Each event as a local payload and as one from the wire, spelled differently; of five one has another number, one another text, one other bytes."""
    raw = F.encode(F.concat_ws("-", "event_type", "event_id"), "UTF-8")
    kind, other = F.col("event_id") % 5, F.col("event_id") % 2 == 1
    number = F.round("value", 2) + F.when(kind == 2, 1).otherwise(0)
    local = F.format_string('{"id":"%d","amount":%s,"kind":"%s","raw":"%s","seen":%s}', "event_id", F.round("value", 2).cast("decimal(20,2)").cast("string"), "event_type", F.lower(F.hex(raw)), F.when(other, "true").otherwise("false"))
    flag = F.when(other, "1").otherwise("0")
    wire = F.format_string(
        '{"seen":"%s","raw":"%s","kind":"%s","amount":"%s","id":"%d"}', flag, F.base64(F.when(kind == 4, F.encode(F.lit("x"), "UTF-8")).otherwise(raw)), F.concat("event_type", F.when(kind == 3, "!").otherwise("")), number.cast("decimal(20,2)").cast("string"), "event_id"
    )
    kinds = {"id": changes.INTEGER, "amount": changes.REAL, "kind": changes.TEXT, "raw": changes.BLOB, "seen": changes.INTEGER}
    # the same JSON in another order, and one whose number is a text
    nested = F.format_string('{"a":{"x":1,"y":[%d,"%s"]},"b":null}', "event_id", "event_type")
    turned = F.format_string('{"b":null,"a":{"y":[%s,"%s"],"x":1}}', F.when(other, F.format_string('"%d"', "event_id")).otherwise(F.col("event_id").cast("string")), F.when(kind == 0, F.col("event_type")).otherwise("none"))
    # decoding costs much more than reading: rows are dealt to all tasks, in however few files they lie
    dealt = t["events"].select("event_id", "event_type", "value").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    return dealt.select("event_id", changes.same_payload(local, wire, kinds, (False, True)).alias("typed"), changes.same_payload(nested, turned).alias("plain"))

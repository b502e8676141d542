import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import codec
from weftline.operators import changes, dml
from weftline.operators.ordinals import after_key, bounded_page, check_contiguous, chunks, with_ordinals
from weftline.operators.tables import affected_by_read, affected_by_write, load_version, migrate, parent_first, register_views, save_version
from weftline.sources.bundles import notifications, read_bundles, stream_bundles, write_bundles
from weftline.sources.tables import pages
from weftline.streaming.reactive import Versions, Watch, follow

LOG = "schema_name string, table_name string, key_json string, op string, payload string, ord long, old_key_json string"
STATE = "schema_name string, table_name string, key_json string, row_version long, deleted int"
DIRTY = "schema_name string, table_name string, key_json string, op string, base_row_version long, payload string, dirty_ordinal long"


def key(name):
    return json.dumps({"id": name}, separators=(",", ":"))


def folded(spark, log, state=(), dirty=()):
    rows = changes.fold(
        spark.createDataFrame([("main", "users", key(k), op, p, i, key(old) if old else None) for i, (k, op, p, old) in enumerate(log)], LOG),
        spark.createDataFrame([("main", "users", key(k), v, d) for k, v, d in state], STATE),
        spark.createDataFrame([("main", "users", key(k), *rest) for k, *rest in dirty], DIRTY),
    )
    return sorted(((json.loads(r.key_json)["id"], r.op, r.base_row_version, r.payload, r.dirty_ordinal) for r in rows.collect()), key=lambda r: r[4])


def test_transitions(spark):
    assert folded(spark, [("a", "INSERT", "{}", None)]) == [("a", "INSERT", 0, "{}", 1)]
    assert folded(spark, [("a", "UPDATE", '{"n":1}', None)], [("a", 7, 0)]) == [("a", "UPDATE", 7, '{"n":1}', 1)]
    assert folded(spark, [("a", "DELETE", None, None)], [("a", 7, 0)]) == [("a", "DELETE", 7, None, 1)]
    # a row that moves to another key
    assert folded(spark, [("new", "UPDATE", "{}", "old")], [("old", 3, 0)]) == [("old", "DELETE", 3, None, 1), ("new", "INSERT", 0, "{}", 2)]
    # a tombstone is written anew, and what is dirty keeps base and place
    assert folded(spark, [("a", "UPDATE", "{}", None), ("b", "INSERT", "{}", None)], [("a", 5, 1)], [("b", "UPDATE", 2, "x", 4), ("z", "DELETE", 1, None, 3)]) == [("z", "DELETE", 1, None, 3), ("b", "INSERT", 2, "{}", 4), ("a", "INSERT", 5, "{}", 5)]
    # the last change of a key counts, in the place of its first
    assert folded(spark, [("a", "INSERT", "1", None), ("b", "INSERT", "1", None), ("a", "UPDATE", "2", None), ("b", "DELETE", None, None)]) == [("a", "INSERT", 0, "2", 1), ("b", "DELETE", 0, None, 2)]
    with pytest.raises(changes.TransitionPending):
        changes.guard_write(True, False)
    changes.guard_write(True, True)


def test_push_order_and_discards(spark):
    dirty = spark.createDataFrame(
        [("main", t, key(k), "x", 0, p, o) for t, k, p, o in [("posts", 1, "{}", 1), ("users", 2, "{}", 2), ("users", 3, None, 3), ("posts", 4, None, 4), ("users", 5, None, 5)]], DIRTY
    )
    state = spark.createDataFrame([("main", "users", key(3), 1, 0), ("main", "posts", key(4), 1, 0), ("main", "users", key(2), 1, 1), ("main", "users", key(5), 1, 1)], STATE)
    send, gone = changes.prepare_push(dirty, state, ["users", "posts"])
    got = [(r.table_name, r.op, r.row_ordinal) for r in send.orderBy("row_ordinal").collect()]
    assert got == [("users", "INSERT", 0), ("posts", "INSERT", 1), ("posts", "DELETE", 2), ("users", "DELETE", 3)]
    assert [json.loads(r.key_json)["id"] for r in gone.collect()] == [5]
    frozen = changes.freeze(send, 3)
    assert [r.chunk for r in frozen.orderBy("row_ordinal").collect()] == [0, 0, 0, 1]
    assert changes.verify_committed(frozen, frozen).first().verified
    assert not changes.verify_committed(frozen, frozen.filter("row_ordinal < 3")).first().verified


def test_replay_cells(spark):
    rows = [("del-live", "DELETE", None, None, "{}"), ("del-gone", "DELETE", None, None, None), ("up-gone", "UPDATE", "{}", None, None), ("up-same", "UPDATE", '{"a":1,"b":2}', None, '{"b":2,"a":1}'), ("up-other", "UPDATE", '{"a":1}', None, '{"a":2}'), ("up-pending", "UPDATE", '{"a":1}', '{"a":3}', '{"a":1}'), ("up-pending-same", "UPDATE", '{"a":1}', '{"a":1}', '{"a":1}')]
    up = spark.createDataFrame([("main", "users", k, op, p) for k, op, p, _, _ in rows], "schema_name string, table_name string, key_json string, op string, payload string")
    pending = spark.createDataFrame([("main", "users", k, "UPDATE", 0, w, 1) for k, _, _, w, _ in rows if w], DIRTY)
    live = spark.createDataFrame([("main", "users", k, now) for k, _, _, _, now in rows if now], "schema_name string, table_name string, key_json string, payload string")
    got = {r.key_json: r.requeue_op for r in changes.replay_plan(up, pending, live).collect()}
    assert got == {"del-live": "INSERT", "del-gone": None, "up-gone": "DELETE", "up-same": None, "up-other": "UPDATE", "up-pending": "UPDATE", "up-pending-same": None}


def test_snapshot_must_be_complete(spark):
    stage = spark.createDataFrame([(0, "main", "users", "a", 1, "{}"), (1, "main", "users", "a", 1, "{}")], "row_ordinal long, schema_name string, table_name string, key_json string, row_version long, payload string")
    with pytest.raises(ValueError, match="1 keys"):
        changes.rebuild(stage, 2)
    live, state = changes.rebuild(stage.limit(1), 1)
    assert live.count() == 1 and state.first().deleted == 0


def test_fingerprint_and_round(spark):
    dirty = spark.createDataFrame([("main", "users", key(1), "INSERT", 0, "{}", 1)], DIRTY)
    none = dirty.limit(0)
    assert changes.fingerprint(dirty, none) != changes.fingerprint(none, dirty) and changes.fingerprint(dirty, none) == changes.fingerprint(dirty, none)
    live = spark.createDataFrame([("main", "users", key(1), "{}")], "schema_name string, table_name string, key_json string, payload string")
    sent = []
    bundles = spark.createDataFrame([(1, 0, "main", "users", key(1), "INSERT", 4, "{}"), (1, 1, "main", "users", key(2), "INSERT", 1, "{}")], "bundle_seq long, row_ordinal long, schema_name string, table_name string, key_json string, op string, row_version long, payload string")
    rows, state, left = changes.sync_round(live, spark.createDataFrame([], STATE), dirty, ["users"], lambda f: sent.append(f.count()), lambda: bundles)
    assert sent == [1] and rows.count() == 2 and state.count() == 2 and left.count() == 0


def test_bundle_files_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([(s, i, "main", "users", key(i), "INSERT", s, "{}") for s in (1, 2) for i in (0, 1)], "bundle_seq long, row_ordinal long, schema_name string, table_name string, key_json string, op string, row_version long, payload string")
    write_bundles(rows, str(tmp_path / "in"))
    back = read_bundles(spark, str(tmp_path / "in"))
    assert sorted(map(tuple, back.select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    assert read_bundles(spark, str(tmp_path / "in"), after_seq=1).count() == 2
    seen = []
    follow(stream_bundles(spark, str(tmp_path / "in")), lambda batch, n: seen.append(batch.count()), str(tmp_path / "c")).awaitTermination()
    assert sum(seen) == 4


def test_notifications(spark):
    text = ": hello\nevent: bundle\ndata: {\"seq\":\ndata: 1}\n\ndata:x\r\n\r\nevent: ping\n\nevent: cut\ndata: off"
    got = [tuple(r) for r in notifications(spark.createDataFrame([(text,)], "value string")).collect()]
    assert got == [("bundle", '{"seq":\n1}'), ("message", "x")]


def test_numbers_and_json():
    cases = {5e-324: "5e-324", 1.7976931348623157e308: "1.7976931348623157e+308", -0.0: "0", 1.0: "1", 1.2345678901234567: "1.2345678901234567", 1e21: "1e+21", 1e20: "100000000000000000000", 123456789012345680000.0: "123456789012345680000", 1e-6: "0.000001", 1e-7: "1e-7", -12.5: "-12.5", 333333333.33333329: "333333333.3333333", 0.1: "0.1", 1e-27: "1e-27", 9007199254740993.0: "9007199254740992"}
    assert {x: codec.number_text(x) for x in cases} == cases
    for x in (float("nan"), float("inf")):
        with pytest.raises(ValueError):
            codec.number_text(x)
    assert codec.canonical_json({"€": 1, "\r": 2, "1": [True, None, "a\"\\\n\u0007é"], "\U0001f600": {}, "דּ": 0.5}) == '{"\\r":2,"1":[true,null,"a\\"\\\\\\n\\u0007é"],"€":1,"\U0001f600":{},"דּ":0.5}'


def test_codecs(spark):
    df = spark.createDataFrame([("-9223372036854775808",), ("0",), (None,)], "x string")
    assert [r[0] for r in df.select(codec.int64_text(F.col("x"))).collect()] == [-(2**63), 0, None]
    for bad in ("01", "-0", "1.0", "9223372036854775808", " 1", ""):
        with pytest.raises(Exception, match="invalid canonical signed-64"):
            spark.createDataFrame([(bad,)], "x string").select(codec.int64_text(F.col("x"))).collect()
    local = spark.createDataFrame([("\\x0aFF",), ("Cv8=",), ("00112233-4455-6677-8899-aabbccddeeff",), ("",)], "x string")
    assert [bytes(r[0]).hex() for r in local.select(codec.local_blob(F.col("x"))).collect()] == ["0aff", "0aff", "00112233445566778899aabbccddeeff", ""]
    with pytest.raises(Exception, match="Base64"):
        spark.createDataFrame([("Cv8",)], "x string").select(codec.wire_blob(F.col("x"))).collect()
    with pytest.raises(Exception, match="UUID"):
        spark.createDataFrame([("00112233-4455-6677-8899-AABBCCDDEEFF",)], "x string").select(codec.wire_uuid(F.col("x"))).collect()


def test_ordinals_pages_chunks(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    numbered = with_ordinals(df, [F.col("k").desc()], "n", 5)
    assert {(r.k, r.n) for r in numbered.collect()} == {(k, 1004 - k) for k in range(1000)}
    check_contiguous(with_ordinals(df, [F.col("k")], "n"), "n")
    with pytest.raises(ValueError, match="not contiguous"):
        check_contiguous(numbered, "n")
    assert [r.k for r in after_key(df, "k", 7, 3).collect()] == [8, 9, 10] and after_key(df, "k", None, 1).first().k == 0
    assert chunks(spark.range(5), "id", 2).agg(F.max("chunk")).first()[0] == 2
    assert [r.id for r in bounded_page(spark.range(50), "id", F.lit(10), 8, 35).collect()] == [0, 1, 2]
    with pytest.raises(Exception, match="too large"):
        bounded_page(spark.range(50), "id", F.lit(100), 8, 35).collect()
    assert [len(p) for p in pages(spark.range(130), 64)] == [64, 64, 2]


def test_dml(spark):
    table = spark.createDataFrame([(1, "a", 10), (2, "b", None)], "id long, name string, n int")
    done = dml.insert(table, spark.createDataFrame([(3,)], "id long"), {"name": F.lit("new")})
    assert [tuple(r) for r in done.columns("id", "name").collect()] == [(3, "new")] and done.table.count() == 3
    with pytest.raises(ValueError, match="no columns"):
        done.columns("id", "nope")
    with pytest.raises(ValueError, match="no columns"):
        dml.insert(table, spark.createDataFrame([(3,)], "nope long"))
    changed = dml.update(table, F.col("n") > 5, {"n": F.col("n") + 1})
    assert sorted(map(tuple, changed.table.collect())) == [(1, "a", 11), (2, "b", None)] and changed.returning.count() == 1
    gone = dml.delete(table, F.col("n") > 5)
    assert [r.id for r in gone.table.collect()] == [2] and gone.returning.first().id == 1
    assert dml.delete_matching(table, table.limit(0).select("id"), ["id"]).table.count() == 2
    circle = dml.cascade_delete({"a": table, "b": table}, "a", F.col("id") == 1, [dml.ForeignKey("a", "n", "b", "id"), dml.ForeignKey("b", "n", "a", "id")])
    assert [circle[n].table.count() for n in "ab"] == [1, 2]


def test_tables_and_watches(spark, tmp_path):
    assert register_views(spark, {"v2": "SELECT * FROM v1", "v1": "SELECT 1 AS x"}) == ["v1", "v2"]
    with pytest.raises(ValueError, match="build on each other"):
        register_views(spark, {"w1": "SELECT * FROM w2", "w2": "SELECT * FROM w1"})
    assert affected_by_read({"V2", "t"}, {"v2": {"v1"}, "v1": {"Base"}}) == {"v2", "v1", "base", "t"}
    cascades = {"person": {"delete": {"address", "comment"}, "update": {"address"}}, "address": {"delete": {"note"}}, "note": {"delete": {"person"}}}
    assert affected_by_write("Person", "delete", cascades) == {"person", "address", "comment", "note"}
    assert affected_by_write("person", "update", cascades) == {"person", "address"}
    assert parent_first(["posts", "users", "files"], {"posts": {"users"}}) == ["users", "posts", "files"]
    assert parent_first(["a", "b"], {"a": {"b"}, "b": {"a"}}) == ["a", "b"]
    with pytest.raises(ValueError, match="exists already"):
        migrate({}, 0, {"0001": dict, "0001_again": dict})
    with pytest.raises(ValueError, match="NNNN"):
        migrate({}, 0, {"1": dict})
    assert migrate({}, -1, {"0004": dict}, lambda: {"fresh": spark.range(1)})[1] == 4
    assert migrate({}, 9, {"0004": dict})[1] == 9
    save_version({"t": spark.range(3)}, str(tmp_path), 2)
    assert load_version(spark, str(tmp_path), 2, ["t"])["t"].count() == 3

    versions = Versions()
    watch = Watch(versions, {"v"}, lambda: spark.range(1), {"v": {"Orders"}})
    assert watch.poll() is not None and watch.poll() is None
    versions.changed(["other"])
    assert watch.poll() is None
    versions.changed(["ORDERS"])
    assert watch.poll() is not None


def test_push_batches_are_cut_one_after_another(spark):
    rng = random.Random(3)
    sizes = [rng.choice([3, 20, 90, 400, 3000]) if i % 3 else 5 for i in range(3000)]
    frozen = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "row_ordinal long, row_json string").repartition(4)
    want, rows, held, batch = {}, 0, 0, 0
    for i, n in enumerate(sizes):
        if rows and (rows + 1 > 50 or held + n > 1000):
            rows, held, batch = 0, 0, batch + 1
        rows, held, want[i] = rows + 1, held + n, batch
    for part_rows in (50, 177, 1_000_000):
        got = changes.push_batches(frozen, 50, 1000, part_rows).collect()
        assert len(got) == 3000 and {r.row_ordinal: r.batch for r in got} == want
    assert changes.push_batches(frozen.limit(0), 50, 1000).count() == 0


def test_gate_and_recovery(spark):
    kind = "schema_name string, table_name string, key_json string, op string, base_row_version long, payload string, dirty_ordinal long"
    none, one = spark.createDataFrame([], kind), spark.createDataFrame([("main", "t", "{}", "UPDATE", 1, "{}", 1)], kind)
    pins = {n: changes.fingerprint(a, b) for n, (a, b) in {"none": (none, none), "dirty": (one, none), "outbox": (none, one)}.items()}
    changes.gate(none, none, pins["none"])
    changes.gate(one, none, pins["dirty"], changes.KEEP_UNSENT)
    changes.gate(none, one, pins["outbox"], changes.KEEP_COMMITTED)
    for dirty, outbox, pin, mode in ((one, none, "none", changes.KEEP_UNSENT), (one, none, "dirty", changes.REQUIRE_EMPTY), (none, one, "outbox", changes.KEEP_UNSENT), (one, none, "dirty", changes.KEEP_COMMITTED)):
        with pytest.raises(changes.TransitionPending):
            changes.gate(dirty, outbox, pins[pin], mode)
    assert changes.choose_recovery(5, 6, 9) == changes.choose_recovery(9, 3, 9) == "pull"
    assert changes.choose_recovery(4, 6, 9) == "rebuild: history pruned" and changes.choose_recovery(10, 3, 9) == "rebuild: checkpoint ahead"
    left = changes.clear_managed({"T": one, "other": one}, ["t"])
    assert left["T"].count() == 0 and left["T"].schema == one.schema and left["other"].count() == 1


def test_glob_and_time_of_day(spark):
    from weftline.functions import compat

    for pattern, yes, no in (("a*[0-9]?", "abc7x", "Abc7x"), ("[^ab]x", "cx", "ax"), ("a.b\\c", "a.b\\c", "aXb\\c"), ("x[", "x[", "x"), ("[]]y", "]y", "y")):
        row = spark.range(1).select(compat.glob(F.lit(yes), pattern).alias("yes"), compat.glob(F.lit(no), pattern).alias("no")).first()
        assert row.yes and not row.no, pattern
    row = spark.range(1).select(compat.parse_time(F.lit("23:59:01")).alias("s"), compat.time_text(F.lit(86341)).alias("t"), compat.parse_time(F.lit(None).cast("string")).alias("n")).first()
    assert (row.s, row.t, row.n) == (86341, "23:59:01", None)


def test_managed_order():
    refer = lambda table, parent, n=1: changes.Reference(table, ("a", "b")[:n], parent, ("x", "y")[:n])
    order = changes.managed_order
    assert order(["c", "a", "b"], [refer("A", "b"), refer("b", "B"), refer("z", "nowhere")]) == ["c", "b", "a"]
    assert order(["a", "b", "c", "d"], [refer("a", "b"), refer("b", "a"), refer("c", "a")]) == ["d", "a", "b", "c"]
    with pytest.raises(ValueError, match="several columns.*a -> b; c -> b"):
        order(["a", "b", "c"], [refer("c", "b", 2), refer("a", "b", 2), refer("a", "out")])
    with pytest.raises(ValueError, match="lead out.*a.a -> out.x; b.a -> off.x"):
        order(["a", "b"], [refer("b", "off"), refer("a", "out")])
    with pytest.raises(ValueError, match="twice"):
        order(["a", "A"], [])


def test_array_hash(spark):
    import hashlib

    rows = [(i, f'{{"n":{i},"t":"é"}}', i // 3) for i in range(11)]
    frozen = spark.createDataFrame(rows, "row_ordinal long, row_json string, chunk long").repartition(4)
    want = hashlib.sha256(("[" + ",".join(r[1] for r in rows) + "]").encode()).hexdigest()
    assert tuple(changes.array_hash(frozen).first()) == (11, want)
    assert tuple(changes.array_hash(frozen.limit(0)).first()) == (0, hashlib.sha256(b"[]").hexdigest())


def test_specs_that_no_side_may_publish(spark):
    kind = "schema_name string, table_name string, key_columns string"
    specs = spark.createDataFrame([("main", "a", "id"), ("main", "b", "id"), ("MAIN", "B", "id"), ("main", "c", "x,y"), (None, "d", "id"), ("main", " ", "id"), ("main", "e", None)], kind)
    assert sorted(map(tuple, changes.spec_problems(specs).collect())) == [
        (".d", "schema is empty"), ("main.", "table is empty"), ("main.b", "given twice"), ("main.c", "more than one key column"), ("main.e", "a key column is empty"),
    ]
    assert changes.spec_problems(specs.limit(0)).count() == 0


def test_what_a_key_column_holds(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "k string")
    assert tuple(changes.key_state(rows, "k").first()) == (5, 2, 1)
    assert tuple(changes.key_state(rows.limit(0), "k").first()) == (0, 0, 0)


def test_all_cells_of_the_conflict_table(spark):
    ops, states, results = ("INSERT", "UPDATE", "DELETE"), ("Missing", "Deleted", "Present"), ("AcceptServer", "KeepLocal", "KeepMerged")
    cells = [("main", "users", f"{op}/{state}/{result}", op, None if op == "DELETE" else '{"id":"l"}', state, 5, '{"id":"s"}', result, '{"id":"m"}') for op in ops for state in states for result in results]
    rows = spark.createDataFrame(cells, "schema_name string, table_name string, key_json string, local_op string, local_payload string, server_state string, server_version long, server_payload string, result string, merged_payload string")
    found = {r.key_json: r for r in changes.resolve_conflicts(rows, ["ID"]).collect()}
    wrong = {f"INSERT/Missing/{r}" for r in results[1:]} | {f"UPDATE/{s}/{r}" for s in states[:2] for r in results[1:]} | {f"DELETE/{s}/KeepMerged" for s in states}
    assert {k for k, r in found.items() if r.error} == wrong
    assert found["UPDATE/Present/KeepLocal"].requeue_op == "UPDATE" and found["INSERT/Deleted/KeepMerged"].requeue_op == "INSERT"
    assert found["DELETE/Present/KeepLocal"].requeue_op == "DELETE" and found["DELETE/Missing/KeepLocal"].requeue_op is None
    assert found["UPDATE/Present/AcceptServer"].new_payload == '{"id":"s"}' and found["UPDATE/Deleted/AcceptServer"].local_action == "Delete"

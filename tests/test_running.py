"""Running values, as-of and interval joins, row-by-row changes, cascades and typed payloads."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import changes, dml, intervals, ordinals, running
from weftline.operators.intervals import overlap_join
from weftline.queries import relational
from weftline.queries.registry import QUERIES


@pytest.fixture
def not_coalesced(spark):
    """Small test tables stay in as many partitions as the session has, so that keys are really split."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_values_split_a_hot_key(spark, not_coalesced):
    r = random.Random(5)
    rows = [(i, None if i % 50 == 0 else 1 if r.random() < 0.9 else r.randrange(2, 40), r.choice([None, r.randrange(100)])) for i in range(4000)]
    df = spark.createDataFrame(rows, "at long, k long, v long").repartition(8)
    kinds = {"total": running.SUM, "n": running.COUNT, "most": running.LARGEST, "least": running.SMALLEST, "last": running.LAST}
    found = {x.at: x for x in running.with_running(df, ["k"], [F.col("at")], {n: (kind, F.col("v")) for n, kind in kinds.items()}).collect()}
    before = {x.at: x for x in running.with_running(df, ["k"], [F.col("at")], {"total": (running.SUM, F.col("v"))}, current=False).collect()}
    state = {}
    for at, k, v in rows:
        seen = state.setdefault(k, [])
        assert before[at].total == (sum(seen) if seen else None)
        if v is not None:
            seen.append(v)
        x = found[at]
        assert (x.total, x.n, x.most, x.least, x.last) == ((sum(seen), len(seen), max(seen), min(seen), seen[-1]) if seen else (None, 0, None, None, None))
    # the hot key's rows lie in many ranges
    ranged = df.repartitionByRange(8, F.col("k"), F.col("at")).withColumn("p", F.spark_partition_id()).filter("k = 1").groupBy("p").count().collect()
    assert len(ranged) >= 6 and max(x["count"] for x in ranged) < 0.3 * len(rows)
    assert running.with_running(df.limit(0), ["k"], [F.col("at")], {"n": (running.COUNT, F.col("v"))}).count() == 0
    with pytest.raises(ValueError, match="unknown kinds"):
        running.with_running(df, ["k"], [F.col("at")], {"x": ("median", F.col("v"))})


def test_as_of(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, "b", 1), (4, None, 9), (5, "a", None)], "id long, k string, t long")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 6, "y"), ("b", 2, "z"), (None, 1, "n")], "k string, s long, v string")
    got = lambda strict: {r.id: r.v for r in running.as_of(left, right, ["k"], "t", "s", ["v"], strict).collect()}
    assert got(False) == {1: "x", 2: "y", 3: None, 4: "n", 5: None}
    assert got(True) == {1: None, 2: "y", 3: None, 4: "n", 5: None}
    with pytest.raises(ValueError, match="both sides"):
        running.as_of(left, right.withColumn("id", F.lit(1)), ["k"], "t", "s", ["id"])


def test_overlaps_against_all_pairs(spark):
    r = random.Random(2)
    make = lambda n: [(i, r.randrange(2), s := r.uniform(-500, 500), s + r.choice([0, 0, 1, 3, 50, 900, -1])) for i in range(n)]
    a, b = make(150), [*make(150), (999, 0, None, 5.0), (998, 0, 5.0, None)]
    left, right = spark.createDataFrame(a, "i long, k long, f double, t double"), spark.createDataFrame(b, "j long, k long, g double, u double")
    want = sorted((x[0], y[0]) for x in a for y in b if None not in y and x[1] == y[1] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    for base in (None, 0.5, 64.0):
        met = overlap_join(left, right, (F.col("f"), F.col("t")), (F.col("g"), F.col("u")), ["k"], base)
        assert sorted((x.i, x.j) for x in met.collect()) == want
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert overlap_join(left.limit(0), right, (F.col("f"), F.col("t")), (F.col("g"), F.col("u")), ["k"]).count() == 0
    with pytest.raises(ValueError, match="both sides"):
        overlap_join(left, left, (F.col("f"), F.col("t")), (F.col("f"), F.col("t")))


@pytest.mark.parametrize("pairs", [intervals.PAIRS, 50])
def test_short_intervals_do_not_meet_on_the_level_of_long_ones(spark, monkeypatch, pairs):
    """Rows compared grow with the pairs that overlap: 400 short intervals, 4 long ones, and a crowd at one place."""
    monkeypatch.setattr(intervals, "PAIRS", pairs)
    spans = [(i, i * 10.0, i * 10.0 + 3) for i in range(400)] + [(1000 + i, i * 700.0, i * 700.0 + 2000) for i in range(4)] + [(2000 + i, 5000.0, 5001.0) for i in range(30)]
    left = spark.createDataFrame(spans, "i long, f double, t double")
    right = spark.createDataFrame(spans, "j long, g double, u double")
    met = overlap_join(left, right, (F.col("f"), F.col("t")), (F.col("g"), F.col("u")))
    want = sorted((x[0], y[0]) for x in spans for y in spans if x[1] <= y[2] and y[1] <= x[2])
    assert sorted((r.i, r.j) for r in met.collect()) == want
    # without the condition on ends: what a task has to compare
    met_in_bins = []
    join = type(left).join
    monkeypatch.setattr(type(left), "join", lambda a, b, on=None, how=None: join(a, b, on, how) if "__a_from" not in a.columns or "__b_from" not in b.columns else met_in_bins.append((a, b)) or join(a, b, on, how))
    overlap_join(left, right, (F.col("f"), F.col("t")), (F.col("g"), F.col("u")))
    a, b = met_in_bins[0]
    same = [F.col(f"__a_{c}") == F.col(f"__b_{c}") for c in ("level", "bin", "turn", "share") if f"__a_{c}" in a.columns]
    assert join(a, b, same).count() < 4 * len(want)


def test_orders_of_one_day_meet_offers_as_one_row(spark, monkeypatch):
    """What meets the offers is one row a day, however many orders there are."""
    met = []
    monkeypatch.setattr(relational, "overlap_join", lambda left, *rest, **named: met.append(left) or overlap_join(left, *rest, **named))
    QUERIES["j9_orders_in_offers"](spark, "/root/testdata/sf0.001")
    assert met[0].count() == met[0].select("day").distinct().count()


def test_typed_payloads_are_decoded_in_all_tasks(spark):
    """The table is one small file, which one task would read and decode."""
    found = QUERIES["y9_typed_payloads"](spark, "/root/testdata/sf0.001")
    n = found.withColumn("p", F.spark_partition_id()).filter("typed is not null").select("p").distinct().count()
    assert n == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_ordinals_take_one_shuffle(spark, monkeypatch):
    """Ranges are sorted where they lie: no shuffle of rows comes after the one that makes them."""
    df = spark.range(1000, numPartitions=4).select(((F.col("id") * 7919) % 1000).alias("v"), F.lit("x").alias("w"))
    numbered = ordinals.with_ordinals(df, [F.col("v").desc()], "n", 5)
    assert sorted((r.n, r.v) for r in numbered.collect()) == [(5 + i, 999 - i) for i in range(1000)]
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1  # that over range sizes


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_row_by_row(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, "b", None), (None, "n", 0)], "k long, s string, n long")
    rows = spark.createDataFrame([(3, 1, "c", 10), (1, 1, "d", 20), (2, 7, "e", 5), (4, 7, None, 6), (5, None, "x", 1), (6, None, "y", 2), (7, 2, "z", 3)], "at long, k long, s string, n long")
    found = dml.upsert(table, rows, ["k"], order=["at"])
    assert _rows(found.table) == sorted([(1, "c", 10), (2, "z", 3), (7, None, 6), (None, "n", 0), (None, "x", 1), (None, "y", 2)], key=str)
    assert _rows(found.returning) == sorted([(1, "c", 10), (2, "z", 3), (7, None, 6), (None, "x", 1), (None, "y", 2)], key=str)
    update = {"s": dml.LAST_KNOWN, "n": lambda old, given: old * 2 + given}
    assert _rows(dml.upsert(table, rows, ["k"], update, order=["at"]).table)[:3] == [(1, "c", 54), (2, "z", None), (7, "e", 16)]
    assert _rows(dml.upsert(table, rows, ["k"], {"n": dml.ADD}, order=["at"]).table)[:3] == [(1, "a", 31), (2, "b", None), (7, "e", 11)]
    assert _rows(dml.upsert(table, rows, ["k"], {"n": dml.SMALLEST}, order=["at"]).table)[:3] == [(1, "a", 1), (2, "b", 3), (7, "e", 5)]
    assert _rows(dml.insert_or_ignore(table, rows, ["k"], order=["at"]).returning) == sorted([(7, "e", 5), (None, "x", 1), (None, "y", 2)], key=str)
    for change in (dml.upsert, dml.insert_or_ignore):
        with pytest.raises(Exception, match="given twice"):
            change(table, rows.drop("at"), ["k"]).table.collect()
        assert change(table, rows.drop("at").filter("k = 2"), ["k"]).table.count() == 3
        with pytest.raises(ValueError, match="no columns to order"):
            change(table, rows, ["k"], order=["when"])
        assert _rows(change(table, rows.limit(0), ["k"], order=["at"]).table) == _rows(table)


def test_cascade_over_circles(spark):
    staff = spark.createDataFrame([(1, None, 10), (2, 1, 20), (3, 2, 10), (4, 4, 30), (5, 9, 30), (6, None, None)], "id long, boss long, team long")
    teams = spark.createDataFrame([(10, 5), (20, 3), (30, 6)], "team long, lead long")
    notes = spark.createDataFrame([("a", 3), ("b", 6), ("c", None)], "note string, about long")
    keys = [dml.ForeignKey("staff", "boss", "staff", "id"), dml.ForeignKey("teams", "lead", "staff", "id"), dml.ForeignKey("staff", "team", "teams", "team"), dml.ForeignKey("notes", "about", "staff", "id")]
    tables = {"staff": staff, "teams": teams, "notes": notes}
    # 1 takes 2, 2 takes 3, 3 leads team 20, whose only member 2 is gone
    found = dml.cascade_delete(tables, "staff", F.col("id") == 1, keys)
    assert {n: _rows(c.returning.select(c.returning.columns[0])) for n, c in found.items()} == {"staff": [(1,), (2,), (3,)], "teams": [(20,)], "notes": [("a",)]}
    assert {n: c.table.count() for n, c in found.items()} == {"staff": 3, "teams": 2, "notes": 2}
    # 6 leads team 30, in which 4, its own boss, and 5 are, and 5 leads team 10
    found = dml.cascade_delete(tables, "staff", F.col("id") == 6, keys)
    assert _rows(found["staff"].returning.select("id")) == [(1,), (2,), (3,), (4,), (5,), (6,)] and found["teams"].table.count() == 0
    none = dml.cascade_delete(tables, "staff", F.col("id") == 77, keys)
    assert [none[n].returning.count() for n in tables] == [0, 0, 0] and none["staff"].table.count() == 6


KINDS = {"id": changes.INTEGER, "Amount": changes.REAL, "name": changes.TEXT, "raw": changes.BLOB, "owner": changes.UUID}
OWNER = "00112233-4455-6677-8899-aabbccddeeff"


def payload(id='"1"', amount="1.5", name='"n"', raw='"00ff"', owner=f'"{OWNER}"', more=""):
    return f'{{"id":{id},"amount":{amount},"name":{name},"raw":{raw},"owner":{owner}{more}}}'


def test_typed_payloads(spark):
    def same(a, b, wire=(False, False)):
        row = spark.createDataFrame([(a, b)], "a string, b string")
        return row.select(changes.same_payload(F.col("a"), F.col("b"), KINDS, wire).alias("x")).first().x

    base = payload()
    assert same(base, payload(amount="1.50")) and same(base, payload(amount='"15e-1"')) and same(base, payload(raw='"AP8="')) and same(base, payload(owner='"ABEiM0RVZneImaq7zN3u/w=="'))
    assert same(base, payload(owner=f'"{OWNER.upper()}"')) and same(payload(id="true"), payload(id='"1"')) and same(payload(id="false"), payload(id='"0"')) and same(payload(id="null"), payload(id="null"))
    assert same(base, base.replace('"amount"', '"Amount"'))
    for other in (payload(amount="1.6"), payload(name='"m"'), payload(raw='"00"'), payload(id='"2"'), payload(id="null"), payload(more=',"x":1'), "[1]", "no json", None):
        assert not same(base, other)
    assert same(None, None) and not same("[1]", "[1]")
    on_wire = payload(amount='"1.5"', raw='"AP8="')
    assert same(base, on_wire, (False, True)) and same(on_wire, base, (True, False))
    for bad, wire in ((payload(id="1"), False), (payload(id='"01"'), False), (payload(name="1"), False), (payload(amount='"x"'), False), (payload(amount="1.5"), True), (payload(raw='"00f"', amount='"1.5"'), True), (payload(owner='"00"'), False)):
        with pytest.raises(Exception):
            same(base, bad, (False, wire))


def test_plain_payloads(spark):
    cases = [('{"a":1}', '{"a":"1"}', False), ('{"a":{"x":1,"y":2}}', '{"a":{"y":2,"x":1}}', True), ('{"a":[1,2]}', '{"a":[2,1]}', False), (None, None, True), ("{}", None, False), ("x", "x", True), ("x", "y", False)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", changes.same_payload(F.col("a"), F.col("b"))).collect())

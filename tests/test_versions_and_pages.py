"""Published versions, page indexes, bounded collections and streams with state."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import manifest
from weftline.operators.pages import page_index
from weftline.plans.nesting import nest_children, nest_chunks
from weftline.streaming import stateful
from weftline.streaming.reactive import Watch


def test_versions_appear_whole(spark, tmp_path):
    path = f"file:{tmp_path}/set"
    assert manifest.latest(spark, path) == -1
    with pytest.raises(ValueError, match="no version"):
        manifest.read(spark, path)
    first = manifest.commit(spark, path, {"a": spark.range(3), "b": spark.range(5)}, -1)
    watch = Watch(manifest.Published(spark, path), {"a"}, lambda: manifest.read(spark, path)["a"])
    assert watch.poll().count() == 3 and watch.poll() is None
    second = manifest.commit(spark, path, {"b": spark.range(7)}, first)
    assert watch.poll() is None  # a is the same, by reference
    with pytest.raises(manifest.Conflict):  # a second writer that started from the first version
        manifest.commit(spark, path, {"a": spark.range(1)}, first)
    assert [manifest.read(spark, path, v)["b"].count() for v in (first, second)] == [5, 7]
    assert manifest.read(spark, path)["a"].count() == 3
    # a writer that stopped halfway: its file has no whole manifest
    (tmp_path / "set" / "manifests" / f"{second + 1:012d}.json").write_text('{"version": 2, "tab')
    assert manifest.latest(spark, path) == second and manifest.read(spark, path)["b"].count() == 7
    third = manifest.commit(spark, path, {"a": spark.range(9)}, second, dropped=("b",))
    assert third > second + 1 and list(manifest.read(spark, path)) == ["a"] and watch.poll().count() == 9
    with pytest.raises(ValueError, match="no tables"):
        manifest.commit(spark, path, {}, third, dropped=("zzz",))

    def refuse():
        raise RuntimeError("open")

    with pytest.raises(RuntimeError, match="open"):
        manifest.commit(spark, path, {"a": spark.range(1)}, third, guard=refuse)


def test_a_writer_that_is_overtaken(spark, tmp_path, monkeypatch):
    path = f"file:{tmp_path}/set"
    first = manifest.commit(spark, path, {"a": spark.range(1)}, -1)
    seen = manifest._manifests

    def overtaken(s, p):
        monkeypatch.setattr(manifest, "_manifests", seen)
        found = seen(s, p)
        manifest.commit(s, p, {"a": s.range(2)}, first)
        return found

    monkeypatch.setattr(manifest, "_manifests", overtaken)
    # the other writer published between this one's look and its own manifest; the number is taken
    monkeypatch.setattr(manifest, "_next", lambda s, p, v: v + 1)
    with pytest.raises(manifest.Conflict):
        manifest.commit(spark, path, {"a": spark.range(3)}, first)
    assert manifest.read(spark, path)["a"].count() == 2


def test_page_index_by_rows_and_bytes(spark):
    r = random.Random(3)
    rows = [(r.randrange(20), i, "x" * r.choice([1, 5, 30, 90])) for i in range(500)]
    table = spark.createDataFrame(rows, "a long, b long, s string").repartition(6)
    found = page_index(table, ["a", "b"], 12, 200, F.length("s"))
    want, page, size = [], [], 0
    for row in sorted(rows):
        if page and (len(page) == 12 or size + len(row[2]) > 200):
            want.append(page)
            page, size = [], 0
        page.append(row)
        size += len(row[2])
    want.append(page)
    got = found.bounds.orderBy("page").collect()
    assert [(x.page, x.n, x.bytes, tuple(x["first"]), tuple(x["last"])) for x in got] == [(i, len(p), sum(len(x[2]) for x in p), p[0][:2], p[-1][:2]) for i, p in enumerate(want)]
    for i in (0, 3, len(want) - 1):
        assert [tuple(x) for x in found.read(table, i).collect()] == want[i]
    assert found.read(table, len(want)).count() == 0
    assert found.page_of(*want[4][2][:2]) == 4 and found.page_of(-1, 0) is None
    with pytest.raises(Exception, match="ties"):
        page_index(table, ["a"], 12)
    with pytest.raises(Exception, match="null"):
        page_index(table.withColumn("a", F.nullif("a", F.lit(3))), ["a", "b"], 12)
    with pytest.raises(ValueError, match="bound of bytes"):
        page_index(table, ["a", "b"], 12, 100)
    assert page_index(table.limit(0), ["a", "b"], 12).bounds.count() == 0


def test_chunks_are_the_collections_in_pieces(spark):
    r = random.Random(4)
    rows = [(None if i % 40 == 0 else 1 if r.random() < 0.6 else r.randrange(2, 9), i, f"v{i}") for i in range(600)]
    child = spark.createDataFrame(rows, "p long, n long, v string").repartition(5)
    chunks = nest_chunks(child, "p", ["n", "v"], [-F.col("n")], 32).collect()
    assert max(len(c.elements) for c in chunks) == 32
    whole = {}
    for c in sorted(chunks, key=lambda c: (c.p or 0, c.chunk)):
        whole.setdefault(c.p, []).extend(tuple(e) for e in c.elements)
    parents = spark.createDataFrame([(k,) for k in range(1, 10)], "p long")
    nested = nest_children(parents, "p", {"kids": (child, "p", ["n", "v"], [-F.col("n")])}).collect()
    assert all([tuple(e) for e in x.kids] == whole.get(x.p, []) for x in nested)
    assert len(whole[None]) == 15 and nest_chunks(child.limit(0), "p", ["n"], [F.col("n")], 5).count() == 0
    with pytest.raises(ValueError):
        nest_chunks(child, "p", ["n"], [F.col("n")], 0)


def test_state_survives_a_restart(spark, tmp_path):
    schema = "key string, ord long, op string, payload string"
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def add(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stateful.start(spark.readStream.schema(schema).parquet(source), out).awaitTermination()
        return {r.key: (r.ord, r.op, r.payload, r.changes) for r in stateful.states(spark.read.parquet(f"{out}/moved")).collect()}

    add([("a", 1, "WRITE", "x"), ("a", 3, "WRITE", "y"), ("b", 2, "DELETE", None), ("c", 9, "WRITE", "z")])
    got = add([("a", 2, "WRITE", "late"), ("b", 5, "WRITE", "back"), ("c", 10, "DELETE", None)])
    assert got == {"a": (3, "WRITE", "y", 3), "b": (5, "WRITE", "back", 2), "c": (10, "DELETE", None, 2)}
    # the third batch moves one key, and writes one
    assert add([("b", 4, "DELETE", None)])["b"] == (5, "WRITE", "back", 3)
    moved = spark.read.parquet(f"{out}/moved")
    assert [r["count"] for r in moved.groupBy("batch").count().orderBy("batch").collect()] == [3, 3, 1]

import random

import pytest
from pyspark.sql import functions as F

from weftline.plans.nesting import Nested, check_labels, nest, nest_children, nest_rows, prefixed

SCHEMA = "id long, name string, a_id long, a_city string, n_id long, n_text string, c_id long, p_name string, ord long"
NOTES = Nested("notes", "collection", {"id": "n_id", "text": "n_text"}, key="n_id")
ADDRESSES = Nested("addresses", "collection", {"id": "a_id", "city": "a_city"}, key="a_id", children=(NOTES,))
CATEGORIES = Nested("categories", "collection", {"id": "c_id"}, key="c_id")
PROFILE = Nested("profile", "per_row", {"name": "p_name"})


def element(row, columns):
    return tuple(row[c] for c in columns)


def distinct(rows, key):
    seen, out = set(), []
    for r in rows:
        if r[key] not in seen:
            seen.add(r[key])
            out.append(r)
    return out


def mapped(rows):
    """The rules in plain Python, row by row."""
    groups = {}
    for r in sorted(rows, key=lambda r: r["ord"]):
        groups.setdefault(r["id"], []).append(r)
    out = []
    for key, group in groups.items():
        with_address = [r for r in group if any(r[c] is not None for c in ("a_id", "a_city", "n_id", "n_text"))]
        addresses = []
        for first in distinct(with_address, "a_id"):
            notes = [r for r in with_address if r["a_id"] == first["a_id"] and (r["n_id"] is not None or r["n_text"] is not None)]
            addresses.append((first["a_id"], first["a_city"], [element(n, ("n_id", "n_text")) for n in distinct(notes, "n_id")]))
        categories = [(r["c_id"],) for r in distinct([r for r in group if r["c_id"] is not None], "c_id")]
        profile = next(((r["p_name"],) for r in group if r["p_name"] is not None), None)
        out.append((key, group[0]["name"], addresses, categories, profile))
    return out


def plain(row):
    return (
        row.id,
        row.name,
        [(a.id, a.city, [tuple(n) for n in a.notes]) for a in row.addresses],
        [tuple(c) for c in row.categories],
        tuple(row.profile) if row.profile is not None else None,
    )


@pytest.mark.parametrize("seed", range(6))
def test_against_row_mapper(spark, seed):
    rng = random.Random(seed)
    maybe = lambda values: rng.choice([None, *values])
    rows = []
    for i in range(rng.randint(1, 60)):
        rows.append({"id": rng.choice([1, 2, 3, None]), "name": f"n{i}", "a_id": maybe([1, 2, 3]), "a_city": maybe(["x", "y"]), "n_id": maybe([1, 2]), "n_text": maybe(["t", "u"]), "c_id": maybe([5, 6]), "p_name": maybe(["p", "q"]), "ord": i})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).orderBy(F.rand(seed))
    found = nest(df, "id", [ADDRESSES, CATEGORIES, PROFILE], [F.col("ord")]).select("id", "name", "addresses", "categories", "profile")
    assert [plain(r) for r in found.collect()] == mapped(rows)


@pytest.mark.parametrize("seed", range(10, 14))
def test_only_collection_against_row_mapper(spark, seed):
    """Without a sibling collection the joined rows are read once; the result is the same."""
    rng = random.Random(seed)
    maybe = lambda values: rng.choice([None, *values])
    rows = [{"id": rng.choice([1, 2, 3, None]), "name": f"n{i}", "a_id": maybe([1, 2, 3]), "a_city": maybe(["x", "y"]), "n_id": maybe([1, 2]), "n_text": maybe(["t", "u"]), "c_id": None, "p_name": maybe(["p", "q"]), "ord": i} for i in range(rng.randint(1, 60))]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).orderBy(F.rand(seed))
    found = nest(df, "id", [ADDRESSES, PROFILE, Nested("categories", "default", default=None)], [F.col("ord")])
    got = [(r.id, r.name, [(a.id, a.city, [tuple(n) for n in a.notes]) for a in r.addresses], [], tuple(r.profile) if r.profile is not None else None) for r in found.collect()]
    assert got == mapped(rows)
    plan = nest(df, "id", [ADDRESSES, PROFILE], [F.col("ord")], sort=False)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_empty_table(spark):
    assert nest(spark.createDataFrame([], SCHEMA), "id", [ADDRESSES, CATEGORIES, PROFILE], [F.col("ord")]).count() == 0


def test_without_key_all_elements_stay(spark):
    df = spark.createDataFrame([(1, 7, 0), (1, 7, 1), (1, None, 2)], "id long, x long, ord long")
    found = nest(df.select("id", "x", "ord"), "id", [Nested("xs", "collection", {"x": "x"})], [F.col("ord")]).first()
    assert [e.x for e in found.xs] == [7, 7]


def test_blob_keys_compare_by_content(spark):
    df = spark.createDataFrame([(1, bytearray(b"a"), 0), (1, bytearray(b"a"), 1), (1, bytearray(b"b"), 2)], "id long, k binary, ord long")
    found = nest(df, "id", [Nested("ks", "collection", {"k": "k"}, key="k")], [F.col("ord")]).first()
    assert [bytes(e.k) for e in found.ks] == [b"a", b"b"]


def test_required_row_is_an_error_if_null(spark):
    df = spark.createDataFrame([(1, None, 0)], "id long, p string, ord long")
    needed = Nested("profile", "per_row", {"p": "p"}, not_null=True)
    with pytest.raises(Exception, match="required field profile is null"):
        nest_rows(df, [needed]).collect()
    with pytest.raises(Exception, match="required field profile is null"):
        nest(df, "id", [needed], [F.col("ord")]).collect()
    assert nest_rows(df, [Nested("profile", "per_row", {"p": "p"}), Nested("n", "default", default=3)]).first()[2:] == (None, 3)


def test_plan_errors(spark):
    df = spark.createDataFrame([(1, 2, 0)], "id long, x long, ord long")
    with pytest.raises(ValueError, match="none of"):
        nest(df, "missing", [], [F.col("ord")])
    with pytest.raises(ValueError, match="y are none of"):
        nest(df, "id", [Nested("ys", "collection", {"y": "y"})], [F.col("ord")])
    with pytest.raises(ValueError, match="no column belongs"):
        Nested("ys", "collection")
    with pytest.raises(ValueError, match="unknown mapping"):
        Nested("ys", "several", {"y": "y"})
    with pytest.raises(ValueError, match="needs a key"):
        Nested("ys", "collection", {"y": "y"}, children=(Nested("zs", "collection", {"z": "z"}),))
    with pytest.raises(ValueError, match="duplicate result columns: id"):
        check_labels(df.select("id", F.lit(1).alias("ID")))


def test_prefixes(spark):
    df = spark.createDataFrame([(1, 2, 3)], "id long, address__street long, address__note__text long")
    assert prefixed(df, "address__") == {"street": "address__street"}


def test_children_collected_first_equal_the_join(spark):
    parents = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    left = spark.createDataFrame([(1, 10), (1, 11), (3, 12)], "fk long, x long")
    right = spark.createDataFrame([(1, 20), (1, 21), (2, 22)], "fk long, y long")
    found = nest_children(parents, "id", {"xs": (left, "fk", ["x"], [F.col("x")]), "ys": (right, "fk", ["y"], [F.col("y")])}).orderBy("id").collect()
    assert [([e.x for e in r.xs], [e.y for e in r.ys]) for r in found] == [([10, 11], [20, 21]), ([], [22]), ([12], [])]


def test_one_shuffle_for_flat_collections(spark):
    df = spark.createDataFrame([(1, 2, 3, 0)], "id long, x long, y long, ord long")
    plan = nest(df, "id", [Nested("xs", "collection", {"x": "x"}, key="x"), Nested("ys", "collection", {"y": "y"}, key="y")], [F.col("ord")], sort=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1

import os

import pytest

from weftline.plans.query import NoteError, Query, Shapes, bind, camel, one, one_or_none, rows

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")


def test_note_errors():
    with pytest.raises(NoteError, match="unknown colour"):
        Query.parse("q", '/*@ {"colour": 1} */ SELECT 1')
    with pytest.raises(NoteError, match="needs the key"):
        Query.parse("q", '/*@ {"nest": {"fields": [{"name": "a", "mapping": "collection", "columns": {"x": "x"}}]}} */ SELECT 1')
    with pytest.raises(NoteError, match="unknown prefix"):
        Query.parse("q", '/*@ {"nest": {"key": "k", "fields": [{"name": "a", "mapping": "collection", "prefix": "x"}]}} */ SELECT 1')


def test_parameters(spark):
    q = Query.parse("q", '/*@ {"params": {"n": "long", "s": "string", "l": "array<long>"}} */ SELECT :n + :n AS twice, :s AS s, array_contains(:l, :n) AS there, \':n\' AS text')
    assert q.run(spark, n=4, s="a'b", l=[1, 4]).first() == (8, "a'b", True, ":n")
    assert q.run(spark, n=4, s=None, l=[]).first()[1:] == (None, None, ":n")
    with pytest.raises(TypeError, match="missing"):
        q.run(spark, n=1)
    with pytest.raises(TypeError, match="unknown"):
        q.run(spark, n=1, s="", l=[], x=2)
    with pytest.raises(TypeError, match="must be long"):
        q.run(spark, n="1", s="", l=[])
    assert bind(1, "boolean", "b") is True and bind(3.0, "long", "n") == 3 and bind(2, "double", "d") == 2.0


def test_schema_runs_nothing(spark):
    q = Query.parse("q", "SELECT raise_error('ran') AS x")
    assert q.schema(spark).names == ["x"]


def test_names_and_shapes(spark):
    assert [camel(x) for x in ("first_name", "id", "a_b_c:1")] == ["firstName", "id", "aBC"]
    renamed = Query.parse("q", '/*@ {"rename": "camel"} */ SELECT 1 AS first_name, 2 AS last_name').run(spark)
    assert renamed.columns == ["firstName", "lastName"]
    shapes = Shapes()
    shapes.register("person", spark.range(1).schema)
    shapes.register("person", spark.range(2).schema)
    with pytest.raises(NoteError, match="person"):
        shapes.register("person", renamed.schema)


def test_cardinality(spark):
    two = spark.range(2).orderBy("id")
    assert one_or_none(spark.range(0)) is None and one(spark.range(1)).id == 0
    assert one(two, strict=False).id == 0 and rows(two, lambda r: r.id) == [0, 1]
    with pytest.raises(ValueError, match="one row"):
        one_or_none(two)
    with pytest.raises(ValueError, match="found none"):
        one(spark.range(0))


def test_duplicate_labels(spark):
    with pytest.raises(ValueError, match="duplicate result columns: a"):
        Query.parse("q", "SELECT 1 AS a, 2 AS A").run(spark)


@needs_data
def test_entry(spark):
    import __spark_entry__ as entry

    found = entry.entry(spark)
    assert found.columns == ["id", "name", "segment", "nation", "orders"]
    first = found.orderBy("id").first()
    assert first.orders and set(first.orders[0].asDict()) == {"key", "status", "price", "lines"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def normal(df):
    def value(x):
        if x is None or x != x:
            return "null"
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(value(v.item() if hasattr(v, "item") else v) for v in r) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None))


@needs_data
def test_all_queries_against_sql(spark):
    import duckdb

    from weftline.queries import ORACLES, QUERIES

    wrong = []
    for name, run in QUERIES.items():
        con = duckdb.connect()
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        got, want = run(spark, SF).toPandas(), con.execute(ORACLES[name]).fetchdf()
        if sorted(got.columns) != sorted(want.columns) or normal(got) != normal(want):
            wrong.append(name)
    assert wrong == []

import pytest
from pyspark.sql import functions as F

from weftline.plans.lineage import NoteError, adapted, attach, find_column, merged, named, nest_noted, noted, origins, resolve, tagged
from weftline.plans.nesting import Nested, nest
from weftline.plans.query import Query, column_type


@pytest.fixture(scope="module")
def joined(spark):
    people = tagged(spark.createDataFrame([(1, "Ann"), (2, "Bo")], "id long, name string"), "p")
    packages = tagged(spark.createDataFrame([(10, 1, "x"), (11, 1, "y"), (12, None, "z")], "id long, person_id long, label string").withColumnsRenamed({"id": "pkg_id"}), "pkg")
    return people, packages


def test_notes_travel_through_views_joins_and_names(spark, joined):
    people, packages = joined
    attach(people, packages, {"id": "person_id"}).createOrReplaceTempView("lineage_view")
    found = spark.sql("SELECT v.name AS who, upper(v.name) AS loud, v.pkg_id FROM (SELECT * FROM lineage_view WHERE id < 5) v JOIN lineage_view w ON v.id = w.id")
    assert [(o.field, o.source, o.column) for o in origins(found)] == [("who", "p", "name"), ("loud", "", "loud"), ("pkg_id", "pkg", "pkg_id")]
    assert origins(found)[2].joined == ((("p", "id"),),)


def test_key_lookup(joined):
    people, packages = joined
    df = attach(people, packages, {"id": "person_id"}).withColumnRenamed("id", "person")
    assert find_column(df, "P.ID") == "person" and find_column(df, "pkg.PKG_ID") == "pkg_id" and find_column(df, "Person") == "person"
    # a bare name is a field's name before it is a column's
    both = df.withColumnRenamed("name", "id")
    assert find_column(both, "id") == "id" and find_column(both, "p.id") in ("id", "person")
    # columns outside nested fields come first
    twice = tagged(df.select("person", F.col("pkg_id").alias("key")), "v")
    assert find_column(twice, "v.key", {"key"}) == "key"
    with pytest.raises(NoteError, match="p.size is none of p.id, p.name, pkg.label, pkg.person_id, pkg.pkg_id"):
        find_column(df, "p.size")


def test_grouping_from_either_side(joined):
    people, packages = joined
    child_right = attach(people, packages, {"id": "person_id"})
    child_left = attach(packages, people, {"person_id": "id"}, how="inner")
    spec = [{"name": "packages", "mapping": "collection", "source": "pkg"}]
    for df in (child_right, child_left):
        found = {r.id: [p.pkg_id for p in r.packages] for r in nest_noted(df.drop("person_id"), spec, [F.col("pkg_id")]).collect()}
        assert found[1] == [10, 11]
    with pytest.raises(NoteError, match="no key is given"):
        resolve(child_right.drop("id"), spec)


def test_columns_go_to_one_field_only(joined):
    people, packages = joined
    df = attach(people, packages, {"id": "person_id"})
    first, second = {"name": "a", "mapping": "per_row", "source": "pkg"}, {"name": "b", "mapping": "per_row", "source": "pkg"}
    with pytest.raises(NoteError, match="b: no column comes from pkg"):
        resolve(df, [first, second])
    prefixed = df.withColumn("x__city", F.lit("c")).withColumn("x__city:1", F.lit("d"))
    _, (a, b) = resolve(prefixed, [first, {"name": "b", "mapping": "per_row", "source": "x", "alias_prefix": "X__"}])
    assert b.columns == {"city": "x__city"} and set(a.columns) == {"pkg_id", "person_id", "label"}


@pytest.mark.parametrize(
    ("spec", "message"),
    [
        ({"name": "a", "mapping": "collection"}, "needs a source"),
        ({"name": "a", "source": "pkg"}, "needs a mapping"),
        ({"name": "a", "mapping": "list", "source": "pkg"}, "unknown mapping"),
        ({"mapping": "per_row", "source": "pkg"}, "needs a name"),
        ({"name": "a", "colour": 1}, "unknown colour"),
        ({"name": "a", "mapping": "per_row", "source": "q", "alias_prefix": "q_"}, "comes from q or begins with q_"),
    ],
)
def test_field_errors(joined, spec, message):
    with pytest.raises(NoteError, match=message):
        resolve(joined[1], [spec])


def test_note_errors(spark, joined):
    with pytest.raises(NoteError, match="unknown colour"):
        noted(joined[0], {"id": {"colour": 1}})
    with pytest.raises(NoteError, match="size is none of id, name"):
        noted(joined[0], {"size": {}})
    with pytest.raises(NoteError, match="no alias"):
        tagged(joined[0], "a.b")
    with pytest.raises(NoteError, match="no adapter loud"):
        adapted(noted(joined[0], {"name": {"adapter": "loud"}}))


def test_precedence_by_member(spark):
    assert merged({"name": "a", "type": "int"}, {"name": "b", "type": None, "default": 0}) == {"name": "b", "type": "int", "default": 0}
    table = tagged(spark.createDataFrame([(1, None), (2, "B")], "k int, v string"), "t", {"v": {"name": "low", "adapter": "lower", "default": "none"}})
    view = tagged(table, "w", {"V": {"name": "middle"}})
    own = noted(view, {"v": {"default": "own"}, "k": {"type": "string"}})
    found = named(adapted(own, {"lower": lambda c: F.lower(c)}))
    assert found.columns == ["k", "middle"] and sorted(map(tuple, found.collect())) == [("1", "own"), ("2", "b")]
    with pytest.raises(Exception, match="required field v is null"):
        adapted(noted(spark.createDataFrame([(None,)], "v string"), {"v": {"not_null": True}})).collect()


def test_null_key_drops(spark):
    df = spark.createDataFrame([(1, None, "a", 0), (1, 5, "b", 1), (1, 5, "c", 2), (2, None, "d", 3)], "id int, k int, v string, o int")
    spec = Nested("xs", "collection", {"k": "k", "v": "v"}, key="k", null_key_drops=True)
    assert [(r.id, [tuple(x) for x in r.xs]) for r in nest(df, "id", [spec], [F.col("o")]).collect()] == [(1, [(5, "b")]), (2, [])]
    with pytest.raises(ValueError, match="drops null keys"):
        Nested("xs", "collection", {"k": "k"}, null_key_drops=True)


def test_parameter_types_of_columns(spark):
    spark.createDataFrame([(1, 2.5, "x", True)], "A long, b double, c string, d boolean").createOrReplaceTempView("typed")
    spark.sql("SELECT a AS z, * FROM typed").createOrReplaceTempView("typed_view")
    assert [column_type(spark, k) for k in ("typed_view.Z", "typed_view.b", "array<typed.c>", "int", "typed.d")] == ["long", "double", "array<string>", "int", "boolean"]
    with pytest.raises(NoteError, match="q is none of z, a, b, c, d of typed_view"):
        column_type(spark, "typed_view.q")
    q = Query.parse("q", '/*@ {"params": {"p": "typed_view.z"}} */ SELECT :p AS p')
    assert q.run(spark, p=3).first().p == 3
    with pytest.raises(TypeError, match="must be long"):
        q.run(spark, p="3")


def test_types_before_and_after_the_adapter(spark):
    rows = spark.createDataFrame([(1, "7"), (2, None)], "id long, digits string")
    own = noted(rows, {"digits": {"sql_type": "int", "adapter": "next", "type": "string"}})
    assert [r.digits for r in adapted(own, {"next": lambda c: c + 1}).orderBy("id").collect()] == ["8", None]
    with pytest.raises(NoteError, match="no type"):
        adapted(noted(rows, {"digits": {"sql_type": "nonsense"}}))


def test_type_of_a_whole_field(joined):
    people, packages = joined
    both = attach(people, packages, {"id": "person_id"}).drop("person_id")
    spec = {"name": "packages", "mapping": "collection", "source": "pkg", "type": "array<struct<number: string, label: string>>"}
    found = nest_noted(both.withColumn("place", F.col("pkg_id") + 0), [spec], [F.col("place")], key="id").orderBy("id").collect()
    assert [[tuple(e) for e in r.packages] for r in found] == [[("10", "x"), ("11", "y")], []]
    inside = {"name": "a", "mapping": "per_row", "source": "p", "children": [{**spec, "mapping": "per_row"}]}
    with pytest.raises(NoteError, match="field around"):
        resolve(both, [inside], key="id")

import pytest
from pyspark.sql import functions as F

from weftline.operators import changes, dml
from weftline.operators.tables import load_version, save_version
from weftline.sources.wire import MAX_DEPTH, decode, decoded, problem_of

GOOD = '{"schema":"main","table":"t","key":{"id":"1"},"row_version":7,"payload":{"a":[1,2.50,null],"b":"\\u00e9"}}'
ROW = {"v": "long"}


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ('{"v":1}', None),
        (' \n{"v" : -9223372036854775808 }\t', None),
        ('{"v":9223372036854775808}', "v is no long"),
        ('{"v":1e2}', "v is no long"),
        ('{"v":true}', "v is no long"),
        ('{"v":1,"v":1}', "duplicate member"),
        ('{"v":1,"\\u0076":1}', "duplicate member"),
        ('{"v":1,"w":1}', "unknown member"),
        ("{}", "missing member"),
        ('{"v":01}', "syntax"),
        ('{"v":NaN}', "syntax"),
        ('{"v":1} x', "syntax"),
        ('{"v":1,}', "syntax"),
        ("[]", "syntax"),
        ("", "syntax"),
        ('{"v":' + "9" * 5000 + "}", "syntax"),
        ('{"v":"\\ud800"}', "unpaired surrogate"),
        ('{"v":' + "[" * 100_000 + "]" * 100_000 + "}", "too deep"),
    ],
)
def test_problems(text, wanted):
    assert problem_of(text, ROW) == wanted


def test_depth_counts_the_row():
    nest = lambda n: '{"v":' + "[" * n + "]" * n + "}"
    assert problem_of(nest(MAX_DEPTH - 1), ROW) == "v is no long" and problem_of(nest(MAX_DEPTH), ROW) == "too deep"


def test_rows(spark):
    df = spark.createDataFrame([(1, GOOD), (2, GOOD.replace('"1"', "1")), (3, None)], "n int, text string")
    found = {r.n: r for r in decode(df).collect()}
    assert [found[n].problem for n in (1, 2, 3)] == [None, "key is no strings", "missing"] and found[2].row is None
    row = found[1].row
    assert (row.schema, row.table, row.key, row.row_version) == ("main", "t", {"id": "1"}, 7) and '"a":[1,2.5' in row.payload.replace(" ", "")
    assert decoded(df.filter("n = 1")).first().row_version == 7 and decode(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="key is no strings"):
        decoded(df.filter("n = 2")).collect()


def test_values(spark):
    table = spark.createDataFrame([(1, 1.5, "x")], "id long, amount double, name string")
    found = dml.insert(table, dml.values(table, [{"ID": 2, "amount": 3}, {"id": 3, "AMOUNT": None}]), {"name": F.lit("new")}).table
    assert sorted(map(tuple, found.collect())) == [(1, 1.5, "x"), (2, 3.0, "new"), (3, None, "new")]
    assert dml.values(table, []).count() == 0
    with pytest.raises(ValueError, match="colour are no columns"):
        dml.values(table, [{"colour": 1}])
    with pytest.raises(ValueError, match="different columns"):
        dml.values(table, [{"id": 1}, {"name": "x"}])
    with pytest.raises(Exception, match="(?i)long|type"):
        dml.values(table, [{"id": "one"}])


def test_guarded_write(spark, tmp_path):
    tables = {"t": spark.range(3)}
    with pytest.raises(changes.TransitionPending):
        save_version(tables, str(tmp_path), 1, guard=lambda: changes.guard_write(True, False))
    assert not list(tmp_path.iterdir())
    save_version(tables, str(tmp_path), 1, guard=lambda: changes.guard_write(True, True))
    assert load_version(spark, str(tmp_path), 1, ["t"])["t"].count() == 3

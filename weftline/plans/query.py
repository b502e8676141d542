"""Named queries: a SQL file with a JSON note on its parameters and its result.

The file begins with a comment ``/*@ {...} */``.  Members: ``params`` (name to Spark type, or to ``view.column``
for the type of that column, also inside ``array<>``), ``nest`` (key, order
and nested fields, see ``nesting``), ``rename`` (camel or plain) and ``shape`` (name of a result schema that
several queries share).  The rest is Spark SQL with ``:name`` parameters.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.plans.lineage import NoteError, only
from weftline.plans.nesting import Nested, check_labels, nest, nest_rows

_NOTE = re.compile(r"\A\s*/\*@(.*?)\*/", re.S)
_QUERY_KEYS = {"params", "nest", "rename", "shape"}
_NEST_KEYS = {"key", "order", "fields"}
_FIELD_KEYS = {"name", "mapping", "columns", "key", "not_null", "default", "children", "null_key_drops"}
_SHORT = {"bigint": "long", "smallint": "int", "tinyint": "int", "float": "double"}
_PYTHON = {"long": int, "int": int, "double": float, "string": str, "boolean": bool, "binary": bytes}

SQL_DIR = Path(__file__).resolve().parent.parent / "sql"


def _nested(spec: dict) -> Nested:
    only(spec, _FIELD_KEYS, spec.get("name", "field"))
    if "name" not in spec or "mapping" not in spec:
        raise NoteError("a nested field needs a name and a mapping")
    children = tuple(_nested(c) for c in spec.get("children", []))
    return Nested(spec["name"], spec["mapping"], dict(spec.get("columns", {})), spec.get("key"), spec.get("not_null", False), spec.get("default"), children, spec.get("null_key_drops", False))


def bind(value: Any, kind: str, name: str) -> Any:
    """A Python value as an argument of the given Spark type; a value of another type is an error.

    Spark takes plain values and array constructors as arguments; a column's type widens what is compared with it.
    """
    if kind.startswith("array<"):
        inner = kind[len("array<") : -1]
        values = [bind(v, inner, name) for v in value or []]
        # an empty list of a type: one null, which no comparison matches
        return F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values or [None]])
    if value is None:
        return F.lit(None)
    if kind == "boolean" and isinstance(value, int):
        value = bool(value)
    elif kind in ("long", "int") and isinstance(value, float) and value == int(value):
        value = int(value)
    elif kind == "double" and isinstance(value, int) and not isinstance(value, bool):
        value = float(value)
    expected = _PYTHON.get(kind)
    if expected is not None and (not isinstance(value, expected) or (expected is int and isinstance(value, bool))):
        raise TypeError(f"parameter {name} must be {kind}, not {type(value).__name__}")
    return value


def column_type(spark: SparkSession, kind: str) -> str:
    """A parameter's type; ``view.column`` stands for the type of that column, through however many views it comes."""
    if kind.startswith("array<"):
        return f"array<{column_type(spark, kind[len('array<') : -1])}>"
    view, dot, column = kind.rpartition(".")
    if not dot:
        return kind
    types = {f.name.lower(): f.dataType.simpleString() for f in spark.table(view).schema}
    if column.lower() not in types:
        raise NoteError(f"{column} is none of {', '.join(types)} of {view}")
    return _SHORT.get(types[column.lower()], types[column.lower()])


@dataclass(frozen=True)
class Query:
    name: str
    sql: str
    params: dict[str, str] = field(default_factory=dict)
    key: str | None = None
    order: tuple[str, ...] = ()
    nested: tuple[Nested, ...] = ()
    rename: str = "plain"
    shape: str | None = None

    @staticmethod
    def parse(name: str, text: str) -> Query:
        found = _NOTE.match(text)
        note = json.loads(found[1]) if found else {}
        only(note, _QUERY_KEYS, name)
        spec = note.get("nest", {})
        only(spec, _NEST_KEYS, f"{name}: nest")
        nested = tuple(_nested(f) for f in spec.get("fields", []))
        if any(n.mapping == "collection" for n in nested) and not spec.get("key"):
            raise NoteError(f"{name}: a collection needs the key of its parent")
        sql = text[found.end() :] if found else text
        return Query(name, sql.strip().rstrip(";"), note.get("params", {}), spec.get("key"), tuple(spec.get("order", [])), nested, note.get("rename", "plain"), note.get("shape"))

    @staticmethod
    def load(name: str, directory: Path = SQL_DIR) -> Query:
        """``orders.by_customer`` is the file orders/by_customer.sql."""
        return Query.parse(name, (directory / f"{name.replace('.', '/')}.sql").read_text())

    def arguments(self, args: dict[str, Any], spark: SparkSession | None = None) -> dict[str, Any]:
        missing, unknown = sorted(set(self.params) - set(args)), sorted(set(args) - set(self.params))
        if missing or unknown:
            raise TypeError(f"{self.name}: missing {missing}, unknown {unknown}")
        kinds = {p: column_type(spark, kind) if spark else kind for p, kind in self.params.items()}
        return {p: bind(args[p], kind, p) for p, kind in kinds.items()}

    def flat(self, spark: SparkSession, **args: Any) -> DataFrame:
        """The joined rows."""
        return check_labels(spark.sql(self.sql, args=self.arguments(args, spark)) if self.params else spark.sql(self.sql))

    def run(self, spark: SparkSession, **args: Any) -> DataFrame:
        """The result, nested if the note says so."""
        df = self.flat(spark, **args)
        if self.key:
            df = nest(df, self.key, list(self.nested), [_ordered(o) for o in self.order])
        elif self.nested:
            df = nest_rows(df, list(self.nested))
        return renamed(df, self.rename)

    def schema(self, spark: SparkSession, **args: Any) -> T.StructType:
        """The result's schema, without running anything."""
        return self.run(spark, **args).schema


def _ordered(column: str) -> Column:
    """``name`` or ``-name`` (a number, descending)."""
    return -F.col(column[1:]) if column.startswith("-") else F.col(column)


def camel(name: str) -> str:
    head, *rest = re.sub(r":\d+$", "", name).split("_")
    return head + "".join(w[:1].upper() + w[1:] for w in rest)


def renamed(df: DataFrame, style: str) -> DataFrame:
    if style == "plain":
        return df
    return check_labels(df.toDF(*[camel(c) for c in df.columns]))


class Shapes:
    """Result schemas that several queries share: each must have the same structure."""

    def __init__(self) -> None:
        self.known: dict[str, T.StructType] = {}

    def register(self, shape: str, schema: T.StructType) -> None:
        plain = lambda s: [(f.name, f.dataType.simpleString()) for f in s]
        held = self.known.setdefault(shape, schema)
        if plain(held) != plain(schema):
            raise NoteError(f"{shape}: {held.simpleString()} is not {schema.simpleString()}")


def rows(df: DataFrame, convert: Any = None) -> list:
    """All rows, each through ``convert`` if given.  For results that are known to be small."""
    found = df.collect()
    return [convert(r) for r in found] if convert else found


def one_or_none(df: DataFrame, strict: bool = True, convert: Any = None) -> Row | Any | None:
    """The only row or none; several are an error unless ``strict`` is off, when the first counts."""
    found = df.limit(2).collect()
    if strict and len(found) > 1:
        raise ValueError("expected one row at most")
    return (convert(found[0]) if convert else found[0]) if found else None


def one(df: DataFrame, strict: bool = True, convert: Any = None) -> Row | Any:
    found = one_or_none(df, strict, convert)
    if found is None:
        raise ValueError("expected one row, found none")
    return found

"""Notes that travel with columns: where a column comes from, and how it is to appear in results.

``tagged`` writes a source's alias, the column's name there and its notes into the metadata of the columns.  Spark
carries metadata through selections, new names, joins and temporary views and drops it where a column is computed,
so a query over views knows the sources of its columns without reading SQL.  Notes of a table hold until a view's
override them, and a view's until the query's do, member by member.

From that, ``resolve`` settles which columns a nested field takes, which column a key means, and, from the joins
made by ``attach``, what to group by.  Nothing here runs a job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from weftline.plans.nesting import COLLECTION, DEFAULT, ENTITY, PER_ROW, Nested, check_labels, nest, nest_rows

META = "weftline"
COLUMN_NOTES = {"name", "sql_type", "type", "adapter", "not_null", "default"}
FIELD_NOTES = {"name", "type", "mapping", "source", "alias_prefix", "key", "null_key_drops", "not_null", "default", "children"}
Adapter = Callable[[Column], Column]


class NoteError(ValueError):
    """A note names something unknown or leaves out what is needed."""


def only(given: Mapping[str, Any], allowed: set[str], where: str) -> None:
    unknown = sorted(set(given) - allowed)
    if unknown:
        raise NoteError(f"{where}: unknown {', '.join(unknown)}")


@dataclass(frozen=True)
class Origin:
    """A result column, the source it comes from (empty for a computed one) and, join by join, the columns its source is joined to."""

    field: str
    source: str
    column: str
    joined: tuple[tuple[tuple[str, str], ...], ...]
    notes: dict[str, Any]

    def is_from(self, source: str) -> bool:
        return bool(self.source) and self.source.lower() == source.lower()

    def named(self, name: str) -> bool:
        return name.lower() in (self.field.lower(), self.column.lower())


def origins(df: DataFrame) -> list[Origin]:
    out = []
    for f in df.schema:
        m = (f.metadata or {}).get(META, {})
        out.append(Origin(f.name, m.get("source", ""), m.get("column", f.name), tuple(tuple((at, column) for at, column in json.loads(j)) for j in m.get("joined", [])), m.get("notes", {})))
    return out


def merged(low: Mapping[str, Any], high: Mapping[str, Any]) -> dict[str, Any]:
    """Notes of a table or view with those of what reads it; a member that is null there overrides nothing."""
    return {**low, **{k: v for k, v in high.items() if v is not None}}


def _written(df: DataFrame, new: Callable[[Origin], dict[str, Any]]) -> DataFrame:
    columns = []
    for f, o in zip(df.schema, origins(df)):
        held = {"source": o.source, "column": o.column, "joined": [json.dumps(j) for j in o.joined], "notes": o.notes}
        columns.append(F.col(f"`{f.name}`").alias(f.name, metadata={**(f.metadata or {}), META: {**held, **new(o)}}))
    return df.select(*columns)


def noted(df: DataFrame, notes: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """The columns with notes of this level, which override those they brought along."""
    known = {c.lower(): c for c in df.columns}
    by_column: dict[str, Mapping[str, Any]] = {}
    for name, given in notes.items():
        if name.lower() not in known:
            raise NoteError(f"{name} is none of {', '.join(df.columns)}")
        only(given, COLUMN_NOTES, name)
        by_column[known[name.lower()]] = given
    return _written(df, lambda o: {"notes": merged(o.notes, by_column.get(o.field, {}))})


def tagged(df: DataFrame, source: str, notes: Mapping[str, Mapping[str, Any]] | None = None) -> DataFrame:
    """A table or view under an alias."""
    if not source or "." in source:
        raise NoteError(f"{source!r} is no alias")
    return _written(noted(df, notes or {}), lambda o: {"source": source, "column": o.field, "joined": []})


def attach(left: DataFrame, right: DataFrame, on: Mapping[str, str], how: str = "left") -> DataFrame:
    """A join on equal columns (left to right) that both sides remember."""
    sides = {o.field.lower(): o for o in origins(left)}, {o.field.lower(): o for o in origins(right)}
    pairs = []
    for a, b in on.items():
        if a.lower() not in sides[0] or b.lower() not in sides[1]:
            raise NoteError(f"{a} or {b} is no column to join on")
        pairs.append((sides[0][a.lower()], sides[1][b.lower()]))

    def remember(df: DataFrame, own: int) -> DataFrame:
        def more(o: Origin) -> dict[str, Any]:
            found = [(p[1 - own].source, p[1 - own].column) for p in pairs if o.is_from(p[own].source)]
            return {"joined": [json.dumps(j) for j in [*o.joined, *([found] if found else [])]]}

        return _written(df, more)

    a, b = remember(left, 0), remember(right, 1)
    condition = F.lit(True)
    for x, y in pairs:
        condition = condition & (a[x.field] == b[y.field])
    return a.join(b, condition, how)


def find_column(df: DataFrame, name: str, nested: set[str] = frozenset()) -> str:
    """The result column that ``source.column`` or a bare name means, in any case; columns outside nested fields come first."""
    every = origins(df)
    outside = [o for o in every if o.field not in nested]
    source, dot, column = name.partition(".")
    if dot:
        tests = [lambda o: o.is_from(source) and o.named(column)]
    else:
        tests = [lambda o: o.field.lower() == name.lower(), lambda o: o.named(name)]
    for test in tests:
        for candidates in (outside, every):
            found = [o.field for o in candidates if test(o)]
            if found:
                return found[0]
    available = sorted(f"{o.source}.{o.column}" if o.source else o.field for o in every)
    raise NoteError(f"{name} is none of {', '.join(available)}")


def _grouping(df: DataFrame, source: str) -> list[str] | None:
    """What a collection of ``source`` is grouped by: the other side of the first join it takes part in, all of its columns.

    None if it takes part in none or none of these columns is selected; some without the others are an error, as
    rows that differ in the others would be taken for one.
    """
    every = origins(df)
    for o in every:
        if o.is_from(source) and o.joined:
            fields = [next((p.field for p in every if p.is_from(at) and p.column.lower() == column.lower()), None) for at, column in o.joined[0]]
            if None in fields and any(fields):
                lost = [f"{at}.{column}" for (at, column), f in zip(o.joined[0], fields) if f is None]
                raise NoteError(f"{source} is joined on {', '.join(lost)} too, which is not selected")
            return None if None in fields else list(dict.fromkeys(fields))
    return None


def _taken(df: DataFrame, spec: Mapping[str, Any], used: set[str]) -> dict[str, str]:
    """Field names and columns: those of the source, else those with the prefix; each column goes to one field only."""
    prefix = spec.get("alias_prefix") or ""
    free = [o for o in origins(df) if o.field not in used]
    found = [o for o in free if o.is_from(spec["source"])]
    if not found and prefix:
        found = [o for o in free if o.field.lower().startswith(prefix.lower())]
        found = [o for o in found if ":" not in o.field[len(prefix) :]] or found
    if not found:
        raise NoteError(f"{spec['name']}: no column comes from {spec['source']}" + (f" or begins with {prefix}" if prefix else ""))
    out: dict[str, str] = {}
    for o in found:
        bare = o.field[len(prefix) :] if prefix and o.field.lower().startswith(prefix.lower()) else o.field
        name = o.notes.get("name") or bare
        if name in out:
            raise NoteError(f"{spec['name']}: two columns are named {name}")
        out[name] = o.field
    return out


def _check(spec: Mapping[str, Any]) -> None:
    only(spec, FIELD_NOTES, spec.get("name", "field"))
    if not spec.get("name"):
        raise NoteError("a nested field needs a name")
    mapping = spec.get("mapping", DEFAULT)
    if mapping not in (COLLECTION, PER_ROW, ENTITY, DEFAULT):
        raise NoteError(f"{spec['name']}: unknown mapping {mapping}")
    if mapping != DEFAULT and not spec.get("source"):
        raise NoteError(f"{spec['name']}: {mapping} needs a source")
    if mapping == DEFAULT and spec.get("source"):
        raise NoteError(f"{spec['name']}: a source needs a mapping")


def _resolve(df: DataFrame, spec: Mapping[str, Any], used: set[str]) -> Nested:
    _check(spec)
    if spec.get("mapping", DEFAULT) == DEFAULT:
        return Nested(spec["name"], DEFAULT, default=spec.get("default"))
    if any(c.get("type") for c in spec.get("children", [])):
        raise NoteError(f"{spec['name']}: a field inside has its type from the field around it")
    children = tuple(_resolve(df, c, used) for c in spec.get("children", []))
    columns = _taken(df, spec, used)
    used |= set(columns.values())
    key = find_column(df, spec["key"]) if spec.get("key") else None
    inner = [c for c in spec.get("children", []) if c.get("mapping") == COLLECTION]
    if key is None and inner:
        found = _grouping(df, inner[0]["source"])
        key = None if found is None else found[0] if len(found) == 1 else tuple(found)
    return Nested(spec["name"], spec["mapping"], columns, key, spec.get("not_null", False), spec.get("default"), children, spec.get("null_key_drops", False))


def resolve(df: DataFrame, specs: list[Mapping[str, Any]], key: str | None = None) -> tuple[str | list[str] | None, list[Nested]]:
    """The root's key and the nested fields, in the order given; fields inside others take their columns first.

    Without a key, the root of collections is grouped by the columns its first collection is joined to: one name, or a list.
    """
    used: set[str] = set()
    nested = [_resolve(df, s, used) for s in specs]
    collections = [s for s in specs if s.get("mapping") == COLLECTION]
    if key is not None:
        return find_column(df, key, used), nested
    if not collections:
        return None, nested
    found = _grouping(df, collections[0]["source"])
    if found is None:
        raise NoteError(f"{collections[0]['name']}: no key is given and no selected column is joined to {collections[0]['source']}")
    return (found[0] if len(found) == 1 else found), nested


def _cast(where: str, value: Column, kind: str) -> Column:
    try:
        return value.cast(DataType.fromDDL(kind))
    except ParseException:
        raise NoteError(f"{where}: {kind} is no type") from None


def adapted(df: DataFrame, adapters: Mapping[str, Adapter] | None = None) -> DataFrame:
    """The columns as their notes want them: ``sql_type``, adapter, ``type`` and default; a null reaches no adapter.

    ``sql_type`` is what a column is read as, for one whose own type says too little; ``type`` is that of the result.
    Names follow later, as ``resolve`` and ``named`` read them.  A null in a ``not_null`` column is an error.
    """
    columns = []
    for f, o in zip(df.schema, origins(df)):
        value, notes = F.col(f"`{f.name}`"), o.notes
        if "sql_type" in notes:
            value = _cast(f.name, value, notes["sql_type"])
        if "adapter" in notes:
            if notes["adapter"] not in (adapters or {}):
                raise NoteError(f"{f.name}: no adapter {notes['adapter']}")
            value = F.when(value.isNotNull(), adapters[notes["adapter"]](value))
        if "type" in notes:
            value = _cast(f.name, value, notes["type"])
        if "default" in notes:
            value = F.coalesce(value, F.lit(notes["default"]))
        if notes.get("not_null"):
            value = F.coalesce(value, F.raise_error(F.lit(f"required field {f.name} is null")))
        columns.append(value.alias(f.name, metadata=f.metadata or {}))
    return df.select(*columns)


def named(df: DataFrame) -> DataFrame:
    """Columns under the names of their notes."""
    return check_labels(df.toDF(*[o.notes.get("name") or o.field for o in origins(df)]))


def nest_noted(df: DataFrame, specs: list[Mapping[str, Any]], order: list[Column], key: str | None = None, adapters: Mapping[str, Adapter] | None = None, sort: bool = True) -> DataFrame:
    """Joined rows to nested results by their notes alone; a field with a ``type`` is cast to it as a whole, elements and all."""
    by, nested = resolve(df, specs, key)
    ready = adapted(df, adapters)
    out = nest(ready, by, nested, order, sort) if by else nest_rows(ready, nested)
    names = {o.field: o.notes["name"] for o in origins(df) if o.notes.get("name")}
    fields = {n.name for n in nested}
    out = out.withColumns({s["name"]: _cast(s["name"], F.col(f"`{s['name']}`"), s["type"]) for s in specs if s.get("type")})
    return check_labels(out.toDF(*[c if c in fields else names.get(c, c) for c in out.columns]))

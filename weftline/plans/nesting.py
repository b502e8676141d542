"""Joined rows to nested results.

A query over related tables gives flat rows, in which a parent's columns repeat for each child.  ``nest`` turns
them into one row per parent with structs for single related rows and ordered arrays of structs for related
collections.  It works by aggregation on the parent's key, so each level costs one shuffle, and partial
aggregation applies to all of it but the arrays themselves.

Rules.  A parent's own fields come from its first row.  A collection leaves out elements whose columns are all
null (with ``null_key_drops``: whose key is null, whatever else they hold) and keeps, of elements with one key, the first; null is a key like any other, and without a key all
elements stay.  A single related row is taken from the first row in which any of its columns is not null; it is
null if there is none, which is an error for a field marked ``not_null``.  Order is that of ``order``, which must
place the rows of a parent without ties.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.running import COUNT, with_running

COLLECTION, PER_ROW, ENTITY, DEFAULT = "collection", "per_row", "entity", "default"
_ORD = "__ord"


@dataclass(frozen=True)
class Nested:
    """A nested field: ``columns`` maps its field names to columns of the joined rows; ``key`` is one column or several."""

    name: str
    mapping: str
    columns: dict[str, str] = field(default_factory=dict)
    key: str | tuple[str, ...] | None = None
    not_null: bool = False
    default: Any = None
    children: tuple[Nested, ...] = ()
    null_key_drops: bool = False

    def __post_init__(self) -> None:
        if self.mapping not in (COLLECTION, PER_ROW, ENTITY, DEFAULT):
            raise ValueError(f"{self.name}: unknown mapping {self.mapping}")
        if self.mapping != DEFAULT and not self.columns:
            raise ValueError(f"{self.name}: no column belongs to it")
        if any(c.mapping == COLLECTION for c in self.children) and self.key is None:
            raise ValueError(f"{self.name}: a collection inside needs a key")
        if self.null_key_drops and (self.mapping != COLLECTION or self.key is None):
            raise ValueError(f"{self.name}: only a collection with a key drops null keys")

    def used(self) -> set[str]:
        return set(self.columns.values()).union(*(c.used() for c in self.children))


def inherit(of_view: list[Nested], own: list[Nested]) -> list[Nested]:
    """Nested fields of a query over a view that has some already.

    A field that the query declares itself replaces the view's of that name, but takes over its key if it names
    none; fields of the view that stand inside a field of the query, or that lost all their columns, go.
    """
    known = {n.name: n for n in of_view}
    merged = [replace(n, key=n.key or known[n.name].key) if n.name in known else n for n in own]
    inside = {c.name for n in own for c in n.children}
    taken = set().union(*(n.used() for n in own)) if own else set()
    names = {n.name for n in own} | inside
    rest = [n for n in of_view if n.name not in names and (n.mapping == DEFAULT or not n.used() <= taken)]
    return rest + merged


def prefixed(df: DataFrame, prefix: str) -> dict[str, str]:
    """Columns that begin with a prefix, by the rest of their name; longer prefixes inside (``a__b__``) are left out."""
    rest = {c[len(prefix) :]: c for c in df.columns if c.lower().startswith(prefix.lower())}
    return {name: c for name, c in rest.items() if "__" not in name}


def check_labels(df: DataFrame) -> DataFrame:
    """Two result columns of one name are an error."""
    seen = [c.lower() for c in df.columns]
    twice = sorted({c for c in seen if seen.count(c) > 1})
    if twice:
        raise ValueError(f"duplicate result columns: {', '.join(twice)}")
    return df


def _struct(node: Nested, inner: list[Column] = ()) -> Column:
    return F.struct(*[F.col(c).alias(name) for name, c in node.columns.items()], *inner)


def _present(node: Nested) -> Column:
    if node.null_key_drops:
        return F.col(node.key).isNotNull()
    out = F.lit(False)
    for c in sorted(node.used()):
        out = out | F.col(c).isNotNull()
    return out


def _required(node: Nested, value: Column) -> Column:
    """The value; for a required field, an error in its place if it is null."""
    if not node.not_null:
        return value
    complaint = F.assert_true(value.isNotNull(), f"required field {node.name} is null")
    return F.when(complaint.isNull(), value)


def _flat_element(node: Nested) -> Column:
    inner = [_row_value(c).alias(c.name) for c in node.children if c.mapping != COLLECTION]
    return _struct(node, inner)


def _row_value(node: Nested) -> Column:
    """A single nested value of one joined row."""
    if node.mapping == DEFAULT:
        return F.lit(node.default)
    value = _flat_element(node)
    if node.mapping == ENTITY and node.not_null and not node.children:
        return value
    return _required(node, F.when(_present(node), value))


def nest_rows(df: DataFrame, nested: list[Nested]) -> DataFrame:
    """Without collections: each joined row gives one result row."""
    used = set().union(*(n.used() for n in nested)) if nested else set()
    return df.select(*[c for c in df.columns if c not in used], *[_row_value(n).alias(n.name) for n in nested])


def _keep_first(pairs: Column, keyed: bool) -> Column:
    """Sorted elements, of each key the first."""
    if keyed:
        by_key = F.sort_array(F.transform(pairs, lambda p: F.struct(p["k"].alias("k"), p["o"].alias("o"), p["e"].alias("e"))))
        pairs = F.get(F.transform(F.array(by_key), lambda all_: F.filter(all_, lambda p, i: (i == 0) | ~p["k"].eqNullSafe(F.get(all_, i - 1)["k"]))), F.lit(0))
        pairs = F.transform(pairs, lambda p: F.struct(p["o"].alias("o"), p["e"].alias("e")))
    else:
        pairs = F.transform(pairs, lambda p: F.struct(p["o"].alias("o"), p["e"].alias("e")))
    return F.transform(F.sort_array(pairs), lambda p: p["e"])


def _collected(node: Nested, element: Column, present: Column) -> Column:
    key = F.col(node.key) if node.key else F.lit(None).cast("string")
    return F.collect_list(F.when(present, F.struct(key.alias("k"), F.col(_ORD).alias("o"), element.alias("e"))))


def _place(n: Nested) -> Column:
    """Where a single related row may come from: null in rows that do not have it."""
    always = n.mapping == ENTITY and n.not_null and not n.children
    return F.col(_ORD) if always else F.when(_present(n), F.col(_ORD))


def _only_deep(nested: tuple[Nested, ...]) -> Nested | None:
    """The collection with collections inside, if it is the only collection here and nothing goes deeper."""
    found = [n for n in nested if n.mapping == COLLECTION]
    if len(found) != 1 or not any(c.mapping == COLLECTION for c in found[0].children):
        return None
    deeper = any(g.mapping == COLLECTION for c in found[0].children for g in c.children)
    return None if deeper else found[0]


def _two_levels(df: DataFrame, keys: list[str], scalars: list[str], nested: tuple[Nested, ...], n: Nested) -> DataFrame:
    """``_level`` with the joined rows read once: elements first, then their parents from the elements."""
    singles = [m for m in nested if m.mapping in (PER_ROW, ENTITY)]
    here = F.when(_present(n), F.col(_ORD))
    own = [c for c in dict.fromkeys(n.columns.values()) if c not in keys and c != n.key]
    aggregates = [
        F.min(_ORD).alias("__first"),
        F.min_by(F.struct(F.lit(0).alias("__"), *scalars), F.col(_ORD)).alias("__root"),
        F.min(here).alias("__at"),
        F.min_by(F.struct(F.lit(0).alias("__"), *own), here).alias("__own"),
    ]
    aggregates += [F.min_by(F.struct(_place(m).alias("o"), _flat_element(m).alias("e")), _place(m)).alias(f"__n_{m.name}") for m in singles]
    for c in n.children:
        if c.mapping == COLLECTION:
            aggregates.append(_collected(c, _flat_element(c), _present(c)).alias(f"__c_{c.name}"))
        elif c.mapping != DEFAULT:
            always = c.mapping == ENTITY and c.not_null and not c.children
            aggregates.append(F.min_by(_flat_element(c), here if always else _place(c)).alias(f"__c_{c.name}"))
    elements = df.groupBy(*keys, n.key).agg(*aggregates)

    def inside(c: Nested) -> Column:
        if c.mapping == COLLECTION:
            return _keep_first(F.col(f"__c_{c.name}"), c.key is not None)
        return F.lit(c.default) if c.mapping == DEFAULT else F.col(f"__c_{c.name}")

    fields = [(F.col("__own")[c] if c in own else F.col(c)).alias(name) for name, c in n.columns.items()]
    element = F.struct(*fields, *[inside(c).alias(c.name) for c in n.children])
    parents = elements.groupBy(*keys).agg(
        F.min("__first").alias(_ORD),
        F.min_by("__root", "__first").alias("__root"),
        F.collect_list(F.when(F.col("__at").isNotNull(), F.struct(F.col("__at").alias("o"), element.alias("e")))).alias("__list"),
        *[F.min_by(f"__n_{m.name}", F.col(f"__n_{m.name}")["o"]).alias(f"__n_{m.name}") for m in singles],
    )
    columns = [F.col(k) for k in keys] + [F.col("__root")[c].alias(c) for c in scalars]
    for m in nested:
        if m is n:
            value = F.transform(F.sort_array("__list"), lambda p: p["e"])
        else:
            value = F.lit(m.default) if m.mapping == DEFAULT else _required(m, F.col(f"__n_{m.name}")["e"])
        columns.append(value.alias(m.name))
    return parents.select(*columns, _ORD)


def _level(df: DataFrame, keys: list[str], scalars: list[str], nested: tuple[Nested, ...]) -> DataFrame:
    """One row per key: the scalars, the nested fields, and the first place (__ord)."""
    only = _only_deep(nested)
    if only is not None and not any(c.not_null for c in only.children):
        return _two_levels(df, keys, scalars, nested, only)
    aggregates = [F.min(_ORD).alias("__first")]
    aggregates += [F.min_by(F.col(c), F.col(_ORD)).alias(f"__s_{c}") for c in scalars]
    deep = [n for n in nested if n.mapping == COLLECTION and any(c.mapping == COLLECTION for c in n.children)]
    for n in nested:
        if n.mapping == COLLECTION and n not in deep:
            aggregates.append(_collected(n, _flat_element(n), _present(n)).alias(f"__n_{n.name}"))
        elif n.mapping in (PER_ROW, ENTITY):
            aggregates.append(F.min_by(_flat_element(n), _place(n)).alias(f"__n_{n.name}"))
    out = df.groupBy(*keys).agg(*aggregates)
    for n in deep:
        inside = _level(df.filter(_present(n)), [*keys, n.key], [c for c in n.columns.values() if c not in (*keys, n.key)], n.children)
        element = F.struct(*[F.col(c).alias(name) for name, c in n.columns.items()], *[F.col(c.name) for c in n.children])
        grouped = inside.groupBy(*keys).agg(F.collect_list(F.struct(F.col(_ORD).alias("o"), element.alias("e"))).alias(f"__n_{n.name}"))
        same = [f"__k{i}" for i in range(len(keys))]
        grouped = grouped.select(*[F.col(k).alias(s) for k, s in zip(keys, same)], f"__n_{n.name}")
        on = F.lit(True)
        for k, s in zip(keys, same):
            on = on & out[k].eqNullSafe(grouped[s])
        out = out.join(grouped, on, "left").drop(*same)
    columns = [F.col(k) for k in keys] + [F.col(f"__s_{c}").alias(c) for c in scalars]
    for n in nested:
        value = F.col(f"__n_{n.name}")
        if n.mapping == COLLECTION and n in deep:
            value = F.coalesce(F.transform(F.sort_array(value), lambda p: p["e"]), F.array())
        elif n.mapping == COLLECTION:
            value = _keep_first(value, n.key is not None)
        elif n.mapping == DEFAULT:
            value = F.lit(n.default)
        else:
            value = _required(n, value)
        columns.append(value.alias(n.name))
    return out.select(*columns, F.col("__first").alias(_ORD))


def _keys(n: Nested) -> list[str]:
    return [] if n.key is None else [n.key] if isinstance(n.key, str) else list(n.key)


def _single_keys(nested: tuple[Nested, ...], made: dict[str, Column]) -> tuple[Nested, ...]:
    """The fields with every key of several columns replaced by one struct column, which is put into ``made``."""
    out = []
    for n in nested:
        inner = _single_keys(n.children, made)
        if isinstance(n.key, str) or n.key is None:
            out.append(replace(n, children=inner))
            continue
        name = f"__key_{len(made)}"
        known = F.lit(True)
        for c in n.key:
            known = known & F.col(c).isNotNull()
        both = F.struct(*[F.col(c) for c in n.key])
        made[name] = F.when(known, both) if n.null_key_drops else both
        out.append(replace(n, key=name, children=inner))
    return tuple(out)


def nest(df: DataFrame, key: str | list[str], nested: list[Nested], order: list[Column], sort: bool = True) -> DataFrame:
    """One row per ``key``, a column or several; columns that no nested field uses are the parent's own.

    A key of several columns whose parts are partly null is one like any other, but for ``null_key_drops``.
    LIMIT and OFFSET belong to the joined rows: apply them to ``df`` before.
    """
    check_labels(df)
    keys = [key] if isinstance(key, str) else list(key)
    for k in keys:
        if k not in df.columns:
            raise ValueError(f"key {k} is none of {', '.join(df.columns)}")

    def check(n: Nested) -> None:
        missing = sorted((n.used() | set(_keys(n))) - set(df.columns))
        if missing:
            raise ValueError(f"{n.name}: {', '.join(missing)} are none of {', '.join(df.columns)}")
        for c in n.children:
            check(c)

    for n in nested:
        check(n)
    used = set().union(*(n.used() for n in nested)) - set(keys) if nested else set()
    scalars = [c for c in df.columns if c not in used and c not in keys]
    made: dict[str, Column] = {}
    single = _single_keys(tuple(nested), made)
    placed = df.withColumns({**made, _ORD: F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])})
    out = _level(placed, keys, scalars, single)
    return (out.orderBy(_ORD) if sort else out).drop(_ORD)


def nest_children(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, list[str], list[Column]]]) -> DataFrame:
    """The same result where parents and children come from different tables, without joining siblings.

    Each child table (with its foreign key, fields and order) is collected by its foreign key before the join,
    so two collections of one parent never multiply.  Valid if no limit and no filter spans several children.
    """
    out = parents
    for name, (child, foreign_key, fields, order) in children.items():
        element = F.struct(*[F.col(c) for c in fields])
        place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
        lists = child.groupBy(F.col(foreign_key).alias("__fk")).agg(F.sort_array(F.collect_list(F.struct(place.alias("o"), element.alias("e")))).alias("__list"))
        out = out.join(lists, out[key] == lists["__fk"], "left").drop("__fk")
        out = out.withColumn(name, F.coalesce(F.transform("__list", lambda p: p["e"]), F.array())).drop("__list")
    return out


def nest_chunks(child: DataFrame, foreign_key: str, fields: list[str], order: list[Column], max_rows: int) -> DataFrame:
    """Collections in bounded rows: (foreign key, chunk, elements), at most ``max_rows`` elements in one, chunks from 0 in ``order``.

    A parent with any number of children never is one array, and its children are numbered over many tasks; the chunks
    of a parent one behind another are what ``nest_children`` would give.  ``order`` should have no ties within a parent.
    """
    if max_rows < 1:
        raise ValueError("a chunk holds at least one row")
    narrow = child.select(F.col(foreign_key).alias("__fk"), F.struct(*fields).alias("__e"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("__o"))
    numbered = with_running(narrow, ["__fk"], [F.col("__o")], {"__n": (COUNT, F.lit(1))})
    chunk = F.floor((F.col("__n") - 1) / max_rows).cast("long")
    listed = F.sort_array(F.collect_list(F.struct(F.col("__n").alias("n"), F.col("__e").alias("e"))))
    return numbered.groupBy(F.col("__fk").alias(foreign_key), chunk.alias("chunk")).agg(F.transform(listed, lambda x: x["e"]).alias("elements"))

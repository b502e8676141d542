"""Changes to tables as new versions of them: each function takes DataFrames and returns a ``Changed``.

``table`` is the table after the change, ``returning`` the rows it touched (new state of inserted and updated
rows, old state of deleted ones), ``log`` the change log from which ``changes.fold`` derives dirty rows.  Nothing
is written: the caller writes the new version where its tables live.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.ordinals import settled


@dataclass(frozen=True)
class Changed:
    table: DataFrame
    returning: DataFrame

    def columns(self, *names: str) -> DataFrame:
        """Some of the returned columns; plain columns of the table only."""
        unknown = sorted(set(names) - set(self.table.columns))
        if unknown:
            raise ValueError(f"{', '.join(unknown)} are no columns of the table")
        return self.returning.select(*(names or self.table.columns))


def _complete(table: DataFrame, rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Columns that the rows lack get their default, else null; a null that is given stays."""
    extra = sorted(set(rows.columns) - set(table.columns))
    if extra:
        raise ValueError(f"{', '.join(extra)} are no columns of the table")
    kinds = dict(table.dtypes)
    values = {c: F.col(c) if c in rows.columns else defaults.get(c, F.lit(None)) for c in table.columns}
    return rows.select(*[v.cast(kinds[c]).alias(c) for c, v in values.items()])


def values(table: DataFrame, rows: list[dict[str, Any]]) -> DataFrame:
    """Given values as rows with the types of the table's columns, in any case; all rows name the same columns."""
    fields = {f.name.lower(): f for f in table.schema}
    names = {n.lower() for n in rows[0]} if rows else set()
    unknown = sorted(names - set(fields))
    if unknown or any({n.lower() for n in r} != names for r in rows):
        raise ValueError(f"{', '.join(unknown)} are no columns of the table" if unknown else "rows name different columns")
    kinds = T.StructType([T.StructField(f.name, f.dataType) for n, f in fields.items() if n in names])

    def typed(f: T.StructField, v: Any) -> Any:
        whole = isinstance(f.dataType, (T.DoubleType, T.FloatType)) and isinstance(v, int) and not isinstance(v, bool)
        return float(v) if whole else v

    by_name = [{n.lower(): v for n, v in r.items()} for r in rows]
    return table.sparkSession.createDataFrame([tuple(typed(f, r[f.name.lower()]) for f in kinds) for r in by_name], kinds)


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> Changed:
    """INSERT of values or of a query's rows."""
    new = _complete(table, rows, defaults or {})
    return Changed(table.unionByName(new), new)


@dataclass(frozen=True)
class Fold:
    """What a column becomes where rows of one statement meet one key, one after another.

    ``step`` takes the old and the given value.  ``given`` folds what several rows give into one value, by an
    aggregate of their values and places, and ``met`` joins that with the old value, so rows of one key need not be
    held together; a plain function of old and given value is folded over an array of the key's values instead.
    """

    step: Callable[[Column, Column], Column]
    given: Callable[[Column, Column], Column] | None = None
    met: Callable[[Column, Column], Column] | None = None


def _all_known(value: Column, folded: Column) -> Column:
    return F.when(F.count_if(value.isNull()) == 0, folded)


#: The value given last; the sum, largest, smallest of all; the last one that is not null.
LAST = Fold(lambda old, given: given, lambda v, at: F.max_by(F.struct(v.alias("v")), at)["v"], lambda old, folded: folded)
ADD = Fold(lambda old, given: old + given, lambda v, at: _all_known(v, F.sum(v)), lambda old, folded: old + folded)
LARGEST = Fold(F.greatest, lambda v, at: F.max(v), F.greatest)
SMALLEST = Fold(F.least, lambda v, at: F.min(v), F.least)
LAST_KNOWN = Fold(lambda old, given: F.coalesce(given, old), lambda v, at: F.max_by(v, F.when(v.isNotNull(), at)), lambda old, folded: F.coalesce(folded, old))


def _placed(table: DataFrame, rows: DataFrame, key: list[str], defaults: dict[str, Column], order: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """Complete new rows with ``__at``, their place, and those without a whole key, which meet no other row.

    Without an order a repeated key is an error, when the rows are read: no row of a DataFrame comes first.
    """
    lost = [c for c in order or [] if c not in rows.columns]
    if lost:
        raise ValueError(f"{', '.join(lost)}: no columns to order the rows by")
    unknown = sorted(set(rows.columns) - set(table.columns) - set(order or []))
    if unknown:
        raise ValueError(f"{', '.join(unknown)} are no columns of the table")
    kinds = dict(table.dtypes)
    at = F.struct(*[F.col(c) for c in order]) if order else F.lit(0)
    given = {c: F.col(c) if c in rows.columns else defaults.get(c, F.lit(None)) for c in table.columns}
    placed = rows.select(*[v.cast(kinds[c]).alias(c) for c, v in given.items()], at.alias("__at"))
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    return placed.filter(whole), placed.filter(~whole).drop("__at")


def _once(key: list[str], order: list[str] | None) -> Column | None:
    """Per key: an error if it is repeated and no order says which row comes first."""
    return None if order else F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("a key is given twice and no order: "), F.concat_ws(", ", *[F.col(c).cast("string") for c in key]))))


def upsert(
    table: DataFrame, rows: DataFrame, key: list[str], update: dict[str, Fold | Callable[[Column, Column], Column]] | None = None, defaults: dict[str, Column] | None = None, order: list[str] | None = None
) -> Changed:
    """INSERT ... ON CONFLICT (key) DO UPDATE SET, row by row in ``order`` (columns of the rows, of the table or not).

    ``update`` maps columns to a ``Fold`` or to a function of the old and the given value; None updates all other
    columns to the value given last.  A new key takes its first row as it is, and the rows behind it update that.
    Rows without a whole key are inserted.  ``returning`` has one row for each key that was touched, in its last
    state.  A key's rows are folded before the one join with the table: by aggregates for the folds above, by an
    array of the key's values for a function.
    """
    placed, loose = _placed(table, rows, key, defaults or {}, order)
    update = {c: LAST for c in table.columns if c not in key} if update is None else update
    folds = {c: f if isinstance(f, Fold) else Fold(f) for c, f in update.items()}
    others = [c for c in table.columns if c not in key]
    aggregates = [F.min_by(F.struct(*[F.col(c) for c in others] or [F.lit(0).alias("_")]), "__at").alias("__first"), F.count("*").alias("__n")]
    for c, f in folds.items():
        listed = F.sort_array(F.collect_list(F.struct(F.col("__at").alias("o"), F.col(c).alias("v"))))
        aggregates.append((f.given(F.col(c), F.col("__at")) if f.given else F.transform(listed, lambda x: x["v"])).alias(f"__f_{c}"))
    check = _once(key, order)
    if check is not None:
        aggregates.append(check.alias("__once"))
    given = placed.groupBy(*[F.col(c).alias(f"__new_{c}") for c in key]).agg(*aggregates)
    if check is not None:
        given = given.filter(F.col("__once").isNull()).drop("__once")
    on = F.lit(True)
    for c in key:
        on = on & (table[c] == given[f"__new_{c}"])
    both = table.withColumn("__old", F.lit(True)).join(given, on, "full_outer")

    kinds = {f.name: f.dataType for f in table.schema}

    def merged(c: str) -> Column:
        if c in key:
            return F.coalesce(F.col(c), F.col(f"__new_{c}"))
        if c not in folds:
            return F.when(F.col("__old"), F.col(c)).otherwise(F.col("__first")[c])
        fold, folded, first = folds[c], F.col(f"__f_{c}"), F.col("__first")[c]
        if fold.given:
            changed = F.when(F.col("__n").isNull(), F.col(c)).otherwise(fold.met(F.col(c), folded))
            return F.when(F.col("__old"), changed).otherwise(folded)
        rest = F.when(F.col("__old"), folded).otherwise(F.slice(folded, F.lit(2), F.greatest(F.size(folded) - 1, F.lit(0))))
        start = F.when(F.col("__old"), F.col(c)).otherwise(first)
        return F.aggregate(F.coalesce(rest, F.array().cast(f"array<{kinds[c].simpleString()}>")), start, lambda old, value: fold.step(old, value).cast(kinds[c]))

    out = both.select(*[merged(c).cast(kinds[c]).alias(c) for c in table.columns], F.col("__n").isNotNull().alias("__touched"))
    return Changed(out.drop("__touched").unionByName(loose), out.filter("__touched").drop("__touched").unionByName(loose))


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: list[str], defaults: dict[str, Column] | None = None, order: list[str] | None = None) -> Changed:
    """INSERT ... ON CONFLICT (key) DO NOTHING, row by row in ``order``: of new rows with one key the first stays."""
    placed, loose = _placed(table, rows, key, defaults or {}, order)
    others = [c for c in table.columns if c not in key]
    check = _once(key, order)
    first = placed.groupBy(*key).agg(F.min_by(F.struct(*[F.col(c) for c in others] or [F.lit(0).alias("_")]), "__at").alias("__first"), *([check.alias("__once")] if check is not None else []))
    if check is not None:
        first = first.filter(F.col("__once").isNull())
    fresh = first.join(table.select(*key), key, "left_anti").select(*[F.col(c) if c in key else F.col("__first")[c].alias(c) for c in table.columns]).unionByName(loose)
    return Changed(table.unionByName(fresh), fresh)


def update(table: DataFrame, where: Column, values: dict[str, Column]) -> Changed:
    """UPDATE ... SET ... WHERE; a condition that is null does not hold."""
    hit = F.coalesce(where, F.lit(False))
    kinds = dict(table.dtypes)
    marked = table.withColumn("__hit", hit)
    changed = marked.select(*[F.when(F.col("__hit"), values[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns], "__hit")
    return Changed(changed.drop("__hit"), changed.filter("__hit").drop("__hit"))


def delete(table: DataFrame, where: Column) -> Changed:
    """DELETE ... WHERE."""
    # the condition as it is can be pushed into the scan; rows for which it is null stay
    return Changed(table.filter(~F.coalesce(where, F.lit(False))), table.filter(where))


def delete_matching(table: DataFrame, keys: DataFrame, on: list[str]) -> Changed:
    """DELETE of the rows whose key occurs in ``keys``; keys may repeat, none delete nothing."""
    return Changed(table.join(keys, on, "left_anti").select(*table.columns), table.join(keys, on, "left_semi").select(*table.columns))


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    parent_column: str


def cascade_delete(tables: dict[str, DataFrame], root: str, where: Column, keys: list[ForeignKey]) -> dict[str, Changed]:
    """DELETE with ON DELETE CASCADE along foreign keys; each table that they lead to by name.

    Keys may lead from a table to itself and in circles.  What goes is found row by row: the keys that the rows of
    one round lose are met with the tables that refer to them, and the rows found there, less those found before, are
    the next round's, until none are found.  Rounds are as many as the longest chain of rows.  Each round keeps only
    the columns that other tables refer to; the tables themselves are read once more at the end.
    """
    reached, waiting = [root], [root]
    while waiting:
        name = waiting.pop(0)
        for child in dict.fromkeys(k.child for k in keys if k.parent == name):
            if child not in reached:
                reached.append(child)
                waiting.append(child)
    keys = [k for k in keys if k.parent in reached]
    referred = {name: sorted({k.parent_column for k in keys if k.parent == name}) for name in reached}
    marked = F.coalesce(where, F.lit(False))

    def known(df: DataFrame, name: str) -> DataFrame:
        """The columns that others refer to; a row without any of them is referred to by none.

        They come out of an array: Spark would carry what it knows of the columns through every checkpoint, and
        what it then derives doubles with each round.
        """
        rows = df.dropna(how="all", subset=referred[name])
        return rows.select(F.explode(F.array(F.struct(*referred[name]))).alias("x")).select("x.*")

    def every(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    front = {root: settled(known(tables[root].filter(where), root).distinct())} if referred[root] else {}
    lost: dict[str, list[DataFrame]] = {name: [f] for name, f in front.items()}
    while front:
        found: dict[str, list[DataFrame]] = {}
        for k in keys:
            if k.parent in front and referred[k.child]:
                gone = front[k.parent].select(F.col(k.parent_column).alias("__gone"))
                table = tables[k.child]
                found.setdefault(k.child, []).append(known(table.join(gone, table[k.column] == gone["__gone"], "left_semi"), k.child))
        front = {}
        for name, hits in found.items():
            # what was found before, in a circle of rows, counts once: a group that holds any of it is left out
            columns = referred[name]
            seen = [p.withColumn("__seen", F.lit(True)) for p in lost.get(name, [])]
            marked_hits = every([*[h.withColumn("__seen", F.lit(False)) for h in hits], *seen])
            fresh = settled(marked_hits.groupBy(*columns).agg(F.bool_or("__seen").alias("__seen")).filter(~F.col("__seen")).select(*columns))
            if not fresh.isEmpty():
                front[name] = fresh
                lost.setdefault(name, []).append(fresh)
    out: dict[str, Changed] = {}
    for name in reached:
        kept, gone = tables[name], None
        if name == root:
            kept, gone = tables[name].filter(~marked), tables[name].filter(where)
        for k in keys:
            if k.child == name and k.parent in lost:
                going = every([p.select(F.col(k.parent_column).alias("__gone")) for p in lost[k.parent]])
                hit = kept.join(going, kept[k.column] == going["__gone"], "left_semi")
                gone = hit if gone is None else gone.unionByName(hit)
                kept = kept.join(going, kept[k.column] == going["__gone"], "left_anti")
        out[name] = Changed(kept, tables[name].limit(0) if gone is None else gone)
    return out


def violations(table: DataFrame, name: str, not_null: list[str] = (), unique: list[list[str]] = (), checks: dict[str, Column] | None = None, foreign: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """Rows (table, rule, n) for each rule that is broken, with the number of rows or keys that break it."""
    flat = [F.count(F.when(F.col(c).isNull(), 1)).alias(f"not_null:{c}") for c in not_null]
    flat += [F.count(F.when(~F.coalesce(cond, F.lit(True)), 1)).alias(f"check:{label}") for label, cond in (checks or {}).items()]
    parts = []
    if flat:
        counted = table.agg(*flat)
        parts.append(counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("n")) for c in counted.columns])).alias("x")).select("x.*"))
    for key in unique:
        known = F.lit(True)
        for c in key:
            known = known & F.col(c).isNotNull()
        twice = table.filter(known).groupBy(*key).count().filter("count > 1")
        parts.append(twice.agg(F.count("*").alias("n")).select(F.lit(f"unique:{','.join(key)}").alias("rule"), "n"))
    for column, (parent, parent_column) in (foreign or {}).items():
        there = parent.select(F.col(parent_column).alias("__p")).distinct()
        orphans = table.filter(F.col(column).isNotNull()).join(there, F.col(column) == F.col("__p"), "left_anti")
        parts.append(orphans.agg(F.count("*").alias("n")).select(F.lit(f"foreign:{column}").alias("rule"), "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter("n > 0").select(F.lit(name).alias("table"), "rule", "n")

"""Sets of tables: views that build on each other, who is affected by a change, versions and migrations."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

Tables = dict[str, DataFrame]


def register_views(spark: SparkSession, views: dict[str, str]) -> list[str]:
    """Creates temporary views, each after those it names; returns the order.  Members of a cycle are an error."""
    waiting, order = dict(views), []
    while waiting:
        names = lambda sql, own: any(re.search(rf"\b{re.escape(o)}\b", sql, re.I) for o in waiting if o != own)
        ready = [name for name, sql in waiting.items() if not names(sql, name)]
        if not ready:
            raise ValueError(f"views build on each other: {', '.join(waiting)}")
        for name in ready:
            spark.sql(waiting.pop(name)).createOrReplaceTempView(name)
            order.append(name)
    return order


def star(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """All columns of an inner join; of those that both sides have (in any case), the left side's."""
    known = {c.lower() for c in left.columns}
    return left.join(right, on).select(*[left[c] for c in left.columns], *[right[c] for c in right.columns if c.lower() not in known])


def affected_by_read(tables: set[str], view_sources: dict[str, set[str]]) -> set[str]:
    """Tables whose change alters a result that reads ``tables``: themselves and all that their views rest on."""
    out, queue = set(), [t.lower() for t in tables]
    sources = {v.lower(): {s.lower() for s in reads} for v, reads in view_sources.items()}
    while queue:
        name = queue.pop()
        if name not in out:
            out.add(name)
            queue += sources.get(name, ())
    return out


def affected_by_write(table: str, action: str, cascades: dict[str, dict[str, set[str]]]) -> set[str]:
    """Tables that a change of ``table`` reaches, along the cascades declared for the action."""
    out, queue = set(), [table.lower()]
    known = {t.lower(): {a: {x.lower() for x in to} for a, to in by.items()} for t, by in cascades.items()}
    while queue:
        name = queue.pop()
        if name not in out:
            out.add(name)
            queue += known.get(name, {}).get(action, ())
    return out


def parent_first(tables: list[str], references: dict[str, set[str]]) -> list[str]:
    """Order in which a table follows those it references; ties and cycles keep the given order."""
    left, out = list(tables), []
    while left:
        ready = [t for t in left if not ((references.get(t, set()) - {t}) & set(left))]
        out += ready[:1] or left
        left = [t for t in left if t not in out]
    return out


MIGRATION = re.compile(r"^(\d{4})(?:_.*)?$")


def migrate(tables: Tables, version: int, steps: dict[str, Callable[[Tables], Tables]], fresh: Callable[[], Tables] | None = None) -> tuple[Tables, int]:
    """Applies the steps above ``version`` in ascending order; -1 is a fresh start, from ``fresh`` at the latest version.

    Steps are named ``NNNN`` or ``NNNN_text``.  The new version is for the caller to store, after the tables.
    """
    numbered: dict[int, Callable[[Tables], Tables]] = {}
    for name, step in steps.items():
        found = MIGRATION.match(name)
        if not found:
            raise ValueError(f"{name}: a step is named NNNN or NNNN_text")
        if int(found[1]) in numbered:
            raise ValueError(f"{name}: version {int(found[1])} exists already")
        numbered[int(found[1])] = step
    latest = max(numbered, default=0)
    if version == -1 and fresh is not None:
        return fresh(), latest
    for at in sorted(n for n in numbered if n > version):
        tables = numbered[at](dict(tables))
    return tables, max(latest, version)


def save_version(tables: Tables, path: str, version: int, guard: Callable[[], None] | None = None) -> None:
    """Writes all tables of a version beside earlier ones; readers name the version they want.

    ``guard`` is asked first and may refuse (``changes.guard_write`` while a synchronisation step is open).
    """
    if guard is not None:
        guard()
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/v{version}/{name}")


def load_version(spark: SparkSession, path: str, version: int, names: list[str]) -> Tables:
    return {name: spark.read.parquet(f"{path}/v{version}/{name}") for name in names}

"""Results that follow their tables: a query runs once at the start and again when a table it rests on changes."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.tables import affected_by_read


class Versions:
    """Counts changes of tables; watchers see the tables that changed since they last looked."""

    def __init__(self) -> None:
        self.now: dict[str, int] = {}

    def changed(self, tables: Iterable[str]) -> None:
        for t in tables:
            self.now[t.lower()] = self.now.get(t.lower(), 0) + 1


class Watch:
    """A query with the tables that it reads; ``poll`` runs it if any of them changed (and the first time)."""

    def __init__(self, versions: Versions, reads: set[str], query: Callable[[], DataFrame], views: dict[str, set[str]] | None = None):
        self.versions, self.query = versions, query
        self.tables = affected_by_read(reads, views or {})
        self.seen: dict[str, int] | None = None

    def poll(self) -> DataFrame | None:
        now = {t: self.versions.now.get(t, 0) for t in self.tables}
        if now == self.seen:
            return None
        self.seen = now
        return self.query()


def follow(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Runs ``apply`` on each batch of a stream of changes, at least once; it must be able to see a batch again."""
    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

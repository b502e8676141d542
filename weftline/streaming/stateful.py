"""Changes folded by key with state that lives in the stream: each batch costs what it brings, not what is known already."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGED = "key string, ord long, op string, payload string, changes long, gone boolean"
_STATE = "ord long, op string, payload string, changes long"


def fold_stream(changes: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """A stream of changes (key, ord, op, payload) to a stream of keys' new states: one row for each key that a batch moves.

    The change with the greatest ``ord`` counts; an older one that comes late is counted and does not win.  A deleted key
    keeps its state, so that late changes of it do not bring it back, until it has been quiet for ``forget_ms`` of
    processing time; then its state goes (``gone``).  A key's rows of a batch come in Arrow batches and are folded as they come.
    """
    timed = forget_ms is not None

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            ord_, op, payload, n = state.get
            state.remove()
            yield pd.DataFrame([(key[0], ord_, op, payload, n, True)], columns=["key", "ord", "op", "payload", "changes", "gone"])
            return
        ord_, op, payload, n = state.get if state.exists else (None, None, None, 0)
        for rows in batches:
            for row in rows.itertuples(index=False):
                n += int(row.n)
                if ord_ is None or row.ord > ord_:
                    ord_, op, payload = int(row.ord), row.op, None if pd.isna(row.payload) else row.payload
        state.update((ord_, op, payload, n))
        if timed and op == "DELETE":
            state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame([(key[0], ord_, op, payload, n, False)], columns=["key", "ord", "op", "payload", "changes", "gone"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if timed else GroupStateTimeout.NoTimeout
    ready = changes.select("key", "ord", "op", "payload", F.lit(1).cast("long").alias("n"))
    return ready.groupBy("key").applyInPandasWithState(step, CHANGED, _STATE, "update", timeout)


def start(changes: DataFrame, path: str, forget_ms: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Writes the states that move, batch by batch, below ``path``: a batch that runs again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/moved/batch={number}")

    writer = fold_stream(changes, forget_ms).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def states(moved: DataFrame) -> DataFrame:
    """The last state of each key out of all that were written, without keys whose state went; deleted keys stay, with op DELETE."""
    last = moved.groupBy("key").agg(F.max_by(F.struct("ord", "op", "payload", "changes", "gone"), F.struct("batch", "changes")).alias("x"))
    return last.filter("NOT x.gone").select("key", "x.ord", "x.op", "x.payload", "x.changes")

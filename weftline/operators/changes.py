"""Synchronising keyed rows: capture of changes, push, replay, conflicts, pull and snapshots, as joins.

Rows are identified by (schema_name, table_name, key_json); a row's content travels as JSON text (payload, null
for a deleted row).  ``row_state`` holds the version that both sides know (row_version, deleted 0/1), ``dirty``
what is to be sent (op, base_row_version, payload, dirty_ordinal), ``live`` the rows as they are (payload).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.codec import bound, canonical, int64_text, local_blob, local_uuid, rows_hash, sha256_hex, wire_blob, wire_uuid
from weftline.operators.ordinals import chunks, settled, with_ordinals
from weftline.operators.tables import parent_first

KEY = ["schema_name", "table_name", "key_json"]
DIRTY = [*KEY, "op", "base_row_version", "payload", "dirty_ordinal"]

ACCEPT_SERVER, KEEP_LOCAL, KEEP_MERGED = "AcceptServer", "KeepLocal", "KeepMerged"
MISSING, DELETED, PRESENT = "Missing", "Deleted", "Present"


class TransitionPending(RuntimeError):
    """A write while a synchronisation step is open."""


def guard_write(operation_open: bool, applying: bool) -> None:
    if operation_open and not applying:
        raise TransitionPending("SYNC_TRANSITION_PENDING")


def _is_live(deleted: Column) -> Column:
    return deleted.isNotNull() & (deleted == 0)


def split_key_changes(log: DataFrame) -> DataFrame:
    """An update that moves a row to another key is a deletion of the old key and a write of the new one."""
    moved = F.col("old_key_json").isNotNull() & (F.col("old_key_json") != F.col("key_json"))
    new = F.struct(F.col("key_json").alias("key_json"), F.col("op").alias("op"), F.col("payload").alias("payload"), F.lit(1).alias("part"))
    old = F.struct(F.col("old_key_json").alias("key_json"), F.lit("DELETE").alias("op"), F.lit(None).cast("string").alias("payload"), F.lit(0).alias("part"))
    return log.select("schema_name", "table_name", "ord", F.explode(F.when(moved, F.array(old, new)).otherwise(F.array(new))).alias("x")).select("schema_name", "table_name", "ord", "x.*")


def fold(log: DataFrame, row_state: DataFrame, dirty: DataFrame) -> DataFrame:
    """Dirty rows after a change log (KEY, op, payload, ord, old_key_json).

    The last change of a key counts.  A key that is dirty already keeps its base version and its ordinal; a new
    one takes the version of its state (0 without) and the next ordinal in the order of its first change.
    """
    parts = split_key_changes(log)
    at = F.struct("ord", "part")
    last = parts.groupBy(*KEY).agg(F.max_by(F.when(F.col("op") == "DELETE", F.lit(None)).otherwise(F.col("payload")), at).alias("payload"), F.max_by("op", at).alias("last_op"), F.min(at).alias("first"))
    held = dirty.select(*KEY, F.col("base_row_version").alias("held_base"), F.col("dirty_ordinal").alias("held_ordinal"))
    state = row_state.select(*KEY, "row_version", "deleted")
    known = last.join(held, KEY, "left").join(state, KEY, "left")
    op = F.when(F.col("last_op") == "DELETE", "DELETE").when(_is_live(F.col("deleted")), "UPDATE").otherwise("INSERT")
    known = known.withColumn("op", op).withColumn("base_row_version", F.coalesce("held_base", "row_version", F.lit(0)).cast("long"))
    highest = dirty.agg(F.coalesce(F.max("dirty_ordinal"), F.lit(0))).first()[0]
    fresh = with_ordinals(known.filter("held_ordinal is null"), [F.col("first"), *[F.col(k) for k in KEY]], "dirty_ordinal", highest + 1)
    again = known.filter("held_ordinal is not null").withColumn("dirty_ordinal", F.col("held_ordinal").cast("long"))
    untouched = dirty.join(last, KEY, "left_anti").select(*DIRTY)
    return untouched.unionByName(fresh.select(*DIRTY)).unionByName(again.select(*DIRTY))


def _table_place(table_order: list[str]) -> Column:
    out = F.lit(2**31 - 1)
    for place, name in reversed(list(enumerate(table_order))):
        out = F.when(F.col("table_name") == name, F.lit(place)).otherwise(out)
    return out


def adopt(live: DataFrame, table_order: list[str]) -> DataFrame:
    """Rows that were there before as first inserts, parents before children, keys in order."""
    placed = live.withColumn("__t", _table_place(table_order))
    numbered = with_ordinals(placed, [F.col("__t"), F.col("table_name"), F.col("key_json")], "dirty_ordinal", 1)
    return numbered.select(*KEY, F.lit("INSERT").alias("op"), F.lit(0).cast("long").alias("base_row_version"), "payload", "dirty_ordinal")


def prepare_push(dirty: DataFrame, row_state: DataFrame, table_order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to send with row_ordinal, rows to discard).

    A deletion of a row that the server does not have is discarded.  Writes go parents first, deletions go last
    and children first, ties by dirty ordinal.
    """
    state = row_state.select(*KEY, "deleted")
    joined = dirty.join(state, KEY, "left")
    pointless = F.col("payload").isNull() & ~_is_live(F.col("deleted"))
    op = F.when(F.col("payload").isNull(), "DELETE").when(_is_live(F.col("deleted")), "UPDATE").otherwise("INSERT")
    send = joined.filter(~pointless).withColumn("op", op).withColumn("__gone", F.col("op") == "DELETE").withColumn("__t", _table_place(table_order))
    order = [F.col("__gone"), F.when(F.col("__gone"), -F.col("__t")).otherwise(F.col("__t")), F.col("dirty_ordinal"), *[F.col(k) for k in KEY]]
    return with_ordinals(send, order, "row_ordinal").select(*DIRTY, "row_ordinal"), joined.filter(pointless).select(*KEY)


def row_json(payload: str = "payload") -> Column:
    """Canonical JSON of a row that is sent."""
    fields = F.struct(F.col("schema_name").alias("schema"), F.col("table_name").alias("table"), F.from_json("key_json", "map<string,string>").alias("key"), F.col("op"), F.col("base_row_version").cast("string").alias("base_row_version"), F.from_json(payload, "map<string,string>").alias("payload"))
    return canonical(F.to_json(fields, {"ignoreNullFields": "false"}))


def freeze(prepared: DataFrame, chunk_rows: int = 200) -> DataFrame:
    """Rows of an outgoing bundle with their canonical JSON and the chunk they travel in."""
    return chunks(prepared.withColumn("row_json", row_json()), "row_ordinal", chunk_rows)


def bundle_hash(frozen: DataFrame) -> DataFrame:
    """One row: n_rows, request_hash.

    Each chunk is hashed by itself (SHA-256 of the JSON array of its rows), and the hash of a bundle is that of its
    chunks' hashes in order, one a line: no task holds more than a chunk of rows or 64 bytes a chunk.
    """
    by_chunk = frozen.groupBy("chunk").agg(F.count("*").alias("n"), rows_hash(F.col("row_json"), F.col("row_ordinal")).alias("h"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("chunk", "h"))), lambda x: x["h"])
    return by_chunk.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.sha2(F.array_join(listed, "\n"), 256).alias("request_hash"))


def array_hash(frozen: DataFrame) -> DataFrame:
    """One row: n_rows, request_hash, the SHA-256 of one JSON array of all rows in order, as peers that know no chunks expect it.

    Each chunk's rows are joined first; the chunks then run through one hash, in order, one after another.  A hash of one
    text is one stream, so one task reads a bundle's bytes, but holds a batch of chunks at a time.
    """
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_ordinal", "row_json"))), lambda x: x["row_json"]), ",")
    by_chunk = frozen.groupBy("chunk").agg(F.count("*").alias("n"), listed.alias("rows"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, total = hashlib.sha256(b"["), 0
        for batch in batches:
            for n, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n:
                    state.update((("," if total else "") + rows).encode())
                    total += n
        state.update(b"]")
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([state.hexdigest()])], names=["n_rows", "request_hash"])

    # a row without rows, so that an empty bundle has a hash too
    begun = frozen.sparkSession.range(1).select(F.lit(None).cast(frozen.schema["chunk"].dataType).alias("chunk"), F.lit(0).cast("long").alias("n"), F.lit("").alias("rows"))
    return by_chunk.unionByName(begun).repartition(1).sortWithinPartitions("chunk").select("n", "rows").mapInArrow(each, "n_rows long, request_hash string")


def verify_committed(frozen: DataFrame, committed: DataFrame) -> DataFrame:
    """One row: whether what was committed equals what was sent, in number and hash."""
    a, b = bundle_hash(frozen), bundle_hash(committed)
    b = b.select(F.col("n_rows").alias("committed_rows"), F.col("request_hash").alias("committed_hash"))
    return a.crossJoin(b).withColumn("verified", (F.col("n_rows") == F.col("committed_rows")) & (F.col("request_hash") == F.col("committed_hash")))  # one row each


#: Kinds of columns in payloads.
TEXT, INTEGER, REAL, BLOB, UUID = "text", "integer", "real", "blob", "uuid"
_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def _member(payload: Column, name: str, kind: str, wire: bool) -> Column:
    """The typed value of a member: null where it is JSON's null, an error where it does not fit its kind."""
    found = F.coalesce(*[F.try_variant_get(payload, f"$['{n}']", "variant") for n in dict.fromkeys((name.lower(), name))])
    spelled = F.struct(found.alias("value"), F.schema_of_variant(found).alias("held"), F.try_variant_get(found, "$", "string").alias("text"))
    return bound(spelled, lambda m: F.when(m["held"] != "VOID", _typed(m["value"], m["held"], m["text"], name, kind, wire)))


def _typed(value: Column, held: Column, text: Column, name: str, kind: str, wire: bool) -> Column:
    def fit(ok: Column, found: Column, as_kind: str) -> Column:
        return F.when(ok, found).otherwise(F.raise_error(F.concat(F.lit(f"{name} is no {kind}: "), F.coalesce(text, F.lit("?")))).cast(as_kind))

    is_text = held == "STRING"
    if kind == TEXT:
        return fit(is_text, text, "string")
    if kind == INTEGER:
        whole = fit(is_text, int64_text(F.when(is_text, text)), "bigint")
        return F.when(held == "BOOLEAN", F.when(text == "true", F.lit(1)).otherwise(F.lit(0)).cast("bigint")).otherwise(whole)
    if kind == REAL:
        number = text.try_cast("double")
        ok = (is_text if wire else held != "BOOLEAN") & (~is_text | text.rlike(_NUMBER)) & (F.abs(number) < float("inf"))
        return fit(F.coalesce(ok, F.lit(False)), number, "double")
    if kind == BLOB:
        return wire_blob(text) if wire else local_blob(text)
    if kind == UUID:
        return wire_uuid(text) if wire else local_uuid(text)
    raise ValueError(f"{name}: unknown kind {kind}")


def typed_payload(payload: Column, kinds: dict[str, str], wire: bool = False) -> Column:
    """A payload as a struct of typed values, column by column; null unless it is a JSON object of exactly these columns.

    On the wire, bytes are canonical Base64 or UUID text and numbers are JSON strings; in local payloads bytes may
    be hexadecimal, Base64 or UUID text and reals may be JSON numbers.  Integers are canonical text, or true and false for 1 and
    0.  A value that does not fit its kind is an error.  Members are named in lower case or as the column is.
    """

    def read(parsed: Column) -> Column:
        def from_members(given: Column) -> Column:
            whole = F.size(given) == len(kinds)
            for name in kinds:
                whole = whole & (F.array_contains(given, name.lower()) | F.array_contains(given, name))
            # a member is looked at only where all are there
            return F.when(whole, F.struct(*[_member(parsed, name, kind, wire).alias(name) for name, kind in kinds.items()]))

        return bound(F.map_keys(F.try_variant_get(parsed, "$", "map<string,variant>")), from_members)

    return bound(F.try_parse_json(payload), read)


def same_payload(a: Column, b: Column, kinds: dict[str, str] | None = None, wire: tuple[bool, bool] = (False, False)) -> Column:
    """Equal content; null equals null only.

    With ``kinds`` both are decoded (``typed_payload``; ``wire`` says which come from the wire) and compared column by
    column: numbers by value, bytes by what they are, however spelled.  Without, both must be the same JSON: members in
    any order at every depth, a number is never a text.
    """
    if kinds is None:
        same = F.to_json(F.try_parse_json(a)) == F.to_json(F.try_parse_json(b))
        return a.eqNullSafe(b) | F.coalesce(same, F.lit(False))
    both = F.struct(typed_payload(a, kinds, wire[0]).alias("a"), typed_payload(b, kinds, wire[1]).alias("b"))
    same = bound(both, lambda x: x["a"].isNotNull() & x["b"].isNotNull() & x["a"].eqNullSafe(x["b"]))
    return F.when(a.isNotNull() & b.isNotNull(), same).otherwise(a.isNull() & b.isNull())


def replay_plan(uploaded: DataFrame, pending: DataFrame, live: DataFrame, kinds: dict[str, str] | None = None, wire: bool = False) -> DataFrame:
    """What happens to each uploaded row once the server has committed it: (KEY, action, requeue_op, requeue_payload).

    If the row changed locally meanwhile, the local state is kept and queued again, else the server's is taken.
    Payloads are compared as ``same_payload`` does; ``wire`` says that the uploaded ones are spelled for the wire.
    """
    now = live.select(*KEY, F.col("payload").alias("live_payload"))
    waiting = pending.select(*KEY, F.col("op").alias("pending_op"), F.col("payload").alias("pending_payload"))
    joined = uploaded.join(waiting, KEY, "left").join(now, KEY, "left")
    there = F.col("live_payload").isNotNull()
    pending_differs = F.col("pending_op").isNotNull() & ~((F.col("pending_op") == F.col("op")) & same_payload(F.col("pending_payload"), F.col("payload"), kinds, (False, wire)))
    live_differs = ~same_payload(F.col("live_payload"), F.col("payload"), kinds, (False, wire))
    requeue = F.when(F.col("op") == "DELETE", F.when(there, "INSERT")).when(~there, "DELETE").when(pending_differs | live_differs, "UPDATE")
    planned = joined.withColumn("requeue_op", requeue)
    payload = F.when(F.col("requeue_op").isin("INSERT", "UPDATE"), F.col("live_payload"))
    return planned.select(*KEY, F.when(F.col("requeue_op").isNull(), "AcceptAuthoritative").otherwise("PreserveLocal").alias("action"), "requeue_op", payload.alias("requeue_payload"))


def resolve_conflicts(conflicts: DataFrame, expected_columns: list[str]) -> DataFrame:
    """Plans for conflicts (KEY, local_op, local_payload, server_state, server_version, server_payload, result, merged_payload).

    Adds local_action (Upsert or Delete), new_payload, state_action (Upsert or Delete), state_version,
    state_deleted, requeue_op, requeue_base; or ``error`` where the chosen result is not possible.
    """
    op, state, result = F.col("local_op"), F.col("server_state"), F.col("result")
    keeps = result.isin(KEEP_LOCAL, KEEP_MERGED)
    given = F.map_keys(F.from_json("merged_payload", "map<string,string>"))
    columns = F.array_sort(F.transform(given, F.lower))
    wanted = F.array(*[F.lit(c.lower()) for c in sorted(c.lower() for c in expected_columns)])
    error = (
        F.when(keeps & ~op.isin("INSERT", "UPDATE", "DELETE"), F.concat(F.lit("unsupported local op "), op))
        .when((result == KEEP_MERGED) & (op == "DELETE"), "KeepMerged is invalid for a deletion")
        .when((result == KEEP_MERGED) & given.isNull(), "KeepMerged needs a JSON object")
        .when((result == KEEP_MERGED) & ~F.coalesce(columns == wanted, F.lit(False)), "KeepMerged must have exactly the table's columns")
        .when(keeps & (op == "INSERT") & (state == MISSING), "an insert conflicts with a live row or a tombstone")
        .when(keeps & (op == "UPDATE") & (state != PRESENT), F.concat(result, F.lit(" is invalid: the server's row is gone")))
        .when((result == KEEP_LOCAL) & op.isin("INSERT", "UPDATE") & F.col("local_payload").isNull(), "the local row has no payload")
    )
    upserts = keeps & op.isin("INSERT", "UPDATE")
    local = F.when(upserts, "Upsert").when(keeps, "Delete").when(state == PRESENT, "Upsert").otherwise("Delete")
    payload = F.when(upserts, F.when(result == KEEP_MERGED, F.col("merged_payload")).otherwise(F.col("local_payload"))).when(~keeps & (state == PRESENT), F.col("server_payload"))
    state_action = F.when(state == MISSING, "Delete").otherwise("Upsert")
    requeue = F.when(upserts, F.when(state == PRESENT, "UPDATE").otherwise("INSERT")).when(keeps & (state == PRESENT), "DELETE")
    ok = error.isNull()
    out = conflicts.withColumn("error", error)
    columns_out = {
        "local_action": local,
        "new_payload": payload,
        "state_action": state_action,
        "state_version": F.when(state != MISSING, F.col("server_version")),
        "state_deleted": F.when(state != MISSING, F.when(state == DELETED, 1).otherwise(0)),
        "requeue_op": requeue,
        "requeue_base": F.when(requeue.isNotNull(), F.col("server_version")),
    }
    return out.select(*KEY, *[F.when(ok, c).alias(name) for name, c in columns_out.items()], "error")


def check_bundles(bundles: DataFrame, after_seq: int, stable_seq: int) -> DataFrame:
    """Rows of bundles (bundle_seq, row_ordinal, KEY, op, row_version, payload) that break a rule: (bundle_seq, problem)."""
    problem = (
        F.when(F.col("bundle_seq") <= after_seq, "bundle_seq is not above the last one applied")
        .when(F.col("bundle_seq") > stable_seq, "bundle_seq is above the stable one")
        .when(F.trim("schema_name") == "", "schema is empty")
        .when(F.trim("table_name") == "", "table is empty")
        .when(F.coalesce(F.col("row_version"), F.lit(0)) <= 0, "row_version is not positive")
        .when(~F.col("op").isin("INSERT", "UPDATE", "DELETE"), "op is unknown")
        .when((F.col("op") != "DELETE") & F.col("payload").isNull(), "payload is missing")
    )
    return bundles.select("bundle_seq", problem.alias("problem")).filter("problem is not null")


def pull(live: DataFrame, row_state: DataFrame, dirty: DataFrame, bundles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(live, row_state, dirty) after bundles: of each key the last change counts, unless its version is known already.

    An applied row is no longer dirty, and its state holds the new version.
    """
    at = F.struct("bundle_seq", "row_ordinal")
    last = bundles.groupBy(*KEY).agg(F.max_by(F.struct("op", "row_version", "payload"), at).alias("x")).select(*KEY, "x.*")
    known = row_state.select(*KEY, F.col("row_version").alias("held"))
    fresh = last.join(known, KEY, "left").filter(F.col("held").isNull() | (F.col("held") < F.col("row_version"))).drop("held")
    applied = fresh.select(*KEY)
    new_live = live.join(applied, KEY, "left_anti").select(*KEY, "payload").unionByName(fresh.filter("op <> 'DELETE'").select(*KEY, "payload"))
    gone = F.when(F.col("op") == "DELETE", 1).otherwise(0)
    new_state = row_state.join(applied, KEY, "left_anti").select(*KEY, "row_version", "deleted").unionByName(fresh.select(*KEY, "row_version", gone.alias("deleted")))
    return new_live, new_state, dirty.join(applied, KEY, "left_anti").select(*DIRTY)


def rebuild(stage: DataFrame, expected_rows: int) -> tuple[DataFrame, DataFrame]:
    """(live, row_state) from a staged snapshot (row_ordinal, KEY, row_version, payload), which must be complete."""
    n, keys = stage.agg(F.count("*"), F.count_distinct(F.struct(*KEY))).first()
    if n != expected_rows or keys != n:
        raise ValueError(f"the snapshot has {n} rows and {keys} keys of {expected_rows} rows expected")
    return stage.select(*KEY, "payload"), stage.select(*KEY, "row_version", F.lit(0).alias("deleted"))


def choose_recovery(last_seq: int, oldest_kept: int, newest: int) -> str:
    """What a client that has applied ``last_seq`` does: pull bundles, or rebuild from a snapshot.

    Bundles from last_seq + 1 on must still exist; a client ahead of the server's newest bundle has seen a history that is
    no more.
    """
    if last_seq > newest:
        return "rebuild: checkpoint ahead"
    if last_seq + 1 < oldest_kept:
        return "rebuild: history pruned"
    return "pull"


def recovery_step(last_seq: Column, oldest_kept: Column, newest: Column) -> Column:
    """``choose_recovery`` for a column of clients."""
    return F.when(last_seq > newest, "rebuild: checkpoint ahead").when(last_seq + 1 < oldest_kept, "rebuild: history pruned").otherwise("pull")


def clear_managed(tables: dict[str, DataFrame], managed: list[str]) -> dict[str, DataFrame]:
    """The tables with those that are synchronised emptied, their schema kept; others stay as they are."""
    names = {m.lower() for m in managed}
    unknown = sorted(names - {t.lower() for t in tables})
    if unknown:
        raise ValueError(f"{', '.join(unknown)} are no tables")
    return {name: df.limit(0) if name.lower() in names else df for name, df in tables.items()}


#: What may be waiting when a snapshot replaces the local rows.
REQUIRE_EMPTY, KEEP_UNSENT, KEEP_COMMITTED = "RequireEmpty", "KeepUnsent", "KeepCommitted"


def gate(dirty: DataFrame, outbox: DataFrame, pinned: tuple[int, int, str], mode: str = REQUIRE_EMPTY) -> None:
    """Before a snapshot is applied: nothing may have changed since it was pinned, and only what the mode allows may wait.

    RequireEmpty allows neither dirty rows nor an outbox, KeepUnsent dirty rows but no outbox, KeepCommitted an outbox
    (whose rows the server has committed) but no dirty rows.
    """
    if mode not in (REQUIRE_EMPTY, KEEP_UNSENT, KEEP_COMMITTED):
        raise ValueError(f"unknown mode {mode}")
    now = fingerprint(dirty, outbox)
    if now != pinned:
        raise TransitionPending("local rows changed while the snapshot was fetched")
    n_dirty, n_outbox, _ = now
    if (n_dirty and mode != KEEP_UNSENT) or (n_outbox and mode != KEEP_COMMITTED):
        raise TransitionPending(f"{n_dirty} dirty rows and {n_outbox} outbox rows wait, which {mode} does not allow")


def round_counts(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """One row of diagnostics for (row_state, dirty) before and after a round: rows known, live, deleted, waiting, sent."""
    parts = []
    for label, (state, dirty) in (("before", before), ("after", after)):
        parts.append(state.agg(F.count("*").alias(f"known_{label}"), F.count(F.when(_is_live(F.col("deleted")), 1)).alias(f"live_{label}")).crossJoin(dirty.agg(F.count("*").alias(f"dirty_{label}"))))  # one row each
    return parts[0].crossJoin(parts[1])


def contract_diff(client: DataFrame, server: DataFrame) -> DataFrame:
    """Tables (schema_name, table_name, key_columns) of both sides that do not agree: (table, problem)."""
    a = client.select(F.lower("schema_name").alias("s"), F.lower("table_name").alias("t"), F.lower("key_columns").alias("ck"))
    b = server.select(F.lower("schema_name").alias("s"), F.lower("table_name").alias("t"), F.lower("key_columns").alias("sk"))
    problem = F.when(F.col("ck").isNull(), "server only").when(F.col("sk").isNull(), "client only").when(F.col("ck") != F.col("sk"), "key differs")
    return a.join(b, ["s", "t"], "full_outer").select(F.concat_ws(".", "s", "t").alias("table"), problem.alias("problem")).filter("problem is not null")


def spec_problems(specs: DataFrame) -> DataFrame:
    """Table specs (schema_name, table_name, key_columns joined by commas) that no side may publish: (table, problem), each once.

    A null counts as blank.  A table is given twice if its names agree in any case.
    """
    s, t, keys = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("schema_name", "table_name", "key_columns"))
    parts = F.transform(F.split(keys, ","), F.trim)
    narrow = specs.select(F.lower(s).alias("s"), F.lower(t).alias("t"), (F.size(parts) == 1).alias("one"), F.exists(parts, lambda x: x == "").alias("blank"))
    found = narrow.groupBy("s", "t").agg(F.count("*").alias("n"), F.bool_and("one").alias("one"), F.bool_or("blank").alias("blank"))
    rules = {"schema is empty": F.col("s") == "", "table is empty": F.col("t") == "", "a key column is empty": F.col("blank"), "more than one key column": ~F.col("one"), "given twice": F.col("n") > 1}
    problems = F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(text)) for text, rule in rules.items()])))
    return found.select(F.concat_ws(".", "s", "t").alias("table"), problems.alias("problem"))


def fingerprint(dirty: DataFrame, outbox: DataFrame) -> tuple[int, int, str]:
    """Pinned before a snapshot is fetched and compared before it is applied: any local change in between shows."""
    parts = dirty.select(F.lit("d").alias("w"), *DIRTY).unionByName(outbox.select(F.lit("o").alias("w"), *DIRTY))
    row = parts.agg(F.count(F.when(F.col("w") == "d", 1)), F.count(F.when(F.col("w") == "o", 1)), F.sum(F.xxhash64("w", *DIRTY).cast("decimal(38,0)"))).first()
    return row[0], row[1], str(row[2])


def sync_round(live: DataFrame, row_state: DataFrame, dirty: DataFrame, table_order: list[str], commit, fetch):
    """Push, then pull: ``commit`` takes frozen rows, ``fetch`` returns bundle rows; both are the caller's."""
    prepared, discarded = prepare_push(dirty, row_state, table_order)
    commit(freeze(prepared))
    sent = prepared.select(*KEY).unionByName(discarded)
    return pull(live, row_state, dirty.join(sent, KEY, "left_anti").select(*DIRTY), fetch())


def latest_rows(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key of a log."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return last.select(*[F.col(c) if c in keys else F.col("__last")[c].alias(c) for c in log.columns])


def key_hash() -> Column:
    return sha256_hex(F.concat_ws("|", *KEY))


@dataclass(frozen=True)
class Reference:
    """A foreign key: columns of a table and of the table that they refer to."""

    table: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


def managed_order(tables: list[str], references: list[Reference]) -> list[str]:
    """The order in which managed tables are written, parents before children.

    Tables that do not depend on each other stay in the given order; those in a circle, and what depends on them, come
    last, in the given order.  A reference of several columns, and one to a table that is not managed, is an error that
    names all such; a table may refer to itself.  Names count in any case.
    """
    names = {t.lower(): t for t in tables}
    if len(names) < len(tables):
        raise ValueError("a table is managed twice")
    own = [r for r in references if r.table.lower() in names]
    wide = sorted(f"{r.table} -> {r.parent}" for r in own if len(r.columns) != 1)
    if wide:
        raise ValueError(f"references of several columns cannot be managed: {'; '.join(wide)}")
    lost = sorted(f"{r.table}.{r.columns[0]} -> {r.parent}.{r.parent_columns[0]}" for r in own if r.parent.lower() not in names)
    if lost:
        raise ValueError(f"references lead out of the managed tables: {'; '.join(lost)}")
    needs: dict[str, set[str]] = {}
    for r in own:
        needs.setdefault(names[r.table.lower()], set()).add(names[r.parent.lower()])
    return parent_first(tables, needs)


def check_synced(table: DataFrame, name: str, key: list[str]) -> str:
    """A table that takes part has one key column, of text or bytes, and not the name of the scope column."""
    if len(key) != 1:
        raise ValueError(f"{name} must have one key column, not {len(key)}")
    kinds = {c.lower(): k for c, k in table.dtypes}
    column = key[0].lower()
    if kinds.get(column) not in ("string", "binary"):
        raise ValueError(f"{name}.{column} must be string or binary, not {kinds.get(column)}")
    if column == "_sync_scope_id":
        raise ValueError(f"{name}: {column} is reserved")
    return column


def key_state(table: DataFrame, column: str) -> DataFrame:
    """What a key column really holds, in one row: n_rows, n_null and n_repeated, the values that occur more than once.

    ``check_synced`` knows a table's types only, and Spark's tables enforce no key.
    """
    counted = table.groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n"))
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.count(F.when(F.col("k").isNotNull() & (F.col("n") > 1), 1)).alias("n_repeated"),
    )


#: Rows in which ``push_batches`` cuts at once; each task holds so many sizes.
PART_ROWS = 1_000_000


def _cuts(sizes: np.ndarray, max_rows: int, max_bytes: int) -> np.ndarray:
    """For each row, where the batch that begins there ends: before the first row that would pass a limit."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(len(sizes))
    full = np.searchsorted(total, total[:-1] + max_bytes, side="right") - 1
    return np.maximum(np.minimum(full, at + max_rows), at + 1)


def push_batches(frozen: DataFrame, max_rows: int, max_bytes: int, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds ``batch``: rows in order, each batch as long as it has at most ``max_rows`` rows and ``max_bytes`` of JSON.

    A row that alone passes the bytes is a batch of its own.  ``row_ordinal`` counts from 0 without gaps.  Where a
    batch begins depends on all batches before it, but within a part it depends only on the first beginning in the part,
    which is one of its first ``max_rows`` rows.  So each part tells, for each of these, where the next part's first
    batch begins and how many batches lie between; these short tables are followed from part to part, and
    then each part is cut by itself.  A part sees the first ``max_rows`` rows of the next one as well.
    """
    sized = frozen.select("row_ordinal", F.octet_length("row_json").cast("long").alias("size"))
    return frozen.join(bounded_batches(sized, max_rows, max_bytes, part_rows), "row_ordinal")


def bounded_batches(sized: DataFrame, max_rows: int, max_bytes: int, part_rows: int = PART_ROWS) -> DataFrame:
    """(row_ordinal, batch) of rows with a size, cut as ``push_batches`` says."""
    part_rows = max(part_rows, max_rows)
    part = F.floor(F.col("row_ordinal") / part_rows)
    again = F.when((F.col("row_ordinal") % part_rows < max_rows) & (part > 0), F.array(part, part - 1)).otherwise(F.array(part))
    dealt = settled(sized.withColumn("part", F.explode(again)))

    def exits(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row_ordinal")
        here, end = int(group["part"].iloc[0]), part_rows
        nexts = _cuts(group["size"].to_numpy(), max_rows, max_bytes)
        n = len(nexts)
        leave, count = np.arange(n + 1), np.zeros(n + 1, np.int64)
        for i in range(min(n, end) - 1, -1, -1):
            leave[i], count[i] = leave[nexts[i]], count[nexts[i]] + 1
        m = min(n, max_rows, end)
        return pd.DataFrame({"part": here, "entry": np.arange(m), "leave": leave[:m] - end, "n": count[:m]})

    tables = dealt.groupBy("part").applyInPandas(exits, "part long, entry long, leave long, n long")
    # max_rows rows for each part of a million: a proven bound
    known = {(r["part"], r["entry"]): (r["leave"], r["n"]) for r in tables.collect()}
    starts, here, entry, number = [], 0, 0, 0
    while (here, entry) in known:
        starts.append((here, entry, number))
        entry, n = known[here, entry]
        here, number = here + 1, number + n
    first = {p: (e, b) for p, e, b in starts}

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row_ordinal")
        here = int(group["part"].iloc[0])
        if here not in first:
            return pd.DataFrame({"row_ordinal": np.zeros(0, np.int64), "batch": np.zeros(0, np.int64)})
        nexts = _cuts(group["size"].to_numpy(), max_rows, max_bytes)
        at, number = first[here]
        begins = np.zeros(len(group) + 1, np.int64)
        while at < min(len(group), part_rows):
            begins[at] = 1
            at = int(nexts[at])
        batch = number - 1 + np.cumsum(begins[:-1])
        # rows before the first beginning belong to the last batch of the part before, which also numbers the rows that it
        # shares with this part
        own = np.arange(len(group)) >= first[here][0]
        if here + 1 in first:
            own &= np.arange(len(group)) < part_rows + first[here + 1][0]
        return pd.DataFrame({"row_ordinal": group["row_ordinal"].to_numpy()[own], "batch": batch[own]})

    return dealt.groupBy("part").applyInPandas(cut, "row_ordinal long, batch long")

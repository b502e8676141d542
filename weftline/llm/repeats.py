"""Exact substring deduplication with suffix sorting by Lyndon groups (operator 1).

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else goes.  To bring equal windows
together without sorting the corpus in one place:

Equal pieces are counted, which settles whole copies (most of what repeats in the test tables); the suffix groups judge
what repeats in part.

1. Each window is led by the least hashed ``GRAM``-byte gram in it (the leftmost of equals), so equal windows
   have the same leader at the same offset.  Windows that follow each other with one leader form a piece, about
   one in a hundred bytes.  Pieces are counted by leader, and where its contents differ by (leader, content):
   what stands there twice is repeated as a whole; a leader that occurs once has nothing repeated.
2. Pieces that occur once but share their leader with others (and one copy of each of those others) are cut
   by the offset of the leader into stretches of ``STEP`` windows.  The windows of a stretch share a core of
   LENGTH - STEP + 1 bytes, and a stretch is written as left bytes, core as one symbol, right bytes.  Stretches
   are dealt by core; equal ones collapse.
3. The distinct stretches of the cores of a task are concatenated, each closed by a symbol of its own, and
   sorted by ``suffix_groups``.  Windows (STEP symbols here) that are equal become neighbours.
4. If over ``HOT`` stretches share a core (a passage in very many different surroundings), their windows are
   grouped by content with Spark instead, salted by the content itself, so no task sees them all.

Spans of a document are merged, and the bytes left are joined.  Matches never cross documents; judgement is on
the input.  Nothing is dropped, capped or sampled.  Equality of cores and contents rests on 64-bit hashes in
steps 1 and 2.

Defined cases: a null text is an empty one, and an empty or short text keeps all its bytes; repeated rows lose
all that is covered, both of them; an empty table gives no rows; other columns are ignored; a null doc_id is an
id like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import bytesplit
from weftline.llm.common import cut, maybe_broadcast, n_partitions
from weftline.llm.suffix_groups import repeated_windows

LENGTH = 400
GRAM = 200
STEP = 25
HOT = 4000
#: Symbols that are sorted as one string.
SORTED_AT_ONCE = 1 << 18
_PLACE_BITS = np.uint64(20)
#: A piece's windows and leader offset are below this; with its start they are kept as one number.
_PACK = 1024


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    padded = np.concatenate((values, np.full(-len(values) % width, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def pieces(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Leader hash, content hash, start, number of windows, and leader offset of each piece of one text."""
    parts = []
    chunk = (1 << int(_PLACE_BITS)) - 1
    for at in range(0, max(len(data) - length + 1, 0), chunk - length + 1):
        own = data[at : at + chunk]
        if len(own) < length:
            break
        sums = bytesplit.prefix_sums(own)
        _, down = bytesplit.powers(len(own) + 1)
        grams = bytesplit.mix64((sums[gram:] - sums[:-gram]) * down[: len(own) - gram + 1])
        low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
        least = _sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
        start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        end = np.concatenate((start[1:], [len(least)]))
        leader = (least[start] & low).astype(np.int64)
        content = bytesplit.mix64((sums[end + length - 1] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        parts.append((grams[leader].view(np.int64), content.view(np.int64), start + at, end - start, leader - start))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).cast("binary").alias("data"))


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return bytesplit.utf8(column)


def _packed(keyed: DataFrame) -> DataFrame:
    """The texts compressed one by one: they are shuffled twice, and are most of what is shuffled."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            data, offsets = _binary(batch.column(2))
            view = memoryview(np.ascontiguousarray(data))
            packed = [pack(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc_id", "th", "data"])

    return keyed.mapInArrow(each, f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, th long, data binary")


def _all_pieces(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _binary(batch.column(2))
            rows, parts = [], []
            for r in range(batch.num_rows):
                if offsets[r + 1] - offsets[r] >= length:
                    parts.append(pieces(data[offsets[r] : offsets[r + 1]], length, gram))
                    rows.append(np.full(len(parts[-1][0]), r))
            if rows:
                row = pa.array(np.concatenate(rows))
                leader, content, start, n, offset = (np.concatenate(p) for p in zip(*parts))
                columns = [pa.array(leader), pa.array(content), batch.column(0).take(row), batch.column(1).take(row), pa.array(start), pa.array(n.astype(np.int32)), pa.array(offset.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "p", "doc_id", "th", "start", "n", "off"])

    return keyed.mapInArrow(each, f"h long, p long, doc_id {keyed.schema['doc_id'].dataType.simpleString()}, th long, start long, n int, off int")


def _stretches(joined: DataFrame, length: int, step: int) -> DataFrame:
    """Documents with the pieces wanted of them to stretches."""
    core = length - step + 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("k", "left", "right", "row", "start", "n")}
            for r, wanted in enumerate(batch.column(3)):
                own = unpack(batch.column(2)[r].as_py())
                for piece in wanted.as_py():
                    h, start, n, off = piece["h"], piece["start"], piece["n"], piece["off"]
                    leader = start + off
                    for j in range((off - n + 1) // step, off // step + 1):
                        # windows whose leader lies at an offset from step * j on
                        begin, end = max(start, leader - step * j - step + 1), min(start + n - 1, leader - step * j)
                        from_, to = leader - step * j, leader - step * j - step + 1 + length
                        out["k"].append(xxhash.xxh64_intdigest(own[from_:to], (h * 31 + j) & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                        out["left"].append(own[begin:from_])
                        out["right"].append(own[to : end + length])
                        out["row"].append(r)
                        out["start"].append(begin)
                        out["n"].append(end - begin + 1)
            row = pa.array(out["row"], pa.int64())
            columns = [pa.array(out["k"], pa.int64()), pa.array(out["left"], pa.binary()), pa.array(out["right"], pa.binary()), batch.column(0).take(row), batch.column(1).take(row), pa.array(out["start"], pa.int64()), pa.array(out["n"], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "left", "right", "doc_id", "th", "start", "n"])

    assert core > 0
    return joined.mapInArrow(each, f"k long, left binary, right binary, doc_id {joined.schema['doc_id'].dataType.simpleString()}, th long, start long, n int")


def _sorted_windows(step: int):
    """Rows (k, left, right) sorted by k to rows (k, left, right, first window, end) of repeated windows."""

    def judge(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        cores: dict[int, int] = {}
        strings = [np.concatenate((np.frombuffer(a, np.uint8).astype(np.int64), [256 + cores.setdefault(k, len(cores))], np.frombuffer(b, np.uint8))) for k, a, b in rows]
        out: list[list] = [[], [], [], [], []]
        for (k, a, b), found in zip(rows, repeated_windows(strings, step)):
            edges = np.flatnonzero(np.diff(np.concatenate(([0], found.astype(np.int8), [0]))))
            for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
                for column, value in zip(out, (k, a, b, begin, end)):
                    column.append(value)
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=["k", "left", "right", "a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SORTED_AT_ONCE and row[0] != held[-1][0]:
                    yield judge(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[1]) + len(row[2]) + 2
        if held:
            yield judge(held)

    return each


def _hot_windows(hot: DataFrame, step: int) -> DataFrame:
    """The same for cores with very many stretches, by grouping the windows themselves."""
    lead = F.octet_length("left")
    windows = hot.withColumn("w", F.explode(F.sequence(F.lit(0), lead + F.octet_length("right") + 1 - step)))
    x = lead - F.col("w")
    windows = windows.withColumn("x", x).withColumn("own", F.concat(F.substr("left", F.col("w") + 1), F.substr("right", F.lit(1), F.lit(step - 1) - x)))
    again = windows.groupBy("k", "x", "own").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    return windows.join(again, ["k", "x", "own"]).select("k", "left", "right", F.col("w").alias("a"), (F.col("w") + 1).alias("b"))


def _same_doc(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, step: int = STEP, hot: int = HOT) -> DataFrame:
    """(doc_id, th, start, end) of repeated stretches, overlapping as they come."""
    if not (gram <= length - step + 1 and length - gram + 1 < _PACK):
        raise ValueError("the core must hold the gram, and a piece at most 1023 windows")
    found = _all_pieces(keyed, length, gram)
    # one row for each leader and task goes into the shuffle; contents differ if the least is not the greatest
    leaders = found.groupBy("h").agg(F.count("*").alias("c"), F.min("p").alias("low"), F.max("p").alias("high")).filter("c > 1")
    live = cut(leaders.select("h", (F.col("low") != F.col("high")).alias("mixed")))
    place = F.col("start") * _PACK * _PACK + F.col("n") * _PACK + F.col("off")
    seen = found.join(maybe_broadcast(live), "h").select("doc_id", "th", place.alias("place"), F.when(F.col("mixed"), F.col("h")).alias("h"), F.when(F.col("mixed"), F.col("p")).alias("p"))
    needed = cut(seen)
    # leaders with several contents: what occurs once is open, and one copy of each other content to compare with
    mixed = needed.filter("h is not null")
    one = F.struct("doc_id", "th", "place")
    counted = cut(mixed.groupBy("h", "p").agg(F.count("*").alias("c"), F.min(one).alias("one")))
    # all but what occurs once, told by the place and not by the content: copies of one content never meet in a task
    alone = counted.filter("c = 1").select(F.col("one.doc_id").alias("a_id"), F.col("one.th").alias("a_th"), F.col("one.place").alias("a_place"))
    at = needed["doc_id"].eqNullSafe(alone["a_id"]) & (needed["th"] == alone["a_th"]) & (needed["place"] == alone["a_place"])
    copies = needed.select("doc_id", "th", "place").join(alone, at, "left_anti")
    start, n, off = F.shiftright("place", 20), F.shiftright("place", 10).bitwiseAND(_PACK - 1), F.col("place").bitwiseAND(_PACK - 1)
    copies = copies.select("doc_id", "th", start.alias("start"), (start + n + (length - 1)).alias("end"))

    opened = counted.select("one.*", "h")
    opened = opened.select("doc_id", "th", start.alias("start"), n.alias("n"), off.alias("off"), "h")
    wanted = opened.groupBy("doc_id", "th").agg(F.collect_set(F.struct("h", "start", "n", "off")).alias("wanted"))
    packed = _packed(keyed)
    joined = packed.join(wanted, _same_doc(packed, wanted)).select(packed["doc_id"], packed["th"], "data", "wanted")
    parts = cut(_stretches(joined, length, step))
    alike = parts.groupBy("k", "left", "right").agg(F.count("*").alias("c"))
    cores = alike.groupBy("k").agg(F.count("*").alias("m"))
    distinct = cut(alike.join(cores, "k").filter("c > 1 or m > 1"))
    short = distinct.filter((F.col("m") > 1) & (F.col("m") <= hot)).select("k", "left", "right")
    dealt = short.repartition(n_partitions(keyed), "k").sortWithinPartitions("k")
    repeated = dealt.mapInArrow(_sorted_windows(step), "k long, left binary, right binary, a int, b int")
    repeated = repeated.unionByName(_hot_windows(distinct.filter(F.col("m") > hot).select("k", "left", "right"), step))
    whole = distinct.filter("c > 1").select("k", "left", "right", F.lit(0).alias("a"), (F.octet_length("left") + F.octet_length("right") + 2 - step).alias("b"))
    placed = parts.join(repeated.unionByName(whole), ["k", "left", "right"])
    return copies.unionByName(placed.select("doc_id", "th", (F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("b") + (length - 1)).alias("end")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, step: int = STEP, hot: int = HOT, keep_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    With ``keep_text`` also the bytes left (kept), and these as a string without characters that a span cut in two (text).
    """
    keyed = _keyed(docs, text_col, id_col)
    found = spans(keyed, length, gram, step, hot)
    by_doc = found.groupBy("doc_id", "th").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    packed = _packed(keyed)
    joined = packed.join(by_doc, _same_doc(packed, by_doc), "left").select(packed["doc_id"], "data", "starts", "ends")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            n_bytes, removed, n_spans = np.zeros((3, batch.num_rows), np.int64)
            digests, kept = [], []
            for r in range(batch.num_rows):
                own = np.frombuffer(unpack(batch.column(1)[r].as_py()), np.uint8)
                n_bytes[r] = len(own)
                if batch.column(2)[r].is_valid and len(batch.column(2)[r]):
                    depth = np.zeros(len(own) + 1, np.int64)
                    np.add.at(depth, batch.column(2)[r].values.to_numpy(), 1)
                    np.add.at(depth, batch.column(3)[r].values.to_numpy(), -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    removed[r] = gone.sum()
                    n_spans[r] = (gone & ~np.concatenate(([False], gone[:-1]))).sum()
                    own = own[~gone]
                left = own.tobytes()
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left if keep_text else None)
            texts = [None if x is None else x.decode("utf-8", "ignore") for x in kept]
            columns = [batch.column(0), pa.array(n_bytes), pa.array(removed), pa.array(n_spans), pa.array(digests, pa.string()), pa.array(kept, pa.binary()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = joined.mapInArrow(each, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, text string")
    return out if keep_text else out.drop("kept", "text")

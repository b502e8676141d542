"""Benchmark decontamination with a distributed positional inverted index (operator 7).

Phrases are the windows of a benchmark item.  One scan counts how often each benchmark term occurs in the
documents; a window with a term that never occurs is out.  A second scan stores postings (term, document,
position) of the rarest terms of each window alone.  Windows then meet the postings of their rarest term, and
the offset-adjusted lists of the next rarest terms are intersected with what is left, by equality of term,
document and position.  The few documents left are scanned once more for postings of all terms of their
windows, and a window counts where all of its terms stand in order.

Sizes: benchmark terms go to the executors as one array if there are at most ``MAX_SENT_TERMS``; beyond that,
postings of all terms are shuffled to meet them.  No list, window or document is capped.

Words are runs of digits, letters a-z after folding A-Z, and all characters beyond ASCII.  A document is
identified by its doc_id and a hash of its text, so repeated rows get equal results and rows that share an id
but not a text do not mix.

Defined cases: a null or empty text has no words and is never hit; an item without words has no window; an item
shorter than a window is one window; an empty table on either side gives documents without hits (or no rows);
other columns are ignored by ``report`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import bytesplit
from weftline.llm.common import cut, maybe_broadcast

WINDOW = 10
#: Rarest terms whose lists are intersected before documents are read again.
RAREST = 3
#: 8 MB as an array.
MAX_SENT_TERMS = 1_000_000

_FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_IS_WORD = np.array([c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 for c in range(256)])


def _words(column: pa.Array) -> Iterator[bytesplit.Words]:
    return bytesplit.words(column, _FOLD, _IS_WORD)


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))


def phrases(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: wid, terms (array of term hashes), items (array of the ids they come from)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, terms = batch.column(0), [], []
            lists: dict[int, list] = {}
            for found in _words(batch.column(1)):
                for r in np.unique(found.rows).tolist():
                    lists.setdefault(r, []).append(found.hashes[found.rows == r].view(np.int64))
            for r, parts in lists.items():
                own = np.concatenate(parts)
                for at in range(max(1, len(own) - window + 1)):
                    rows.append(r)
                    terms.append(own[at : at + window])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(terms, pa.list_(pa.int64()))], names=["item", "terms"])

    kind = items.schema[id_col].dataType.simpleString()
    flat = items.select(F.col(id_col), F.col(text_col)).mapInArrow(each, f"item {kind}, terms array<long>")
    return flat.groupBy("terms").agg(F.collect_set("item").alias("items")).withColumn("wid", F.xxhash64("terms"))


def _member(sent: np.ndarray | None):
    """A test for membership in a sorted array; a table of 20 bits drops most others before the search."""
    if sent is None:
        return lambda h: np.ones(len(h), bool)
    maybe = np.zeros(1 << 20, bool)
    maybe[(sent >> np.uint64(44)).astype(np.int64)] = True

    def test(h: np.ndarray) -> np.ndarray:
        out = maybe[(h >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(sent) and len(at):
            found = np.searchsorted(sent, h[at])
            found[found == len(sent)] = 0
            out[at] = sent[found] == h[at]
        return out

    return test


def _send(terms: DataFrame) -> object:
    """The distinct terms as a broadcast sorted array, or None if they are too many to send."""
    terms = cut(terms.distinct())
    if terms.count() > MAX_SENT_TERMS:
        return None
    values = np.array([r[0] for r in terms.collect()], np.int64).view(np.uint64)
    return terms.sparkSession.sparkContext.broadcast(np.sort(values))


def _scan_counts(keyed: DataFrame, sent) -> DataFrame:
    """One row per document with n_words, and one per task and benchmark term with its count (doc columns null)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test, counts = _member(None if sent is None else sent.value), {}
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            for found in _words(batch.column(2)):
                n_words += np.bincount(found.rows, minlength=batch.num_rows)
                values, n = np.unique(found.hashes[test(found.hashes)].view(np.int64), return_counts=True)
                for v, k in zip(values.tolist(), n.tolist()):
                    counts[v] = counts.get(v, 0) + k
            nothing = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, nothing, batch.column(0), batch.column(1), pa.array(n_words)], names=["term", "tf", "doc_id", "th", "n_words"])
            if len(counts) > 1_000_000 or sent is None:
                yield from flush(counts, batch.schema.field(0).type)
        yield from flush(counts, kind_arrow)

    def flush(counts: dict, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        if counts:
            n = len(counts)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64()), pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=["term", "tf", "doc_id", "th", "n_words"])
            counts.clear()

    kind = keyed.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    kind_arrow = to_arrow_type(kind)
    return keyed.mapInArrow(each, f"term long, tf long, doc_id {kind.simpleString()}, th long, n_words long")


def postings(keyed: DataFrame, sent) -> DataFrame:
    """The index: (term, doc_id, th, pos), of the sent terms or of all."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = _member(None if sent is None else sent.value)
        for batch in batches:
            for found in _words(batch.column(2)):
                at = np.flatnonzero(test(found.hashes))
                rows = pa.array(found.rows[at])
                yield pa.RecordBatch.from_arrays([pa.array(found.hashes[at].view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found.places[at])], names=["term", "doc_id", "th", "pos"])

    return keyed.mapInArrow(each, f"term long, doc_id {keyed.schema['doc_id'].dataType.simpleString()}, th long, pos long")


def _same_doc(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & a["th"].eqNullSafe(b["th"])


def _meet(found: DataFrame, index: DataFrame, which: int) -> DataFrame:
    """Keeps the places at which the list of the window's term number ``which`` agrees too."""
    one = F.get("rare", F.lit(which))
    short = found.filter(F.size("rare") <= which)
    want = found.filter(F.size("rare") > which).withColumn("__term", one["term"]).withColumn("__pos", F.col("start") + one["at"])
    on = (want["__term"] == index["term"]) & (want["__pos"] == index["pos"]) & _same_doc(want, index)
    return want.join(index, on, "left_semi").drop("__term", "__pos").unionByName(short)


def search(docs: DataFrame, windows: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All places of all windows: (doc_id, th, start, wid), and the documents: (doc_id, th, n_words)."""
    keyed = _keyed(docs, text_col)
    windows = cut(windows)
    sent = _send(windows.select(F.explode("terms").alias("term")))
    scanned = cut(_scan_counts(keyed, sent))
    counted = scanned.filter("term is null").select("doc_id", "th", "n_words")
    tf = cut(scanned.filter("term is not null").groupBy("term").agg(F.sum("tf").alias("tf")))
    # a frequent term stands in very many windows; its count is one row
    placed = windows.select("wid", "terms", F.posexplode("terms").alias("at", "term")).join(maybe_broadcast(tf), "term", "left")
    rare = placed.groupBy("wid").agg(
        F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("tf", F.lit(0)).alias("tf"), F.col("at").cast("long").alias("at"), "term"))), 1, RAREST).alias("rare")
    )
    rare = cut(rare.filter(F.get("rare", F.lit(0))["tf"] > 0))
    rare_terms = _send(rare.select(F.explode("rare.term").alias("term")))
    index = cut(postings(keyed, rare_terms))
    first = rare.withColumn("term", F.get("rare", F.lit(0))["term"])
    found = index.join(maybe_broadcast(first), "term").select("doc_id", "th", "wid", "rare", (F.col("pos") - F.get("rare", F.lit(0))["at"]).alias("start")).filter("start >= 0")
    for which in range(1, RAREST):
        found = _meet(found, index, which)
    # equal rows give equal postings: each place once, or the terms below would be counted once for each row
    found = cut(found.select("doc_id", "th", "wid", "start").distinct())

    # what is left is read again, with all terms
    left = cut(found.select("doc_id", "th").distinct())
    again = keyed.join(maybe_broadcast(left), _same_doc(keyed, left), "left_semi")
    hit_windows = cut(windows.join(found.select("wid").distinct(), "wid", "left_semi").select("wid", "terms"))
    full = postings(again, _send(hit_windows.select(F.explode("terms").alias("term")))).distinct()
    wanted = found.join(maybe_broadcast(hit_windows), "wid").select("doc_id", "th", "wid", "start", F.size("terms").alias("n"), F.posexplode("terms").alias("at", "term"))
    on = (wanted["term"] == full["term"]) & (wanted["start"] + wanted["at"] == full["pos"]) & _same_doc(wanted, full)
    # grouping by the place alone, within a document's rows, spreads even a passage that a third of the documents hold
    agreed = wanted.join(full, on, "left_semi").groupBy("doc_id", "th", "wid", "start", "n").agg(F.count("*").alias("k"))
    return agreed.filter("k = n").select("doc_id", "th", "wid", "start", F.col("n").cast("long").alias("length")), counted


def near(docs: DataFrame, items: DataFrame, slop: int, text_col: str = "text", id_col: str = "item_id") -> DataFrame:
    """Proximity matches: (doc_id, th, item, pos) where all terms of an item stand within ``slop`` words of its
    rarest one at pos, in any order.  Lists of the RAREST terms are met first, then those of all terms.  Positions are
    dealt into stretches of ``slop`` words, so only neighbouring stretches of one document meet."""
    keyed = _keyed(docs, text_col)
    whole = phrases(items, 1 << 30, id_col).select(F.explode("items").alias("item"), "terms")
    sent = _send(whole.select(F.explode("terms").alias("term")))
    index = cut(postings(keyed, sent))
    tf = index.groupBy("term").agg(F.count("*").alias("tf"))
    distinct = whole.select("item", F.explode(F.array_distinct("terms")).alias("term")).join(tf, "term", "left")
    rare = distinct.groupBy("item").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("tf", F.lit(0)).alias("tf"), "term"))), 1, RAREST).alias("rare"))
    rare = cut(rare.filter(F.get("rare", F.lit(0))["tf"] > 0).withColumn("term", F.get("rare", F.lit(0))["term"]))
    found = index.join(maybe_broadcast(rare), "term").select("doc_id", "th", "item", "pos", "rare")
    stretch = F.floor(F.col("pos") / max(slop, 1))
    others = index.select("term", F.col("doc_id").alias("d2"), F.col("th").alias("h2"), F.col("pos").alias("p2"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("s2"))
    for which in range(1, RAREST):
        short = found.filter(F.size("rare") <= which)
        want = found.filter(F.size("rare") > which).withColumn("__t", F.get("rare", F.lit(which))["term"]).withColumn("__s", stretch)
        on = (want["__t"] == others["term"]) & (want["__s"] == others["s2"]) & want["doc_id"].eqNullSafe(others["d2"]) & want["th"].eqNullSafe(others["h2"]) & (F.abs(want["pos"] - others["p2"]) <= slop)
        found = want.join(others, on, "left_semi").drop("__t", "__s").unionByName(short)
    found = cut(found.select("doc_id", "th", "item", "pos").distinct())
    terms = whole.select("item", F.array_distinct("terms").alias("terms"))
    every = found.join(maybe_broadcast(cut(terms)), "item").select("doc_id", "th", "item", "pos", F.size("terms").alias("n"), F.explode("terms").alias("term"), stretch.alias("__s"))
    on = (every["term"] == others["term"]) & (every["__s"] == others["s2"]) & every["doc_id"].eqNullSafe(others["d2"]) & every["th"].eqNullSafe(others["h2"]) & (F.abs(every["pos"] - others["p2"]) <= slop)
    met = every.join(others, on, "left_semi").groupBy("doc_id", "th", "item", "pos", "n").agg(F.count("*").alias("k"))
    return met.filter("k = n").select("doc_id", "th", "item", "pos")


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Hit documents: (doc_id, th, n_hit, items), and all documents: (doc_id, th, n_words)."""
    windows = cut(phrases(items, window))
    places, counted = search(docs, windows, text_col)
    places = cut(places)
    own = Window.partitionBy("doc_id", "th").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    reached = F.greatest(F.coalesce(F.max(end).over(own), F.lit(0)), F.col("start"))
    covered = places.withColumn("fresh", F.greatest(end - reached, F.lit(0))).groupBy("doc_id", "th").agg(F.sum("fresh").alias("n_hit"))
    sources = windows.select("wid", "items")
    named = places.select("doc_id", "th", "wid").distinct().join(maybe_broadcast(sources), "wid")
    named = named.select("doc_id", "th", F.explode(F.col("items").cast("array<string>")).alias("item")).distinct()
    listed = named.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list("item")).alias("items"))
    on = covered["doc_id"].eqNullSafe(listed["doc_id"]) & covered["th"].eqNullSafe(listed["th"])
    return covered.join(listed, on).select(covered["doc_id"], covered["th"], "n_hit", "items"), counted


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (ids as sorted strings)."""
    found, counted = hits(docs, items, window, text_col)
    joined = counted.join(found, _same_doc(counted, found), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(counted["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), items_of.alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with their columns."""
    found, _ = hits(docs, items, window, text_col)
    bad = cut(found.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")))
    on = docs["doc_id"].eqNullSafe(bad["__id"]) & F.xxhash64(docs[text_col]).eqNullSafe(bad["__th"])
    return docs.join(maybe_broadcast(bad), on, "left_anti")

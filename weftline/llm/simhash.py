"""SimHash near-duplicates by anchor-point covering (operator 4).

A text becomes a 64-bit fingerprint: bit j is 1 if over half of the XXH64 values of its word shingles have it.
Fingerprints that differ in at most two bits are linked.

Anchors are the codewords of the perfect Hamming code of length 31, whose covering radius is 1, laid over each
half of the fingerprint.  If two fingerprints differ in at most two bits, they differ in at most one bit on
some half.  There the anchor that covers the first one (distance at most 1) lies within radius + 1 = 2 of the
other.  So a fingerprint is replicated to every anchor within distance 2 of each half: one or sixteen
codewords, which the syndrome gives without search.  Fingerprints are then compared anchor by anchor, and each
anchor gives the links of a spanning forest of its members, not their pairs; connected components join the
forests.  Equal fingerprints collapse before that, so a group of exact copies costs one row.

Inside an anchor, members are compared through the values that lie within one bit of them (two members are
within two bits if they share such a value), so the work is linear in the members even where thousands of near
copies meet.

Defined cases: a null, empty or wordless text has fingerprint zero and is linked like any other; fewer words
than a shingle make one shingle; repeated rows share a component; an empty table gives no rows; other columns
of the input are ignored by ``classes`` and kept by ``keep_one``.  A null doc_id gets a component only by what
it is linked to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, n_partitions
from weftline.llm.components import components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
HALF = 31
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles hashed at a time; bounds the memory that a very long text needs.
_BLOCK = 1 << 17


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of one text over its word shingles, repeats included."""
    words = _WORD.findall((text or "").encode("utf-8", "replace").translate(_LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    ones, digest, view = np.zeros(64, np.int64), xxhash.xxh64_intdigest, memoryview(joined)
    for at in range(0, n, _BLOCK):
        values = np.array([digest(view[s:e], SEED) for s, e in zip(first[at : at + _BLOCK], last[at : at + _BLOCK])], np.uint64)
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, hashed: bool = False) -> DataFrame:
    """Rows of doc_id and fp (the fingerprint as a signed long), if ``hashed`` with th, a hash of the text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:]], names=["doc_id", "fp", "th"][: batch.num_columns])

    kind = docs.schema[id_col].dataType.simpleString()
    th = [F.xxhash64(text_col).alias("th")] if hashed else []
    return docs.select(F.col(id_col), F.col(text_col), *th).mapInArrow(each, f"doc_id {kind}, fp long" + (", th long" if hashed else ""))


_POSITIONS = np.arange(1, HALF + 1, dtype=np.uint64)
_PAIRS = [[(a, a ^ s) for a in range(1, HALF + 1) if a < a ^ s <= HALF] for s in range(HALF + 1)]


def _syndromes(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for position in range(1, HALF + 1):
        out ^= np.where((words >> np.uint64(position - 1)) & np.uint64(1), position, 0)
    return out


def anchors_within_two(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 31-bit word, the codewords at distance 2 or less: (index of the word, codeword).

    A word with syndrome s = 0 is a codeword, and no other is nearer than 3.  Else flipping bit s gives the
    one at distance 1, and flipping two positions whose xor is s gives the fifteen at distance 2.
    """
    syndrome, index, codes = _syndromes(words), [], []
    for s in np.unique(syndrome).tolist():
        at = np.flatnonzero(syndrome == s)
        flips = [0] if s == 0 else [1 << (s - 1)] + [(1 << (a - 1)) | (1 << (b - 1)) for a, b in _PAIRS[s]]
        for flip in flips:
            index.append(at)
            codes.append(words[at] ^ np.uint64(flip))
    return (np.concatenate(index), np.concatenate(codes)) if index else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mask = np.uint64((1 << HALF) - 1)
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for half in (0, 1):
            index, codes = anchors_within_two((fps >> np.uint64(32 * half)) & mask)
            keys = (codes | np.uint64(half << HALF)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[index].view(np.int64))], names=["anchor", "fp"])


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n members the smallest one that the links a-b reach."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, a, least)
        np.minimum.at(fresh, b, least)
        np.minimum.at(fresh, label[a], least)
        np.minimum.at(fresh, label[b], least)
        while not np.array_equal(fresh, fresh[fresh]):
            fresh = fresh[fresh]
        if np.array_equal(fresh, label):
            return label
        label = fresh


def _forest(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each member to the first one of its component, where members within two bits are neighbours."""
    if len(members) <= 64:
        a, b = np.triu_indices(len(members), 1)
        near = np.bitwise_count(members[a] ^ members[b]) <= MAX_BITS
        a, b = a[near], b[near]
    else:
        flips = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)))
        values = (members[:, None] ^ flips[None, :]).ravel()
        owner = np.repeat(np.arange(len(members)), len(flips))
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        same = values[1:] == values[:-1]
        a, b = owner[:-1][same], owner[1:][same]
    root = _stars(len(members), a, b)
    moved = np.flatnonzero(root != np.arange(len(members)))
    return members[moved], members[root[moved]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor in, links out; an anchor may span batches."""
    rest_key, rest = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        size = np.diff(bounds)
        left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        two = bounds[:-1][size == 2]
        x, y = fps[two].view(np.uint64), fps[two + 1].view(np.uint64)
        near = np.bitwise_count(x ^ y) <= MAX_BITS
        left.append(x[near])
        right.append(y[near])
        for k in np.flatnonzero(size > 2).tolist():
            x, y = _forest(fps[bounds[k] : bounds[k + 1]].view(np.uint64))
            left.append(x)
            right.append(y)
        pair = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0].view(np.int64)), pa.array(pair[:, 1].view(np.int64))], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate((rest_key, batch.column(0).to_numpy(zero_copy_only=False)))
        fps = np.concatenate((rest, batch.column(1).to_numpy(zero_copy_only=False)))
        if not len(keys):
            continue
        done = int(np.searchsorted(keys, keys[-1], side="left"))
        if done:
            yield links(keys[:done], fps[:done])
        rest_key, rest = keys[done:], fps[done:]
    if len(rest):
        yield links(rest_key, rest)


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints within two bits; ``distinct`` has each fp once.

    Two bits may fall on the bits that no anchor sees (the last of each half) or on both halves; in all cases
    one half differs in at most one bit, where both fingerprints reach the same anchor.
    """
    spread = distinct.select("fp").mapInArrow(_replicas, "anchor long, fp long")
    dealt = spread.repartition(n_partitions(distinct), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(_compare, "a long, b long").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, hashed: bool = False) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id that links reach); if ``hashed`` th and root too."""
    marked = cut(fingerprints(docs, id_col, text_col, size, hashed))
    first = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(first))
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    more = ["root"] if hashed else []
    named = rooted.join(least, "root").select("fp", "component_id", *more)
    # a fingerprint may belong to a third of all documents: AQE splits that partition, its other side is one row
    return marked.join(named, "fp").select("doc_id", "fp", "component_id", *(["th"] if hashed else []), *more)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """The document with the smallest id of each component, all columns; rows that repeat id and text become one row.

    Texts of one id that lie in different components all stay.  Rows without an id belong to no component that could
    name them and stay.
    """
    found = classes(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, size, hashed=True)
    roots = found.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("x")).select(F.col("x.doc_id").alias("__kept"), F.col("x.th").alias("__th")).distinct()
    marked = docs.withColumn("__own_th", F.xxhash64(text_col))
    kept = marked.join(roots, (F.col(id_col) == F.col("__kept")) & (F.col("__own_th") == F.col("__th")), "left_semi")
    return kept.dropDuplicates([id_col, "__own_th"]).drop("__own_th").unionByName(docs.filter(F.col(id_col).isNull()))

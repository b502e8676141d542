"""A prefix trie of conversations, its totals summed from the leaves up by messages (operator 13).

* Turns are numbered over range partitions, so a conversation of any length is split over tasks.  A turn is a digest
  of its role and text from then on.
* The key of a prefix is the sum of the digests of its turns, each hashed with its place, in four sums of 32-bit
  words: running sums, which are made piece by piece (``running``) and need no long group in one task.  Nodes are the
  groups of equal length and key.
* Every node names one of its members: that with the least hash of its id.  The nodes that name one conversation are a
  path without gaps, so a long chain of single children counts as one unit.  As hashes are random, a way from the root
  to a leaf changes its path about ln(conversations) times, whatever the shape of the trie.
* Leaf-peeling: a path holds the number of paths that hang on it and have not finished.  In each round the paths
  without any left are complete; they send their totals to their parents' paths, which add them up and count down,
  until the root's path, the last, is complete.  Then one running sum along each path, from its end, adds the
  messages that its nodes got.

Defined cases: rows without a conv_id belong to no conversation and are left out; a null role or text counts as
empty; turns that tie (null turns come first) are ordered by the
first ``TIE`` characters of role and text, then by digest; repeated rows are turns of their own; an
empty table gives no rows; other columns are ignored, whatever their names.  ``block`` is taken toward zero, as SQL's remainder is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import WORD_RE, cut

#: Places of a running sum that one task adds up at a time.
PIECE = 4096
#: Characters of role and text that order turns which tie.
TIE = 64
#: Ids of members that are written as one text.
IDS = 512
_SUMS = ["s0", "s1", "s2", "s3"]


def running(rows: DataFrame, key: list[str], place: str, values: list[str]) -> DataFrame:
    """Sums of ``values`` from the first place of each key up to each row.

    Places are whole numbers from 0; each piece of ``PIECE`` places is summed by itself, the sums of pieces are summed
    next, and both are added, so a key of any length is split.
    """
    piece = F.floor(F.col(place) / PIECE).cast("long")
    upto = Window.partitionBy(*key, "__piece").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("__piece", piece).withColumns({f"__{v}": F.sum(v).over(upto) for v in values})
    # only keys of several pieces have sums of earlier ones
    pieces = rows.withColumn("__piece", piece).groupBy(*key, "__piece").agg(*(F.sum(v).alias(f"__{v}") for v in values))
    earlier = Window.partitionBy(*key).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(*key, "__piece", *(F.sum(f"__{v}").over(earlier).alias(f"__c_{v}") for v in values)).filter(F.col("__piece") > 0)
    met = within.join(carried, [*key, "__piece"], "left")
    added = {v: F.col(f"__{v}") + F.coalesce(F.col(f"__c_{v}"), F.lit(0)) for v in values}
    return met.withColumns(added).drop("__piece", *(f"__{v}" for v in values), *(f"__c_{v}" for v in values))


def numbered(conversations: DataFrame) -> DataFrame:
    """Per turn: conv, its place in the conversation from 1, a digest of role and text, and the words of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)))
    words = F.regexp_count(text, F.lit(WORD_RE)).cast("long")
    # ties are settled by short beginnings, so that the texts need not travel
    begins = [F.substring(role, 1, TIE).alias("role"), F.substring(text, 1, TIE).alias("text")]
    narrow = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), words.alias("words"), *begins)
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("digest")]
    ranged = cut(narrow.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = ranged.withColumn("own", F.row_number().over(Window.partitionBy("part", "conv").orderBy(*order)))
    # a conversation has turns in several parts only at their edges
    sizes = ranged.groupBy("conv", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("conv", "part", F.sum("n").over(earlier).alias("before")).filter("before is not null")
    return inside.join(shift, ["conv", "part"], "left").select("conv", (F.col("own") + F.coalesce("before", F.lit(0))).alias("place"), "digest", "words")


def rebuilt(turns: DataFrame, heads: int, block: int) -> DataFrame:
    """Per turn of the rebuilt conversations: conv, place, digest, words.

    Conversation c begins with the first h turns of conversation c - c % block, h = crc32(c) % ``heads``; its own turns
    behind its first h follow.
    """
    base = turns.filter((F.col("place") < heads) & (F.col("conv") % block == 0))
    first = base.groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "words"))).alias("head"))  # fewer than ``heads`` turns
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumn("h", F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(heads)).cast("int"))
    known = convs.withColumn("base", F.col("conv") - F.col("conv") % block).join(first, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<place:bigint,digest:string,words:bigint>>")), F.lit(1), F.col("h"))
    plan = cut(known.select("conv", "n", "h", head.alias("head")))
    taken = plan.select("conv", F.inline("head"))
    own = turns.join(plan.select("conv", "h", F.size("head").alias("m")), "conv").filter(F.col("place") > F.col("h"))
    kept = own.select("conv", (F.col("place") - F.col("h") + F.col("m")).alias("place"), "digest", "words")
    length = plan.select("conv", (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length"))
    return taken.unionByName(kept).join(length, "conv")


def _words_of(place: Column, digest: Column) -> list[Column]:
    """Four 32-bit words of a hash of a turn at its place."""
    hashed = F.md5(F.concat_ws(",", place.cast("string"), digest))
    return [F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def nodes(conversations: DataFrame, heads: int = 4, block: int = 20) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie, without the totals of subtrees, and who ends where.

    Nodes: key, parent (its key), depth, conv (smallest member), path (the member of least hash), n_convs, words.
    Ends: key and conv of each conversation's last node.
    """
    turns = cut(numbered(conversations))
    rows = rebuilt(turns, heads, block)
    hashed = rows.withColumns(dict(zip(_SUMS, _words_of(F.col("place"), F.col("digest"))))).drop("digest")
    own = hashed.withColumns({f"own_{s}": F.col(s) for s in _SUMS})
    summed = running(own, ["conv"], "place", _SUMS)

    def key(sums: list[Column], depth: Column) -> Column:
        return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *(s.cast("string") for s in sums))))

    here = key([F.col(s) for s in _SUMS], F.col("place"))
    above = key([F.col(s) - F.col(f"own_{s}") for s in _SUMS], F.col("place") - 1)
    members = cut(summed.select("conv", "place", "words", "length", here.alias("key"), above.alias("parent")))
    zero = key([F.lit(0)] * 4, F.lit(0))
    roots = turns.select("conv").distinct().select("conv", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("words"), zero.alias("key"), F.lit(None).cast("binary").alias("parent"))
    every = members.drop("length").unionByName(roots)
    chance = F.struct(F.xxhash64("conv").alias("x"), F.col("conv").alias("c"))
    grouped = every.groupBy("key", F.col("place").alias("depth")).agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("conv"), F.min(chance)["c"].alias("path"), F.max("words").alias("words"), F.max("parent").alias("parent")
    )
    ended = members.filter(F.col("place") == F.col("length")).select("key", "conv")
    turnless = turns.select("conv").distinct().join(members.filter(F.col("place") == 1).select("conv"), "conv", "left_anti")
    return cut(grouped), ended.unionByName(turnless.select(zero.alias("key"), "conv"))


def end_digests(ends: DataFrame) -> DataFrame:
    """Per node: SHA-256 of the ids of the conversations that end there, ascending, joined by commas.

    Ids are joined by blocks of ``IDS`` numbers first; the blocks of a node, in order, run through one hash.
    """
    blocks = ends.groupBy("key", F.floor(F.col("conv") / IDS).cast("long").alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    counted = blocks.join(blocks.groupBy("key").agg(F.count("*").alias("n")), "key")
    few = counted.filter("n = 1").select("key", F.sha2("ids", 256).alias("ends_sha256"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        at, state = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != at:
                    if state is not None:
                        yield out()
                    at, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if state is not None:
            yield out()

    many = counted.filter("n > 1").repartition("key").sortWithinPartitions("key", "block").select("key", "ids")
    return few.unionByName(many.mapInArrow(each, "key binary, ends_sha256 string"))


def peel(paths: DataFrame) -> DataFrame:
    """Totals of every path's whole subtree, by rounds of messages.

    ``paths``: path, above (the path that its head hangs on; null for the root's), at (depth of the node there),
    saved and leaves of its own nodes.  Gives path, above, at, saved, leaves.
    """
    hanging = paths.filter(F.col("above").isNotNull()).groupBy(F.col("above").alias("path")).agg(F.count("*").alias("left"))
    state = cut(paths.join(hanging, "path", "left").withColumn("left", F.coalesce("left", F.lit(0))))
    finished = []
    while True:
        done = state.filter("left = 0")
        finished.append(done.drop("left"))
        waiting = state.filter("left > 0")
        sent = done.groupBy(F.col("above").alias("path")).agg(F.sum("saved").alias("m_saved"), F.sum("leaves").alias("m_leaves"), F.count("*").alias("m_left"))
        got = waiting.join(sent, "path", "left")
        added = {c: F.col(c) + sign * F.coalesce(f"m_{c}", F.lit(0)) for c, sign in (("saved", 1), ("leaves", 1), ("left", -1))}
        state = cut(got.withColumns(added).drop("m_saved", "m_leaves", "m_left"))
        if state.isEmpty():
            break
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out


def trie(conversations: DataFrame, heads: int = 4, block: int = 20) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    node, ends = nodes(conversations, heads, block)
    children = node.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    above = node.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv"), F.col("path").alias("above"))
    known = node.join(children, "key", "left").join(above, "parent", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    own = {"saved": (F.col("n_convs") - 1) * F.col("words"), "leaves": (F.col("n_children") == 0).cast("long")}
    known = cut(known.withColumns(own).drop("parent", "words"))
    # a path's head is its highest node; the node above it belongs to another path
    paths = known.groupBy("path").agg(F.min_by("above", "depth").alias("above"), (F.min("depth") - 1).alias("at"), F.max("depth").alias("last"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    last = paths.select("path", "last")
    totals = peel(paths.drop("last"))
    inbox = totals.filter(F.col("above").isNotNull()).groupBy(F.col("above").alias("path"), F.col("at").alias("depth")).agg(F.sum("saved").alias("m_saved"), F.sum("leaves").alias("m_leaves"))
    met = known.drop("above").join(inbox, ["path", "depth"], "left").join(last, "path")
    values = {c: F.col(c) + F.coalesce(f"m_{c}", F.lit(0)) for c in ("saved", "leaves")}
    ready = met.withColumns(values | {"from_end": F.col("last") - F.col("depth")}).drop("m_saved", "m_leaves", "last")
    summed = running(ready, ["path"], "from_end", ["saved", "leaves"])
    digested = summed.join(end_digests(ends), "key", "left")
    return digested.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )

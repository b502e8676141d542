"""Operator 13 against a trie in memory."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

from weftline.llm import conversation_trie
from weftline.llm.conversation_trie import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, heads=4, block=20):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [t[1:] for t in sorted(ts)] for c, ts in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % heads
        whole = tuple(turns.get(c - int(math.fmod(c, block)), [])[:h] + turns[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        saved[s] = (len(members[s]) - 1) * words + sum(saved[c] for c in children[s])
        leaves[s] = sum(leaves[c] for c in children[s]) or 1
    return sorted(
        (min(m), len(s), -1 if not s else min(members[s[:-1]]), len(m), len(children[s]), leaves[s], saved[s], hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest())
        for s, m in members.items()
    )


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def made(seed, convs=150, words=2, longest=6):
    r = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = r.choice([r.randrange(60), r.randrange(3000), -r.randrange(50)])
        start = len(rows)
        rows += [(c, start + k, r.choice("ua"), " ".join(r.choice("xy") for _ in range(r.randint(0, words)))) for k in range(r.randint(1, longest))]
    return rows


def test_random_tries(spark):
    for seed in range(2):
        rows = made(seed)
        assert found(trie(spark.createDataFrame(rows, SCHEMA).repartition(7))) == plain(rows)


def test_long_conversation_and_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 16)
    monkeypatch.setattr(conversation_trie, "IDS", 4)
    rows = [(7, k, "user", f"turn {k}") for k in range(300)]
    for c in range(100, 160):  # every one a prefix of the long one, all in its own depth, then copies of one first turn
        rows += [(c, k, "user", f"turn {k}") for k in range(c - 95)]
    rows += [(c, 0, "user", "hello") for c in range(1000, 1100)]
    assert found(trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == plain(rows)


def test_nulls_ties_repeats(spark):
    rows = [(1, None, None, "a b"), (1, 0, "user", None), (1, 0, "user", None), (2, None, "", "a b"), (None, 1, "user", "lost"), (3, 5, "u", "t"), (3, 5, "a", "t"), (23, 1, "u", "x"), (23, 2, "u", "y z")]
    assert found(trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_empty_table_and_clashing_columns(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "user", "b c")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert trie(frame.limit(0)).count() == 0
    wide = frame.selectExpr("*", "1 AS key", "2 AS path", "3 AS depth", "4 AS words", "5 AS place", "6 AS part", "7 AS digest")
    assert found(trie(wide)) == plain(rows)


def test_rounds_grow_slowly(spark, monkeypatch):
    """Conversations that each extend the one before make a chain; its rounds are few, whatever the ids."""
    rows = [(20 * c, k, "user", f"turn {k}") for c in range(1, 41) for k in range(c)]
    rounds = []
    cut = conversation_trie.cut
    monkeypatch.setattr(conversation_trie, "cut", lambda df: (rounds.append("left" in df.columns), cut(df))[1])
    assert found(trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    assert sum(rounds) <= 14

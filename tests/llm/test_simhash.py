import re

import numpy as np
import pytest
import xxhash

from weftline.llm import simhash
from weftline.llm.components import components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(v >> j & 1 for v in values) > len(values))


def brute_classes(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_matches_definition():
    for text in [None, "", " \n\t", "One", "one TWO", "a b c", "a b c d a b c d", "Été É é ABC abc x y\x0bz", "the quick brown fox " * 50]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_anchors_are_all_codewords_within_two():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 31, 40, dtype=np.uint64)
    words = np.concatenate((words, np.array([0], np.uint64)))
    index, codes = simhash.anchors_within_two(words)
    assert (np.bitwise_count(words[index] ^ codes) <= 2).all()
    assert (simhash._syndromes(codes) == 0).all()
    assert set(np.bincount(index).tolist()) <= {1, 16}


@pytest.mark.parametrize("n", [40, 600])
def test_links_connect_what_brute_force_connects(spark, n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(b) for b in base}
    while len(fps) < n:
        x = int(rng.choice(list(fps)))
        for _ in range(int(rng.integers(1, 5))):
            x ^= 1 << int(rng.integers(0, 64))
        fps.add(x)
    fps = sorted(fps)
    want = {f: fps[r] for f, r in zip(fps, brute_classes(fps))}
    signed = lambda x: int(np.uint64(x).view(np.int64))
    found = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"))).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(found.get(signed(f), signed(f)), set()).add(f)
    wanted = {}
    for f in fps:
        wanted.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_classes_on_odd_rows(spark):
    rows = [(5, None, "x"), (3, "", None), (9, " \n", "y"), (1, "a b c d e", "z"), (1, "a b c d e", "z"), (7, "A B C D E", None), (8, "word " * 30000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.component_id) for r in simhash.classes(docs).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (1, 1), (7, 1), (8, 8)}
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 3, 8]
    twice = docs.unionByName(spark.createDataFrame([(8, "another text of one id", "t"), (None, "x", "u")], "doc_id long, text string, fp string"))
    assert sorted((r.doc_id or 0, r.fp) for r in simhash.keep_one(twice).collect()) == [(0, "u"), (1, "z"), (3, None), (8, "s"), (8, "t")]
    assert simhash.classes(docs.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300))

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from weftline.llm import queries, repeats
from weftline.llm.suffix_groups import repeated_windows, suffix_array


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(40), text(14)
    texts = [None, "", "short", "ab" * 400, "a" * 700, "xyz" * 150 + "q" + "xyz" * 150]
    for _ in range(25):
        texts.append(text(rng.randint(1, 120)))
        if rng.random() < 0.5:
            texts[-1] += passage + text(rng.randint(0, 20))
        if rng.random() < 0.4:
            texts[-1] = line + texts[-1] + line
    near = text(150)
    for _ in range(12):
        words = near.split()
        words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    return texts + texts[8:12]


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = np.concatenate((rng.integers(1, int(rng.integers(2, 5)), int(rng.integers(0, 50))), [0]))
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert repeated_windows([], 3) == []


@pytest.mark.parametrize(("seed", "hot"), [(1, 4000), (2, 1)])
def test_removal_against_brute_force(spark, seed, hot):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, data string")
    got = {r.doc_id: r for r in repeats.remove_repeats(docs, length=60, gram=24, step=7, hot=hot, keep_text=True).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == brute(texts, 60)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.values())


def test_whole_length_and_odd_rows(spark):
    base = "".join(random.Random(4).choice("abcdefgh ") for _ in range(3000))
    rows = [(1, base), (1, base), (None, "z" + base[500:1200] + "z"), (4, None), (5, ""), (6, base[:399]), (7, base[:400] + "!" * 399)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect())
    assert got == sorted((i or -1, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], 400)))
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_planted_passages_are_judged_by_bytes(spark, tmp_path):
    # 51 words of these are under 400 bytes; a passage of over 50 words goes if, and only if, it has 400 bytes
    rng = random.Random(9)
    words = lambda n: [rng.choice("abcdefgh") + "".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 9))) for _ in range(n)]
    short, long = " ".join(words(51)), " ".join(words(90))
    assert len(short) < 398 and len(long) > 400  # with a byte at either end that may be alike
    texts = {i: "\n".join((" ".join(words(60)), *([], [short], [long], [short, long])[i % 4], " ".join(words(60)))) for i in range(32)}
    spark.createDataFrame(texts.items(), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op1_repeated_bytes(spark, str(tmp_path)).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in texts] == brute(texts.values(), 400)
    for i, text in texts.items():
        # size says nothing of what was removed
        assert got[i].n_bytes == len(text.encode())
        assert (got[i].n_removed > 0) == (i % 4 >= 2) and long not in got[i].text
        assert i % 4 >= 2 or got[i].text == text

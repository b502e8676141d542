"""Texts longer than the blocks in which bytes are handled."""

import random
import re

import numpy as np
import pyarrow as pa

from weftline.llm import bytesplit, decontaminate, language_id, quality_model, repeats, simhash, simhash_wide


def long_text(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(n))


def test_words_keep_places_and_hashes_across_blocks():
    text = long_text(1, 500_000)
    assert len(text.encode()) > 2 * bytesplit.BLOCK
    parts = list(decontaminate._words(pa.array(["x y", None, text, "y"])))
    rows = np.concatenate([p.rows for p in parts])
    places = np.concatenate([p.places for p in parts])
    hashes = np.concatenate([p.hashes for p in parts])
    words = re.findall(r"[a-zé]+", text)
    assert (rows == 2).sum() == len(words) and (places[rows == 2] == np.arange(len(words))).all()
    assert (rows == 0).sum() == 2 and (rows == 3).sum() == 1 and (rows == 1).sum() == 0
    by_word = {}
    for w, h in zip(words, hashes[rows == 2].tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert hashes[rows == 0][1] == hashes[rows == 3][0]


def test_one_word_longer_than_a_block():
    parts = list(decontaminate._words(pa.array(["a" * (3 * bytesplit.BLOCK) + " b"])))
    assert sum(len(p.hashes) for p in parts) == 2


def test_pieces_cover_all_windows_of_a_long_text():
    data = np.frombuffer(long_text(2, 300_000).encode(), np.uint8)
    assert len(data) > 1 << 20
    _, _, start, n, offset = repeats.pieces(data)
    assert start[0] == 0 and (start[1:] == start[:-1] + n[:-1]).all() and start[-1] + n[-1] == len(data) - repeats.LENGTH + 1
    assert n.max() <= repeats.LENGTH - repeats.GRAM + 1 and (offset >= n - 1).all() and offset.max() <= repeats.LENGTH - repeats.GRAM


def test_repeats_across_the_chunks_of_a_long_text(spark):
    text = long_text(3, 300_000)
    raw = text.encode()
    edge = (1 << 20) - 700
    passage = raw[edge : edge + 1500].decode("utf-8", "ignore")
    docs = spark.createDataFrame([(1, text), (2, "begin " + passage + " end")], "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    n = len(passage.encode())
    assert n <= got[2].n_removed <= n + 1 and got[2].n_spans == 1
    assert got[1].n_removed == got[2].n_removed and got[1].n_bytes == len(raw)


def test_other_operators_take_long_texts_whole():
    text = long_text(4, 200_000)
    words = text.split()
    half = " ".join(words[: len(words) // 2])
    assert simhash.fingerprint(text) != simhash.fingerprint(half)
    assert len(simhash_wide.shingle_hashes(text)) > 1.5 * len(simhash_wide.shingle_hashes(half))
    assert (quality_model.features(text) != quality_model.features(half)).any()
    vocabulary = language_id._vocabulary(["zzzz", "zzzz"])
    flags = vocabulary.presence(*bytesplit.utf8(pa.array([text + " zzzz", text])))
    assert flags[0].all() and not flags[1].all()

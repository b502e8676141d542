import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from weftline.llm import token_counts  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "  a  b ", "a\n\nb\tc", "<s> </s> <unk> <0x0A>", "日本語のテキスト \U0001f600", "ﬁ① é ñ", "a▁b", "▁▁a", "\x00", "x" * 9000, "ab" * 6000, "a" * 3000 + " " * 40 + "b", "0123456789" * 30, "the " * 2000]


def test_counts_equal_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(5)
    alphabet = list("abcdefghijklmnopqrstuvwxyz    \n.,'-\"éñüß0123456789▁日本\t") + ["the ", "ing ", "tion", "  "]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(400)]
    got = token_counts.piece_counter(MODEL)(texts).tolist()
    assert got == [len(model.encode(t)) for t in texts]


def test_long_sequences_equal_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(8)
    parts = ["a", "b", "e", "t", "h", "in", "tion", "the", "ing", "aa", "é", "日", "0", "="]
    texts = ["".join(rng.choice(parts[:k]) for _ in range(n)) for k in (2, 5, 9, 14) for n in (4097, 20_000)]
    texts += ["a" * 5000 + "b" + "a" * 4097, "abab" * 3000 + "aba" * 3001, "".join(rng.choices("etaoinshrdlu", k=200_000))]
    got = token_counts.piece_counter(MODEL)(texts).tolist()
    assert got == [len(model.encode(t)) for t in texts]


def one_by_one(merges, symbols):
    """The leftmost pair of the lowest rank, again and again."""
    rank = dict(zip(merges.keys.tolist(), merges.ranks.tolist()))
    while True:
        found = [(rank[(a << 24) | b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (a << 24) | b in rank]
        if not found:
            return len(symbols)
        r, i = min(found)
        symbols[i : i + 2] = [r]


def test_long_way_and_short_way_in_any_vocabulary(monkeypatch):
    rng = random.Random(2)
    for _ in range(60):
        pieces = ["a", "b", "c"] + list({"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(25)})
        rng.shuffle(pieces)  # longer pieces may rank before their parts
        merges = token_counts.Merges([(p, -i) for i, p in enumerate(pieces)])
        words = ["".join(rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(2, 60))) for _ in range(20)]
        monkeypatch.setattr(token_counts, "LONG", 1)
        long_way = merges.count(words).tolist()
        monkeypatch.setattr(token_counts, "LONG", 1000)
        assert long_way == merges.count(words).tolist() == [one_by_one(merges, [int(merges.symbol[ord(c)]) for c in w]) for w in words]


def test_rows(spark):
    rows = [(1, None, 7), (1, None, 7), (None, "some words here", 1), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, MODEL).collect()))
    assert got == [(-1, 15, 3), (1, 0, 0), (1, 0, 0), (3, 0, 0)]
    assert token_counts.count_tokens(docs.limit(0), MODEL).count() == 0

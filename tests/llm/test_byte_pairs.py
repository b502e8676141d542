"""Operator 11 against the tokenizer library and as a round trip."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from weftline.llm import byte_pairs
from weftline.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def coder(spark):
    return byte_pairs.Coder(byte_pairs.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_pairs.read_ranks(RANKS), special_tokens={})


def texts():
    r = random.Random(7)
    out = [None, "", " ", "\n", "\na", " a", "a ", "a \n", "a\n b", "a  \nb", "\n \n", "it's  the\n\n thing's 12345 \t x", "<|endoftext|>", "\x00\x01\x1c\x85\xa0 x", "_ a_b __"]
    out += ["=" * 1000, "ab" * 700, "é" * 100, "日本語" * 50, "🎉" * 30, "the" * 400]
    out += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)), "".join(r.choice("eta ins") for _ in range(3000))]
    out += ["".join(r.choice("aeinrst") for _ in range(r.randint(40, 300))) for _ in range(30)]
    out += ["".join(r.choice("abcdefgh .,'\n\t12é日🎉 sS_") for _ in range(r.randint(1, 400))) for _ in range(80)]
    return out + [" ".join(r.choice(["laou.", "the\nnew", "ünt", "Xq", "_"]) for _ in range(r.randint(1, 300))) for _ in range(30)]


def test_ids_are_the_librarys_and_decode_to_the_text(spark, coder, library):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(5)
    rows = byte_pairs.decode(byte_pairs.encode(docs, coder), coder).collect()
    assert len(rows) == len(texts())
    for row in rows:
        assert row.ids == " ".join(map(str, library.encode_ordinary(row.text or ""))), row.text
        assert bytes(row.bytes) == (row.text or "").encode()


def test_folds_alone_give_the_same_ids(spark, coder, library):
    words = [w for t in texts() if t for w in byte_pairs.Splitter(coder.pattern).words(t)]
    words = [w for w in dict.fromkeys(words) if w.encode() not in coder.whole]
    frame = spark.createDataFrame([(w,) for w in words], "w string").repartition(8)
    for row in frame.select("w", F.get(coder.folded(F.array("w")), F.lit(0)).alias("ids")).collect():
        assert row.ids == " ".join(map(str, library.encode_ordinary(row.w))), row.w


def test_pieces_give_the_words_of_the_whole_text(coder):
    splitter = byte_pairs.Splitter(coder.pattern)
    for text in texts():
        if text:
            first, rest = splitter.pieces(text)
            assert splitter.words(first) + [w for p in rest for w in splitter.words_of(p)] == splitter.words(text)


def test_every_character_is_split_as_the_library_splits_it(coder, library):
    words = byte_pairs.Splitter(coder.pattern).words
    r = random.Random(3)
    points = [c for c in r.sample(range(0x110000), 20000) if not 0xD800 <= c < 0xE000] + list(range(0x3100))
    for c in points:
        text = f"a{chr(c)}1 {chr(c)}"
        assert [t for w in words(text) for t in library.encode_ordinary(w)] == library.encode_ordinary(text), hex(c)


def test_defined_cases(spark, coder):
    clashing = spark.createDataFrame([(1, "one one", 5, "x"), (1, "one one", 5, "x"), (None, None, None, None)], "doc_id long, text string, ids int, w string")
    rows = byte_pairs.encode(clashing, coder).orderBy("doc_id").collect()
    assert [r.ids for r in rows] == ["", rows[1].ids, rows[1].ids] and rows[1].w == "x" and rows[1].ids
    assert byte_pairs.encode(clashing.limit(0), coder).count() == 0
    unknown = spark.createDataFrame([("0 50255",), ("7 99999",), ("",)], "ids string")
    assert [r.bytes is None for r in byte_pairs.decode(unknown, coder).collect()] == [False, True, False]


def test_query_against_the_library(spark, library):
    import hashlib

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op11_byte_pairs"](spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_folds_of_words_that_are_tokens_give_that_token(spark, coder, library):
    words = [" ga", "fd", "th", " the", "a", "\n"]
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    for row in frame.select("w", F.get(coder.folded(F.array("w")), F.lit(0)).alias("ids")).collect():
        assert row.ids == " ".join(map(str, library.encode_ordinary(row.w))), row.w


def test_columns_give_the_pieces_and_words_of_each_text(coder):
    splitter = byte_pairs.Splitter(coder.pattern)
    first, rest, n = splitter.columns(pa.array(texts(), pa.string()))
    ends = n.cumsum().tolist()
    for text, head, k, end in zip(texts(), first.to_pylist(), n.tolist(), ends):
        assert (head, rest.to_pylist()[end - k : end]) == splitter.pieces(text or ""), text
    distinct = rest.unique()
    words, owners = splitter.words_of_each(distinct)
    for i, piece in enumerate(distinct.to_pylist()):
        assert [w for w, owner in zip(words, owners.tolist()) if owner == i] == splitter.words_of(piece), piece


def test_pieces_are_read_once_for_all_texts_of_a_portion(coder):
    writer = byte_pairs.Writer(pa.table({"w": pa.array([], pa.string()), "ids": pa.array([], pa.string())}), coder.whole, coder.pattern)
    read, words = [], writer.splitter.words
    writer.splitter.words = lambda text: read.append(text) or words(text)
    ids, lacking = writer(pa.array(["the laou, the laou\nthe xqv", None, "the"] * 500))
    assert ids.to_pylist()[:3] == ids.to_pylist()[3:6] and lacking.to_pylist()[1:3] == [[], []]
    assert sum(map(len, read)) < 1500 * len("the") + 100  # first pieces, then each other piece once

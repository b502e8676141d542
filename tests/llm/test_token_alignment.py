"""Operator 12 against a plain two-pointer merge with counts in a dictionary."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from weftline.llm import token_alignment
from weftline.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def plain(texts):
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    byte_of = token_alignment._byte_of()
    found, counts = [], Counter()
    for text in texts:
        if not text:
            found.append(([], [], [], []))
            continue
        a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
        bytes_a = [bytes(byte_of[c] for c in a_model.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            found.append(([], [], [], []))
            continue
        groups, links, x, y, end_a, end_b, left, right = [], [], 0, 0, 0, 0, [], []
        while x < len(a) or y < len(b):
            if end_a <= end_b and x < len(a):
                left.append(a[x])
                end_a += len(bytes_a[x])
                x += 1
            else:
                right.append(b[y])
                end_b += len(bytes_b[y])
                y += 1
            if end_a == end_b:
                groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                links.append((left[-1], right[-1]))
                left, right = [], []
        counts.update(links)
        found.append((a, b, groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(len(a), len(b), len(g), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), ";".join(g)) for a, b, g, k in found]


TEXTS = [None, "", " ", "a", "hello world", "  two  spaces ", "▁ mark", "<s> </s> <|endoftext|> <unk>", "日本語 🎉 é\n\tx", "\x00", "the the the", "the the the", "x" * 5000, "long words " * 3000]


def run(spark, texts):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, row int").repartition(3)
    rows = token_alignment.with_counts(token_alignment.align(docs, A, B)).collect()
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_against_a_plain_merge(spark):
    assert run(spark, TEXTS) == plain(TEXTS)


def test_pairs_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "PAIRS", 3)
    assert run(spark, TEXTS) == plain(TEXTS)
    monkeypatch.setattr(token_alignment, "PAIRS", 0)
    assert run(spark, TEXTS) == plain(TEXTS)


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "same"), (1, "same"), (None, "other")], "doc_id long, text string")
    rows = sorted(token_alignment.with_counts(token_alignment.align(docs, A, B)).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.n_links) for r in rows[:2]] == [(1, rows[0].n_links)] * 2 and rows[2].doc_id is None
    assert rows[0].count_sum == 2 * rows[0].n_links  # each link of the two rows is held twice
    assert token_alignment.with_counts(token_alignment.align(docs.limit(0), A, B)).count() == 0


def test_query_against_a_plain_merge(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    rows = {r.doc_id: r for r in QUERIES["op12_token_alignment"](spark, SF).collect()}
    for doc, (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) in zip(docs, plain([d.text for d in docs]), strict=True):
        r = rows[doc.doc_id]
        digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (n_a, n_b, n_groups, n_links, n_best, count_sum, digest)

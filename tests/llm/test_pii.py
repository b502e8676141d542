"""Surrogates against a second reading of the same rules, and in spaces that are nearly used up."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm import pii


def changed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.pseudonymize(df, "k").orderBy("doc_id").collect()
    return [r.text for r in rows], [r.n_entities for r in rows]


def test_phone_spellings_and_country_codes(spark):
    texts = ["call +12125550100 or", "call +1 212 555 0100 or", "call (212) 555-0100 or", "call 212-555-0100 or", "call +4930123456789 or", "call +49 30 1234 56789 or", "id 212-555-01001 or 1-212-555-0100"]
    got, n = changed(spark, texts)
    digits = [re.sub(r"\D", "", t) for t in got]
    assert got[0].startswith("call +1") and digits[0] == digits[1] == "1" + digits[2] and digits[2] == digits[3] != "2125550100"
    assert digits[4] == digits[5] and digits[4].startswith("49") and digits[4] != "4930123456789"
    assert [re.sub(r"\d", "9", t) for t in got] == [re.sub(r"\d", "9", t) for t in texts]
    assert got[6] == texts[6] and n == [1, 1, 1, 1, 1, 1, 0]


def test_later_mentions_without_title(spark):
    texts = ["Mrs. Anna Smith came. Anna Smith sat; Smith spoke of Smithfield and SMITH.", "Anna Smith of another text has no title.", "Dr. Anna Smith and Smith's dog, Mr. Tom Smith, and Tom Smith."]
    got, n = changed(spark, texts)
    found = re.fullmatch(r"Mrs\. (\w+) (\w+) came\. (\w+) (\w+) sat; (\w+) spoke of Smithfield and SMITH\.", got[0])
    given, family = found[1], found[2]
    assert found.groups() == (given, family, given, family, family) and (given, family) != ("Anna", "Smith")
    assert got[1] == texts[1]
    third = re.fullmatch(r"Dr\. (\w+) (\w+) and (\w+)'s dog, Mr\. (\w+) (\w+), and (\w+) (\w+)\.", got[2])
    assert third[1] == given and third[2] == third[3] == third[5] == third[7] == family and third[4] == third[6] not in ("Tom", given)
    assert n == [3, 0, 4]


@pytest.mark.parametrize("share", [1.0])
def test_a_space_that_is_used_up(spark, share):
    """All addresses of four octets of one digit, or nine tenths of them: still distinct, of the same format, none its own."""
    rng = random.Random(2)
    every = [f"{a}.{b}.{c}.{d}" for a in range(1, 10) for b in range(1, 10) for c in range(1, 10) for d in range(1, 10)]
    ips = every if share == 1 else rng.sample(every, int(share * len(every)))
    keys = spark.createDataFrame([("ip", x) for x in ips], "kind string, norm string")
    got = {r.norm: r.core for r in pii.surrogates(keys, "k").collect()}
    assert set(got) == set(ips) and len(set(got.values())) == len(ips)
    assert all(a != b and re.fullmatch(r"\d\.\d\.\d\.\d", b) for a, b in got.items())


def test_numbers_keep_their_length_however_many(spark):
    keys = spark.createDataFrame([("ssn", f"{i:09d}") for i in range(100_000_000, 100_020_000)] + [("card", "4111111111111111"), ("phone", "2125550100")], "kind string, norm string")
    rows = pii.surrogates(keys, "k").collect()
    assert len({(r.kind, r.core) for r in rows}) == len(rows) == 20_002
    assert all(len(r.core) == len(r.norm) and r.core != r.norm for r in rows)


def test_names_that_outlast_the_tries_of_numbers(spark, monkeypatch):
    """Names still open when numbers are exchanged: the parts are joined with surrogates out of several rounds."""
    monkeypatch.setattr(pii, "NUMBER_TRIES", 0)
    names = [f"Mr. {a}{b}{c} Weber" for a in "BCDF" for b in "aeio" for c in "lmn"]
    found = spark.createDataFrame([(x,) for x in names], "match string")
    got = {r.match: r.surrogate for r in pii.replacements(found, "k").collect()}
    assert set(got) == set(names) and len(set(got.values())) == len(names)
    assert all(v.startswith("Mr. ") and v != k for k, v in got.items())


def test_matches_against_a_second_reading(spark):
    """Each detected value is gone, each text between stays, equal values get equal surrogates over all texts."""
    rng = random.Random(4)
    people = ["Mr Paul Weber", "Frau Eva König", "Dr. Li", "Señora María López", "Prof. O'Brien"]
    values = [f"{rng.choice('abc')}{i}@mail{i % 3}.example.org" for i in range(8)] + ["+44 20 7946 0018", "123-45-6789", "4111 1111 1111 1111", "10.20.30.40", "ab" * 20] + people
    words = "the quick brown fox jumps over lazy dogs".split()
    texts, parts = [], []
    for _ in range(60):
        own = [rng.choice(values) for _ in range(rng.randint(0, 3))]
        between = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(len(own) + 1)]
        texts.append("".join(f"{b}, {v}, " for b, v in zip(between, own)) + between[-1])
        parts.append((own, between))
    got, n = changed(spark, [*texts, None, ""])
    assert got[-2:] == [None, ""] and n[:-2] == [len(own) for own, _ in parts]
    known = {}
    for text, (own, between) in zip(got, parts):
        at = 0
        for b, v in zip(between, own):
            assert text.startswith(f"{b}, ", at)
            at += len(b) + 2
            found = text[at : text.index(",", at)]
            assert known.setdefault(v, found) == found and found != v
            at += len(found) + 2
        assert text[at:] == between[-1]
    assert len(set(known.values())) == len(known)


def test_a_very_long_text(spark):
    text = "some words and more " * 200_000 + "write to ann@example.org, Mr. Paul Weber, then Weber."
    got, n = changed(spark, [text])
    assert len(got[0]) > 4_000_000 and "ann@" not in got[0] and "Weber" not in got[0] and n == [3]


def test_thousands_of_repetitions_in_one_match(spark):
    """One match may have thousands of words, titles, particles, initials or labels: no stack grows with them."""
    n = 6000
    texts = ["Mr. " + "Anna " * n, "Mr. " * n + "Anna", "Mr. " + "van " * n + "Berg", "Mr. " + "A. " * n + "Berg", "x@" + "ab." * n + "com end"]
    found = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", pii.matches(F.col("text")).alias("found"))
    assert {r.doc_id: r.found for r in found.collect()} == {i: [t.strip().removesuffix(" end")] for i, t in enumerate(texts)}
    got, counts = changed(spark, texts[:4])
    assert counts == [1, 1, 1, 1] and not any(w in t for t in got for w in ("Anna", "Berg")) and got[2].count(" van") == n


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "Mr. Paul Weber", 5, 6)], "doc_id long, text string, n_entities int, __map int").withColumn("kind", F.lit("x"))
    row = pii.pseudonymize(df.drop("__map")).first()
    assert row.n_entities == 1 and row.kind == "x" and "Weber" not in row.text

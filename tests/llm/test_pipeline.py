"""The stages of the pipeline, each against a brute-force version of its whole result, and its defined cases."""

import random
import re

import pytest

import corpus_pipeline
from weftline.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(30), prose(6)]
    texts = [prose(rng.randint(50, 160)) for _ in range(60)]

    def edited(text, n):
        words = text.split()
        for _ in range(n):
            words[rng.randrange(len(words))] = word()
        return " ".join(words)

    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for i, t in enumerate(texts)]
    rows += [(200 + i, edited(texts[i], i % 4), "en", "b") for i in range(20)]  # copies and near copies, and some that are not near
    rows += [(300 + i, edited(texts[i], 30), "en", "c") for i in range(5)]
    rows += [(400, prose(49), "en", "a"), (401, None, "en", "a"), (402, "", None, None), (403, "x y z " * 60, "en", "a"), (404, " ".join(word() + "###" for _ in range(70)), "en", "b")]
    rows += [(500, prose(40) + " " + " ".join(items[0].split()[5:20]) + " " + prose(30), "en", "a"), (501, prose(50) + " " + items[1] + " " + prose(9), "en", "b"), (502, prose(40) + " " + " ".join(items[0].split()[:9]) + " " + prose(30), "en", "a")]
    rows += [(600, prose(60) + " mail ann.77@mail3.example.com or +1 (212) 555-0100 now", "en", "a")]
    rows += [(7, prose(80), "en", "a"), rows[9], (None, texts[3], "en", "a"), (None, texts[3], "en", "a")]  # an id with two texts, a repeated row, rows without ids
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], items


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def accepted(text):
    w = words(text)
    if len(w) < 50:
        return False
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    repeated = {j for i, t in enumerate(triples) if triples.count(t) > 1 for j in (i, i + 1, i + 2)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    chars = sum(map(len, w))
    letters, capitals = sum(c.isalpha() for c in text), sum(c.isupper() for c in text)
    return not (100 * len(repeated) > 50 * len(w) or 5 * symbols > len(w) or chars < 2 * len(w) or chars > 15 * len(w) or 2 * letters < chars or 2 * capitals > letters)


def near(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(a.lower()), words(b.lower()))]
    return len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])


def hit(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    own = split(text)
    for item in map(split, items):
        n = min(10, len(item))
        windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
        if n and any(tuple(own[i : i + n]) in windows for i in range(len(own) - n + 1)):
            return True
    return False


def test_every_stage_against_its_definition(spark, tmp_path):
    rows, items = made()
    spark.createDataFrame(enumerate(items), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    order = lambda found: sorted(found, key=str)

    def step(name, docs):
        path = f"{tmp_path}/{name}"
        stages[name](spark, docs, str(tmp_path)).write.parquet(path)
        out = spark.read.parquet(path)
        return out, order(map(tuple, out.collect()))

    docs, found = step("quality rules", docs)
    want = [r for r in rows if accepted(r[1])]
    assert found == order(want)

    docs, found = step("near duplicates", docs)
    known = [r for r in want if r[0] is not None]
    group = list(range(len(known)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(known)):
        for k in range(i):
            if near(known[i][1], known[k][1]):
                group[root(i)] = root(k)
    least = {}
    for i, r in enumerate(known):
        least[root(i)] = min(least.get(root(i), r), r, key=lambda x: x[0])
    want = list(dict.fromkeys(least.values())) + [r for r in want if r[0] is None]
    assert found == order(want)

    docs, found = step("decontamination", docs)
    want = [r for r in want if not hit(r[1], items)]
    assert found == order(want)

    docs, found = step("personal data", docs)
    got = {r[0]: r for r in found if r[0] is not None and r[0] != 7}
    for r in want:
        if r[0] == 600:
            assert got[600][1] != r[1] and not re.search("ann.77|555-0100", got[600][1]) and got[600][4] == len(got[600][1])
            assert len(words(got[600][1])) == len(words(r[1]))
    assert [x for x in found if x[0] != 600] == order(r for r in want if r[0] != 600)

    mixed = stages["mixing"](spark, docs, str(tmp_path)).collect()
    taken = {(r.doc_id, r.text): (r.source, r.copies) for r in mixed}
    by_mix = {}
    for r in mixing.mix(docs).collect():
        by_mix[r.doc_id] = by_mix.get(r.doc_id, 0) + r.taken
    got = {}
    for (i, text), (_, copies) in taken.items():
        got[i] = got.get(i, 0) + copies * len(words(text)) * (2 if i is None else 1)
    assert {i: n for i, n in by_mix.items() if n and i is not None} == {i: n for i, n in got.items() if i is not None}


def test_empty_table_and_more_columns(spark, tmp_path):
    rows, items = made()
    spark.createDataFrame(enumerate(items), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS copies", "2 AS target", "'x' AS n_entities", "3 AS grp")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == corpus_pipeline.COLUMNS, name
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_key_of_the_session(spark):
    from weftline.llm import pii

    assert pii.session_key(spark) == pii.DEFAULT_KEY
    spark.conf.set(pii.KEY_SETTING, "own")
    try:
        assert pii.session_key(spark) == "own"
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_a_cluster_that_names_no_key():
    """The job runs with a secret drawn for the application: the same for all its queries, no other application's and not the known one."""
    from types import SimpleNamespace

    from weftline.llm import pii

    def session(application, named=None):
        context = SimpleNamespace(master="spark://host:7077", applicationId=application)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: named or default))

    with pytest.warns(UserWarning, match=pii.KEY_SETTING):
        drawn = pii.session_key(session("app-1"))
    assert pii.session_key(session("app-1")) == drawn and len(drawn) == 64
    with pytest.warns(UserWarning):
        assert pii.session_key(session("app-2")) not in (drawn, pii.DEFAULT_KEY)
    assert pii.session_key(session("app-1", "own")) == "own"

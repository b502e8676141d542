"""Wrapper inference on templates whose elements tell nothing by name, and on odd markup."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import html_text as H

WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def nameless(rng, k):
    """A page of plain divs: a bar of links, sometimes a notice, a head, paragraphs with lists, and closing words."""
    paragraphs = [prose(rng, rng.randint(20, 40)) for _ in range(rng.randint(1, 5))]
    items = [prose(rng, 3) for _ in range(rng.randint(0, 3))]
    notice = "<div><p>We move house in May.</p></div>" if k % 3 == 0 else ""
    body = "".join(f"<p>{p}</p>" for p in paragraphs) + ("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if items else "")
    bar = "".join(f'<a href="{i}">{prose(rng, 2)}</a> ' for i in range(rng.randint(3, 6)))
    html = f"<body><div>{bar}</div>{notice}<div><div><h1>Head {k}</h1>{body}</div></div><div><p>All rights reserved, the house of pages.</p></div></body>"
    return html, " ".join([f"Head {k}", *paragraphs, *items])


def texts(spark, pages):
    df = spark.createDataFrame([(i, "http://one.example.com/%s" % i, h) for i, h in pages], "page_id long, url string, html string")
    return {r.page_id: r.text for r in H.extract(df).collect()}


def test_slots_of_the_wrapper_tell_main_text(spark):
    rng = random.Random(5)
    made = [nameless(rng, k) for k in range(24)]
    got = texts(spark, [(k, h) for k, (h, _) in enumerate(made)])
    assert got == {k: t for k, (_, t) in enumerate(made)}


def test_without_the_wrapper_texts_change(monkeypatch):
    """Each page read by a wrapper of one page keeps the template's fixed words: inference is what tells them."""
    rng = random.Random(5)
    made = [nameless(rng, 3 * k) for k in range(8)]
    pages = [H.Page(h) for h, _ in made]
    together = H.label(H.infer([p.root for p in [H.Page(h) for h, _ in made]]))
    assert [H.main_text(p, together) for p in pages] == [t for _, t in made]
    constant = H.label(H.infer([H.Page("<body><p>x</p></body>").root]))
    assert [H.main_text(p, constant) for p in pages] != [t for _, t in made]


def test_expression_has_optional_and_repeated_groups():
    a = H.Page("<body><h1>t</h1><dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl><p>x</p><p>y</p></body>").root
    b = H.Page("<body><div class=ad>q</div><h1>t</h1><dl><dt>a</dt><dd>b</dd></dl><p>x</p></body>").root
    wrapper = H.infer([a, b])
    assert H.expression(wrapper) == "(body(div.ad(#)? h1(#) dl((dt(#) dd(#))+) p(#)+))"
    assert H._load(H._dump(wrapper, [])) == [wrapper[0], wrapper[1], H._load(H._dump(wrapper, []))[2]]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        found = H.aligned([[x, 0, []] for x in a], [[x, 0, []] for x in b])
        assert [i for i, _ in found if i is not None] == list(range(len(a))) and [j for _, j in found if j is not None] == list(range(len(b)))
        assert all(a[i] == b[j] for i, j in found if i is not None and j is not None)
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert sum(i is not None and j is not None for i, j in found) == best[-1][-1]


@pytest.mark.parametrize(
    "part",
    [
        '<div class="a b c d e f g comments">Reader says</div>',
        '<div data-x="%s" class="comments">Reader says</div>' % ("y" * 600),
        "<section id='comments'><div>Reader says</div></section>",
        '<p class="advert">Buy</p>',
        "<nav><a href=1>One</a></nav><form>Name <input></form><script>var a = '</p>';</script><style>p{}</style>",
    ],
)
def test_what_is_no_main_text(spark, part):
    got = texts(spark, [(k, f"<html><body><article><h1>Head {k}</h1><p>Some text {k}.</p>{part}</article></body></html>") for k in range(3)])
    assert got == {k: f"Head {k} Some text {k}." for k in range(3)}


def test_references_and_space(spark):
    pages = [(1, "<article><p>a&am<b>p;</b> b&lt;c &eacute;\n\n  d<b>e</b>f</p>\n<p> g&nbsp;h </p></article>"), (2, "<p>caf&#233;<br>x"), (3, "<div>" * 3000 + "deep")]
    assert texts(spark, pages) == {1: "a&amp; b<c é def g h", 2: "café x", 3: "deep"}


def test_many_structures_of_one_host_are_all_read(spark):
    """Over a thousand structures; each page's rare part is read by its own slots."""
    rng = random.Random(7)
    tags = ["h2", "p", "blockquote", "h3", "ul", "figure", "table"]
    pages, want = [], {}
    for k in range(600):
        parts = [(rng.choice(tags), prose(rng, 4)) for _ in range(rng.randint(3, 9))]
        pages.append((k, "<body><div id=top><a href=/>Home</a> <a href=/a>About</a></div><div id=text>" + "".join(f"<{t}>{x}</{t}>" for t, x in parts) + "</div><div>Imprint and so on</div></body>"))
        want[k] = " ".join(x for _, x in parts)
    assert texts(spark, pages) == want


def test_a_very_long_page_and_repeated_rows(spark):
    rng = random.Random(3)
    paragraphs = [prose(rng, 30) for _ in range(6000)]
    long = "<body><nav>m</nav><article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article></body>"
    df = spark.createDataFrame([(1, "http://a.example/", long), (1, "http://a.example/", long), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert {(r.page_id, r.text) for r in H.extract(df).collect()} == {(1, " ".join(paragraphs)), (2, "")}


@pytest.mark.parametrize("piece", ["<a ", '<a href="', "<a href='\"", "</div>", "<div></p>", "<script ", "<!-- ", "<", '<a "\'>', "<div>", "</script", "<p x='", "<? "])
def test_malformed_pages_are_read_in_linear_time(piece):
    import time

    began = time.perf_counter()
    H.Page("<p>start</p>" + piece * (1_000_000 // len(piece)))
    H.Page("<p>start</p>" + piece * (1_000_000 // len(piece)) + ">\"'")
    assert time.perf_counter() - began < 20


def test_tokens_are_those_of_an_expression():
    """The scanner against one regular expression, on short random pages."""
    import random
    import re

    token = re.compile(
        r"<!--.*?(?:-->|\Z)"
        r"|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|select|button|title|object)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
        r"|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
        r"|<[!?][^>]*>",
        re.S | re.I,
    )
    rng = random.Random(8)
    parts = ["<a ", "<div>", "</div>", "<p class='x'>", '"', "'", ">", "<", "text", " ", "<script>", "</script >", "<!--", "-->", "<!doctype x>", "<? x", "</", "href=", "<Title a>", "</title>"]
    for _ in range(20000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        want = [(m.start(), m.end(), m["name"] and m["name"].lower(), bool(m["close"]), m["attrs"] or "") for m in token.finditer(page)]
        assert list(H._tokens(page)) == want, page

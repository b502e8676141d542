"""Main text of web pages by union-free wrapper inference (operator 6).

Pages of a host come from few templates.  A page is read as a stream of tokens: elements opened and closed, and
text slots.  Adjacent equal runs of elements fold into repeated groups.  The folded streams of a host are then
aligned one after another with the wrapper found so far: what agrees stays, what only one side has becomes optional,
so the wrapper is a union-free regular expression with text slots, such as
``body(div.ad(#)? article(h1(#) p(#)+))``.  Alignment goes element by element, so mismatches end at their
element's end; elements without a name are told apart by what they hold.  Each slot of the wrapper gathers facts over
all pages: how often it occurs, its text inside and
outside links, and whether its text is the same everywhere.

The slots of the wrapper are then labelled.  A slot is main text if it lies in the main part: a marked article, else
the deepest section with most of the varying text outside links; if it is not in a menu (an element with more link
text than other text, or named so), header, footer, sidebar, advert, form, notice or comment part; and, outside a
marked article, if its text is not one that the template repeats on page after page.  Every page is read by
aligning its stream with the wrapper of its host: a text is kept if its slot is main text.

All pages count.  Streams with one structure are added up, distinct ones are merged in two steps, first within
``BUCKETS`` parts of a host and then over them, so a host with a third of all pages is shared among tasks.

Defined cases: a null or empty html, or one without text, gives an empty text; a null or odd url counts as one
host of its own; truncated pages are read to their end; a page without a text in its host's main part is read by
itself; malformed pages are read in time that grows with their length; lists of over 250,000 pairs of elements are aligned by
equal spelling instead of likeness; repeated rows get equal texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import difflib
import html as html_lib
import json
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, maybe_broadcast, n_partitions

#: Longest run of elements that folds into a repeated group.
MAX_GROUP = 4
#: A slot with the same text on at least so many pages, and no longer, is part of the template.
CONSTANT_PAGES, CONSTANT_CHARS = 4, 200
#: Share of the text that the main part holds at least.
MAIN_SHARE = 0.6
#: Parts of a host whose structures are merged side by side.
BUCKETS = 16
#: Structures that a task holds before it passes them on.
HELD = 20_000

_TAG = re.compile(r"(/?)([a-zA-Z][\w:-]*)")
#: Elements whose content is no text of the page.
_RAW = re.compile(r"(script|style|noscript|template|iframe|svg|textarea|select|button|title|object)\b", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript template iframe svg textarea select button title object".split()}
_ATTR = re.compile(r"(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LABEL = re.compile(r"[^a-z0-9]+")

# What elements and their class, id or role names mean.
CONTAINERS = frozenset("html body div section article main nav header footer aside form ul ol dl table figure blockquote details dialog menu fieldset center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption figcaption pre br hr address summary head option legend".split())
SECTIONS = frozenset("html body div section article main center".split())
NOT_MAIN = frozenset("nav header footer aside form menu dialog fieldset".split())
NOT_MAIN_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar header masthead footer sidebar aside breadcrumb breadcrumbs"
    " cookie cookies consent notice notices popup modal overlay comment comments disqus reply replies share sharing social related recommended newsletter subscribe signup login search form pagination pager toolbar widget complementary contentinfo".split()
)
MAIN_TAGS = frozenset(("article", "main"))
MAIN_NAMES = frozenset(("articlebody", "main", "article"))

# A slot is ["#", bits, facts, places]; an element [label, bits, children]; a group of several elements is an element
# whose label is "(" and the keys inside.  Facts: pages, characters outside links and in links, least and greatest
# hash, longest text.  Places are those of the texts in the page itself.
SLOT = "#"
OPTIONAL, REPEATED = 1, 2


@lru_cache(maxsize=1 << 13)
def _label(name: str, attrs: str) -> str:
    names = [w for m in _ATTR.finditer(attrs) for w in _LABEL.split((m[2] or m[3] or m[4] or "").lower()) if w and not w.isdigit()]
    return ".".join([name, *names])


@lru_cache(maxsize=1 << 16)
def _meaning(label: str) -> tuple[bool, bool, bool]:
    """Whether an element is outside the main text, whether it is the article, whether it is a section."""
    if label[:1] == "(":
        return False, False, True
    tag, *names = label.split(".")
    if tag not in CONTAINERS:
        heading = tag[:1] == "h" and tag[1:].isdigit()
        return not heading and not NOT_MAIN_NAMES.isdisjoint(n for n in names if n != "header"), False, False
    return tag in NOT_MAIN or not NOT_MAIN_NAMES.isdisjoint(names), tag in MAIN_TAGS or not MAIN_NAMES.isdisjoint(names), tag in SECTIONS


def _tokens(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Comments, elements and declarations of a page: begin, end, name (None: nothing to read), whether it closes, attributes.

    A ``<`` that begins none of them is text.  No stretch is read twice, whatever the page holds: places of quotes and
    of ``>`` are listed once, and a quote from which no end was found is remembered.
    """
    stops = [m.start() for m in re.finditer("[>\"']", page)]
    ends = [p for p in stops if page[p] == ">"]
    # where the next stop of the same kind is
    again, last = [-1] * len(stops), {}
    for k in range(len(stops) - 1, -1, -1):
        c = page[stops[k]]
        again[k] = last.get(c, -1)
        last[c] = k
    dead: set[int] = set()

    def tag_end(at: int) -> int:
        k, passed = bisect.bisect_left(stops, at), []
        while k < len(stops) and k not in dead:
            if page[stops[k]] == ">":
                return stops[k] + 1
            passed.append(k)
            if again[k] < 0:
                break
            k = again[k] + 1
        dead.update(passed)
        return -1

    def next_end(at: int) -> int:
        k = bisect.bisect_left(ends, at)
        return ends[k] + 1 if k < len(ends) else -1

    at = page.find("<")
    while at >= 0:
        end, name, close, attrs = -1, None, False, ""
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = end + 3 if end >= 0 else len(page)
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = next_end(at + 2)
        else:
            raw = _RAW.match(page, at + 1)
            if raw is not None:
                begun = next_end(raw.end())
                if begun >= 0:
                    kind = raw[1].lower()
                    found = _RAW_END[kind].search(page, begun)
                    end = found.end() if found else len(page)
            else:
                tag = _TAG.match(page, at + 1)
                if tag is not None:
                    end = tag_end(tag.end())
                    name, close, attrs = tag[2].lower(), bool(tag[1]), page[tag.end() : end - 1] if end >= 0 else ""
        if end >= 0:
            yield at, end, name, close, attrs
            at = page.find("<", end)
        else:
            at = page.find("<", at + 1)


class Page:
    """A page as a tree of elements and slots, and its texts: runs between the ends of blocks, as pieces (raw, in a link)."""

    def __init__(self, page: str):
        self.texts: list[list[tuple[str, bool]]] = []
        self.root: list = ["", 0, []]
        open_: list[tuple[str, list]] = [("", self.root)]  # containers: tag, element
        self._into, self._fresh = self.root, True
        names: Counter[str] = Counter()
        link, at = False, 0
        for begin, end, name, close, attrs in _tokens(page):
            if begin > at:
                self._text(page[at:begin], link)
            at = end
            if name is None:
                continue
            if name == "a":
                link = not close
            if name not in BLOCKS:
                continue
            self._fresh = True
            if name in CONTAINERS:
                link = False
                if not close:
                    element = [_label(name, attrs), 0, []]
                    open_[-1][1][2].append(element)
                    open_.append((name, element))
                    names[name] += 1
                elif names[name]:
                    closed = None
                    while closed != name:
                        closed = open_.pop()[0]
                        names[closed] -= 1
                self._into = open_[-1][1]
            elif close:
                self._into = open_[-1][1]
            elif name not in ("br", "hr"):
                self._into = [_label(name, attrs), 0, []]
                open_[-1][1][2].append(self._into)
        if at < len(page):
            self._text(page[at:], link)
        self._finish()

    def _text(self, raw: str, link: bool) -> None:
        if raw.isspace():
            if self.texts and not self._fresh:  # white space between inline elements counts
                self.texts[-1].append((" ", link))
            return
        if self._fresh:
            self._into[2].append([SLOT, 0, None, [len(self.texts)]])
            self.texts.append([])
            self._fresh = False
        self.texts[-1].append((raw, link))

    def _finish(self) -> None:
        """Facts of the slots, then repeated groups, from the leaves up."""
        stack, order = [self.root], []
        while stack:
            element = stack.pop()
            order.append(element)
            for child in element[2]:
                if child[0] != SLOT:
                    stack.append(child)
                else:
                    pieces = self.texts[child[3][0]]
                    in_links = sum(len(raw) for raw, link in pieces if link)
                    whole = "".join(raw for raw, _ in pieces)
                    mark = xxhash.xxh32_intdigest(whole.encode("utf-8", "replace"))
                    child[2] = [1, len(whole) - in_links, in_links, mark, mark, len(whole)]
        for element in reversed(order):
            element[2] = fold(element[2])


def _keys(items: list) -> list[str]:
    return [x[0] for x in items]


#: Elements that tell nothing by name: what they hold tells whether two of them are one.
_PLAIN = frozenset(("div", "section"))


def _profile(item: list) -> frozenset[str]:
    """Keys inside an element, two levels deep."""
    found = set()
    for child in item[2]:
        found.add(child[0])
        if child[0] != SLOT:
            found.update(f"{child[0]}/{x[0]}" for x in child[2])
    return frozenset(found)


def _likeness(a: list, b: list) -> float:
    """How much speaks for aligning two items: 0 if they cannot be one."""
    if a[0] != b[0]:
        return 0.0
    if a[0] not in _PLAIN:
        return 4.0
    x, y = _profile(a), _profile(b)
    if not x or not y:
        return 1.0
    common = len(x & y) / len(x | y)
    return 1.0 + 3.0 * common if common else 0.0


def _runs_equal(a: list, b: list) -> bool:
    for x, y in zip(a, b):
        if x[0] != y[0] or (x[0] in _PLAIN and _profile(x) != _profile(y)):
            return False
    return True


def _group_label(items: list) -> str:
    return "(" + " ".join(_keys(items)) + ")"


def fold(items: list) -> list:
    """Adjacent equal runs become one, marked as repeated; a run of several elements becomes a group."""
    out: list = []
    for item in items:
        out.append(item)
        for k in range(1, MAX_GROUP + 1):
            if k > 1 and len(out) > k and out[-k - 1][0] == _group_label(out[-k:]):
                out[-k - 1] = [out[-k - 1][0], REPEATED, merged(out[-k - 1][2], out[-k:])]
                del out[-k:]
                break
            if len(out) < 2 * k or not _runs_equal(out[-2 * k : -k], out[-k:]):
                continue
            if k == 1:
                out[-2:] = [joined(out[-2], out[-1], REPEATED)]
            else:
                out[-2 * k :] = [[_group_label(out[-k:]), REPEATED, merged(out[-2 * k : -k], out[-k:])]]
            break
    return out


def _grouped(items: list, labels: set[str]) -> list:
    """Runs that form one of the groups named become that group, even where they stand once."""
    out: list = []
    for item in items:
        out.append(item)
        for k in range(2, MAX_GROUP + 1):
            if len(out) < k:
                break
            label = _group_label(out[-k:])
            if label in labels:
                if len(out) > k and out[-k - 1][0] == label:
                    out[-k - 1 :] = [[label, out[-k - 1][1] | REPEATED, merged(out[-k - 1][2], out[-k:])]]
                else:
                    out[-k:] = [[label, REPEATED, out[-k:]]]
                break
    return out


def _groups_in(items: list) -> set[str]:
    return {x[0] for x in items if x[0][:1] == "("}


def aligned(a: list, b: list) -> list[tuple[int | None, int | None]]:
    """The alignment of two lists of items with most likeness, as pairs of positions; what only one has is paired with None."""
    head, shorter = 0, min(len(a), len(b))
    while head < shorter and _runs_equal(a[head : head + 1], b[head : head + 1]):
        head += 1
    tail = 0
    while tail < shorter - head and _runs_equal(a[len(a) - 1 - tail : len(a) - tail], b[len(b) - 1 - tail : len(b) - tail]):
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    out: list[tuple[int | None, int | None]] = [(i, i) for i in range(head)]
    if len(x) * len(y) > 250_000:
        spelled = [[f"{i[0]} {sorted(_profile(i))}" if i[0] in _PLAIN else i[0] for i in items] for items in (x, y)]
        for op, i, i2, j, j2 in difflib.SequenceMatcher(None, *spelled, autojunk=False).get_opcodes():
            if op == "equal":
                out += [(head + i + k, head + j + k) for k in range(i2 - i)]
            else:
                out += [(head + k, None) for k in range(i, i2)] + [(None, head + k) for k in range(j, j2)]
    else:
        alike = [[_likeness(i, j) for j in y] for i in x]
        best = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            row, below = best[i], best[i + 1]
            for j in range(len(y) - 1, -1, -1):
                skip = max(below[j], row[j + 1])
                row[j] = max(skip, below[j + 1] + alike[i][j]) if alike[i][j] else skip
        i = j = 0
        while i < len(x) or j < len(y):
            if i < len(x) and j < len(y) and alike[i][j] and best[i][j] == best[i + 1][j + 1] + alike[i][j]:
                out.append((head + i, head + j))
                i, j = i + 1, j + 1
            elif j == len(y) or (i < len(x) and best[i][j] == best[i + 1][j]):
                out.append((head + i, None))
                i += 1
            else:
                out.append((None, head + j))
                j += 1
    return out + [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]


def joined(a: list, b: list, bits: int = 0) -> list:
    """Two items with one key as one."""
    bits |= a[1] | b[1]
    if a[0] != SLOT:
        return [a[0], bits, merged(a[2], b[2])]
    x, y = a[2], b[2]
    return [SLOT, bits, [x[0] + y[0], x[1] + y[1], x[2] + y[2], min(x[3], y[3]), max(x[4], y[4]), max(x[5], y[5])], a[3] + b[3]]


def merged(a: list, b: list) -> list:
    """Two lists of items aligned: what only one has becomes optional."""
    labels = _groups_in(a) | _groups_in(b)
    if labels:
        a, b = _grouped(a, labels), _grouped(b, labels)
    out = []
    for i, j in aligned(a, b):
        if i is None or j is None:
            one = b[j] if i is None else a[i]
            out.append([one[0], one[1] | OPTIONAL, *one[2:]])
        else:
            out.append(joined(a[i], b[j]))
    return out


def infer(trees: list[list]) -> list:
    """Wrapper of a host's pages: their trees aligned one after another."""
    wrapper = trees[0]
    for tree in trees[1:]:
        wrapper = joined(wrapper, tree)
    return wrapper


def expression(item: list) -> str:
    """The wrapper as a regular expression."""
    if item[0] == SLOT:
        body = SLOT
    else:
        inside = []
        for child in item[2]:
            inside.append(expression(child))
        body = f"({' '.join(inside)})" if item[0][:1] in ("", "(") else f"{item[0]}({' '.join(inside)})"
    return body + ("+" if item[1] & REPEATED else "") + ("?" if item[1] & OPTIONAL else "")


def _dump(item: list, out: list, facts: bool = True) -> list:
    """A tree as a flat list; without facts, what makes two structures equal."""
    if item[0] == SLOT:
        out.append([item[1], *item[2]] if facts else item[1])
    else:
        out.append(item[0])
        out.append(item[1])
        for child in item[2]:
            _dump(child, out, facts)
        out.append(None)
    return out


def _load(flat: list) -> list:
    root = top = None
    stack: list[list] = []
    at = 0
    while at < len(flat):
        token = flat[at]
        if token is None:
            top = stack.pop()
        elif isinstance(token, list):
            stack[-1][2].append([SLOT, token[0], token[1:], []])
        else:
            at += 1
            top = [token, flat[at], []]
            if stack:
                stack[-1][2].append(top)
            else:
                root = top
            stack.append(top)
        at += 1
    return root


def _constant(slot: list) -> bool:
    pages, _, _, low, high, longest = slot[2]
    return pages >= CONSTANT_PAGES and low == high and longest <= CONSTANT_CHARS


def label(wrapper: list) -> list:
    """The wrapper's structure with labels as bits: of elements, whether they are in the main part; of slots, whether they are main text."""
    mass: dict[int, int] = {}
    marks: list[tuple[list, int]] = []  # articles, with their place in the order of the walk

    def weigh(item: list, outside: bool, variable: bool) -> tuple[int, int]:
        """Usable characters and characters in links below an element."""
        if item[0] == SLOT:
            return (0 if outside or (variable and _constant(item)) else item[2][1]), item[2][2]
        away, article, _ = _meaning(item[0])
        outside = outside or away
        if article and not outside and not variable:
            marks.append((item, len(marks)))
        chars = links = 0
        for child in item[2]:
            c, n = weigh(child, outside, variable)
            chars, links = chars + c, links + n
        menu = variable and item[0].split(".")[0] in CONTAINERS and links > chars
        mass[id(item)] = 0 if menu else chars
        return mass[id(item)], links

    weigh(wrapper, False, False)
    regions = set()
    found = [m for m, _ in marks if mass[id(m)] > 0]
    inner = {id(m): False for m in found}
    for m in found:
        # an article inside another one with most of its text is the article
        if not inner[id(m)]:
            below = [x for x in found if x is not m and _holds(m, x)]
            chosen = max(below, key=lambda x: mass[id(x)], default=None)
            if chosen is not None and mass[id(chosen)] >= MAIN_SHARE * mass[id(m)]:
                continue
            regions.add(id(m))
            for x in below:
                inner[id(x)] = True
    marked = bool(regions)
    if not marked:
        whole, _ = weigh(wrapper, False, True)
        best = wrapper
        while True:
            below = [c for c in best[2] if c[0] != SLOT and _meaning(c[0])[2]]
            heavy = max(below, key=lambda c: mass[id(c)], default=None)
            if heavy is None or whole == 0 or mass[id(heavy)] < MAIN_SHARE * whole:
                break
            best = heavy
        regions.add(id(best))

    def labelled(item: list, outside: bool, inside: bool, template: bool) -> list:
        if item[0] == SLOT:
            return [SLOT, int(inside and not outside and not (template and _constant(item))), [0, item[2][1] + item[2][2], 0, 0, 0, 0], []]
        outside = outside or _meaning(item[0])[0]
        inside = inside or id(item) in regions
        menu = not marked and template and id(item) not in regions and inside and item[0].split(".")[0] in CONTAINERS and _links(item) > _chars(item)
        children = []
        for child in item[2]:
            children.append(labelled(child, outside or menu, inside, template))
        return [item[0], int(inside and not outside and not menu), children]

    out = labelled(wrapper, False, False, not marked)
    return out if marked or _kept(out) else labelled(wrapper, False, False, False)


def _holds(outer: list, inner: list) -> bool:
    stack = list(outer[2])
    while stack:
        item = stack.pop()
        if item is inner:
            return True
        if item[0] != SLOT:
            stack += item[2]
    return False


def _sum(item: list, which: int) -> int:
    total, stack = 0, [item]
    while stack:
        one = stack.pop()
        if one[0] == SLOT:
            total += one[2][which]
        else:
            stack += one[2]
    return total


def _chars(item: list) -> int:
    return _sum(item, 1)


def _links(item: list) -> int:
    return _sum(item, 2)


def _kept(item: list) -> bool:
    stack = [item]
    while stack:
        one = stack.pop()
        if one[0] != SLOT:
            stack += one[2]
        elif one[1]:
            return True
    return False


def read(page: list, known: list, keep: list[bool]) -> None:
    """Marks the texts of a page whose slots are main text, by aligning the page's tree with the labelled wrapper.

    What the wrapper lacks counts as the element around it.
    """
    inside = bool(known[1])
    a, b = page[2], known[2]
    labels = _groups_in(a) | _groups_in(b)
    if labels:
        a, b = _grouped(a, labels), _grouped(b, labels)
    for i, j in aligned(a, b):
        if i is None:
            continue
        if a[i][0] == SLOT:
            for place in a[i][3]:
                keep[place] = bool(b[j][1]) if j is not None else inside
        elif j is not None:
            read(a[i], b[j], keep)
        else:
            _unknown(a[i], inside, keep)


def _unknown(item: list, inside: bool, keep: list[bool]) -> None:
    stack = [(item, inside)]
    while stack:
        one, inside = stack.pop()
        if one[0] == SLOT:
            for place in one[3]:
                keep[place] = inside
        else:
            inside = inside and not _meaning(one[0])[0]
            stack += [(child, inside) for child in one[2]]


def main_text(page: Page, labels: list | None) -> str:
    """Texts of the slots that are main text, joined by one space."""
    keep = [False] * len(page.texts)
    if labels is not None:
        read(page.root, labels, keep)
    if not any(keep) and page.texts:
        read(page.root, label(page.root), keep)
    whole = " ".join("".join(html_lib.unescape(raw) for raw, _ in pieces) for pieces, kept in zip(page.texts, keep) if kept)
    return " ".join(whole.split())


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)"


def _with_host(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html", F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))).alias("host"))


def _deep() -> None:
    """Elements nest as deep as a page has them."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))


def structures(pages: DataFrame) -> DataFrame:
    """Rows (host, bucket, shape, tree): each structure of a host with the facts of its pages, added up in each task."""

    def flushed(held: dict[tuple[str, str], list]) -> pa.RecordBatch:
        hosts, shapes = [h for h, _ in held], [s for _, s in held]
        buckets = [int(s[:8], 16) % BUCKETS for s in shapes]
        trees = [json.dumps(_dump(t, [])) for t in held.values()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(buckets, pa.int32()), pa.array(shapes, pa.string()), pa.array(trees, pa.string())], names=["host", "bucket", "shape", "tree"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _deep()
        held: dict[tuple[str, str], list] = {}
        for batch in batches:
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = Page(text.as_py() or "")
                shape = xxhash.xxh3_128_hexdigest(json.dumps(_dump(page.root, [], False)).encode("utf-8", "replace"))
                known = held.get((host, shape))
                _forget_places(page.root)
                held[host, shape] = page.root if known is None else joined(known, page.root)
                if len(held) >= HELD:
                    yield flushed(held)
        if held:
            yield flushed(held)

    return _with_host(pages).select("host", "html").mapInArrow(each, "host string, bucket int, shape string, tree string")


def _forget_places(root: list) -> None:
    stack = [root]
    while stack:
        one = stack.pop()
        if one[0] == SLOT:
            one[3] = []
        else:
            stack += one[2]


def _merged_by(n_keys: int, finish: Callable[[list], list[str]]):
    """Rows (keys..., shape, tree) sorted by the keys and the shape: one row for each combination of the keys."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _deep()
        held, shapes = None, {}

        def done() -> pa.RecordBatch:
            # the most frequent structure first
            trees = [shapes[s] for s in sorted(shapes, key=lambda s: (-_pages(shapes[s]), s))]
            values = [*held, *finish(infer(trees))]
            kinds = [pa.int32() if isinstance(v, int) else pa.string() for v in values]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[f"c{i}" for i in range(len(values))])

        for batch in batches:
            for *keys, shape, tree in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None and keys != held:
                    yield done()
                    shapes = {}
                held = keys
                tree = _load(json.loads(tree))
                shapes[shape] = joined(shapes[shape], tree) if shape in shapes else tree
        if shapes:
            yield done()

    return each


def _pages(root: list) -> int:
    stack, most = [root], 0
    while stack:
        one = stack.pop()
        if one[0] == SLOT:
            most = max(most, one[2][0])
        else:
            stack += one[2]
    return most


def wrappers(pages: DataFrame) -> DataFrame:
    """One row per host: its wrapper as an expression, and the labelled wrapper as JSON."""
    n = n_partitions(pages)
    parts = structures(pages).repartition(n, "host", "bucket").sortWithinPartitions("host", "bucket", "shape")
    partial = parts.mapInArrow(_merged_by(2, lambda w: [json.dumps(_dump(w, []))]), "host string, bucket int, tree string")
    whole = partial.select("host", F.format_string("%04d", "bucket").alias("shape"), "tree").repartition(n, "host").sortWithinPartitions("host", "shape")
    return whole.mapInArrow(_merged_by(1, lambda w: [expression(w), json.dumps(_dump(label(w), []))]), "host string, wrapper string, labels string")


@lru_cache(maxsize=2048)
def _labels(text: str | None) -> list | None:
    return _load(json.loads(text)) if text else None


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text."""
    found = cut(wrappers(pages)).select("host", "labels")
    known = _with_host(pages).join(maybe_broadcast(found), "host", "left")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _deep()
        for batch in batches:
            texts = [main_text(Page(h.as_py() or ""), _labels(of_host.as_py())) for h, of_host in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return known.select("page_id", "url", "html", "labels").mapInArrow(each, f"page_id {kind}, url string, text string")

"""Alignment of the tokens of two tokenizers over the same bytes (operator 12).

Each text, a space before it, is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B).  Their tokens
are byte strings, so their cumulative lengths are ends in one row of bytes.  A merge of the two rows of ends, inside
``mapInArrow``, cuts the tokens into groups at the ends that both have; the tokens that end there are linked.  Pairs
of ids are counted within their document first; Spark adds the counts up over the corpus, finds the highest count of
each id on either side, and joins both back to the documents' links.

A text is cut at single spaces between characters that are no white space.  Neither vocabulary has a token over such
a place (checked for B; A's own splitting begins a word there), so both have an end there, and groups never reach over it.  Each
distinct piece between two cuts is encoded and merged once, and remembered within a bound; a text is the sum of its
pieces.  Texts with other white space side by side, or at an end, are one piece.

Links are written once, as Parquet in the shared folder, and read twice: to count pairs, and to meet the counts.  The
most frequent pairs (at most ``PAIRS``, a few MB) are broadcast; the links of all others meet the rest of the table by
a shuffle.  A pair has one row in a document, however often it occurs, so a hot pair has at most one row a document.

Defined cases: null and empty texts have no tokens, and neither have texts whose A or B bytes, joined, are not the
space and the text; all their counts are 0 and their groups are empty.  Repeated rows and ids are kept apart, each with its own
row, and all of their links count.  An empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import shared_dir

#: Pairs that are broadcast: 2^18 rows of three numbers and two marks.
PAIRS = 1 << 18
#: Characters of texts encoded at a time.
_CHARS = 4 << 20
#: Pieces of text that a worker remembers before it starts anew (about 80 MB).
REMEMBERED = 1 << 18

_WIDE = re.compile(r"\s\s").search


def _byte_of() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """A byte-level vocabulary (a ``.json`` file) and the bytes of its tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.model.no_truncation()
        self.model.no_padding()
        # words begin at spaces only where this is the only splitting, and nothing rewrites the text before
        self.splits_words = self.model.normalizer is None and type(self.model.pre_tokenizer).__name__ == "ByteLevel" and getattr(self.model.pre_tokenizer, "use_regex", True)
        added = {i: token.content for i, token in self.model.get_added_tokens_decoder().items()}
        byte_of = _byte_of()
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for text, i in vocabulary.items():
            self.pieces[i] = added[i].encode() if i in added else bytes(byte_of[c] for c in text)

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A piece vocabulary (a ``.model`` file), which puts a space before each text itself, and the bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(t[3:5], 16)]) if self.model.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(texts)]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Both vocabularies, in a worker, and the pieces of text it has merged."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.len_a, self.len_b = (np.array([len(p) for p in side.pieces], np.int64) for side in (self.a, self.b))
        # a token of B over a space, or a splitting of A that is not byte-level's, would make cuts wrong
        self.cuts = self.a.splits_words and not any(b" " in p.lstrip(b" ") for p in self.b.pieces)
        # a token and what follows it in the written groups
        self.n_a, self.n_b = len(self.len_a), len(self.len_b)
        self.written = [f"{i}{mark}" for n, marks in ((self.n_a, ",|"), (self.n_b, ",;")) for mark in marks for i in range(n)]
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes = np.zeros((4, 0), np.int64)  # A tokens, B tokens, links (-1: bytes differ), first link
        self.links = np.zeros(0, np.int64)

    def pieces_of(self, text: str) -> list[str]:
        if not self.cuts or _WIDE(" " + text) or text[-1].isspace():
            return [text]
        return text.split(" ")

    def __call__(self, texts: list[str]) -> Iterator[tuple]:
        split = [self.pieces_of(t) if t else [] for t in texts]
        fresh = {p for pieces in split for p in pieces if p not in self.at}
        if len(self.at) + len(fresh) > REMEMBERED:
            self.forget()
            fresh = {p for pieces in split for p in pieces}
        # texts that are one piece may hold any white space: they are read alone
        single = {pieces[0] for pieces in split if len(pieces) == 1} & fresh
        together = sorted(fresh - single)
        for at in range(0, len(together), 1 << 13):
            self.learn(together[at : at + (1 << 13)])
        for text in sorted(single):
            self.learn([text])
        for pieces in split:
            at = np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))
            n_a, n_b, n, first = self.sizes[:, at]
            if not pieces or (n < 0).any():
                yield 0, 0, 0, 0, "", [], [], []
                continue
            total = int(n.sum())
            pairs, occurs = np.unique(self.links[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(total)], return_counts=True)
            yield int(n_a.sum()), int(n_b.sum()), total, total, ";".join(map(self.groups.__getitem__, at.tolist())), pairs >> 32, pairs & 0xFFFFFFFF, occurs

    def learn(self, pieces: list[str]) -> None:
        """Merges the ends of a text of these pieces; where its bytes differ, those of its halves, down to the piece that is to blame."""
        text = " ".join(pieces)
        (a,), (b,), whole = self.a([text]), self.b([text]), b" " + text.encode()
        a_bytes, b_bytes = b"".join([self.a.pieces[i] for i in a]), b"".join([self.b.pieces[i] for i in b])
        if a_bytes != whole or b_bytes != whole:
            if len(pieces) > 1:
                self.learn(pieces[: len(pieces) // 2])
                self.learn(pieces[len(pieces) // 2 :])
            else:
                self.keep(pieces, [""], np.array([[0], [0], [-1]]), self.links[:0])
            return
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends = np.cumsum([len(p.encode()) + 1 for p in pieces])
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        met = np.searchsorted(ends_b, ends_a)  # no A token ends behind the last B token
        last_a = ends_b[met] == ends_a
        last_b = np.zeros(len(b), bool)
        last_b[met[last_a]] = True
        before_a, before_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b  # groups closed before a token
        size_a, size_b = np.bincount(before_a), np.bincount(before_b)
        # the A tokens of a group, then its B tokens
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + (np.cumsum(size_b) - size_b)[before_a]] = a + last_a * self.n_a
        order[np.arange(len(b)) + np.cumsum(size_a)[before_b]] = 2 * self.n_a + b + last_b * self.n_b
        tokens = list(map(self.written.__getitem__, order.tolist()))
        upto_a, upto_b, upto = (np.searchsorted(x, ends, "right") for x in (ends_a, ends_b, ends_a[last_a]))
        if not (ends_a[last_a][upto - 1] == ends).all():
            raise ValueError("a token reaches over a cut")
        stops = (upto_a + upto_b).tolist()
        groups = ["".join(tokens[i:k])[:-1] for i, k in zip([0, *stops], stops)]
        self.keep(pieces, groups, np.array([np.diff(x, prepend=0) for x in (upto_a, upto_b, upto)]), (a[last_a] << 32) | b[last_b])

    def keep(self, pieces: list[str], groups: list[str], sizes: np.ndarray, links: np.ndarray) -> None:
        self.at.update(zip(pieces, range(len(self.groups), len(self.groups) + len(pieces))))
        self.groups += groups
        first = len(self.links) + np.cumsum(sizes[2]) - sizes[2]
        self.sizes = np.concatenate((self.sizes, np.vstack((sizes, first))), axis=1)
        self.links = np.concatenate((self.links, links))


_aligners: dict[tuple[str, str], Aligner] = {}


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``row`` (a number of its own), n_a, n_b, n_groups, n_links, ``groups`` as text (``a1,a2|b1;a3|b2``),
    and the distinct linked pairs with their occurrences (``link_a``, ``link_b``, ``link_n``).

    The vocabulary files must exist on every worker.
    """
    names = ["n_a", "n_b", "n_groups", "n_links", "groups", "link_a", "link_b", "link_n"]
    ints = pa.list_(pa.int32())
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), ints, ints, ints]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path_a, path_b) not in _aligners:
            _aligners[path_a, path_b] = Aligner(path_a, path_b)
        aligner = _aligners[path_a, path_b]
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= _CHARS):
                    chars += len(texts[end])
                    end += 1
                found = list(zip(*aligner(texts[at:end])))
                columns = [pa.array(values, kind) for values, kind in zip(found, kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), *columns], names=[id_col, "row", *names])
                at = end

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("row"), F.col(text_col))
    longs = ", ".join(f"{n} long" for n in names[:4])
    return rows.mapInArrow(each, f"`{id_col}` {kind}, row long, {longs}, groups string, link_a array<int>, link_b array<int>, link_n array<int>")


def links(aligned: DataFrame) -> DataFrame:
    """One row for each distinct pair of a document: row, a, b, n."""
    return aligned.select("row", F.inline(F.arrays_zip("link_a", "link_b", "link_n"))).toDF("row", "a", "b", "n")


def pair_counts(linked: DataFrame) -> DataFrame:
    """Per pair of ids: its count over all links, and whether that is the highest of its A id and of its B id, ties included."""
    pairs = linked.groupBy("a", "b").agg(F.sum("n").alias("n_pair"))
    top_a, top_b = pairs.groupBy("a").agg(F.max("n_pair").alias("top_a")), pairs.groupBy("b").agg(F.max("n_pair").alias("top_b"))
    met = pairs.join(top_a, "a").join(top_b, "b")
    return met.select("a", "b", "n_pair", (F.col("n_pair") == F.col("top_a")).alias("best_a"), (F.col("n_pair") == F.col("top_b")).alias("best_b"))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet into the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def with_counts(aligned: DataFrame) -> DataFrame:
    """Rows of ``align`` (any more columns stay, the links go) with, summed over each row's links: count_sum (corpus-wide counts of
    their pairs), n_best and n_best_a (links whose pair is the most frequent of its B id, of its A id)."""
    table = written(aligned, "alignment")
    pairs = written(pair_counts(links(table)), "pairs")
    level = F.floor(F.log2("n_pair") * 8).cast("int")  # a few hundred levels
    total, least = 0, None
    levels = pairs.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    for at, n in levels:
        total += n
        if total > PAIRS:
            break
        least = at
    frequent = F.lit(False) if least is None else level >= least

    def summed(met: DataFrame) -> DataFrame:
        best = [F.sum(F.when(F.col(side), F.col("n")).otherwise(0)).alias(name) for side, name in (("best_b", "n_best"), ("best_a", "n_best_a"))]
        return met.groupBy("row").agg(F.sum(F.col("n") * F.col("n_pair")).alias("count_sum"), *best)

    sums = summed(links(table).join(F.broadcast(pairs.filter(frequent)), ["a", "b"]))  # at most PAIRS rows
    if total > PAIRS:
        seldom = links(table).join(F.broadcast(pairs.filter(frequent).select("a", "b")), ["a", "b"], "left_anti")
        rest = summed(seldom.join(pairs.filter(~frequent), ["a", "b"]))
        sums = sums.unionByName(rest).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("count_sum", "n_best", "n_best_a")))
    kept = table.drop("link_a", "link_b", "link_n").join(sums, "row", "left")
    return kept.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("count_sum", "n_best", "n_best_a")}).drop("row")

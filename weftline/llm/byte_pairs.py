"""Byte-level BPE encoding and decoding by Spark's higher-order functions (operator 11).

A rank file gives each token's bytes a rank, which is also its id.  A text is split by a pattern into words; of all
neighbouring pieces of a word whose joined bytes have a rank those of the lowest rank, leftmost first, are joined
until no neighbours have one.  A word that is a token as it stands is that token.

* The merges of a word are one ``aggregate``.  Its state is a string: a piece is one character, and between two
  pieces stands the character of their joint rank.  A step finds the least rank, puts the joined piece in place and
  looks the two pairs beside it up again.  Characters of ranks lie below
  those of pieces, so the least character of the state is the least rank.
* The ranks are a literal.  Spark searches a map from its start, so it is an array of short strings of entries, and
  the hash of a pair says in which one it is.
* Words of more than ``LONG`` bytes join a pair at all of its places in one step, unless the piece it becomes could
  rank lower with a neighbour or the pair could overlap another of its rank; then the leftmost alone.  Both ways give
  the same pieces.
* The distinct words of the corpus are counted, and the frequent ones (at most ``WORDS`` words and ``WORD_TOTAL``
  bytes: a fixed bound for what is broadcast) are folded once each.  Texts are written by Arrow batches with that
  dictionary; a word that it lacks is folded in its row, by the same expression.  No text is shuffled, and what the
  dictionary holds bears on time only.
* Decoding looks up the bytes of each id and joins them, by Arrow batches.

Defined cases: a null text counts as empty; an empty text has no tokens and decodes to no bytes; repeated rows are
encoded alike; an empty table gives no rows; other columns stay, but one with the name of a result column is replaced.
An id that the file lacks makes the decoded bytes null.
"""

from __future__ import annotations

import base64
import uuid
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from weftline.llm.common import cut, let

#: Words of more bytes than this take all places of a pair in one step.
LONG = 48
#: Bounds of the dictionary: words, bytes of one, bytes of all.
WORDS, WORD_BYTES, WORD_TOTAL = 1 << 20, 48, 16 << 20
#: Pieces of text, distinct in a portion, that a task gathers before it adds them up; half as many distinct ones are passed on.
COUNTED = 3 << 19
#: Bytes of texts that are counted or decoded at a time, and that are written at a time: larger portions repeat fewer pieces.
_CHARS, _WRITTEN = 4 << 20, 8 << 20
#: What may be white space, in Arrow's spelling: texts with two of it in a row are split by the slower way, which holds for all.
_WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

_RANK, _PIECE = 0x10000, 0x20000  # first characters of ranks and of pieces; ids stay below their distance
_NONE, _END = chr(0x1FFFF), chr(0x10FFFF)
_MISSING = "_"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (read on the driver)."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in lines}


class Buckets:
    """A literal from pairs of pieces to their ranks, as an array of strings: the hash of a pair says which one may hold it.

    A string begins with what holds for a pair that it lacks, and its entries are set apart by a character that is in
    none.  As one flat array it is cheap to send and to read with every task, which maps are not.
    """

    def __init__(self, entries: dict[str, str]):
        size = 1 << max(4, len(entries).bit_length() - 1)
        parts = [_NONE] * size
        for pair, value in entries.items():
            parts[xxhash.xxh64_intdigest(pair.encode(), 42) & (size - 1)] += f";{pair}{value}"
        self.mask = size - 1
        self.column = F.split(F.lit(",".join(parts)), ",")  # folded when the query is planned

    def at(self, buckets: Column, pair: Column) -> Column:
        """Rank of a pair in ``buckets``, the bound literal; ``_NONE`` where it has none."""
        bucket = F.get(buckets, F.xxhash64(pair).bitwiseAND(F.lit(self.mask)).cast("int"))
        return F.left(F.call_function("substring_index", bucket, pair, F.lit(-1)), F.lit(1))


class Coder:
    """Encoding and decoding by one rank file and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing or max(ranks.values()) >= _PIECE - _RANK - 1:
            raise ValueError(f"ranks must cover all single bytes ({missing[:5]}) and stay below {_PIECE - _RANK - 1}")
        # Rust's white space, whatever Python's is
        self.pattern = pattern.replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}")
        pairs: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left, right] = rank
        lefts, rights = {(rank, left) for (left, _), rank in pairs.items()}, {(rank, right) for (_, right), rank in pairs.items()}
        # a joined piece that may rank lower beside another, or whose pairs of several cuts can overlap
        alone = {part for pair, rank in pairs.items() for part in pair if rank < part}
        alone |= {rank for rank, piece in lefts & rights if (piece, piece) not in pairs or pairs[piece, piece] != rank}
        self.pairs = Buckets({chr(_PIECE + a) + chr(_PIECE + b): chr(_RANK + rank) for (a, b), rank in pairs.items()})
        self.whole = {token: rank for token, rank in ranks.items()}
        self.alone = F.split(F.lit(",".join("1" if i in alone else "0" for i in range(max(ranks.values()) + 1))), ",")
        self.joined = F.split(F.lit(",".join(chr(_PIECE + i) for i in range(max(ranks.values()) + 1))), ",")
        self.bytes = "".join(chr(b) for b in range(256)), "".join(chr(_PIECE + ranks[bytes([b])]) for b in range(256))

    def _merged(self, pieces: Column, buckets: Column, joined: Column) -> Column:
        """Pieces of a word, one character each, after all merges one at a time."""

        def rank(pair: Column) -> Column:
            return self.pairs.at(buckets, pair)

        def step(state: Column, _: Column) -> Column:
            def with_joined(least: Column) -> Column:
                def put(k: Column, new: Column) -> Column:
                    # left piece, rank, right piece at k - 1 to k + 1; the pairs beside them from k - 3 to k + 3
                    beside = F.concat(rank(F.concat(F.substr(state, k - 3, F.lit(1)), new)), new, rank(F.concat(new, F.substr(state, k + 3, F.lit(1)))))
                    return F.overlay(state, beside, k - 2, F.lit(5))

                return let(F.instr(state, least), lambda k: let(F.get(joined, F.ascii(least) - _RANK), lambda new: put(k, new)))

            # a state that ends with the mark of no rank is done
            least_of = let(F.array_min(F.split(state, "")), lambda least: F.when(least == _NONE, F.concat(state, F.lit(_NONE))).otherwise(with_joined(least)))
            return F.when(F.endswith(state, F.lit(_NONE)), state).otherwise(least_of)

        def start(n: Column) -> Column:
            inner = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.substr(pieces, i, F.lit(1)), rank(F.substr(pieces, i, F.lit(2)))))
            state = F.concat(F.lit(_END + _NONE), F.array_join(inner, ""), F.substr(pieces, n, F.lit(1)), F.lit(_NONE + _END))
            return F.aggregate(inner, state, step)

        return let(F.length(pieces), lambda n: F.when(n < 2, pieces).otherwise(F.translate(start(n), _NONE + _END, "")))

    def _merged_long(self, pieces: Column, buckets: Column, joined: Column, alone: Column) -> Column:
        """The same for a long word, a pair at all of its places at a time."""

        def round_of(s: Column) -> Column:
            def put(p: Column, ranks: Column, least: Column) -> Column:
                def at(k: Column, rank: Column) -> Column:
                    single, new = F.get(alone, rank) == "1", F.get(joined, rank)
                    return F.when(single, F.overlay(s, new, k, F.lit(2))).otherwise(F.replace(s, F.concat(F.get(p, k - 1), F.get(p, k)), new))

                found = let(F.array_position(ranks, least).cast("int"), lambda k: let(F.ascii(least) - _RANK, lambda rank: at(k, rank)))
                return F.when(F.coalesce(least, F.lit(_NONE)) == _NONE, F.concat(s, F.lit(_END))).otherwise(found)

            return let(F.split(s, ""), lambda p: let(F.transform(p, lambda x, i: self.pairs.at(buckets, F.concat(x, F.get(p, i + 1)))), lambda r: let(F.array_min(r), lambda least: put(p, r, least))))

        # a state that ends with the end mark is done
        done = F.aggregate(F.split(pieces, ""), pieces, lambda s, _: F.when(F.endswith(s, F.lit(_END)), s).otherwise(round_of(s)))
        return F.translate(done, _END, "")

    def folded(self, words: Column) -> Column:
        """Ids, in decimal and joined by a space, of each of an array of words; a word that is a token is not looked for here."""

        def ids(word: Column, buckets: Column, joined: Column, alone: Column) -> Column:
            pieces = F.translate(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), *self.bytes)
            merged = let(pieces, lambda p: F.when(F.length(p) <= LONG, self._merged(p, buckets, joined)).otherwise(self._merged_long(p, buckets, joined, alone)))
            return F.array_join(F.transform(F.split(merged, ""), lambda c: (F.ascii(c) - _PIECE).cast("string")), " ")

        return let(self.pairs.column, lambda buckets: let(self.joined, lambda joined: let(self.alone, lambda alone: F.transform(words, lambda w: ids(w, buckets, joined, alone)))))


class Splitter:
    """Texts as pieces that can be read one by one, and their words.

    A space between two characters that are no white space begins a word, and no word reaches over it.  Line ends
    between such characters are words of their own.
    """

    def __init__(self, pattern: str):
        self.words = regex.compile(pattern).findall
        self.wide = regex.compile(r"\s\s").search
        self.cut = regex.compile(r"(?<=\S) (?=\S)").split

    def pieces(self, text: str) -> tuple[str, list[str]]:
        """The first piece as it stands, and the pieces behind a space or line end, the space left out."""
        split = self.cut(text) if self.wide(text) else text.replace("\n", " \n").split(" ")
        return split[0], split[1:]

    def words_of(self, piece: str) -> list[str]:
        return self.words(piece if piece[:1] == "\n" else " " + piece)

    def columns(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """The same for a column of texts (null: empty): first pieces, all other pieces, and how many of these each text has."""
        texts = texts.cast(pa.string()).fill_null("")
        wide = pc.match_substring_regex(texts, _WHITE + "{2}")
        parts = pc.split_pattern(pc.replace_substring(texts.filter(pc.invert(wide)), "\n", " \n"), " ")
        if any_wide := [[first, *rest] for first, rest in map(self.pieces, texts.filter(wide).to_pylist())]:
            mask = wide.to_numpy(zero_copy_only=False)
            place = np.empty(len(mask), np.int64)
            place[~mask], place[mask] = np.arange(len(parts)), len(parts) + np.arange(len(any_wide))
            parts = pa.concat_arrays([parts, pa.array(any_wide, parts.type)]).take(pa.array(place))
        n, flat = pc.list_value_length(parts).to_numpy().astype(np.int64), parts.flatten()
        first = np.zeros(len(flat), bool)
        first[np.cumsum(n) - n] = True
        return flat.filter(pa.array(first)), flat.filter(pa.array(~first)), n - 1

    def words_of_each(self, pieces: pa.Array) -> tuple[list[str], np.ndarray]:
        """Words of all pieces and the place of the piece that each is of, those of a piece in their order.

        Pieces without white space are read as one text, where a space begins each of them, and so are those of which
        it is a line end that begins them.
        """
        whites, sizes = pc.count_substring_regex(pieces, _WHITE).to_numpy(), pc.binary_length(pieces).to_numpy()
        plain = (whites == 0) & (sizes > 0)
        lines = (whites == 1) & (sizes > 1) & pc.starts_with(pieces, "\n").to_numpy(zero_copy_only=False)
        words, owners = [], [np.zeros(0, np.int64)]
        for chosen, mark, between in ((plain, " ", " "), (lines, "\n", "")):
            if len(own := np.flatnonzero(chosen)):
                found = self.words(between + pc.binary_join(_lists(np.array([len(own)]), pieces.take(pa.array(own))), between)[0].as_py())
                starts = pc.starts_with(pa.array(found, pa.string()), mark).to_numpy(zero_copy_only=False)
                if starts.sum() != len(own):
                    raise ValueError("by this pattern a space or line end between other characters does not always begin a word")
                words += found
                owners.append(own[np.cumsum(starts) - 1])
        for i in np.flatnonzero(~plain & ~lines).tolist():
            own = self.words_of(pieces[i].as_py())
            words += own
            owners.append(np.full(len(own), i))
        return words, np.concatenate(owners)


def _portions(column: pa.Array, size: int = _CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a column of strings, of at most ``size`` bytes each or one longer row.

    What Arrow holds in reserve goes back to the system after each: workers stay alive between tasks.
    """
    at, ends = 0, np.cumsum(pc.binary_length(column).fill_null(0).to_numpy().astype(np.int64))
    while at < len(ends):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield at, end
        pa.default_memory_pool().release_unused()
        at = end


def _lists(n: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Values in lists of ``n`` each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), values)


def _added_up(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("w", use_threads=False).aggregate([("n", "sum")]).rename_columns(["w", "n"])


def count_words(docs: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """Distinct words ``w`` of all texts and their counts ``n``: each task counts its own, Spark adds them up."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, pieces, heads = Splitter(pattern), [], Counter()

        def out() -> Iterator[pa.RecordBatch]:
            counted = _added_up(pieces)
            words, owners = splitter.words_of_each(counted.column("w").combine_chunks())
            own = pa.table({"w": pa.array(words, pa.string()), "n": counted.column("n").to_numpy()[owners]})
            first = pa.table({"w": pa.array(heads.keys(), pa.string()), "n": pa.array(heads.values(), pa.int64())})
            pieces.clear()
            heads.clear()
            yield from _added_up([own, first]).combine_chunks().to_batches()

        for batch in batches:
            for at, end in _portions(batch.column(0)):
                first, rest, _ = splitter.columns(batch.column(0).slice(at, end - at))
                for head in first.to_pylist():
                    heads.update(splitter.words(head))
                found = rest.value_counts()
                pieces.append(pa.table({"w": found.field("values"), "n": found.field("counts")}))
                if sum(map(len, pieces)) > COUNTED:
                    pieces[:] = [_added_up(pieces)]
                    if len(pieces[0]) > COUNTED // 2:
                        yield from out()
        if pieces:
            yield from out()
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(text_col)).mapInArrow(each, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, coder: Coder, text_col: str = "text") -> pa.Table:
    """Frequent distinct words of the corpus with their ids in decimal, within the bounds above."""
    counted = cut(count_words(docs, coder.pattern, text_col).filter((F.col("n") > 1) & (F.octet_length("w") <= WORD_BYTES)))
    level = F.floor(F.log2("n") * 8).cast("int")  # a few hundred levels, whatever the corpus
    rows, size, least = 0, 0, None
    for at, n, n_bytes in counted.groupBy(level.alias("level")).agg(F.count("*"), F.sum(F.octet_length("w"))).orderBy(F.desc("level")).collect():
        rows, size = rows + n, size + n_bytes
        if rows > WORDS or size > WORD_TOTAL:
            break
        least = at
    chosen = counted.filter(F.lit(False) if least is None else level >= least)
    return chosen.select("w", F.get(coder.folded(F.array("w")), F.lit(0)).alias("ids")).toArrow()


class Writer:
    """Texts as ids, in a worker: known words by the dictionary, places of the others marked.

    Each distinct piece of a portion of texts is written once; texts are put together from the places of their pieces.
    The dictionary, with the words that are tokens, stays in Arrow columns, found by the hash of a word and compared:
    a tenth of what a dict takes.
    """

    def __init__(self, table: pa.Table, whole: dict[bytes, int], pattern: str):
        tokens = {}
        for token, rank in whole.items():
            try:
                tokens[token.decode()] = str(rank)
            except UnicodeDecodeError:
                pass  # no text on its own
        names = pa.array(tokens.keys(), pa.string())
        table = table.filter(pc.invert(pc.is_in(table.column("w"), value_set=names))).combine_chunks()
        self.known = pa.concat_arrays([names, *table.column("w").chunks])
        # the last one stands for a word that is lacking
        self.ids = pa.concat_arrays([pa.array(tokens.values(), pa.string()), *table.column("ids").chunks, pa.array([_MISSING], pa.string())])
        parts = (self.known.slice(at, 1 << 16).to_numpy(zero_copy_only=False) for at in range(0, len(self.known), 1 << 16))
        hashes = np.concatenate([_hashes(part) for part in parts])
        self.order = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.order]
        self.splitter = Splitter(pattern)

    def find(self, words: list[str]) -> np.ndarray:
        """Places of words in the dictionary; that of the lacking mark for those that it lacks."""
        hashes = _hashes(words)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        rows = self.order[at]
        same = pc.equal(self.known.take(pa.array(rows)), pa.array(words, pa.string())).to_numpy(zero_copy_only=False)
        return np.where(same, rows, len(self.known))

    def __call__(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Per text its ids joined by a space, with a mark for each word that is to be folded, and these words."""
        heads, rest, n_rest = self.splitter.columns(texts)
        coded = rest.dictionary_encode()
        n_distinct = len(coded.dictionary)
        words, owners = self.splitter.words_of_each(coded.dictionary)
        # what is written once: the distinct pieces, then the first piece of each text
        of_heads = [self.splitter.words(head) for head in heads.to_pylist()]
        words += [w for own in of_heads for w in own]
        owners = np.concatenate((owners, np.repeat(n_distinct + np.arange(len(of_heads)), [len(own) for own in of_heads])))
        by_owner = np.argsort(owners, kind="stable")
        n = np.bincount(owners, minlength=n_distinct + len(of_heads))
        rows = self.find(words)[by_owner]
        written = pc.binary_join(_lists(n, self.ids.take(pa.array(rows))), " ")
        lacks: dict[int, list[str]] = {}
        for k in by_owner[rows == len(self.known)].tolist():
            lacks.setdefault(int(owners[k]), []).append(words[k])
        # texts by the places of what they are made of; an empty first piece is none
        begun = n[n_distinct:] > 0
        first = np.cumsum(n_rest) - n_rest
        places = np.insert(coded.indices.to_numpy().astype(np.int64), first[begun], n_distinct + np.flatnonzero(begun))
        sizes = n_rest + begun
        ids = pc.binary_join(_lists(sizes, written.take(pa.array(places))), " ")
        lacked = np.zeros(len(n), np.int64)
        lacked[list(lacks)] = [len(own) for own in lacks.values()]
        sums = np.concatenate(([0], np.cumsum(lacked[places])))[np.concatenate(([0], np.cumsum(sizes)))]
        missing = [w for piece in places[lacked[places] > 0].tolist() for w in lacks[piece]]
        return ids, _lists(np.diff(sums), pa.array(missing, pa.string()))


def _hashes(words: list[str] | np.ndarray) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


_writers: dict[str, Writer] = {}


def encode(docs: DataFrame, coder: Coder, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds ``ids_col``: the token ids of each whole text in decimal, joined by one space."""
    docs = docs.drop(ids_col)
    shared = docs.sparkSession.sparkContext.broadcast((dictionary(docs, coder, text_col), coder.whole, coder.pattern))
    name, place = uuid.uuid4().hex, docs.columns.index(text_col)
    kinds = StructType([*docs.schema.fields, StructField("__ids", StringType()), StructField("__lacking", ArrayType(StringType()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _writers:
            _writers.clear()
            _writers[name] = Writer(*shared.value)
        writer = _writers[name]
        for batch in batches:
            for at, end in _portions(batch.column(place), _WRITTEN):
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*part.columns, *writer(part.column(place))], names=[*batch.schema.names, "__ids", "__lacking"])

    marked = docs.mapInArrow(each, kinds)
    # a mark stands at the place of each word that was folded here
    filled = F.array_join(F.zip_with(F.split("__ids", _MISSING), coder.folded(F.col("__lacking")), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return marked.withColumn(ids_col, F.when(F.size("__lacking") == 0, F.col("__ids")).otherwise(filled)).drop("__ids", "__lacking")


def n_ids(ids: Column) -> Column:
    """How many ids: one more than the spaces between them."""
    spaces = F.octet_length(ids) - F.octet_length(F.replace(ids, F.lit(" "), F.lit("")))
    return F.when(ids == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def decode(rows: DataFrame, coder: Coder, ids_col: str = "ids", bytes_col: str = "bytes") -> DataFrame:
    """Adds ``bytes_col``: the bytes of ids in decimal, joined by Arrow batches; null where the file lacks an id."""
    rows = rows.drop(bytes_col)
    shared = rows.sparkSession.sparkContext.broadcast(coder.whole)
    place = rows.columns.index(ids_col)
    kinds = StructType([*rows.schema.fields, StructField(bytes_col, BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(map(str, shared.value.values()), pa.string())
        tokens = pa.array(shared.value.keys(), pa.binary())
        for batch in batches:
            for at, end in _portions(batch.column(place)):
                part = batch.slice(at, end - at)
                ids = part.column(place).cast(pa.string())
                lists = pc.split_pattern(ids, " ")
                # a list with an id without a token gives null
                joined = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, tokens.take(pc.index_in(lists.values, value_set=names))), b"")
                joined = pc.if_else(pc.equal(ids, ""), pa.scalar(b"", pa.binary()), pc.if_else(ids.is_valid(), joined, pa.scalar(None, pa.binary())))
                yield pa.RecordBatch.from_arrays([*part.columns, joined], names=[*batch.schema.names, bytes_col])

    return rows.mapInArrow(each, kinds)

"""Token counts by rank-synchronous merging (operator 5).

A byte-pair vocabulary merges, in each pre-token, the adjacent pair of lowest rank (the leftmost if it occurs
again) until none is left.  Pre-tokens are independent, so all of a batch lie one behind another in a flat
array, and in each round every sequence applies its own best pair at the same time; sequences without a pair
leave the array and give the number of symbols that survive.  Only the two pairs beside a merge are looked up
again.

Pre-tokens are words with the space before them, split further between characters that never stand side by
side in a piece.  Each distinct word is counted once and remembered, within a bound.  A character that no piece
covers counts as its UTF-8 bytes (byte fallback).  In sequences of more than ``LONG`` symbols a round takes all
places of the best pair at once, not the leftmost alone, and touches no others, so rounds are as many as the
different pairs that merge.  Where a merge makes a pair that ranks before its own, that one goes first, and the
places behind it wait.

Defined cases: a null text counts as empty, an empty text has no tokens; repeated rows count alike; an empty
table gives no rows; other columns are ignored, but for the ids that are asked for.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
LONG = 4096
#: Distinct words that a worker remembers before it starts anew (about 100 MB).
REMEMBERED = 700_000
_NONE = np.iinfo(np.int64).max
_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Merges:
    """Tables of a piece vocabulary: symbols of characters, ranks and results of pairs."""

    def __init__(self, pieces: list[tuple[str, float]]):
        """``pieces``: text and score of the ordinary pieces; a higher score merges first."""
        order = sorted(pieces, key=lambda p: -p[1])
        ids = {text: i for i, (text, _) in enumerate(order)}
        self.known = len(ids)
        for text, _ in order:
            for c in text:
                ids.setdefault(c, len(ids))  # stands in pieces but is none
        pairs, beside = {}, set()
        for rank, (text, _) in enumerate(order):
            for k in range(1, len(text)):
                beside.add((ord(text[k - 1]) << 21) | ord(text[k]))
                left, right = ids.get(text[:k]), ids.get(text[k:])
                if left is not None and right is not None:
                    pairs[(left << 24) | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.beside = np.array(sorted(beside), np.int64)
        self.symbol = np.full(0x110000, -1, np.int32)
        for text, i in ids.items():
            if len(text) == 1:
                self.symbol[ord(text)] = i

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, which is also the symbol it becomes."""
        key = (left.astype(np.int64) << 24) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], _NONE) if len(self.keys) else np.full(len(key), _NONE)

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        if not words:
            return np.zeros(0, np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        length = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), length)
        # symbols that are no piece count as bytes
        width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        symbol = self.symbol[code]
        last = np.zeros(len(code), bool)
        last[np.cumsum(length)[length > 0] - 1] = True
        both = (code[:-1] << 21) | code[1:]
        at = np.searchsorted(self.beside, both)
        at[at == len(self.beside)] = 0
        last[:-1] |= (self.beside[at] != both) if len(self.beside) else True
        total = np.zeros(len(words), np.int64)
        alone = last & np.concatenate(([True], last[:-1]))
        weight = np.where((symbol >= 0) & (symbol < self.known), 1, width)
        np.add.at(total, word[alone], weight[alone])
        rest = ~alone
        symbol, word, last, width = symbol[rest], word[rest], last[rest], width[rest]
        first = np.flatnonzero(np.concatenate(([True], last[:-1]))) if len(last) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate((first, [len(symbol)])))
        if (size > LONG).any():
            long = np.repeat(size > LONG, size)
            self._ranks(symbol[long], word[long], last[long], width[long], total)
            symbol, word, last, width = symbol[~long], word[~long], last[~long], width[~long]
        self._rounds(symbol, word, last, width, total)
        return total

    def _rounds(self, symbol, word, last, width, total) -> None:
        rank = np.full(len(symbol), _NONE)
        if len(symbol):
            rank[:-1] = np.where(last[:-1], _NONE, self.rank(symbol[:-1], symbol[1:]))
        while len(symbol):
            first = np.flatnonzero(np.concatenate(([True], last[:-1])))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.concatenate((first, [len(symbol)])))
            # the leftmost place of the best rank
            is_best = np.flatnonzero(rank == np.repeat(best, size))
            sequence = np.repeat(np.arange(len(first)), size)[is_best]
            lead = np.concatenate(([True], sequence[1:] != sequence[:-1]))
            place = is_best[lead]
            done = best == _NONE
            if done.any():
                over = np.repeat(done, size)
                weight = np.where((symbol[over] >= 0) & (symbol[over] < self.known), 1, width[over])
                np.add.at(total, word[over], weight)
                place = place[~done]
            else:
                over = np.zeros(len(symbol), bool)
            symbol[place] = rank[place]
            last[place] = last[place + 1]
            over[place + 1] = True
            keep = ~over
            new = np.cumsum(keep) - 1
            symbol, word, last, width, rank, place = symbol[keep], word[keep], last[keep], width[keep], rank[keep], new[place]
            if not len(place):
                continue
            after = np.minimum(place + 1, len(symbol) - 1)
            rank[place] = np.where(last[place], _NONE, self.rank(symbol[place], symbol[after]))
            before = place - 1
            before = before[(before >= 0)]
            before = before[~last[before]]
            rank[before] = self.rank(symbol[before], symbol[before + 1])

    def _ranks(self, symbol, word, last, width, total) -> None:
        """Rank after rank, each at all of its places in all sequences; the arrays keep their length and are linked."""
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n)
        rank, left = np.full(n, _NONE), np.ones(n, bool)
        ranks: list[int] = []
        waiting: dict[int, list[np.ndarray]] = {}

        def offer(places: np.ndarray) -> None:
            places = places[~last[places]]
            rank[places] = self.rank(symbol[places], symbol[after[places]])
            places = places[rank[places] != _NONE]
            places = places[np.argsort(rank[places], kind="stable")]
            found, starts = np.unique(rank[places], return_index=True)
            for r, part in zip(found.tolist(), np.split(places, starts[1:])):
                if r not in waiting:
                    heapq.heappush(ranks, r)
                waiting.setdefault(r, []).append(part)

        offer(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            place = np.unique(np.concatenate(waiting.pop(r)))
            place = place[rank[place] == r]
            if not len(place):
                continue
            every = place
            # of places one behind another every second: a merge uses up the symbol after it
            k = np.arange(len(place))
            follows = np.concatenate(([False], after[place[:-1]] == place[1:]))
            place = place[(k - np.maximum.accumulate(np.where(follows, 0, k))) % 2 == 0]
            used, prior = after[place], before[place]
            same, behind = np.full(len(place), r), np.minimum(after[used], n - 1)
            merged = np.concatenate(([False], prior[1:] == used[:-1]))
            leftward = np.where(last[prior], _NONE, self.rank(np.where(merged, r, symbol[prior]), same))
            rightward = np.where(last[used], _NONE, self.rank(same, symbol[behind]))
            sooner = np.minimum(leftward, rightward) < r
            if sooner.any():
                # in each word up to the first place whose merge makes a better pair
                gone = np.cumsum(sooner) - sooner
                start = np.maximum.accumulate(np.where(np.concatenate(([True], word[place[1:]] != word[place[:-1]])), k[: len(place)], 0))
                fits = gone == gone[start]
                place, used = place[fits], used[fits]
                waiting[r] = [every]
                heapq.heappush(ranks, r)
            symbol[place], last[place], left[used], rank[used] = r, last[used], False, _NONE
            after[place] = after[used]
            before[after[place]] = place
            rank[place] = _NONE
            offer(np.union1d(place, before[place][before[place] >= 0]))
        weight = np.where((symbol >= 0) & (symbol < self.known), 1, width)
        np.add.at(total, word[left], weight[left])


class Counter:
    """Counts whole texts as a SentencePiece model with a space before each text does."""

    def __init__(self, merges: Merges):
        self.merges, self.seen = merges, {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        split = [self._words(t) for t in texts]
        fresh = list({w for words in split for w in words if w not in self.seen})
        if len(self.seen) + len(fresh) > REMEMBERED:
            self.seen = {}
            fresh = list({w for words in split for w in words})
        for at in range(0, len(fresh), 1 << 16):
            part = fresh[at : at + (1 << 16)]
            self.seen.update(zip(part, self.merges.count([SPACE + w if w[:1] != SPACE else w for w in part]).tolist()))
        get = self.seen.__getitem__
        return np.array([sum(map(get, words)) for words in split], np.int64)

    @staticmethod
    def _words(text: str) -> list[str]:
        """Words without the space before them; words behind several spaces carry all of theirs."""
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return [w[1:] if w[1:2] not in ("", SPACE) else w for w in _RUNS.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")


_counters: dict[str, Counter] = {}


def piece_counter(model_file: str) -> Counter:
    """Counter of a SentencePiece BPE model, one in each worker."""
    if model_file not in _counters:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        ordinary = [i for i in range(model.get_piece_size()) if not any(is_kind(i) for is_kind in special)]
        _counters[model_file] = Counter(Merges([(model.id_to_piece(i), model.get_score(i)) for i in ordinary]))
    return _counters[model_file]


#: Characters of texts counted at a time.
_CHARS = 4 << 20


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, n_bytes (UTF-8) and n_tokens.  ``model_file`` must exist on every worker."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(model_file)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found, at = [], 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= _CHARS):
                    chars += len(texts[end])
                    end += 1
                found.append(counter(texts[at:end]))
                at = end
            n_tokens = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_tokens)], names=[id_col, "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col), n_bytes.alias("n_bytes")).mapInArrow(each, f"`{id_col}` {kind}, n_bytes long, n_tokens long")

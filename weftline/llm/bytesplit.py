"""Words and rolling hashes of whole Arrow string columns, computed on their UTF-8 bytes with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at a time: bounds the working memory (about 60 bytes each) whatever the texts' lengths.
BLOCK = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i below n."""
    if len(_tables.get("up", ())) < n:
        for name, base in (("up", _P), ("down", _P_INV)):
            steps = np.full(max(n, BLOCK + 1), base, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"][:n], _tables["down"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[i] = sum over j < i of (data[j] + 1) P^j, modulo 2^64."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values of a string column and the offset at which each value starts (null: empty)."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``size`` bytes, or of one longer row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


class Words:
    """Words of a block of rows: hash, row within the batch, position within its row."""

    def __init__(self, hashes: np.ndarray, rows: np.ndarray, places: np.ndarray):
        self.hashes, self.rows, self.places = hashes, rows, places


def words(column: pa.Array, fold: np.ndarray, is_word: np.ndarray) -> Iterator[Words]:
    """Hashed words of a string column; ``fold`` maps bytes, ``is_word`` tells word bytes (after folding)."""
    data, offsets = utf8(column)
    for first, last in blocks(offsets):
        at, end, base = int(offsets[first]), int(offsets[last]), 0
        while at < end or base == 0:
            stop = end
            if end - at > 2 * BLOCK:  # one long row: cut it between words
                inside = is_word[fold[data[at : at + 2 * BLOCK]]]
                gaps = np.flatnonzero(~inside)
                stop = at + int(gaps[-1]) + 1 if len(gaps) else end
            piece = fold[data[at:stop]]
            starts = np.minimum(offsets[first : last + 1], stop) - at if last > first + 1 else np.array([0, stop - at])
            found = _block_words(piece, np.maximum(starts, 0), is_word)
            found.rows += first
            if last == first + 1:
                found.places += base
                base += len(found.places)
            yield found
            at = stop
            if at >= end:
                break


def _block_words(piece: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> Words:
    inside = is_word[piece]
    edge = np.zeros(len(piece) + 1, bool)
    edge[bounds] = True  # a row begins here: words never cross it
    before = np.zeros(len(piece), bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(piece), bool)
    after[:-1] = inside[1:]
    stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
    sums = prefix_sums(piece)
    _, down = powers(len(piece) + 1)
    hashes = mix64((sums[stop] - sums[start]) * down[start])
    rows = np.searchsorted(bounds, start, side="right") - 1
    first = np.searchsorted(start, bounds[:-1], side="left")
    return Words(hashes, rows, np.arange(len(start)) - first[rows])

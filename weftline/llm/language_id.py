"""Language identification with string kernels (operator 9).

The blended spectrum of a text is the set of its byte n-grams of one to four bytes, after folding A-Z and
turning ASCII that is no letter into spaces.  The presence kernel of two texts is the number of n-grams they
share over the root of the product of their numbers.  Nyström landmarks stand for the training texts: with K
the kernel between texts and landmarks and S that among landmarks, the features are K S^(-1/2), on which a
one-versus-rest ridge regression is solved.

Only n-grams of the landmarks can count, so presence is a 0/1 vector over these (those that at least two landmarks
have), found by exact comparison: a text of any length sets only what it contains.  The kernel is a matrix product, and
a batch of texts is scored by one product with the landmarks folded into it: (X L') (S^(-1/2) W) = X (L' S^(-1/2) W).

The model is fitted on a sample of labelled texts: at most about ``PER_LANGUAGE`` of each language and ``LEARNED_BYTES``
in all, whatever the corpus size and however many languages; every text is scored whole.

Defined cases: a text that is null or has no letter gets ``und`` with score 0; repeated rows get equal results;
an empty table, or one without labelled rows, gives ``und`` throughout; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import bytesplit

PER_LANGUAGE = 600
#: Bytes of all learned texts together.
LEARNED_BYTES = 64 << 20
#: Longer texts are not learned from; all are scored.
LEARNED_TEXT_BYTES = 1 << 20
#: Landmarks of all languages together.
MAX_LANDMARKS = 256
RIDGE = 1e-3
N_GRAMS = (1, 2, 3, 4)
UNKNOWN = "und"
#: Slots of the table by which n-grams are looked up.
_TABLE_BITS = 20
#: Flags held at a time while scoring.
_FLAGS = 1 << 24

_FOLD = np.array([c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], np.uint8)


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """N-grams of texts given by their bytes, as (row, number): no folded byte is 0, so the number tells the length too."""
    longest = max(N_GRAMS)
    for at in range(0, len(data), bytesplit.BLOCK):
        # windows may begin in this stretch and end beyond it
        part = _FOLD[data[at : at + bytesplit.BLOCK + longest - 1]].astype(np.uint32)
        row = np.searchsorted(offsets, np.arange(at, at + len(part)), side="right") - 1
        gram = np.zeros(len(part), np.uint32)
        for n in N_GRAMS:
            ok = len(part) - n + 1
            if ok <= 0:
                break
            gram = (gram[:ok] << np.uint32(8)) | part[n - 1 : n - 1 + ok]
            inside = row[:ok] == row[n - 1 : n - 1 + ok]
            yield row[:ok][inside], gram[inside]


def _slot(gram: np.ndarray) -> np.ndarray:
    return (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - _TABLE_BITS)


class Vocabulary:
    """The n-grams that count.  Most are found by their slot in a table, those whose slot is taken by search."""

    def __init__(self, grams: np.ndarray):
        self.grams = np.unique(grams)
        slot = _slot(self.grams)
        first = np.unique(slot, return_index=True)[1]
        self.table = np.full(1 << _TABLE_BITS, len(self.grams), np.int32)
        self.table[slot[first]] = first
        self.known = np.append(self.grams, np.uint32(0))
        self.others = np.setdiff1d(np.arange(len(self.grams)), first)
        self.shared = np.zeros(1 << _TABLE_BITS, bool)
        self.shared[slot[self.others]] = True

    def __len__(self) -> int:
        return len(self.grams)

    def presence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows of flags, one column for each n-gram."""
        width = len(self) + 1
        out = np.zeros((len(offsets) - 1, width), bool)
        flat = out.ravel()
        for row, gram in _grams(data, offsets):
            slot = _slot(gram)
            found = self.table[slot]
            found[self.known[found] != gram] = len(self)
            if len(self.others):
                again = np.flatnonzero(self.shared[slot])
                at = np.minimum(np.searchsorted(self.grams[self.others], gram[again]), len(self.others) - 1)
                hit = self.grams[self.others[at]] == gram[again]
                found[again[hit]] = self.others[at[hit]]
            flat[row.astype(np.int64) * width + found] = True
        return out[:, :-1]


def _vocabulary(texts: list[str]) -> Vocabulary:
    """N-grams of at least two of the texts; of all if there are none such."""
    seen: dict[int, list[np.ndarray]] = {}
    data, offsets = bytesplit.utf8(pa.array(texts, pa.large_string()))
    for row, gram in _grams(data, offsets):
        pairs = np.unique((row.astype(np.uint64) << np.uint64(32)) | gram)
        seen.setdefault(0, []).append(pairs)
    pairs = np.unique(np.concatenate(seen[0])) if seen else np.zeros(0, np.uint64)
    grams, count = np.unique((pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32), return_counts=True)
    return Vocabulary(grams[count > 1] if (count > 1).any() else grams)


def _normed(flags: np.ndarray) -> np.ndarray:
    x = flags.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def _vectors(texts: list[str], vocabulary: Vocabulary) -> np.ndarray:
    return _normed(vocabulary.presence(*bytesplit.utf8(pa.array(texts, pa.large_string()))))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    vocabulary: Vocabulary
    #: One column per language, over the n-grams; the last row is the offset.
    weights: np.ndarray

    def scores(self, flags: np.ndarray) -> np.ndarray:
        return _normed(flags) @ self.weights[:-1] + self.weights[-1]


def fit(texts: list[str], languages: list[str]) -> Model:
    """Ridge regression on Nyström features of a few hundred texts."""
    names = sorted(set(languages))
    if not names:
        return Model([], Vocabulary(np.zeros(0, np.uint32)), np.zeros((1, 0), np.float32))
    y = np.array([[1.0 if lang == name else -1.0 for name in names] for lang in languages])
    each = max(2, MAX_LANDMARKS // len(names))
    chosen = [i for name in names for i in [i for i, lang in enumerate(languages) if lang == name][:each]]
    vocabulary = _vocabulary([texts[i] for i in chosen])
    landmarks = _vectors([texts[i] for i in chosen], vocabulary)
    among = (landmarks @ landmarks.T).astype(np.float64)
    value, vector = np.linalg.eigh(among)
    value = np.maximum(value, 1e-8)
    root = (vector / np.sqrt(value)) @ vector.T
    turned = np.ascontiguousarray(landmarks.T)
    z = np.concatenate([_vectors(texts[at : at + 64], vocabulary) @ turned for at in range(0, len(texts), 64)]).astype(np.float64) @ root
    centre, mean = z.mean(0), y.mean(0)
    gram = (z - centre).T @ (z - centre) / len(z)
    w = np.linalg.solve(gram + RIDGE * np.eye(len(gram)), (z - centre).T @ (y - mean) / len(z))
    folded = landmarks.T @ (root @ w).astype(np.float32)
    return Model(names, vocabulary, np.concatenate((folded, (mean - centre @ w)[None, :])).astype(np.float32))


def training_texts(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """A bounded sample of labelled rows of (doc_id, text, lang), fetched to the driver in order of their hash."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.octet_length("text") <= LEARNED_TEXT_BYTES))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    # of a language, so many texts as its share of the bytes holds
    most = {r["lang"]: min(per_language, r["n"] * LEARNED_BYTES / len(sizes) / max(r["bytes"], 1)) for r in sizes}
    place = F.xxhash64(F.lit("language"), F.col("doc_id").cast("string")).bitwiseAND(F.lit((1 << 40) - 1))
    chosen = F.lit(False)
    for r in sizes:
        chosen = chosen | ((F.col("lang") == r["lang"]) & (place < int(min(1.0, most[r["lang"]] / r["n"]) * (1 << 40))))
    rows = known.select("doc_id", "text", "lang").filter(chosen).collect()
    rows.sort(key=lambda r: (r.lang, str(r.doc_id), r.text))
    return [r.text for r in rows], [r.lang for r in rows]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, lang_pred and score (0 to 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            data, offsets = bytesplit.utf8(batch.column(1))
            best, sure = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for first, last in bytesplit.blocks(offsets) if own.languages else ():
                step = max(1, _FLAGS // (len(own.vocabulary) + 1))
                for row in range(first, last, step):
                    end = min(row + step, last)
                    scores = own.scores(own.vocabulary.presence(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]))
                    power = np.exp(4.0 * (scores - scores.max(1, keepdims=True)))
                    best[row:end], sure[row:end] = scores.argmax(1), (power / power.sum(1, keepdims=True)).max(1)
            lettered = batch.column(2).to_numpy(zero_copy_only=False).astype(bool) & (best >= 0)
            names = [own.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(lettered, sure, 0.0))], names=[id_col, "lang_pred", "score"])

    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col), lettered.alias("__l")).mapInArrow(each, f"`{id_col}` {kind}, lang_pred string, score double")

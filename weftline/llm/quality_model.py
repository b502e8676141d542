"""Quality scores from preference pairs (operator 3), after Bradley and Terry.

A text is described by some shape features; of a pair in which one text is preferred, the probability is the
logistic function of the difference of their scores, which are linear in the features.  The weights minimise
the logistic loss over feature differences of pairs (label 1 preferred to label 0), by Newton steps.  Scores
are then compared with a quantile of the training scores: that which leaves the share of label 0 below it.  The
logistic function of the distance to it is the result, so 0.5 is the threshold.

The model is fitted on at most about ``PER_LABEL`` texts of each label and ``PAIRS`` pairs; every text is scored
whole.

Defined cases: a null or empty text has a score like any other (its features are zero); repeated rows get equal
scores; an empty table gives no rows; without texts of both labels all scores are 0.5; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_sample

PER_LABEL = 1500
PAIRS = 40_000
RIDGE = 1e-2

_CLASSES = np.zeros(256, np.int64)
for _k, _members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",;:", b"!?", b"#", b"$", b"%", b"&", b"*", b"|<>{}[]~^\\", b"\"'()-_/=+@`"), 1):
    _CLASSES[list(_members)] = _k
_N_CLASSES = int(_CLASSES.max()) + 1

FEATURES = _N_CLASSES + 10


def features(text: str | None) -> np.ndarray:
    """Shares of byte classes, lengths, and how much of the text repeats."""
    out = np.zeros(FEATURES)
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return out
    shares = np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=_N_CLASSES) / len(raw)
    out[:_N_CLASSES] = np.sqrt(shares)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    length = np.fromiter(map(len, words), np.int64, n)
    windows = max(n - 2, 1)
    out[_N_CLASSES:] = (
        np.log1p(n) / 10,
        length.mean() / 10,
        min(length.std() / 10, 3.0),
        (length > 20).mean(),
        1 - len(set(lines)) / max(len(lines), 1),
        1 - len(set(words)) / n,
        1 - len(set(zip(words, words[1:], words[2:]))) / windows if n > 2 else 0.0,
        (length == 1).mean(),
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1.0,
    )
    return out


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.centre) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip((raw - self.threshold) / self.spread, -500, 500)))


def fit(x: np.ndarray, label: np.ndarray, share_of_zero: float, pairs: int = PAIRS, seed: int = 7) -> Model:
    """Newton steps on the pairwise logistic loss; ``share_of_zero`` places the threshold among all labelled rows."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, 1.0)
    rng = np.random.default_rng(seed)
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - centre) / scale
    difference = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(difference @ w, -30, 30)))
        gradient = difference.T @ (p - 1) / pairs + RIDGE * w
        curve = (difference * (p * (1 - p))[:, None]).T @ difference / pairs + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    raw = z @ w
    # the quantile over all labelled rows: classes weigh as they occur, not as they were sampled
    order = np.argsort(raw, kind="stable")
    weight = np.where(label == 1, (1 - share_of_zero) / len(good), share_of_zero / len(bad))[order]
    cut = min(int(np.searchsorted(np.cumsum(weight), share_of_zero - 1e-9)), len(raw) - 2)
    threshold = float(raw[order[cut]] + raw[order[cut + 1]]) / 2
    return Model(centre, scale, w, threshold, max(float(raw.std()) / 2, 1e-6))


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """``docs`` has doc_id and text, ``labels`` has doc_id and label (0 or 1); a bounded sample reaches the driver."""
    known = labels.filter(F.col("label").isin(0, 1)).select("doc_id", "label").distinct()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = bounded_sample(known, "label", "doc_id", per_label, "quality")
    # at most about 2 * per_label rows: a proven bound
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = described(joined.select(F.struct("doc_id", "label").alias("key"), "text"), "key").collect()
    rows.sort(key=lambda r: (str(r.key.doc_id), r.key.label, r.features))
    x = np.array([r.features for r in rows]).reshape(-1, FEATURES)
    total = sum(counts.values())
    return fit(x, np.array([r.key.label for r in rows]), counts.get(0, 0) / total if total else 0.5)


def described(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """The id and the features of each text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], names=[id_col, "features"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(each, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, features array<double>")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the score (0 to 1) of each text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(values))], names=[id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(each, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")

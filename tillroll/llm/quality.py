"""Quality classifier: Naive Bayes support vectors.

A text is the set of its n-grams: words, and runs of three word shapes (case, punctuation, digits,
length, repetition of the word before).  Indicators are scaled by the log ratio of how often the two
classes have them, and a linear hinge-loss model is fitted on them by dual coordinate descent.

The ratios count all learnable labelled rows, the hinge fit uses at most `PER_CLASS` of each class; scoring is one pass over all texts with
a table of 2**BITS weights.  Null and empty texts have no n-grams and get the score of the bias.
Without labelled rows of both classes every score is the share of class 1 among the labels seen, or 0.5.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.sampling import agreed_labels, labelled_sample
from tillroll.llm.text import ALNUM, SPACED, chunks, distinct_pairs, joined, map_texts, mix, owners, sigmoid, span_hashes, words

BITS = 18
PER_CLASS = 3000
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 20
BLEND = 0.25

_UPPER, _LETTER, _DIGIT, _SIGN = (np.zeros(256, np.int32) for _ in range(4))
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1
_DIGIT[48:58] = 1
_SIGN[(ALNUM == 32) & (SPACED != 32)] = 1


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct n-grams of a chunk of texts."""
    data, begins = joined(texts)
    data = SPACED[data]
    starts, ends, cuts = words(data, begins)
    row = owners(cuts)
    hashes = span_hashes(data, starts, ends)

    def within(table):
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=sums[1:])
        return sums[ends] - sums[starts]

    upper, letters, digits, signs = map(within, (_UPPER, _LETTER, _DIGIT, _SIGN))
    again = np.zeros(len(row), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    case = np.where(upper == 0, 0, np.where((upper == letters) & (upper > 1), 2, 1))
    size = np.digitize(ends - starts, (3, 13))
    shape = (((case * 4 + np.minimum(signs, 3)) * 2 + (digits > 0)) * 2 + again) * 3 + size
    shape = shape.astype(np.uint64)
    inside = row[2:] == row[:-2]
    runs = mix((shape[:-2] * np.uint64(1000) + shape[1:-1]) * np.uint64(1000) + shape[2:] + np.uint64(1 << 40))[inside]
    shift = np.uint64(64 - BITS)
    return distinct_pairs(
        np.concatenate([row, row[2:][inside]]), np.concatenate([hashes >> shift, runs >> shift]), BITS
    )


def fit_hinge(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, size: int, epochs: int = EPOCHS) -> np.ndarray:
    """Dual coordinate descent for the L2-regularised hinge loss; the order of rows is fixed by a seed."""
    weights, alpha = np.zeros(size), np.zeros(len(rows))
    norms = [float(v @ v) for v in values]
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for k in rng.permutation(len(rows)):
            at, x = rows[k], values[k]
            if norms[k] == 0:
                continue
            gradient = sign[k] * float(weights[at] @ x) - 1
            new = min(max(alpha[k] - gradient / norms[k], 0.0), COST)
            if new != alpha[k]:
                weights[at] += (new - alpha[k]) * sign[k] * x
                moved = max(moved, abs(new - alpha[k]))
                alpha[k] = new
        if moved < 1e-4:
            break
    return weights


@dataclass
class Model:
    weights: np.ndarray  # of n-gram indicators, bias last
    slope: float = 1.0
    offset: float = 0.0

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.concatenate([self._score(texts[a:b]) for a, b in chunks(texts)] or [np.empty(0)])

    def _score(self, texts: list[bytes]) -> np.ndarray:
        row, bucket = ngrams(texts)
        norm = np.sqrt(np.bincount(row, minlength=len(texts)) + 1.0)
        sums = np.bincount(row, self.weights[bucket], len(texts)) + self.weights[-1]
        return sigmoid(self.slope * sums / norm + self.offset)


def fit_rows(buckets: list[np.ndarray], labels: np.ndarray, counts: np.ndarray | None = None) -> Model:
    """The model of texts given as sets of n-grams, and their labels.

    `counts` tells how many rows of each class have each n-gram; without it these texts are counted.
    """
    size, bias = (1 << BITS) + 1, 1 << BITS
    if len(set(labels.tolist())) < 2:
        share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
        return Model(np.zeros(size), 0.0, float(np.log(share / (1 - share))))
    seen = np.full((2, size), SMOOTHING)
    if counts is not None:
        seen[:, :-1] += counts
    else:
        for at, label in zip(buckets, labels):
            seen[label, at] += 1
    seen[:, bias] = 1
    ratio = np.log(seen[1] / seen[1, :-1].sum()) - np.log(seen[0] / seen[0, :-1].sum())
    ratio[bias] = 1.0
    rows = [np.append(at, bias) for at in buckets]
    values = [ratio[at] / np.sqrt(len(at)) for at in rows]
    weights = fit_hinge(rows, values, np.where(labels == 1, 1.0, -1.0), size)
    weights[:-1] = (1 - BLEND) * np.abs(weights[:-1]).mean() + BLEND * weights[:-1]
    weights *= ratio
    margins = np.array([weights[at].sum() / np.sqrt(len(at)) for at in rows])
    scale = np.abs(margins).mean() or 1.0
    slope, offset = platt(margins / scale, labels)
    return Model(weights.astype(np.float64), slope / scale, offset)


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins, with softened targets."""
    ones, zeros = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * margins + b)
        w, g = p * (1 - p) + 1e-9, p - target
        h = np.array([[(w * margins**2).sum() + 1e-6, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, [(g * margins).sum(), g.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def class_counts(docs: DataFrame, labels: DataFrame, learnable: Column) -> np.ndarray:
    """Per class and bucket, how many learnable labelled rows have it; summed inside each task first.

    Two times 2**BITS numbers at most reach the driver.
    """

    def count(batches):
        seen = np.zeros(2 << BITS, np.int64)
        for batch in batches:
            texts, label = batch.column("utf8").to_pylist(), batch.column("label").to_numpy().astype(np.int64)
            for a, b in chunks(texts):
                row, bucket = ngrams(texts[a:b])
                seen += np.bincount(label[a:b][row] << BITS | bucket, minlength=2 << BITS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["place", "n"])

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("utf8")
    known = agreed_labels(labels, "quality", learnable).hint("merge")  # labels grow with the texts
    texts = docs.filter(learnable).select("doc_id", text).join(known, "doc_id")
    found = texts.select("utf8", "label").mapInArrow(count, "place bigint, n bigint")
    found = found.groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 << BITS)
    counts[found["place"].to_numpy()] = found["n"].to_numpy()
    return counts.reshape(2, -1)


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, per_class: int = PER_CLASS) -> Model:
    """Learns `quality` from labelled rows for which `learnable` holds, at most `per_class` of them by hinge loss."""

    def work(texts):
        found = []
        for a, b in chunks(texts):
            row, bucket = ngrams(texts[a:b])
            found += np.split(bucket.astype("<i4"), np.searchsorted(row, np.arange(1, b - a)))
        return [pa.array([f.tobytes() for f in found], pa.binary())]

    sample = labelled_sample(docs, labels, "quality", learnable, per_class)
    grams = map_texts(sample, [F.col("doc_id"), F.col("label")], [("grams", "binary")], work)
    rows = sorted(grams.collect(), key=lambda r: (r.doc_id, bytes(r.grams)))
    counts = class_counts(docs, labels, learnable)
    return fit_rows([np.frombuffer(r.grams, "<i4") for r in rows], np.array([r.label for r in rows], int), counts)


def score(docs: DataFrame, model: Model, keep: list[Column | str]) -> DataFrame:
    """Adds `score`, the probability of class 1, to the columns `keep`; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, keep, [("score", "double")], lambda texts: [pa.array(shared.value.score(texts), pa.float64())])

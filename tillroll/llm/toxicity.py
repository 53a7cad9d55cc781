"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

Every sentence has a logistic score over its words and word beginnings; a document is toxic if any
sentence is (noisy-or).  The weights are trained from document labels through the noisy-or, so the
model itself finds which sentences offend.  Training starts where documents without any weight are as
toxic as the labels, and goes on until the loss settles, on tables of any size.

The fit uses at most `PER_CLASS` labelled rows of each class; scoring is one pass over all texts with
a table of 2**BITS weights.  Sentences end at `.`, `!`, `?` or a line break.  Null and empty texts have
no sentence and score 0; without labelled rows of both classes all scores are 0.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.sampling import labelled_sample
from tillroll.llm.text import ALNUM, chunks, joined, map_texts, mix, owners, sigmoid, span_hashes, words

BITS = 18
PER_CLASS = 2000
BEGINNINGS = (4, 5, 6, 7)
RATE, BIAS_RATE = 1.0, 0.3
FLOOR = 1e-3  # of squared gradients: words of few documents take short steps
SPARSITY = 2e-4
MIN_DOCS = 3
BATCH = 64
LEAST_STEPS, MOST_STEPS = 600, 6000
PATIENCE, SETTLED = 5, 0.02  # so little gained over so many epochs ends the training

_STOP = np.zeros(256, np.int32)
_STOP[[ord(c) for c in ".!?\n"]] = 1


@dataclass
class Sentences:
    """Features of a chunk of texts, sentence by sentence."""

    row: np.ndarray  # text of every sentence
    first: np.ndarray  # bytes from the beginning of the text
    last: np.ndarray
    owner: np.ndarray  # sentence of every feature, each feature once
    bucket: np.ndarray


def sentences(texts: list[bytes]) -> Sentences:
    raw, begins = joined(texts)
    data = ALNUM[raw]
    starts, ends, cuts = words(data, begins)
    text = owners(cuts)
    stops = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(_STOP[raw], out=stops[1:])
    part = stops[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (part[1:] != part[:-1]) | (text[1:] != text[:-1])
    owner, heads = np.cumsum(new) - 1, np.flatnonzero(new)
    tails = np.append(heads[1:], len(starts))[: len(heads)] - 1
    shift = np.uint64(64 - BITS)
    buckets = [span_hashes(data, starts, ends) >> shift]
    owning = [owner]
    for n in BEGINNINGS:
        long = np.flatnonzero(ends - starts > n)
        buckets.append(mix(span_hashes(data, starts[long], starts[long] + n) + np.uint64(n)) >> shift)
        owning.append(owner[long])
    row = text[heads]
    pairs = np.unique(np.concatenate(owning) << BITS | np.concatenate(buckets).astype(np.int64))
    first, last = starts[heads] - begins[row], ends[tails] - begins[row]
    return Sentences(row, first, last, pairs >> BITS, pairs & ((1 << BITS) - 1))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]):
        """Of a chunk: noisy-or, sentences, and the probability of each sentence."""
        found = sentences(texts)
        p = sigmoid(np.bincount(found.owner, self.weights[found.bucket], len(found.row)) + self.bias)
        p = np.minimum(p, 1 - 1e-12)
        return -np.expm1(np.bincount(found.row, np.log1p(-p), len(texts))), found, p


def document_scores(logits: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each sentence, and of each document that no sentence is toxic."""
    p = np.clip(sigmoid(logits), 1e-9, 1 - 1e-9)
    return p, np.exp(np.bincount(row, np.log1p(-p), rows))


def slopes(logits: np.ndarray, row: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient of the documents' mean log likelihood by the logit of each sentence, and the mean loss."""
    p, clean = document_scores(logits, row, len(labels))
    toxic = np.maximum(1 - clean, 1e-9)
    pull = np.minimum(clean / toxic, 1e3)
    loss = -np.where(labels == 1, np.log(toxic), np.log(np.maximum(clean, 1e-300))).mean()
    return np.where(labels[row] == 1, pull[row] * p, -p) / len(labels), loss


def even_bias(counts: np.ndarray, labels: np.ndarray) -> float:
    """The bias at which documents of so many sentences are toxic as often as the labels are, without any weight."""
    low, high = -20.0, 5.0
    for _ in range(40):
        middle = (low + high) / 2
        below = -np.expm1(counts * np.log1p(-sigmoid(middle))).mean() < labels.mean()
        low, high = (middle, high) if below else (low, middle)
    return low


@dataclass
class Rows:
    """Documents as (sentence of every feature, feature), and how many sentences each has."""

    docs: list[tuple[np.ndarray, np.ndarray]]
    counts: np.ndarray
    labels: np.ndarray

    def batch(self, chosen) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sentence of every feature, feature, document of every sentence, and labels."""
        offsets = np.concatenate([[0], np.cumsum(self.counts[chosen])]).astype(np.int64)
        owner = np.concatenate([self.docs[k][0] + o for k, o in zip(chosen, offsets)])
        bucket = np.concatenate([self.docs[k][1] for k in chosen])
        return owner, bucket, np.repeat(np.arange(len(chosen)), np.diff(offsets)), self.labels[chosen]


def train(rows: Rows, chosen: np.ndarray, features: int) -> tuple[np.ndarray, float]:
    """Weights and bias by steps of adaptive size with an L1 penalty, until the loss of an epoch settles."""
    weights, squares = np.zeros(features), np.full(features, FLOOR)
    bias, bias_square = even_bias(rows.counts[chosen], rows.labels[chosen]), 1e-6
    rng = np.random.default_rng(0)
    steps, losses = 0, []
    while steps < MOST_STEPS:
        order, total = rng.permutation(chosen), 0.0
        for at in range(0, len(order), BATCH):
            owner, bucket, row, label = rows.batch(order[at : at + BATCH])
            slope, loss = slopes(np.bincount(owner, weights[bucket], len(row)) + bias, row, label)
            gradient = np.bincount(bucket, slope[owner], features)
            squares += gradient**2
            step = RATE / np.sqrt(squares) * (gradient != 0)
            moved = weights + step * gradient
            weights = np.sign(moved) * np.maximum(np.abs(moved) - step * SPARSITY, 0)
            by_bias = slope.sum()
            bias_square += by_bias**2
            bias += BIAS_RATE * by_bias / np.sqrt(bias_square)
            total += loss * len(label)
            steps += 1
        losses.append(total / len(order))
        back = losses[-1 - PATIENCE] if len(losses) > PATIENCE else np.inf
        if steps >= LEAST_STEPS and losses[-1] > back * (1 - SETTLED):
            break
    return weights, float(bias)


def fit_rows(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Fits documents given as (sentence of every feature, bucket); sentences are numbered from 0.

    Documents without words have no say.
    """
    weights = np.zeros(1 << BITS)
    counts = np.array([int(owner.max()) + 1 if len(owner) else 0 for owner, _ in docs], np.int64)
    chosen = np.flatnonzero(counts)
    if len(set(labels[chosen].tolist())) < 2:
        return Model(weights, -30.0)
    # Words of few documents can only be learned by heart; their weights stay zero.
    seen = np.zeros(1 << BITS, np.int64)
    for _, bucket in docs:
        seen[np.unique(bucket)] += 1
    used = np.flatnonzero(seen >= MIN_DOCS)
    place = np.zeros(1 << BITS, np.int64)
    place[used] = np.arange(len(used))
    common = [seen[bucket] >= MIN_DOCS for _, bucket in docs]
    rows = Rows([(owner[c], place[bucket[c]]) for (owner, bucket), c in zip(docs, common)], counts, labels)
    weights[used], bias = train(rows, chosen, len(used))
    return Model(weights, bias)


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, per_class: int = PER_CLASS) -> Model:
    """Learns `toxic` from labelled rows for which `learnable` holds."""

    def work(texts):
        owner, bucket = [], []
        for a, b in chunks(texts):
            found = sentences(texts[a:b])
            first = np.searchsorted(found.row, np.arange(b - a + 1))
            cuts = np.searchsorted(found.owner, first)
            for k in range(b - a):
                mine = slice(cuts[k], cuts[k + 1])
                owner.append((found.owner[mine] - first[k]).astype("<i4").tobytes())
                bucket.append(found.bucket[mine].astype("<i4").tobytes())
        return [pa.array(owner, pa.binary()), pa.array(bucket, pa.binary())]

    sample = labelled_sample(docs, labels, "toxic", learnable, per_class)
    features = map_texts(sample, [F.col("doc_id"), F.col("label")], [("owner", "binary"), ("bucket", "binary")], work)
    rows = sorted(features.collect(), key=lambda r: (r.doc_id, bytes(r.bucket)))
    made = [(np.frombuffer(r.owner, "<i4").astype(np.int64), np.frombuffer(r.bucket, "<i4")) for r in rows]
    return fit_rows(made, np.array([r.label for r in rows], int))


def score(docs: DataFrame, model: Model, keep: list[Column | str], offending: float = 0.5) -> DataFrame:
    """Adds to the columns `keep` the document's score and where it offends.

    `worst_start`, `worst_end`: code points of the sentence with the highest score (null without
    sentences, the first of equals); `n_offending`: sentences scoring at least `offending`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts):
        scores, starts, stops, many = [], [], [], []
        for a, b in chunks(texts):
            total, found, p = shared.value.scores(texts[a:b])
            scores.append(total)
            many.append(np.bincount(found.row, p >= offending, b - a).astype(np.int64))
            cuts = np.searchsorted(found.row, np.arange(b - a + 1)).tolist()
            for k, text in enumerate(texts[a:b]):
                if cuts[k] == cuts[k + 1]:
                    starts.append(None)
                    stops.append(None)
                    continue
                worst = cuts[k] + int(p[cuts[k] : cuts[k + 1]].argmax())
                before = len(text[: found.first[worst]].decode("utf-8", "replace"))
                starts.append(before)
                stops.append(before + len(text[found.first[worst] : found.last[worst]].decode("utf-8", "replace")))
        flat = lambda parts: np.concatenate(parts) if parts else []
        return [pa.array(flat(scores), pa.float64()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(flat(many), pa.int64())]

    return map_texts(docs, keep, [("score", "double"), ("worst_start", "bigint"), ("worst_end", "bigint"), ("n_offending", "bigint")], work)


def drop_toxic(docs: DataFrame, model: Model, limit: float) -> DataFrame:
    """The documents scoring below `limit`, with all their columns; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = [b"" if t is None else t.encode() for t in batch.column("text").to_pylist()]
            clean = [shared.value.scores(texts[a:b])[0] < limit for a, b in chunks(texts)]
            yield batch.filter(pa.array(np.concatenate(clean) if clean else [], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Two- and three-character grams over lower-case letters, all else a blank, fall into 2**BITS buckets.
Document frequencies cover every learnable text; the weights are trained on a sample by
follow-the-regularised-leader with an elastic net, one row at a time; a temperature fitted on sample
rows kept aside makes the probabilities honest.

The sample takes about `SAMPLE` rows in equal shares over all languages, but no fewer than about `LEAST`
of each, by a threshold on a hash; the row of a language that comes first by it is always taken, and one
row of each at least is trained on, so every language can be predicted.  Of rows of one language repeating
an id one is taken.  Null texts and texts without a letter are `und` with score 0,
as is every text if nothing could be learned.
"""

import functools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.sampling import one_per_id
from tillroll.llm.text import chunks, map_texts, mix

BITS = 13
ROWS = 256  # texts in one dense table
SAMPLE = 4000
LEAST = 20  # sample rows of a language, as far as it has them
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-4
ASIDE = 5  # every so many sample rows calibrate
UNKNOWN = "und"


@functools.cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How often each text (row) has each bucket (column), and whether it has a letter."""
    strings = [f" {t.decode('utf-8', 'replace').lower()} " for t in texts]
    points = np.frombuffer("".join(strings).encode("utf-32-le", "replace"), np.uint32)
    begins = np.zeros(len(strings) + 1, np.int64)
    np.cumsum([len(s) for s in strings], out=begins[1:])
    is_letter = letters()[points]
    points = np.where(is_letter, points, 32).astype(np.uint64)
    row = np.repeat(np.arange(len(strings)), np.diff(begins))
    shift = np.uint64(64 - BITS)
    cells = []
    for n in (2, 3):
        # A gram has no two blanks in a row and so never lies in two texts.
        use = is_letter[: len(points) - 1] | is_letter[1:]
        code = points[:-1] << np.uint64(21) | points[1:]
        if n == 3:
            use = use[:-1] & use[1:]
            code = code[:-1] << np.uint64(21) | points[2:]
        cells.append(((row[: len(code)] << BITS) | (mix(code + np.uint64(n << 60)) >> shift).astype(np.int64))[use])
    counts = np.bincount(np.concatenate(cells), minlength=len(texts) << BITS).reshape(len(texts), -1)
    some = np.add.reduceat(is_letter, begins[:-1], dtype=np.int64) > 0 if len(texts) else np.empty(0, bool)
    return counts, some


@dataclass
class Model:
    names: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    weights: np.ndarray | None = None  # bucket by language
    bias: np.ndarray | None = None
    temperature: float = 1.0

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for a, b in chunks(texts, rows=ROWS):
            if not self.names:
                names += [UNKNOWN] * (b - a)
                scores += [0.0] * (b - a)
                continue
            counts, some = grams(texts[a:b])
            p = softmax((weigh(counts, self.idf) @ self.weights + self.bias) / self.temperature)
            best = p.argmax(axis=1)
            names += [self.names[k] if s else UNKNOWN for k, s in zip(best, some)]
            scores += np.where(some, p[np.arange(b - a), best], 0.0).tolist()
        return names, scores


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Dampened counts times inverse document frequency, rows of length one."""
    x = np.log1p(counts.astype(np.float32)) * idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(norm > 0, norm, 1)[:, None]


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, names: list[str], idf: np.ndarray) -> Model:
    """Follow-the-regularised-leader over (buckets, weighted values) of texts; labels number the names."""
    kinds = len(names)
    z, n = np.zeros((1 << BITS, kinds)), np.zeros((1 << BITS, kinds))
    bias = np.zeros(kinds)
    bias_n = np.ones(kinds)

    def solve(z, n):
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    train = [k for k in range(len(rows)) if k % ASIDE or len(rows) < 2 * ASIDE]
    trained = set(labels[train].tolist())
    for k in range(0, len(rows), ASIDE):
        if labels[k] not in trained:
            trained.add(labels[k])
            train.append(k)
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for k in rng.permutation(train):
            at, x = rows[k]
            w = solve(z[at], n[at])
            wrong = softmax(x @ w + bias)
            wrong[labels[k]] -= 1
            g = x[:, None] * wrong[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
            bias_n += wrong * wrong
            bias -= 0.1 * wrong / np.sqrt(bias_n)
    weights = solve(z, n)
    aside = [k for k in range(len(rows)) if k % ASIDE == 0]
    logits = np.array([rows[k][1] @ weights[rows[k][0]] + bias for k in aside]).reshape(len(aside), kinds)
    truth = labels[aside]
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(aside)), truth] + 1e-12).mean()
    return Model(names, idf, weights.astype(np.float32), bias, float(min(np.geomspace(0.05, 5, 60), key=loss)))


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts and, per bucket, of texts having it; summed inside each task first."""

    def count(batches):
        total, seen = 0, np.zeros(1 << BITS, np.int64)
        for batch in batches:
            texts = batch.column("utf8").to_pylist()
            total += len(texts)
            for a, b in chunks(texts, rows=ROWS):
                seen += (grams(texts[a:b])[0] > 0).sum(axis=0)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], total))], names=["bucket", "n"])

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("utf8")
    rows = docs.select(text).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = {r.bucket: r.n for r in rows.collect()}  # one number per bucket at most
    total = found.pop(-1, 0)
    seen = np.zeros(1 << BITS)
    seen[list(found)] = list(found.values())
    return total, seen


def fit(docs: DataFrame, learnable: Column, sample: int = SAMPLE) -> Model:
    """Learns `lang` from rows for which `learnable` holds and which have text and language."""
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(
        learnable & F.col("text").isNotNull() & F.col("lang").isNotNull()
    )
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(10**9))
    kinds = known.groupBy("lang").agg(F.approx_count_distinct(place, 0.02).alias("n"), F.min(place).alias("first")).collect()
    if not kinds:
        return Model()
    total, seen = document_frequencies(known)
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)
    wanted = max(sample / len(kinds), LEAST)
    bounds = [(r["lang"], max(int(min(1.0, wanted / max(r["n"], 1)) * 10**9), r["first"] + 1)) for r in kinds]
    bounds = docs.sparkSession.createDataFrame(bounds, "lang string, __bound long")
    chosen = one_per_id(known.join(F.broadcast(bounds), "lang").filter(place < F.col("__bound")), "lang")

    def work(texts):
        at, count = [], []
        for a, b in chunks(texts, rows=ROWS):
            for line in grams(texts[a:b])[0]:
                used = np.flatnonzero(line)
                at.append(used.astype("<i4").tobytes())
                count.append(line[used].astype("<i4").tobytes())
        return [pa.array(at, pa.binary()), pa.array(count, pa.binary())]

    rows = map_texts(chosen, [F.col("doc_id"), F.col("lang")], [("at", "binary"), ("n", "binary")], work)
    rows = sorted(rows.collect(), key=lambda r: (hash_order(r.doc_id), bytes(r.at)))
    names = sorted(r["lang"] for r in kinds)
    number = {name: k for k, name in enumerate(names)}
    made = []
    for r in rows:
        at = np.frombuffer(r.at, "<i4")
        x = np.log1p(np.frombuffer(r.n, "<i4").astype(np.float32)) * idf[at]
        made.append((at, x / (np.sqrt(x @ x) or 1)))
    return fit_rows(made, np.array([number[r.lang] for r in rows], int), names, idf)


def hash_order(doc_id) -> tuple[int, int]:
    return (int(doc_id) * 0x9E3779B97F4A7C15 & 0xFFFFFFFF, int(doc_id))


def predict(docs: DataFrame, model: Model, keep: list[Column | str]) -> DataFrame:
    """Adds `lang_pred` and `score` to the columns `keep`; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts):
        names, scores = shared.value.predict(texts)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return map_texts(docs, keep, [("lang_pred", "string"), ("score", "double")], work)

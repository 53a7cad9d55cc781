"""Helpers for Arrow batches of texts: whole texts as bytes, words, hashes and counted features.

Texts are read as UTF-8 bytes.  A batch is worked off in chunks of about `CHUNK` bytes, so memory
depends on the longest single text, not on the batch.  A null text counts as empty.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)

# The words of licence and passage matching: ASCII letters and digits, and every byte of other characters.
ALNUM = np.full(256, 32, np.uint8)
ALNUM[128:] = np.arange(128, 256)
for _byte in b"0123456789abcdefghijklmnopqrstuvwxyz":
    ALNUM[_byte] = _byte
for _byte in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    ALNUM[_byte] = _byte + 32
# Words between white space, as they are written.
SPACED = np.arange(256, dtype=np.uint8)
SPACED[9:14] = 32


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def utf8(column: str = "text") -> Column:
    """The text as bytes, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def bucket_of(doc_id: str, buckets: int) -> Column:
    """The remainder that tells held-out documents from those a model may learn from; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % buckets


def map_texts(docs: DataFrame, keep: list[Column | str], schema: list[tuple[str, str]], work: Callable, text: str = "text") -> DataFrame:
    """Adds columns made from whole texts.

    `work(texts)` takes a list of bytes, of the column `text`, and returns one Arrow array per column of `schema`.
    The columns `keep` pass through unchanged.  Nothing is shuffled.  A batch is handed over in stretches of about
    `CHUNK` bytes, and a text that is kept by its name is not sent a second time.
    """
    sent = text in [c for c in keep if isinstance(c, str)] and docs.schema[text].dataType == T.StringType()
    source = docs.select(*keep) if sent else docs.select(*keep, utf8(text).alias("__utf8"))
    kept = [c for c in source.columns if c != "__utf8"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__utf8")
    body = text if sent else "__utf8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(body)), 0).to_pylist()
            for first, last in ranges(sizes) if sizes else [(0, 0)]:
                part = batch.slice(first, last - first)
                columns = [part.column(name) for name in kept]
                yield pa.RecordBatch.from_arrays(columns + work(as_bytes(part.column(body))), names=names)

    names = kept + [name for name, _ in schema]
    return source.mapInArrow(run, ", ".join(filter(None, [kinds, *(f"`{n}` {kind}" for n, kind in schema)])))


def as_bytes(texts: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
    return [t or b"" for t in texts.to_pylist()]


def chunks(texts: list[bytes], size: int = CHUNK, rows: int = 1 << 13) -> Iterator[tuple[int, int]]:
    """Ranges of at most `rows` rows holding about `size` bytes; a longer text has a range of its own."""
    return ranges([len(t) for t in texts], size, rows)


def ranges(sizes: list[int], size: int = CHUNK, rows: int = 1 << 13) -> Iterator[tuple[int, int]]:
    """The same for the sizes of the texts."""
    first, total = 0, 0
    for row, length in enumerate(sizes):
        if total and (total + length > size or row - first == rows):
            yield first, row
            first, total = row, 0
        total += length + 1
    if first < len(sizes):
        yield first, len(sizes)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a blank after each, and where each begins (one more entry for the end)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return data, begins


def words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of normalised data (separators are blanks), and the first word of each text."""
    edges = np.flatnonzero(np.diff((data != 32).view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[0::2], edges[1::2]
    return starts, ends, np.searchsorted(starts, begins)


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, CHUNK + (CHUNK >> 2))
            self.up, self.down = (self._series(base, size) for base in (int(_PRIME), pow(int(_PRIME), -1, 1 << 64)))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _series(base: int, n: int):
        series = np.full(n, base, np.uint64)
        series[0] = 1
        return np.multiply.accumulate(series)


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per span: equal bytes have equal hashes in any chunk and on any machine."""
    up, down = _powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def owners(cuts: np.ndarray) -> np.ndarray:
    """For the entries between consecutive cuts, the number of the range they lie in."""
    return np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))


def distinct_pairs(rows: np.ndarray, buckets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs in order; row numbers and buckets fit 32 bits together."""
    keys = (rows.astype(np.uint32) << np.uint32(bits)) | buckets.astype(np.uint32)
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return (keys >> np.uint32(bits)).astype(np.int64), (keys & np.uint32((1 << bits) - 1)).astype(np.int64)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))

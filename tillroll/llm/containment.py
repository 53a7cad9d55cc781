"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity with all of it.  Items are therefore
partitioned by size (powers of two), and for each size every document is covered by overlapping
windows of twice that many shingles, in which a contained item is similar enough for MinHash: at a
containment of 0.8 and `SLOTS` hashes a window that holds the item is missed less than once in 100,000.
Any equal slot makes a candidate; candidates are verified by exact shingle containment in the whole
document, in the same task, so no text is shuffled.

Words are ASCII letters and digits and other characters, lower-cased; shingles are sets of five words.
An item with fewer words is one shingle; an item without words is in no document, nor is any item in a
null or empty text.  Items repeating an id are items of their own.

Items are broadcast in blocks whose index takes about `BLOCK_BYTES` in a Python worker: any number of
them is searched, one block after the other, and each document keeps one row.  Every block has Python
workers of its own, so after `PASSES` blocks the rows are written to the shared folder and read back.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.text import ALNUM, chunks, joined, map_texts, mix, span_hashes, utf8, words
from tillroll.staging import stage

SHINGLE = 5
THRESHOLD = 0.8
SLOTS = 64
BLOCK_BYTES = 64 << 20
PASSES = 4
ITEM_BYTES = 20 * SLOTS  # of an item in the index beside its words: minima, owners, table, counters
WORD_TABLE = ALNUM.tobytes()


def multipliers(slots: int) -> np.ndarray:
    return mix(np.arange(1, slots + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def line_of(text: bytes) -> bytes:
    return b" " + b" ".join(text.translate(WORD_TABLE).split()) + b" "


def item_shingles(text: bytes, shingle: int = SHINGLE) -> tuple[int, list[bytes]]:
    """Words per shingle and the distinct shingles, each between blanks."""
    found = text.translate(WORD_TABLE).split()
    size = min(shingle, len(found))
    return size, list({b" " + b" ".join(found[k : k + size]) + b" ": None for k in range(len(found) - size + 1)}) if size else []


def shingle_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words."""
    n = max(len(word_hashes) - size + 1, 0)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * np.uint64(0xBF58476D1CE4E5B9) + word_hashes[k : k + n]
    return mix(total)


@dataclass
class Group:
    """Items of one size class and shingle length, per slot in the order of the low halves of their minima."""

    words: int
    size: int  # most shingles of an item, a power of two
    minima: np.ndarray  # slots x items
    owners: np.ndarray  # the item of each minimum
    table: np.ndarray  # slot by low bits of a minimum: may there be an item

    def owners_of(self, slot: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `values`, and the items that have the value there as their minimum."""
        hit = np.flatnonzero(self.table[slot][values & np.uint32(self.table.shape[1] - 1)])
        first = np.searchsorted(self.minima[slot], values[hit])
        many = np.searchsorted(self.minima[slot], values[hit], side="right") - first
        nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(hit, many), self.owners[slot][np.repeat(first, many) + nth]


def group_of(words: int, size: int, members: list[int], sketches: np.ndarray) -> Group:
    """`sketches` has a row per item; the table has four to eight places per item, but some thousands."""
    order = np.argsort(sketches, axis=0, kind="stable").T
    minima = np.ascontiguousarray(np.take_along_axis(sketches.T, order, axis=1))
    places = 1 << max(14, (4 * len(members) - 1).bit_length())
    table = np.zeros((len(minima), places), bool)
    for line, values in zip(table, minima):
        line[values & np.uint32(places - 1)] = True
    return Group(words, size, minima, np.array(members, np.int32)[order], table)


class Index:
    def __init__(self, items: list[tuple[object, bytes]], shingle: int = SHINGLE, slots: int = SLOTS):
        self.ids = [i for i, _ in items]
        self.shingle = shingle
        self.lines = [line_of(text) for _, text in items]
        self.counts = np.zeros(len(items), np.int32)
        self.factors = multipliers(slots)
        sets: dict[tuple[int, int], list[int]] = {}
        sketches = np.zeros((len(items), slots), np.uint32)
        for k, (_, text) in enumerate(items):
            size, found = item_shingles(text, shingle)
            self.counts[k] = len(found)
            if found:
                data, begins = joined([text])
                data = ALNUM[data]
                starts, ends, _ = words(data, begins)
                hashes = shingle_hashes(span_hashes(data, starts, ends), size)
                sketches[k] = (hashes[None, :] * self.factors[:, None]).min(axis=1).astype(np.uint32)
                sets.setdefault((size, 1 << (len(found) - 1).bit_length()), []).append(k)
        self.groups = [group_of(*kind, members, sketches[members]) for kind, members in sorted(sets.items())]

    def shingles(self, item: int) -> list[bytes]:
        return item_shingles(self.lines[item], self.shingle)[1]

    def candidates(self, texts: list[bytes]) -> set[tuple[int, int]]:
        """(row, item) of a chunk of texts where a window and an item agree in a slot."""
        data, begins = joined(texts)
        data = ALNUM[data]
        starts, ends, cuts = words(data, begins)
        hashes = span_hashes(data, starts, ends)
        found: set[tuple[int, int]] = set()
        for size in sorted({g.words for g in self.groups}):
            groups = [g for g in self.groups if g.words == size]
            found |= self._search(groups, shingle_hashes(hashes, size), cuts, size)
        return found

    def _search(self, groups: list[Group], shingles: np.ndarray, cuts: np.ndarray, size: int) -> set[tuple[int, int]]:
        first = cuts[:-1]
        many = np.maximum(np.diff(cuts) - size + 1, 0)  # shingles of each text
        step = min(g.size for g in groups)
        count = -(-many // step)
        row = np.repeat(np.arange(len(many)), count)
        if not len(row):
            return set()
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        begin = first[row] + nth * step
        end = np.minimum(begin + step, first[row] + many[row])
        # Runs and the gaps between them alternate, so that no block takes shingles across texts.
        edges = np.stack([begin, end], axis=1).ravel()
        edges = edges[:-1] if edges[-1] == len(shingles) else edges
        wide = []
        for g in groups:
            heads = np.flatnonzero(nth % (g.size // step) == 0)
            pair = np.append(row[heads][1:] == row[heads][:-1], False)
            wide.append((g, heads, row[heads], pair))
        found = [np.empty(0, np.int64)]
        for slot, factor in enumerate(self.factors):
            low = np.minimum.reduceat(shingles * factor, edges)[0::2]
            for g, heads, rows, pair in wide:
                block = np.minimum.reduceat(low, heads) if len(heads) < len(low) else low
                window = block.copy()
                window[:-1][pair[:-1]] = np.minimum(block[:-1], block[1:])[pair[:-1]]
                at, item = g.owners_of(slot, window.astype(np.uint32))
                found.append(np.unique(rows[at].astype(np.int64) << 32 | item))
        pairs = np.unique(np.concatenate(found))
        return set(zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist()))

    def matches(self, texts: list[bytes], threshold: float = THRESHOLD) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of every text that contains an item to the threshold."""
        for a, b in chunks(texts):
            lines: dict[int, bytes] = {}
            for row, item in sorted(self.candidates(texts[a:b])):
                if row not in lines:
                    lines = {row: line_of(texts[a + row])}
                shared = sum(s in lines[row] for s in self.shingles(item))
                if shared >= threshold * self.counts[item]:
                    yield a + row, item, shared


def blocks(items: DataFrame) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks whose index is small enough to broadcast, whatever their number and length."""
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ITEM_BYTES).alias("n")).first().n or 0
    parts = -(-total // BLOCK_BYTES)
    for k in range(parts):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else items
        rows = part.select("item_id", utf8().alias("text")).collect()
        yield sorted(((r.item_id, bytes(r.text)) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


MATCHES = "array<struct<item_id:bigint,shared:bigint,shingles:bigint>>"


def find_items(docs: DataFrame, items: DataFrame, keep: list[Column | str], threshold: float = THRESHOLD) -> DataFrame:
    """Adds `matches`, the items that each text contains, to the columns `keep`; one row per document, no shuffle."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("shared", pa.int64()), ("shingles", pa.int64())]))
    result = docs.select(*keep, F.col("text").alias("__searched"), F.array().cast(MATCHES).alias("matches"))
    for nth, rows in enumerate(blocks(items)):
        result = stage(result, "matches") if nth and nth % PASSES == 0 else result
        shared = docs.sparkSession.sparkContext.broadcast(Index(rows))

        def work(texts, shared=shared):
            index, found = shared.value, [[] for _ in texts]
            for row, item, n in index.matches(texts, threshold):
                found[row].append(dict(item_id=index.ids[item], shared=n, shingles=int(index.counts[item])))
            return [pa.array(found, kind)]

        kept = [F.col(f"`{c}`") for c in result.columns]
        result = map_texts(result, kept, [("__more", MATCHES)], work, "__searched")
        result = result.withColumn("matches", F.concat("matches", "__more")).drop("__more")
    return result.drop("__searched")


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, shared and all shingles of the item, and their ratio, for every contained item."""
    found = find_items(docs, items, [F.col("doc_id")], threshold).select("doc_id", F.explode("matches").alias("m"))
    return found.select(
        "doc_id", "m.item_id", F.col("m.shared").alias("n_shared"), F.col("m.shingles").alias("n_shingles"),
        (F.col("m.shared") / F.col("m.shingles")).alias("containment"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no item, with all their columns; no shuffle."""
    clean = docs
    for nth, rows in enumerate(blocks(items)):
        clean = stage(clean, "clean") if nth and nth % PASSES == 0 else clean
        shared = docs.sparkSession.sparkContext.broadcast(Index(rows))

        def run(batches, shared=shared):
            for batch in batches:
                texts = [b"" if t is None else t.encode() for t in batch.column("text").to_pylist()]
                keep = np.ones(len(texts), bool)
                keep[[row for row, _, _ in shared.value.matches(texts, threshold)]] = False
                yield batch.filter(pa.array(keep))

        clean = clean.mapInArrow(run, docs.schema)
    return clean

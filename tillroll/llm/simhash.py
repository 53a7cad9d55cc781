"""Near duplicates by SimHash: fingerprints that differ in few bits, compared in tiles.

Two fingerprints within `radius` bits agree on at least one of `segments` > radius bit ranges, whole.
Rows are therefore compared only inside buckets of equal segments; a bucket is cut into tiles of rows
sorted by population count, and a pair of tiles is compared with exclusive-or and bit counts only if
their population counts come within the radius.  The comparison is exact for any data.

Equal fingerprints are collapsed first.  A bucket beyond `BLOCK` rows is spread over pairs of blocks,
so no task holds more than two blocks of it, and links leave a task only as a spanning forest.

Texts: null counts as empty; a text without words has fingerprint zero, linked like any other; one
with fewer words than a shingle is one shingle.  Rows with a null id get a fingerprint but no class
(null); rows repeating an id are fingerprinted one by one, and classes that share an id may merge.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.components import components, spanning
from tillroll.llm.text import map_texts
from tillroll.staging import stage

SHINGLE = 4
RADIUS = 4
SEED = 42
BLOCK = 4096
TILE = 1024


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Of every bit, the majority over the hashes of all shingles, repeats included."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = max(len(words) - shingle + 1, 1)
    ends = ends[-n:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends.tolist())), np.uint64, n)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(n, 64)
    whole = n // 255 * 255
    totals = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:  # sums of 255 rows fit one byte
        totals += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * totals > n).view(">u8")[0])


def fingerprints(docs: DataFrame, keep: list[Column | str]) -> DataFrame:
    """Adds the fingerprint as a signed 64-bit number `fp` to the columns `keep`; no shuffle."""

    def work(texts):
        made = np.array([fingerprint(t) for t in texts], np.uint64)
        return [pa.array(made.view(np.int64))]

    return map_texts(docs, keep, [("fp", "bigint")], work)


def segment_masks(segments: int) -> list[int]:
    cuts = [64 * k // segments for k in range(segments + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def compare(fps: np.ndarray, mine: np.ndarray, both: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among rows of one bucket.

    `mine` marks the block of a row; with `both`, only pairs across the two blocks are new.
    """
    weight = np.bitwise_count(fps)
    order = np.argsort(weight, kind="stable")
    fps, weight, mine = fps[order], weight[order], mine[order]
    left, right = [], []
    for a in range(0, len(fps), TILE):
        tile = fps[a : a + TILE]
        heaviest = int(weight[min(a + TILE, len(fps)) - 1])
        for b in range(a, len(fps), TILE):
            if int(weight[b]) - heaviest > radius:
                break  # this and all later tiles are too heavy
            near = np.bitwise_count(tile[:, None] ^ fps[None, b : b + TILE]) <= radius
            if both:
                near &= mine[a : a + TILE, None] != mine[None, b : b + TILE]
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            i, j = i[i < j], j[i < j]
            if len(i):
                i, j = spanning(i, j, len(fps))
                left.append(i)
                right.append(j)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = spanning(np.concatenate(left), np.concatenate(right), len(fps))
    return order[i], order[j]


def links(distinct: DataFrame, radius: int = RADIUS, segments: int | None = None) -> DataFrame:
    """Pairs (a, b) of `id` whose `fp` differ in at most `radius` bits, reduced to spanning forests.

    `distinct` has one row per fingerprint.  `segments` defaults to one more than the radius.
    """
    segments = segments or radius + 1
    if segments <= radius:
        raise ValueError("segments must exceed the radius")
    pairs = [F.struct(F.lit(k).alias("seg"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("val")) for k, m in enumerate(segment_masks(segments))]
    bucketed = distinct.select("id", "fp", F.explode(F.array(*pairs)).alias("s")).select("id", "fp", "s.seg", "s.val")
    sizes = bucketed.groupBy("seg", "val").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    spread = (
        bucketed.join(sizes, ["seg", "val"])
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "seg", "val",
            F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
            "own", "id", "fp",
        )
    )
    keys = ["seg", "val", "low", "high"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            runs = boundaries(table)
            yield from found(table.slice(0, runs[-2]), runs[:-1])
            rest = table.slice(runs[-2])
        if rest is not None:
            yield from found(rest, boundaries(rest))

    def boundaries(table: pa.Table) -> np.ndarray:
        if not table.num_rows:
            return np.zeros(2, np.int64)
        new = np.zeros(table.num_rows, bool)
        for key in keys:
            column = table[key].to_numpy()
            new[1:] |= column[1:] != column[:-1]
        return np.concatenate([[0], np.flatnonzero(new), [table.num_rows]])

    def found(table: pa.Table, runs: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, fps = table["id"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
        own, low, high = (table[c].to_numpy() for c in ("own", "low", "high"))
        a, b = [], []
        for first, last in zip(runs[:-1].tolist(), runs[1:].tolist()):
            if last - first > 1:
                i, j = compare(fps[first:last], own[first:last], bool(low[first] != high[first]), radius)
                a.append(ids[first:last][i])
                b.append(ids[first:last][j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return spread.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(near, "a bigint, b bigint")


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Adds `component_id`, the smallest `doc_id` reachable over links, to rows of `doc_id` and `fp`.

    Copies meet in one row per fingerprint before anything is compared; only rows whose fingerprint
    has a link take part in the search for components.
    """
    prints = stage(prints, "fingerprints")
    distinct = stage(prints.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct")
    found = components(links(distinct, radius))
    by_fp = distinct.join(found, distinct.id == found.node, "left").select(
        F.col("fp").alias("own_fp"), F.coalesce("component", "id").alias("component_id")
    )
    return prints.join(by_fp, prints.fp.eqNullSafe(by_fp.own_fp), "left").select(
        *prints.columns, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every document."""
    found = classes(fingerprints(docs, [F.col("doc_id").cast("bigint").alias("doc_id")]), radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each class, that with the smallest id, with all its columns.

    Classes are over fingerprints, so rows repeating an id with other texts are judged one by one, and
    a row goes only if one of its own class stays.  Rows without an id stay and are not shuffled.  Of
    rows repeating id and fingerprint the one with the smallest hash of its text stays; the rank limit
    is applied before the shuffle too, so an id holding many rows sends one per task.
    """
    named = docs.filter("doc_id IS NOT NULL")
    work = named.select(F.col("doc_id").cast("bigint").alias("__id"), "text", F.struct(*docs.columns).alias("__row"))
    printed = stage(fingerprints(work, ["__id", "__row"]), "printed")
    distinct = stage(printed.filter("__id IS NOT NULL").groupBy("fp").agg(F.min("__id").alias("first")), "distinct")
    found = components(links(distinct.select("fp", F.col("fp").alias("id")), radius))
    placed = distinct.join(found, distinct.fp == found.node, "left")
    stays = placed.groupBy(F.coalesce("component", "fp").alias("class")).agg(F.min(F.struct("first", "fp")).alias("s"))
    stays = stays.select(F.col("s.first").alias("__first"), F.col("s.fp").alias("__fp"))
    rank = F.row_number().over(Window.partitionBy("__id", "fp").orderBy(F.xxhash64("__row.text")))
    ranked = printed.withColumn("__rank", rank).filter("__rank = 1")
    kept = ranked.join(stays, (F.col("__id") == F.col("__first")) & (F.col("fp") == F.col("__fp")), "left_semi")
    return kept.select("__row.*").unionByName(docs.filter("doc_id IS NULL"))

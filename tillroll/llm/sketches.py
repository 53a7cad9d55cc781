"""Document fingerprints: the k smallest hashes of a text's word shingles (bottom-k sketch).

A sketch is an ascending `array<bigint>` of at most k distinct 63-bit hashes.  Sketches of parts merge into
the sketch of the whole, and two of them estimate resemblance, containment and numbers of shingles; texts of
up to k shingles are compared exactly.  Words stand between white space, A-Z count as a-z.  A text with fewer
words than a shingle is one shingle; a text without words (null, empty, white space) has an empty sketch.

Repeated rows and equal texts have equal sketches.  Other columns pass through unread, whatever their names.
An empty table gives an empty result.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.text import SPACED, chunks, joined, map_texts, mix, span_hashes, utf8, words

K = 128
SHINGLE = 5
_LOWER = SPACED.copy()
_LOWER[65:91] += 32
_STEP = np.uint64(0xD1342543DE82EF95)
_SALTS = 256


def shingle_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash per window of `size` words; of all words if there are fewer."""
    size = min(size, len(word_hashes))
    if not size:
        return word_hashes
    n = len(word_hashes) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * _STEP + word_hashes[k : k + n]
    return mix(total) >> np.uint64(1)


def bottom(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    hashes = np.sort(hashes)
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    return hashes[new][:k].astype(np.int64)


def sketch_texts(texts: list[bytes], k: int = K, size: int = SHINGLE) -> list[np.ndarray]:
    """The sketches of whole texts."""
    found = []
    for first, last in chunks(texts):
        raw, begins = joined(texts[first:last])
        data = _LOWER[raw]
        starts, ends, cuts = words(data, begins)
        hashes = span_hashes(data, starts, ends)
        found += [bottom(shingle_hashes(hashes[a:b], size), k) for a, b in zip(cuts[:-1], cuts[1:])]
    return found


def _lists(sketches: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(sketches) + 1, np.int32)
    np.cumsum([len(s) for s in sketches], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *sketches])))


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> tuple[float, float]:
    """`resemblance` and `containment` of two sketches inside a task."""
    both = bottom(np.concatenate([a, b]), k)
    if not len(both):
        return 1.0, 1.0
    shared = np.intersect1d(a, b, assume_unique=True)
    known = min([s[-1] for s in (a, b) if len(s) >= k], default=(1 << 63) - 1)
    mine = np.searchsorted(a, known, "right")
    inside = np.searchsorted(shared, known, "right") / mine if mine else float(not len(a))
    return np.searchsorted(shared, both[-1], "right") / len(both), inside


def fingerprints(docs: DataFrame, keep: list[Column | str], k: int = K, size: int = SHINGLE) -> DataFrame:
    """The columns `keep` and the `sketch` of every text; nothing is shuffled."""
    return map_texts(docs, keep, [("sketch", "array<bigint>")], lambda texts: [_lists(sketch_texts(texts, k, size))])


def union(a: Column | str, b: Column | str, k: int = K) -> Column:
    """The sketch of both texts together."""
    return F.slice(F.sort_array(F.array_distinct(F.concat(a, b))), 1, k)


def resemblance(a: Column | str, b: Column | str, k: int = K) -> Column:
    """Shared shingles over all shingles of two texts, 1 for two empty sketches."""
    both = union(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def containment(a: Column | str, b: Column | str, k: int = K) -> Column:
    """Share of the shingles of `a` that `b` has too, 1 for an empty `a`.

    Only hashes up to the smaller end of the full sketches are known on both sides.
    """

    def end(s):
        return F.when(F.size(s) >= k, F.array_max(s)).otherwise(F.lit((1 << 63) - 1))

    known = F.filter(a, lambda h: h <= F.least(end(a), end(b)))
    shared = F.size(F.array_intersect(known, b))
    return F.when(F.size(known) == 0, (F.size(a) == 0).cast("double")).otherwise(shared / F.size(known))


def distinct_shingles(a: Column | str, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(2.0**63) / F.array_max(a))


def merge(sketches: DataFrame, keys: list[str], k: int = K, sketch: str = "sketch") -> DataFrame:
    """One sketch per group: that of all its rows together.  Null keys are a group, null sketches are empty.

    A group is merged per task first, then over `_SALTS` parts, then whole: no task collects more than the
    sketches that tasks or parts have reduced it to.
    """
    source = sketches.select(*keys, F.col(sketch).alias("__sketch"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kind = None
        for batch in batches:
            kind = batch.schema
            lists = batch.column(len(keys))
            groups = zip(*(batch.column(i).to_pylist() for i in range(len(keys)))) if keys else [()] * len(lists)
            for row, group in enumerate(groups):
                new = lists[row].values if lists[row].is_valid else None
                mine = held.get(group, np.empty(0, np.int64))
                held[group] = bottom(np.concatenate([mine, new.to_numpy()]), k) if new is not None else mine
            if len(held) > 1 << 14:  # many small groups: hand them on
                yield out(held, kind)
                held = {}
        if held:
            yield out(held, kind)

    def out(held, kind):
        columns = [pa.array([g[i] for g in held], kind.field(i).type) for i in range(len(keys))]
        return pa.RecordBatch.from_arrays([*columns, _lists(list(held.values()))], names=kind.names)

    def level(df: DataFrame, by: list[Column | str]) -> DataFrame:
        merged = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("__sketch")))), 1, k)
        return df.groupBy(*by).agg(merged.alias("__sketch"))

    reduced = source.mapInArrow(per_task, kinds).withColumn("__salt", F.pmod(F.xxhash64("__sketch"), _SALTS))
    return level(level(reduced, [*keys, "__salt"]), list(keys)).withColumnRenamed("__sketch", sketch)


# Neighbours in the order of ids.


def _in_order(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text and tail, dealt to ordered parts that each end with the first row of the next one (`tail`).

    Parts are ranges of ids.  An id (or null) with more rows than a part should have gets parts of its own,
    dealt by the hash of the text.  The part limits are a few numbers per part, taken from the ids.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8().alias("text"))
    quantiles = [k / parts for k in range(1, parts)]
    ids = rows.select("doc_id")
    seen = ids.agg(
        F.count("*").alias("n"), F.count_if(F.isnull("doc_id")).alias("nulls"),
        F.percentile_approx("doc_id", quantiles or [0.5], 10_000).alias("q"),
    ).first()
    share = max(1, -(-seen["n"] // parts))
    counted = ids.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    hot = {r.doc_id: r.n for r in counted.filter(F.col("n") > 2 * share).collect()}  # at most parts / 2 ids
    # A bound is the smallest id of a range; a hot id is a range of its own.
    bounds = sorted({*(seen["q"] or []), *hot, *(i + 1 for i in hot if i < (1 << 63) - 1)})
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    limits = F.lit(bounds) if bounds else F.array().cast("array<bigint>")
    rank = F.aggregate(
        F.lit(steps), F.lit(0), lambda at, s: F.when(F.get(limits, at + s - 1) <= F.col("doc_id"), at + s).otherwise(at)
    )
    spread = {**hot, **({None: seen["nulls"]} if seen["nulls"] > share else {})}
    place, sub = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for key, n in spread.items():
        same = F.col("doc_id").eqNullSafe(F.lit(key).cast("bigint"))
        place = F.when(same, F.xxhash64("text")).otherwise(place)
        sub = F.when(same, F.floor((F.xxhash64("text") / 2.0**64 + 0.5) * -(-n // share))).otherwise(sub)
    order = F.struct(F.isnull("doc_id").alias("last"), F.bitwise_not("doc_id").alias("down"), place.alias("place"))
    rows = rows.select(
        "doc_id", "text", order.alias("at"),
        # Falling ids: the ranges counted from above, rows without id after all of them.
        F.struct(F.when(F.isnull("doc_id"), 1).otherwise(-rank).alias("range"), sub.alias("sub")).alias("part"),
    )
    firsts = sorted(((tuple(r.part), r["at"]) for r in rows.groupBy("part").agg(F.min("at").alias("at")).collect()))
    if not firsts:
        return rows.select("doc_id", "text", F.lit(False).alias("tail"), F.lit(0).alias("number"))
    spark = docs.sparkSession
    table = [(k, *part, *at) for k, (part, at) in enumerate(firsts)]
    known = spark.createDataFrame(table, "number int, range int, sub long, last boolean, down long, place long")
    numbered = F.broadcast(known.select(F.struct("range", "sub").alias("part"), "number"))  # one row per part
    # The first text of a part ends the part before; the first part's ends the last.
    heads = F.broadcast(known.select(F.struct("last", "down", "place").alias("at"), F.pmod(F.col("number") - 1, F.lit(len(table))).alias("number")))
    tails = rows.join(heads, rows["at"].eqNullSafe(heads["at"])).groupBy("number").agg(F.min("text").alias("text"))
    body = rows.join(numbered, "part").select("doc_id", "text", F.lit(False).alias("tail"), "number", "at")
    nothing = F.lit(None).cast(rows.schema["at"].dataType).alias("at")
    ends = tails.select(F.lit(None).cast("bigint").alias("doc_id"), "text", F.lit(True).alias("tail"), "number", nothing)
    return body.unionByName(ends).repartitionById(len(table), F.col("number")).sortWithinPartitions("number", "tail", "at", "text")


_EDITED = """doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,
  near_edited double, near_next double, kept_in_edited double, n_shingles double"""


def edited(docs: DataFrame, k: int = K, size: int = SHINGLE, parts: int | None = None) -> DataFrame:
    """Sketches (as text) of every text and of its edited text, and how like they and the next text's are.

    The next document follows in falling order of doc_id (rows without id last, ties by text), after the last
    the first; a lone document follows itself.  The edited text has the last half of its code points, rounded
    down, replaced by the first as many of the next text.  Texts are shuffled once.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [c.split()[0] for c in _EDITED.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        ends: list[bool] = []
        for batch in batches:
            # The last row of a batch waits for the one after it.
            ids, texts, ends = (old[-1:] + batch.column(c).to_pylist() for old, c in ((ids, 0), (texts, 1), (ends, 2)))
            for first, last in chunks(texts[:-1]):
                yield made(ids[first : last + 1], texts[first : last + 1], ends[first : last + 1])

    def made(ids, texts, ends):
        rows = [r for r in range(len(ids) - 1) if not ends[r]]
        halves = []
        sizes = []
        for r in rows:
            text, after = texts[r].decode(), texts[r + 1].decode()
            half = len(text) // 2
            sizes.append(len(text))
            halves.append((text[: len(text) - half] + after[:half]).encode())
        own, new = sketch_texts(texts, k, size), sketch_texts(halves, k, size)
        near = [likeness(own[r], n, k) for r, n in zip(rows, new)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids[r] for r in rows], pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in halves], pa.string()),
                pa.array([hex_digits(own[r]) for r in rows], pa.string()),
                pa.array([hex_digits(s) for s in new], pa.string()),
                pa.array([n[0] for n in near], pa.float64()),
                pa.array([likeness(own[r], own[r + 1], k)[0] for r in rows], pa.float64()),
                pa.array([n[1] for n in near], pa.float64()),
                pa.array([_count(own[r], k) for r in rows], pa.float64()),
            ],
            names=names,
        )

    return _in_order(docs, max(1, parts)).select("doc_id", "text", "tail").mapInArrow(run, _EDITED)


def _count(sketch: np.ndarray, k: int) -> float:
    return float(len(sketch)) if len(sketch) < k else (k - 1) * 2.0**63 / float(sketch[-1])


def hex_digits(sketch: np.ndarray) -> str:
    """A sketch as 16 hex digits per hash, smallest hash first."""
    return sketch.astype(">i8").tobytes().hex()


def from_hex(text: Column | str) -> Column:
    """The sketch that `hex_digits` has written."""
    text = F.col(text) if isinstance(text, str) else text
    starts = F.sequence(F.lit(0), F.floor(F.length(text) / 16).cast("int") - 1)
    digits = F.transform(starts, lambda i: F.conv(F.substring(text, i * 16 + 1, F.lit(16)), 16, 10))
    return F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(digits.cast("array<bigint>"))

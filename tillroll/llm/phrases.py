"""Phrase collocations by set-oriented mining over occurrence relations.

The relation of length k holds the places of every phrase of k words: one row per chunk of a language's
texts, sorted by piece and position, and a row per phrase of the chunk.  A place is a number; the words of a piece have consecutive places and
pieces lie a gap apart, so the merge join of a sorted relation with itself by piece and adjacent position is
a shift by one place.  Per length: the relation is written to the shared folder, its groups are
counted (per chunk first, then over all chunks), a semi-join with the frequent groups shortens it, and only
what is left is extended by one word.  Semi-join and merge join run in one co-group per chunk.

Texts are lower-cased (A-Z) and split into pieces at `.,;:!?` and the line breaks 0A-0D, pieces into words at
blanks and tabs.  Null texts are empty, the language null is `und`.  Everything is counted per language, over
whole texts, repeated rows included.  Other columns are not read.  An empty table gives an empty result.

A chunk holds about `WINDOW` bytes, or one longer text whole, so memory depends on the longest text.  A group
has one row per chunk when it is counted or joined, however often it occurs.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.text import utf8
from tillroll.staging import new_path

WINDOW = 8 << 20
MAX_WORDS = 3
MIN_COUNT = 10
TOP = 2000
UNKNOWN = "und"

_WORD, _BLANK, _BREAK = 0, 1, 2
_KINDS = np.zeros(256, np.uint8)
_KINDS[[9, 32]] = _BLANK
_KINDS[[*b".,;:!?", 10, 11, 12, 13]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# A chunk's row with its places comes with a row for every group in it.
_FIRST = "chunk bigint, lang string, at int, word string, n bigint, places binary"
_LONGER = "chunk bigint, at int, prefix bigint, next bigint, n bigint, places binary"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a relation once to the shared folder, packed more tightly than by default, and return the table."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pack(places: np.ndarray) -> bytes:
    return zstandard.compress(places.tobytes())


def unpack(places: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(places), np.int32)


def read_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, how often each occurs, and the word at every place (-1 between pieces)."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    kinds = _KINDS[data]
    inside = kinds == _WORD
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[0::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    spelled = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes())]
    ).dictionary_encode()
    numbers = spelled.indices.to_numpy()
    if not len(numbers):
        return pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int32)
    piece = np.cumsum(kinds == _BREAK, dtype=np.int32)[starts]
    at = np.arange(len(starts))
    at[1:] += np.cumsum(np.diff(piece) > 0)
    places = np.full(at[-1] + 1, -1, np.int32)
    places[at] = numbers
    vocabulary = spelled.dictionary.cast(pa.large_string()).cast(pa.string())
    return vocabulary, np.bincount(numbers, minlength=len(vocabulary)), places


def occurrences(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The relation of single words: a row per chunk of texts of one language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 32

        def chunk(lang: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            sizes.pop(lang)
            vocabulary, counts, places = read_words(held.pop(lang))
            n = len(vocabulary)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n + 1, number)),
                    pa.array([lang] * (n + 1), pa.string()),
                    pa.array(np.arange(-1, n, dtype=np.int32)),
                    pa.concat_arrays([pa.nulls(1, pa.string()), vocabulary]),
                    pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(counts, pa.int64())]),
                    pa.concat_arrays([pa.array([pack(places)], pa.binary()), pa.nulls(n, pa.binary())]),
                ],
                names=["chunk", "lang", "at", "word", "n", "places"],
            )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(lang, []).append(text.as_py())
                sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1]) + 1
                if sizes[lang] >= window:
                    yield chunk(lang)
                elif len(sizes) > 4 and sum(sizes.values()) >= 4 * window:
                    yield chunk(max(sizes, key=sizes.get))
        for lang in list(held):
            yield chunk(lang)

    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), utf8().alias("text")).mapInArrow(run, _FIRST)


def extend(relation: DataFrame, frequent: DataFrame, last: bool = False) -> DataFrame:
    """The relation of phrases longer by a word, from a relation and the frequent groups in it.

    `frequent` has chunk, `at` (the group's number in the chunk), id (its number everywhere) and `next` (its
    last word).  The phrases at adjacent places of a piece share all words but the first and the last one, so
    both must be frequent and the second brings the new word.  The `last` relation comes without places.
    """

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return table(0, None, *[np.empty(0, np.int64)] * 3)
        at, ids, words = (right[c].to_numpy() for c in ("at", "id", "next"))
        alive = np.full(int(at.max()) + 2, -1, np.int32)
        alive[at] = np.arange(len(ids), dtype=np.int32)
        places = unpack(left["places"][0].as_py())
        # Groups above the last frequent one share the last entry, as does the gap's -1.
        places = alive[np.where(places < len(alive) - 1, places, -1)]
        here = np.flatnonzero((places[:-1] >= 0) & (places[1:] >= 0))
        pairs = places[here].astype(np.int64) * len(ids) + places[here + 1]
        pairs, numbers, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        longer = None
        if not last:
            longer = np.full(len(places), -1, np.int32)
            longer[here] = numbers
        return table(left["own"][0].as_py(), longer, ids[pairs // len(ids)], words[pairs % len(ids)], counts)

    def table(own, longer, prefix, following, counts) -> pa.Table:
        n, whole = len(prefix), int(longer is not None)
        return pa.table(
            [
                pa.array(np.full(n + whole, own)),
                pa.array(np.arange(-whole, n, dtype=np.int32)),
                *(pa.concat_arrays([pa.nulls(whole, pa.int64()), pa.array(c, pa.int64())]) for c in (prefix, following, counts)),
                pa.concat_arrays([pa.array([pack(longer)] if whole else [], pa.binary()), pa.nulls(n, pa.binary())]),
            ],
            names=["chunk", "at", "prefix", "next", "n", "places"],
        )

    mine = relation.filter("places IS NOT NULL").select(F.col("chunk").alias("own"), "places").groupBy("own")
    return mine.cogroup(frequent.select("chunk", "at", "id", "next").groupBy("chunk")).applyInArrow(run, _LONGER)


def frequent_groups(groups: DataFrame, key: list[str], min_count: int) -> DataFrame:
    """The rows of groups that occur `min_count` times or more in all chunks, with their count `f` and an id.

    One shuffle: a group's rows, one per chunk that has it, meet and learn their sum.  The id is the place of
    the group's first row in the written table, so it is fixed by writing it.
    """
    met = groups.repartition(*key).withColumn("place", F.monotonically_increasing_id())
    over = Window.partitionBy(*key)
    counted = met.withColumns({"f": F.sum("n").over(over), "id": F.min("place").over(over)})
    return stage(counted.filter(F.col("f") >= min_count).drop("n", "place"), "frequent")


def mine(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> tuple[list[DataFrame], DataFrame]:
    """Per length, the phrases that occur `min_count` times or more, and the number of words per language.

    A phrase has lang, text, f (occurrences) and `phrase`, the array of its words' numbers.
    """
    relation = stage(occurrences(docs), "words")
    groups = relation.filter("places IS NULL").select("chunk", "at", "lang", "word", "n")
    totals = groups.groupBy("lang").agg(F.sum("n").alias("n"))
    key = ["lang", "word"]
    phrases = []
    for length in range(1, max_words + 1):
        if length < max_words:
            rows = frequent_groups(groups, key, min_count)
            frequent = rows.select("id", *key, "f").distinct()
        else:
            frequent = groups.groupBy(*key).agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count)
            frequent = stage(frequent.withColumn("id", F.monotonically_increasing_id()), "frequent")
        if length == 1:
            spelled = one = stage(
                frequent.select("id", F.array("id").alias("phrase"), "f", "lang", F.col("word").alias("text")), "phrases"
            )
        else:
            first = spelled.select(F.col("id").alias("prefix"), "phrase", "lang", "text")
            last = one.select(F.col("id").alias("next"), F.col("text").alias("word"))
            spelled = stage(
                frequent.join(first, "prefix").join(last, "next").select(
                    "id", F.concat("phrase", F.array("next")).alias("phrase"), "f", "lang", F.concat_ws(" ", "text", "word").alias("text"),
                ),
                "phrases",
            )
        phrases.append(spelled)
        if length < max_words:
            last = length + 1 == max_words
            relation = extend(relation, rows if length > 1 else rows.withColumn("next", F.col("id")), last)
            relation = relation if last else stage(relation, "occurrences")
            key = ["prefix", "next"]
            groups = relation.filter("places IS NULL").select("chunk", "at", *key, "n")
    return phrases, totals


def scored(phrases: list[DataFrame]) -> DataFrame:
    """Candidates of two words or more with the counts of their weakest cut and its score, exact beyond 64 bits."""
    counts = [p.select("phrase", "f") for p in phrases]
    parts = []
    for length in range(2, len(phrases) + 1):
        found = phrases[length - 1].select("lang", "text", "phrase", F.col("f").alias("a"))
        cuts = []
        for k in range(1, length):
            left = counts[k - 1].select(F.col("phrase").alias("head"), F.col("f").alias(f"l{k}"))
            right = counts[length - k - 1].select(F.col("phrase").alias("rest"), F.col("f").alias(f"r{k}"))
            found = found.withColumns({"head": F.slice("phrase", 1, k), "rest": F.slice("phrase", k + 1, length - k)})
            found = found.join(left, "head").join(right, "rest").drop("head", "rest")
            a, l, r = (f"cast({c} AS decimal(19, 0))" for c in ("a", f"l{k}", f"r{k}"))  # noqa: E741
            score = F.expr(f"({a} * {a} * cast(1000000 AS decimal(7, 0))) div ({l} * {r})")
            cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        worst = F.array_min(F.array(*cuts))
        parts.append(found.withColumn("cut", worst).select("lang", "text", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    return reduce(DataFrame.unionByName, parts)


def inner(phrases: list[DataFrame]) -> DataFrame:
    """phrase and `longest`: the largest count of a longer candidate that contains it."""
    parts = []
    for length in range(3, len(phrases) + 1):
        sub = [F.slice("phrase", at, size) for size in range(2, length) for at in range(1, length - size + 2)]
        parts.append(phrases[length - 1].select(F.explode(F.array(*sub)).alias("phrase"), F.col("f").alias("longer")))
    return reduce(DataFrame.unionByName, parts).groupBy("phrase").agg(F.max("longer").alias("longer"))


def collocations(
    docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP, within: int = 50
) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase goes if a longer candidate holds it and has `within` per cent of its occurrences or more.
    Order: score and a falling, phrase rising by its bytes.
    """
    if max_words < 2:
        raise ValueError("a phrase has two words or more")
    phrases, totals = mine(docs, max_words, min_count)
    found = scored(phrases)
    if max_words > 2:
        found = found.join(inner(phrases), "phrase", "left")
        found = found.filter(F.col("longer").isNull() | (100 * F.col("longer") < within * F.col("a")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "text"))
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), F.col("text").alias("phrase"), "a", "l", "r", "n", "score"
    )

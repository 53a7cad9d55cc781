"""Hard negatives: for an anchor and a positive, the rows of other labels that score just below the positive.

Rows have id, label and an integer vector; the score of a row is its inner product with the anchor, higher
comes first, ties by smaller id.  They are searched in a multiway hyperplane tree.  A node has a few split
points far apart, and a row belongs to the nearest one.  Every split point stores the range of its distances
to the rows of each sibling subtree.  A score window becomes an annulus of distances around the anchor (a
subtree's norms lie in a known range), and a subtree goes if, for any sibling's split point, the distances the
annulus allows do not meet the stored range.  What is left is compared exactly, so the result is exact.

The split points come from `SAMPLE` rows at most; every row is in the index, and leaves may hold any number
of rows: they are spread over files by id and streamed.  Anchors are searched in blocks of about `BLOCK`, in
the order of leaves; a block, the tree and the leaves each window must visit are all that is broadcast.

Rows with a null id, label or vector, or with a null component, take no part.  Of rows that repeat an id the
one with the smallest label, then the smallest vector does.  Vectors may differ in length: missing components
are zero.  Other columns are not read.  An empty table gives an empty result.  Scores beyond 64 bits raise
OverflowError.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.staging import new_path, stage

SAMPLE = 8192
FAN = 8
LEAF = 64  # sampled rows
BLOCK = 1024
_ROWS = 4096
_EXACT = 1 << 53
_SLACK = 1e-6


class Node(NamedTuple):
    points: np.ndarray
    children: list[int]  # a node's number, or -1 - leaf


class Ranges(NamedTuple):
    """Of one node: distances of each split point (rows) to the rows below each child (columns), norms of these rows."""

    low: np.ndarray
    high: np.ndarray
    short: np.ndarray
    long: np.ndarray


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def far_apart(rows: np.ndarray, fan: int) -> np.ndarray:
    """Up to `fan` different rows: the one farthest from the mean, then always the one farthest from those taken."""
    first = int(np.argmax(distances(rows, rows.mean(axis=0)[None, :])[:, 0]))
    taken, nearest = [first], distances(rows, rows[first : first + 1])[:, 0]
    while len(taken) < fan and nearest.max() > 0:
        taken.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, distances(rows, rows[taken[-1]][None, :])[:, 0])
    return rows[taken]


class Tree:
    """Split points of all nodes; the ranges are added when every row has been seen."""

    def __init__(self, sample: np.ndarray, fan: int = FAN, leaf: int = LEAF):
        self.nodes: list[Node] = []
        self.leaves = 0
        self.ranges: list[Ranges | None] = []
        self.root = self._grow(sample, fan, leaf)

    def _grow(self, rows: np.ndarray, fan: int, leaf: int) -> int:
        points = far_apart(rows, fan) if len(rows) > leaf else rows[:0]
        if len(points) < 2:
            self.leaves += 1
            return -self.leaves
        number = len(self.nodes)
        self.nodes.append(Node(points, []))
        near = distances(rows, points).argmin(axis=1)
        for j in range(len(points)):
            self.nodes[number].children.append(self._grow(rows[near == j], fan, leaf))
        return number

    def visit(self, rows: np.ndarray, seen=None) -> np.ndarray:
        """The leaf of each row; `seen(node, distances, child)` is told of every node passed."""
        leaves = np.empty(len(rows), np.int32)
        pending = [(self.root, np.arange(len(rows)))]
        while pending:
            at, these = pending.pop()
            if at < 0:
                leaves[these] = -1 - at
            elif len(these):
                away = distances(rows[these], self.nodes[at].points)
                near = away.argmin(axis=1)
                if seen:
                    seen(at, away, near, these)
                pending += [(child, these[near == j]) for j, child in enumerate(self.nodes[at].children)]
        return leaves

    def reachable(self, anchors: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict[int, np.ndarray]:
        """The windows (anchor number, lowest and highest score) that may have rows in each leaf."""
        norms = (anchors * anchors).sum(axis=1)
        found: dict[int, np.ndarray] = {}
        pending = [(self.root, np.arange(len(of)))]
        while pending:
            at, these = pending.pop()
            if not len(these):
                continue
            if at < 0:
                found[-1 - at] = these
                continue
            ranges = self.ranges[at]
            mine = of[these]
            away = distances(anchors, self.nodes[at].points)[mine]
            for j, child in enumerate(self.nodes[at].children):
                if ranges.short[j] > ranges.long[j]:
                    continue  # no rows
                least = np.sqrt(np.maximum(norms[mine] + ranges.short[j] - 2 * high[these], 0))[:, None]
                most = norms[mine] + ranges.long[j] - 2 * low[these]
                slack = (_SLACK * (1 + np.sqrt(norms[mine]) + np.sqrt(ranges.long[j])))[:, None]
                some = most >= -slack[:, 0]
                most = np.sqrt(np.maximum(most, 0))[:, None]
                some &= (np.maximum(away - most, least - away) <= ranges.high[:, j] + slack).all(axis=1)
                some &= (away + most >= ranges.low[:, j] - slack).all(axis=1)
                pending.append((child, these[some]))
        return found


class Index(NamedTuple):
    rows: DataFrame  # leaf, id, label, vector (packed), sorted by leaf and id in files
    tree: Tree
    width: int
    exact: bool  # scores are exact as doubles


def _unpack(column: pa.Array, width: int, exact: bool) -> np.ndarray:
    rows = np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), width)
    return rows.astype(np.float64) if exact else rows


def build(rows: DataFrame, sample: int = SAMPLE, fan: int = FAN, leaf: int = LEAF) -> Index | None:
    """Fits the tree on the `sample` rows with the smallest hashes of their ids and puts every row into its leaf.

    `rows` has id, label and vector (array<bigint>).  None if no row takes part.
    """
    valid = rows.select(F.col("id").cast("bigint").alias("id"), "label", "vector").dropna()
    valid = valid.filter(~F.exists("vector", F.isnull))
    one = stage(valid.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.*"), "vectors")
    size = one.agg(
        F.max(F.size("vector")).alias("width"),
        F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("decimal(20, 0)"))))).alias("peak"),
    ).first()
    if size["width"] is None:
        return None
    width = max(size["width"], 1)
    largest = width * int(size["peak"] or 0) ** 2
    if largest >= 1 << 62:
        raise OverflowError("inner products do not fit 64 bits")
    exact = largest < _EXACT

    def packed(vectors) -> np.ndarray:
        out = np.zeros((len(vectors), width), np.int64)
        for row, vector in enumerate(vectors):
            out[row, : len(vector)] = vector
        return out

    chosen = one.orderBy(F.xxhash64("id"), "id").select("vector").limit(sample).collect()
    tree = Tree(packed([r.vector for r in chosen]).astype(float), fan, leaf)
    shared = one.sparkSession.sparkContext.broadcast(tree)
    label = one.schema["label"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            lengths = np.diff(lists.offsets.to_numpy())
            if (lengths == width).all():
                vectors = lists.flatten().to_numpy().reshape(-1, width)
            else:
                vectors = packed(lists.to_pylist())
            leaves = shared.value.visit(vectors.astype(float))
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaves), batch.column(0), batch.column(1), pa.array([v.tobytes() for v in vectors], pa.binary())],
                names=["leaf", "id", "label", "vector"],
            )

    placed = one.select("id", "label", "vector").mapInArrow(place, f"leaf int, id bigint, label {label}, vector binary")
    indexed = stage(placed.repartitionByRange("leaf", "id").sortWithinPartitions("leaf", "id"), "index")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        kept = [_no_ranges(len(n.points)) for n in tree.nodes]
        for batch in batches:
            vectors = _unpack(batch.column(0), width, True)
            norms = (vectors * vectors).sum(axis=1)

            def seen(at, away, near, these):
                r = kept[at]
                for j in np.unique(near):
                    mine = near == j
                    np.minimum(r.low[:, j], away[mine].min(axis=0), out=r.low[:, j])
                    np.maximum(r.high[:, j], away[mine].max(axis=0), out=r.high[:, j])
                    r.short[j] = min(r.short[j], norms[these[mine]].min())
                    r.long[j] = max(r.long[j], norms[these[mine]].max())

            tree.visit(vectors, seen)
        out = [(at, i, j, r.low[i, j], r.high[i, j], r.short[j], r.long[j]) for at, r in enumerate(kept) for i in range(len(r.low)) for j in range(len(r.low)) if r.short[j] <= r.long[j]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), [pa.int32()] * 3 + [pa.float64()] * 4)], names=["node", "i", "j", "low", "high", "short", "long"])

    measured = indexed.select("vector").mapInArrow(measure, "node int, i int, j int, low double, high double, short double, long double")
    bounds = measured.groupBy("node", "i", "j").agg(F.min("low"), F.max("high"), F.min("short"), F.max("long"))
    tree.ranges = [_no_ranges(len(n.points)) for n in tree.nodes]
    for at, i, j, low, high, short, long in bounds.collect():  # fan squared per node
        r = tree.ranges[at]
        r.low[i, j], r.high[i, j], r.short[j], r.long[j] = low, high, short, long
    return Index(indexed, tree, width, exact)


def _no_ranges(n: int) -> Ranges:
    return Ranges(np.full((n, n), np.inf), np.full((n, n), -np.inf), np.full(n, np.inf), np.full(n, -np.inf))


class Windows(NamedTuple):
    """What to look for: rows of the anchor's own label or of others, with scores from `low` to `high`."""

    anchors: np.ndarray  # vectors
    ids: np.ndarray  # of the anchors
    labels: list
    of: np.ndarray  # the anchor of each window
    low: np.ndarray
    high: np.ndarray
    same: bool


def best(windows: Windows, at: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, k: int):
    """The first k rows of each of the windows `at`: window, score and id."""
    mine = windows.of[at]
    needed, mine = np.unique(mine, return_inverse=True)
    scores = (windows.anchors[needed] @ vectors.T)[mine]
    own = np.array([windows.labels[a] for a in windows.of[at]], dtype=labels.dtype)
    fits = (own[:, None] == labels[None, :]) == windows.same
    fits &= windows.ids[windows.of[at]][:, None] != ids[None, :]
    fits &= (scores >= windows.low[at][:, None]) & (scores <= windows.high[at][:, None])
    if scores.shape[1] > k:
        worst = np.iinfo(np.int64).min if scores.dtype.kind == "i" else -np.inf
        masked = np.where(fits, scores, worst)
        fits &= masked >= np.partition(masked, -k, axis=1)[:, -k][:, None]
    w, r = np.nonzero(fits)
    return first_of(at[w], scores[w, r].astype(np.int64), ids[r], k)


def first_of(w: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int):
    """Of rows of many windows the first k of each."""
    order = np.lexsort((ids, -score, w))
    w, score, ids = w[order], score[order], ids[order]
    starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.empty(0, np.int64)
    place = np.arange(len(w)) - np.repeat(starts, np.diff(np.append(starts, len(w))))
    keep = place < k
    return w[keep], score[keep], ids[keep]


def scan(index: Index, windows: Windows, visits: dict[int, np.ndarray], k: int) -> DataFrame:
    """The first k rows per window (w, score, id) that each task finds in the leaves to visit."""
    if not visits:
        return index.rows.sparkSession.createDataFrame([], "w int, score bigint, id bigint")
    shared = index.rows.sparkSession.sparkContext.broadcast((windows, visits))
    width, exact = index.width, index.exact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, visits = shared.value
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                part = batch.slice(first, _ROWS)
                leaves, ids = part.column(0).to_numpy(), part.column(1).to_numpy()
                labels = part.column(2).to_numpy(zero_copy_only=False)
                vectors = _unpack(part.column(3), width, exact)
                cuts = np.flatnonzero(np.diff(leaves)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(leaves)]):
                    todo = visits.get(int(leaves[a]), np.empty(0, np.int64)) if b > a else np.empty(0, np.int64)
                    for w in range(0, len(todo), BLOCK):
                        new = best(windows, todo[w : w + BLOCK], ids[a:b], labels[a:b], vectors[a:b], k)
                        held = tuple(np.concatenate(x) for x in zip(held, new))
                if len(held[0]) > 1 << 20:
                    held = first_of(*held, k)
        w, score, ids = first_of(*held, k)
        if len(w):
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.int32()), pa.array(score), pa.array(ids)], names=["w", "score", "id"])

    rows = index.rows.filter(F.col("leaf").isin(sorted(visits)))
    return rows.select("leaf", "id", "label", "vector").mapInArrow(run, "w int, score bigint, id bigint")


def search(index: Index, windows: Windows, home: np.ndarray, k: int) -> DataFrame:
    """The first k rows of every window with their `rank` from 1: the anchors' own leaves first, whose k-th
    score narrows the windows, then the leaves that cannot be ruled out."""
    own = {int(leaf): np.flatnonzero(home[windows.of] == leaf) for leaf in np.unique(home[windows.of])}
    near = stage(scan(index, windows, own, k), "near")
    low = windows.low.copy()
    place = Window.partitionBy("w").orderBy(F.desc("score"), "id")
    ranked = near.withColumn("rank", F.row_number().over(place))
    for w, score in ranked.filter(F.col("rank") == k).select("w", "score").collect():  # one per window
        low[w] = max(low[w], score)
    visits = {}
    for leaf, these in index.tree.reachable(windows.anchors.astype(float), windows.of, low.astype(float), windows.high.astype(float)).items():
        these = these[home[windows.of[these]] != leaf]
        if len(these):
            visits[leaf] = these
    far = scan(index, windows._replace(low=low), visits, k)
    return near.unionByName(far).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def blocks(anchors: DataFrame, size: int) -> Iterator[Column]:
    """Conditions that deal the anchors (leaf, id) to blocks of about `size`, neighbouring leaves together."""
    leaves, held = [], 0
    for leaf, n in sorted(map(tuple, anchors.groupBy("leaf").count().collect())):
        parts = -(-n // size)
        if parts > 1:
            for part in range(parts):
                yield (F.col("leaf") == leaf) & (F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
            continue
        if held + n > size:
            yield F.col("leaf").isin(leaves)
            leaves, held = [], 0
        leaves.append(leaf)
        held += n
    if leaves:
        yield F.col("leaf").isin(leaves)


_RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block: int = BLOCK, **tree: int
) -> DataFrame:
    """Per anchor and each of its first `positives` rows of the same label, the first `negatives` rows of other
    labels whose score is from `low` to `high` per cent of the positive's.

    `is_anchor` is a condition on id.  The blocks' results are written to the shared folder one after another.
    """
    spark = rows.sparkSession
    index = build(rows, **tree)
    if index is None:
        return spark.createDataFrame([], _RESULT)
    anchors = index.rows.filter(is_anchor)
    path = new_path(spark, "negatives")
    spark.createDataFrame([], _RESULT).write.parquet(path)
    for condition in blocks(anchors, block):
        chosen = anchors.filter(condition).orderBy("id").collect()
        vectors = np.frombuffer(b"".join(bytes(r.vector) for r in chosen), np.int64).reshape(len(chosen), index.width)
        vectors = vectors.astype(float) if index.exact else vectors
        ids, home = np.array([r.id for r in chosen], np.int64), np.array([r.leaf for r in chosen])
        all_of = np.arange(len(chosen))
        least, most = np.iinfo(np.int64).min >> 1, np.iinfo(np.int64).max >> 1
        same = Windows(vectors, ids, [r.label for r in chosen], all_of, np.full(len(chosen), least), np.full(len(chosen), most), True)
        found = search(index, same, home, positives).select("w", "id", "score").orderBy("w", "rank").collect()
        # low * p <= 100 * score <= high * p, in whole numbers.
        found = [(w, i, p, -((-low * p) // 100), high * p // 100) for w, i, p in found]
        found = [f for f in found if f[3] <= f[4]]
        if not found:
            continue
        of, floor, ceiling = (np.array([f[c] for f in found], np.int64) for c in (0, 3, 4))
        wanted = same._replace(of=of, low=floor, high=ceiling, same=False)
        pairs = spark.createDataFrame(
            [(k, int(ids[w]), i, p) for k, (w, i, p, _, _) in enumerate(found)], "w int, anchor_id bigint, positive_id bigint, positive_score bigint"
        )
        result = search(index, wanted, home, negatives).join(F.broadcast(pairs), "w").select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        result.coalesce(1 + len(found) * negatives // 100_000).write.mode("append").parquet(path)
    return spark.read.schema(_RESULT).parquet(path)


def quantised(vector: str, factor: int) -> Column:
    """floor(factor * component) of a vector, null if a component is null or not finite."""
    whole = F.transform(vector, lambda x: F.floor(factor * x.cast("double")))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, whole)

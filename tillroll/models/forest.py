"""Random forest as relational steps: binned features, hashed bootstrap weights, trees grown level by level.

A tree is a table of nodes; the children of node i are 2 i + 1 and 2 i + 2.  A level is one aggregate: tasks walk
their rows to the nodes in Arrow batches and count them by (node, feature, bin), the counts are shuffled and summed, and
the best cut of every node follows from running sums over at most `bins` rows.  Hashes decide bootstrap weights and the features a node
tries, counts are whole numbers, and ties go to the first feature and bin, so every run grows the same trees.

Only nodes reach the driver, at most `trees * 2 ** depth` per level, whatever the number of rows.
"""

import functools
import hashlib
import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators.ranking import values_at
from tillroll.staging import stage

BINS = 32
# Cut points of the Poisson distribution with mean 1, scaled to 32 bits: bootstrap weights 0, 1, 2 …
POISSON = [math.floor(2**32 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(8)]
_DIGITS = 6

NODES = "tree int, node int, feature int, cut int, active long, positive long, gain double"


class Forest(NamedTuple):
    features: list[str]
    edges: list[list[float]]  # per feature: a value's bin is the number of edges below it
    weights: tuple[float, float]  # of the two classes
    trees: int
    depth: int
    nodes: DataFrame  # NODES: the feature tried and cut (bins up to it go left), -1 for leaves; rows per class


def edge_ranks(total: int, bins: int) -> list[int]:
    """0-based ranks of the last rows of all bins but the last."""
    return sorted({-(-total * i // bins) - 1 for i in range(1, bins)} - {-1})


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    picked = values_at(rows, features, lambda n: edge_ranks(n, bins))
    return [sorted(set(picked[f][1].values())) for f in features]


def _rounded(feature: str) -> Column:
    """Sums of doubles without the noise of their order."""
    return F.round(F.coalesce(F.col(feature).cast("double"), F.lit(0.0)), _DIGITS)


def bootstrap_weights(keys: Sequence[str | None], seed: int, trees: int) -> np.ndarray:
    """How often each row is drawn for each tree: a Poisson number from a hash."""
    ends = [f"{seed}|{tree}".encode() for tree in range(trees)]
    drawn = np.empty((len(keys), trees), np.uint32)
    for row, key in enumerate(keys):
        begin = b"" if key is None else key.encode() + b"|"
        drawn[row] = np.frombuffer(b"".join([_md5(begin + end).digest()[:4] for end in ends]), ">u4")
    return np.searchsorted(POISSON, drawn.ravel(), side="right").astype(np.uint8).reshape(drawn.shape)


_md5 = functools.partial(hashlib.md5, usedforsecurity=False)


def _binned(columns: Sequence[pa.Array], edges: list[list[float]]) -> np.ndarray:
    """Per feature and row the number of edges below the value."""
    return np.stack([np.searchsorted(cuts, c.to_numpy(zero_copy_only=False)) for c, cuts in zip(columns, edges)]).astype(np.int16)


def tried(features: int, seed: int, tree: int, node: int) -> list[int]:
    """The features a node may cut: the square root of their number, by hash."""
    order = sorted(range(features), key=lambda f: hashlib.md5(f"{seed}|{tree}|{node}|{f}".encode()).hexdigest())
    return order[: max(1, round(math.sqrt(features)))]


def _walk(feature: np.ndarray, cut: np.ndarray, bins: np.ndarray, rows: np.ndarray, levels: int) -> np.ndarray:
    """The node of one tree that each of the given rows reaches after so many levels, or the leaf before."""
    at = np.zeros(len(rows), np.int64)
    for _ in range(levels):
        f = feature[at]
        below = 2 * at + 1 + (bins[np.maximum(f, 0), rows] > cut[at])
        at = np.where(f < 0, at, below)
    return at


def fit(
    rows: DataFrame, key: str, label: str, features: Sequence[str], trees: int = 100, depth: int = 10, bins: int = BINS, seed: int = 42
) -> Forest:
    """Grow `trees` trees on rows with a unique key and a label of 0 or 1; classes weigh the same in total."""
    features, spark = list(features), rows.sparkSession
    plain = rows.select(key, F.col(label).cast("int").alias("_label"), *[_rounded(f).alias(f) for f in features])
    plain = stage(plain.filter("_label IN (0, 1)"), "forest-rows")
    counted = plain.agg(F.count_if(F.col("_label") == 0), F.count_if(F.col("_label") == 1)).first()
    weights = tuple(sum(counted) / (2.0 * n) if n else 0.0 for n in counted)
    edges = bin_edges(plain, features, bins)
    data = stage(_drawn(plain, key, features, edges, trees, seed), "forest-bins")

    nodes: dict[tuple[int, int], list] = {}  # feature, cut, rows per class, gain
    still = [(tree, 0) for tree in range(trees)] if all(counted) else []
    if not still:
        nodes = {(tree, 0): [-1, -1, *counted, 0.0] for tree in range(trees)}
    for level in range(depth):
        if not still:
            break
        opened = sorted(still)  # tree by tree
        grown = _best_cuts(data, _level(nodes, opened, trees, level, len(features), seed), weights, max(map(len, edges)) + 1)
        still = []
        for number, total, best in grown.collect():
            tree, node = opened[number]
            nodes.setdefault((tree, node), [-1, -1, *total, 0.0])
            if best is None:
                continue
            nodes[tree, node][:2] = best["feature"], best["cut"]
            nodes[tree, node][4] = best["score"] - _purity(weights, *total)
            left = (best["n0"], best["n1"])
            right = (total["n0"] - left[0], total["n1"] - left[1])
            for child, (n0, n1) in ((2 * node + 1, left), (2 * node + 2, right)):
                nodes[tree, child] = [-1, -1, n0, n1, 0.0]
                if n0 and n1 and level + 1 < depth:
                    still.append((tree, child))
    table = spark.createDataFrame([(*at, *values) for at, values in nodes.items()], NODES)
    return Forest(features, edges, weights, trees, depth, table)


def _purity(weights, n0, n1) -> float:
    a, b = weights[0] * n0, weights[1] * n1
    return (a * a + b * b) / (a + b)


def _drawn(rows: DataFrame, key: str, features: list[str], edges, trees: int, seed: int) -> DataFrame:
    """Label, bins (two bytes per feature) and bootstrap weights (a byte per tree) of every row."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.ascontiguousarray(_binned([batch.column(f"_x{i}") for i in range(len(edges))], edges).T)
            weights = bootstrap_weights(batch.column("_key").to_pylist(), seed, trees)
            packed = [pa.array([row.tobytes() for row in table], pa.binary()) for table in (bins, weights)]
            yield pa.RecordBatch.from_arrays([batch.column("_label"), *packed], names=["_label", "_bins", "_weights"])

    values = [F.col(f).alias(f"_x{i}") for i, f in enumerate(features)]
    return rows.select("_label", F.col(key).cast("string").alias("_key"), *values).mapInArrow(
        draw, "_label int, _bins binary, _weights binary"
    )


def _unpacked(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


class _Level(NamedTuple):
    """What a task needs to count one level: the nodes above it, and its open nodes, tree by tree."""

    depth: int
    feature: np.ndarray  # tree, node
    cut: np.ndarray
    open: np.ndarray  # tree, node of the level: the number of the open node, -1 if there is none
    tried: np.ndarray  # open node, feature


def _level(nodes, opened, trees: int, level: int, n_features: int, seed: int) -> _Level:
    size = 2**level - 1
    feature, cut = np.full((trees, max(size, 1)), -1, np.int16), np.full((trees, max(size, 1)), -1, np.int16)
    for (tree, node), values in nodes.items():
        if node < size:
            feature[tree, node], cut[tree, node] = values[:2]
    numbers = np.full((trees, size + 1), -1, np.int64)
    for number, (tree, node) in enumerate(opened):
        numbers[tree, node - size] = number
    return _Level(level, feature, cut, numbers, np.array([tried(n_features, seed, tree, node) for tree, node in opened], np.int16))


def _cells(data: DataFrame, level: _Level, bins: int) -> DataFrame:
    """Rows per class, open node, tried feature and bin; each task counts its rows first."""
    shared = data.sparkSession.sparkContext.broadcast(level)
    names = ["_open", "_f", "_bin", "b0", "b1"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depth, feature, cut, opened, features = shared.value
        width = features.shape[1]
        counts = np.zeros((len(features), width, bins, 2), np.int64)
        flat = counts.reshape(-1)
        for batch in batches:
            if not batch.num_rows:
                continue
            label = batch.column("_label").to_numpy()
            placed = np.ascontiguousarray(_unpacked(batch.column("_bins"), np.int16).T)
            weights = np.ascontiguousarray(_unpacked(batch.column("_weights"), np.uint8).T)
            for tree, weight in enumerate(weights):
                mine = opened[tree]
                some = np.flatnonzero(mine >= 0)
                if not len(some):
                    continue
                rows = np.flatnonzero(weight)
                at = _walk(feature[tree], cut[tree], placed, rows, depth) - (2**depth - 1)
                number = np.where(at >= 0, mine[np.maximum(at, 0)], -1)
                rows, number = rows[number >= 0], number[number >= 0]
                # Open nodes of a tree have neighbouring numbers.
                first, last = mine[some[0]], mine[some[-1]] + 1
                for k in range(width):
                    cell = (((number - first) * width + k) * bins + placed[features[number, k], rows]) * 2 + label[rows]
                    size = (last - first) * width * bins * 2
                    found = np.bincount(cell, weights=weight[rows], minlength=size)
                    flat[first * width * bins * 2 : last * width * bins * 2] += found.astype(np.int64)
        filled = np.flatnonzero(counts.any(axis=3))
        number, slot, at_bin = np.unravel_index(filled, counts.shape[:3])
        both = counts.reshape(-1, 2)[filled]
        table = [number, features[number, slot] if len(filled) else number, at_bin]
        for first in range(0, len(filled), 1 << 16):
            part = slice(first, first + (1 << 16))
            columns = [pa.array(c[part].astype(np.int32)) for c in table]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(both[part, c]) for c in (0, 1))], names=names)

    counted = data.mapInArrow(count, "_open int, _f int, _bin int, b0 long, b1 long")
    return counted.groupBy("_open", "_f", "_bin").agg(F.sum("b0").alias("b0"), F.sum("b1").alias("b1"))


def _best_cuts(data: DataFrame, level: _Level, weights, bins: int) -> DataFrame:
    """Open node, rows per class, and the best cut (null if no cut parts the node's rows)."""
    counts = _cells(data, level, bins)
    feature = Window.partitionBy("_open", "_f")
    running = feature.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.select(
        "_open", "_f", "_bin",
        F.sum("b0").over(running).alias("l0"), F.sum("b1").over(running).alias("l1"),
        F.sum("b0").over(feature).alias("n0"), F.sum("b1").over(feature).alias("n1"),
    )

    def purity(n0: Column, n1: Column) -> Column:
        a, b = F.lit(weights[0]) * n0, F.lit(weights[1]) * n1
        return (a * a + b * b) / (a + b)

    l0, l1, n0, n1 = (F.col(c) for c in ("l0", "l1", "n0", "n1"))
    parts = l0 + l1 < n0 + n1
    score = F.when(parts, purity(l0, l1) + purity(n0 - l0, n1 - l1))
    cut = F.struct(
        score.alias("score"), (-F.col("_f")).alias("f"), (-F.col("_bin")).alias("b"), l0.alias("n0"), l1.alias("n1")
    )
    best = sums.groupBy("_open").agg(F.first(F.struct("n0", "n1")).alias("total"), F.max(F.when(parts, cut)).alias("best"))
    return best.select(
        "_open", "total",
        F.when(
            F.col("best").isNotNull(),
            F.struct((-F.col("best.f")).alias("feature"), (-F.col("best.b")).alias("cut"), "best.score", "best.n0", "best.n1"),
        ).alias("best"),
    )


def _grown(forest: Forest) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per tree the feature, the cut and the share of class 1 by node; of bounded size."""
    size = 2 ** (forest.depth + 1) - 1
    by_tree = {}
    for tree, node, feature, cut, n0, n1, _ in forest.nodes.collect():
        arrays = by_tree.setdefault(tree, (np.full(size, -1, np.int16), np.full(size, -1, np.int16), np.zeros(size)))
        a, b = forest.weights[0] * n0, forest.weights[1] * n1
        arrays[0][node], arrays[1][node], arrays[2][node] = feature, cut, b / (a + b) if a + b else 0.0
    return [arrays for _, arrays in sorted(by_tree.items())]


def score(rows: DataFrame, forest: Forest, name: str) -> DataFrame:
    """Add as column `name` the mean share of class 1 over the leaves a row reaches.  Nothing is shuffled."""
    shared = rows.sparkSession.sparkContext.broadcast(_grown(forest))
    edges, trees, depth = forest.edges, forest.trees, forest.depth

    @F.arrow_udf("double")
    def mean(*columns: pa.Array) -> pa.Array:
        bins = _binned(columns, edges)
        total, every = np.zeros(len(columns[0])), np.arange(len(columns[0]))
        for feature, cut, share in shared.value:
            total += share[_walk(feature, cut, bins, every, depth)]
        return pa.array(total / trees)

    return rows.withColumn(name, F.round(mean(*[_rounded(f) for f in forest.features]), 9))


def importance(forest: Forest) -> DataFrame:
    """Share of each feature in the falls of impurity, averaged over the trees: Feature, Importance."""
    spark = forest.nodes.sparkSession
    names = spark.createDataFrame(list(enumerate(forest.features)), "at int, Feature string")
    gains = forest.nodes.filter("feature >= 0").groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
    total = F.sum("gain").over(Window.partitionBy("tree"))
    shares = gains.withColumn("share", F.when(total > 0, F.col("gain") / total).otherwise(0.0))
    mean = shares.groupBy(F.col("feature").alias("at")).agg((F.sum("share") / forest.trees).alias("mean"))
    return names.join(F.broadcast(mean), "at", "left").select("Feature", F.coalesce("mean", F.lit(0.0)).alias("Importance"))

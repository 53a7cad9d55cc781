"""Isolation forest on transaction features (Liu, Ting and Zhou, 2008).

The score quantile is taken over distinct feature tuples, weighted by their rows.  A tree sees a fixed number of rows, whatever the size of the table.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import dates
from tillroll.functions.numbers import safe_ratio
from tillroll.operators.cleaning import DUPLICATE_KEY
from tillroll.operators.ranking import exact_quantiles
from tillroll.staging import stage

FEATURES = ["Quantity", "UnitPrice", "TotalPrice", "Hour", "DayOfWeek"]
TREES = 100
SAMPLE = 256
CONTAMINATION = 0.01

_NODE = "tree int, node int, feature int, threshold double, path double"


def anomaly_features(sales: DataFrame) -> DataFrame:
    """Model inputs next to the identifying columns; rows with a missing input are left out."""
    return sales.select(
        *[c for c in DUPLICATE_KEY if c not in FEATURES],
        "Quantity",
        "UnitPrice",
        "TotalPrice",
        F.hour("InvoiceDate").alias("Hour"),
        dates.day_of_week("InvoiceDate").alias("DayOfWeek"),
    ).dropna(subset=FEATURES)


def _draw(seed: int) -> Column:
    """A hash of what names a row; rows it does not tell apart follow in the order of their features."""
    names = [F.col("InvoiceNo"), F.col("StockCode"), F.col("CustomerID"), F.col("Quantity").cast("string")]
    names.append(F.col("InvoiceDate").cast("string"))
    return F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in names], F.lit(seed)).cast("binary"))


def _sample(rows: DataFrame, wanted: int, seed: int) -> DataFrame:
    """`wanted` rows in the order of a seeded hash, numbered from 0; a bounded heap per task."""
    order = ["draw", *FEATURES]
    chosen = rows.select(*FEATURES, _draw(seed).alias("draw")).orderBy(*order).limit(wanted)
    return chosen.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1)


def _expected_path(size):
    """Mean depth of an unsuccessful search in a binary tree of `size` rows."""
    size = np.asarray(size, dtype=float)
    harmonic = np.log(np.maximum(size - 1, 1)) + np.euler_gamma
    return np.where(size > 2, 2 * harmonic - 2 * (size - 1) / np.maximum(size, 1), np.where(size == 2, 1.0, 0.0))


def leaf_path(depth: int, size: int) -> float:
    """Depth of a leaf and the mean depth that its rows would still have, without the noise of the logarithm."""
    return round(float(depth + _expected_path(size)), 9)


def _grow(tree: int, rows: np.ndarray, height: int, seed: int) -> list[tuple]:
    """Nodes of one random tree; children of node `i` are `2 i + 1` and `2 i + 2`.

    A hash of tree and node picks one of the features that vary, and a threshold in its range.
    """
    nodes, pending = [], [(0, 0, rows)]
    while pending:
        node, depth, part = pending.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(low < high)
        if depth >= height or not len(varying):
            nodes.append((tree, node, -1, 0.0, leaf_path(depth, len(part))))
            continue
        digits = hashlib.md5(f"{seed}|{tree}|{node}".encode()).hexdigest()
        feature = int(varying[int(digits[:8], 16) % len(varying)])
        threshold = float(low[feature] + (high[feature] - low[feature]) * (int(digits[8:16], 16) / 2**32))
        below = part[:, feature] <= threshold
        nodes.append((tree, node, feature, threshold, 0.0))
        pending.append((2 * node + 1, depth + 1, part[below]))
        if not below.all():
            pending.append((2 * node + 2, depth + 1, part[~below]))
    return nodes


def distinct_tuples(rows: DataFrame) -> DataFrame:
    """Distinct feature tuples with their number of rows, staged."""
    return stage(rows.groupBy(*FEATURES).agg(F.count("*").alias("copies")), "tuples")


def fit_forest(rows: DataFrame, total: int, trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> dict:
    """Arrays of all tree nodes: at most `trees * 2 * sample` of them reach the driver.

    Each tree takes the next `sample` rows of one random order, beginning again at its end; all rows
    if there are fewer.
    """
    per_tree = max(1, min(sample, total))
    wanted = max(1, min(total, trees * per_tree))
    places = rows.sparkSession.range(trees * per_tree).select(
        F.floor(F.col("id") / per_tree).cast("int").alias("tree"), (F.col("id") % wanted).cast("int").alias("position")
    )
    chosen = _sample(rows, wanted, seed).join(places, "position")
    height = int(np.ceil(np.log2(max(per_tree, 2))))
    features = FEATURES

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        ordered = group.sort_values("position")[features].to_numpy(dtype=float)
        nodes = _grow(tree, ordered, height, seed)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "path"])

    grown = (
        chosen.groupBy("tree").applyInPandas(grow, _NODE).toPandas()
    )
    shape = (trees, 2 ** (height + 1) - 1)
    forest = {
        "feature": np.full(shape, -1, dtype=np.int32),
        "threshold": np.zeros(shape),
        "path": np.zeros(shape),
        "height": height,
        "scale": float(_expected_path(per_tree)) or 1.0,
    }
    at = (grown["tree"].to_numpy(), grown["node"].to_numpy())
    for name in ("feature", "threshold", "path"):
        forest[name][at] = grown[name].to_numpy()
    # Without rows there are no trees.
    filled = np.unique(at[0])
    for name in ("feature", "threshold", "path"):
        forest[name] = forest[name][filled]
    return forest


def _path_lengths(forest: dict, rows: np.ndarray) -> np.ndarray:
    """Mean path length of each row over all trees, one vectorised level at a time.

    A leaf leads to itself: no value is above its threshold, and the child below is the leaf.
    """
    total = np.zeros(len(rows))
    values, start = rows.ravel(), np.arange(len(rows)) * rows.shape[1]
    for feature, threshold, path in zip(forest["feature"], forest["threshold"], forest["path"]):
        inner = feature >= 0
        places = np.arange(len(feature))
        below = np.where(inner, 2 * places + 1, places)
        column, limit = np.where(inner, feature, 0).astype(np.int64), np.where(inner, threshold, np.inf)
        node = np.zeros(len(rows), dtype=np.int64)
        for _ in range(forest["height"]):
            above = values.take(start + column.take(node)) > limit.take(node)
            node = below.take(node)
            node += above
        total += path.take(node)
    return total / len(forest["feature"])


def scored_rows(rows: DataFrame, forest: dict, name: str = "score") -> DataFrame:
    """Add the score in (0, 1) of every row, in Arrow batches; nothing is shuffled.

    Walking the trees inside the JVM takes a lambda call per tree and level and is many times slower.
    """
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        trees = shared.value
        for batch in batches:
            values = np.column_stack([column.to_numpy(dtype=float) for column in batch])
            yield pd.Series(np.round(np.exp2(-_path_lengths(trees, values) / trees["scale"]), 9))

    return rows.withColumn(name, score(*[F.col(c).cast("double") for c in FEATURES]))


def score_tuples(tuples: DataFrame, forest: dict) -> DataFrame:
    """The same for distinct tuples, written once."""
    return stage(scored_rows(tuples, forest), "scores")


def detect_anomalies(
    sales: DataFrame,
    contamination: float = CONTAMINATION,
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = 42,
) -> DataFrame:
    """Feature rows with `Anomaly`: -1 above the score quantile `1 - contamination`, else 1.

    The quantile is exact over all rows.  Feature rows are staged, so sales are made once, and scored once
    where they are: no join on the features could be skewed by a tuple that many rows share.
    """
    rows = stage(anomaly_features(sales), "features")
    forest = fit_forest(rows, rows.count(), trees, sample, seed)
    scored = stage(scored_rows(rows, forest, "_score"), "scores")
    (cutoff,) = exact_quantiles(scored, "_score", [1 - contamination])
    found = F.when(F.col("_score") > F.lit(cutoff).cast("double"), -1).otherwise(1)
    return scored.withColumn("Anomaly", found).drop("_score")


def flagged(sales: DataFrame, **options) -> DataFrame:
    """The anomalous rows alone."""
    return detect_anomalies(sales, **options).filter("Anomaly = -1")


def _scored(rows, contamination, trees, sample, seed):
    rows = stage(rows, "features")
    tuples = distinct_tuples(rows)
    total = tuples.agg(F.sum("copies")).first()[0] or 0
    forest = fit_forest(rows, total, trees, sample, seed)
    scored = score_tuples(tuples, forest)
    (cutoff,) = exact_quantiles(scored, "score", [1 - contamination], "copies")
    return scored, F.lit(cutoff).cast("double")


def anomaly_summary(
    sales: DataFrame,
    contamination: float = CONTAMINATION,
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = 42,
) -> DataFrame:
    """Rows, flagged rows and rate, means of flagged and normal rows, from the scored tuples."""
    scored, cutoff = _scored(anomaly_features(sales), contamination, trees, sample, seed)
    flagged = F.col("score") > cutoff

    def count(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("copies"))), F.lit(0))

    def mean(column, condition):
        weighted = F.sum(F.when(condition, F.col(column) * F.col("copies")))
        return safe_ratio(weighted * 1.0, F.sum(F.when(condition, F.col("copies"))))

    return scored.agg(
        F.sum("copies").alias("total_transactions"),
        count(flagged).alias("anomalies"),
        safe_ratio(count(flagged) * 1.0, F.sum("copies")).alias("anomaly_rate"),
        mean("Quantity", flagged).alias("avg_quantity_anomalous"),
        mean("Quantity", ~flagged).alias("avg_quantity_normal"),
        mean("TotalPrice", flagged).alias("avg_total_price_anomalous"),
        mean("TotalPrice", ~flagged).alias("avg_total_price_normal"),
    )

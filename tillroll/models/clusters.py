"""K-means on standardised customer features, cluster profiles and names."""

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numbers import half_even, safe_ratio
from tillroll.operators.ranking import rows_at
from tillroll.operators.rollups import as_metrics
from tillroll.schema import CUSTOMER_CLUSTERS
from tillroll.staging import stage

FEATURES = ["Recency", "Frequency", "MonetaryValue", "AvgOrderValue", "TotalQuantity", "CustomerLifespan"]

# Cluster names and the marketing advice for each.
VIP = "💎 VIP Champions"
LOYAL = "⭐ Loyal Customers"
HIGH_VALUE = "🎯 High-Value Buyers"
LOST = "⚠️ At-Risk/Lost"
GROWERS = "🌱 Potential Growers"
STRATEGIES = {
    VIP: "Maintain exclusivity, early access to new products, personal service",
    LOYAL: "Reward loyalty, refer-a-friend program, VIP upgrade path",
    HIGH_VALUE: "Increase frequency with targeted campaigns, bundle offers",
    LOST: "Win-back campaign, special discounts, survey for feedback",
    GROWERS: "Nurture with educational content, small incentives to increase engagement",
}


def standardise(df: DataFrame, columns: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """Add `scaled_<column>`: distance from the mean in population standard deviations.

    A constant column becomes 0.
    """
    filled = df.fillna(0, list(columns))
    moments = filled.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}_dev") for c in columns]
    ).first()
    scaled = {}
    for c in columns:
        mean, deviation = moments[f"{c}_mean"], moments[f"{c}_dev"]
        scaled[f"scaled_{c}"] = (F.col(c) - F.lit(mean)) / F.lit(deviation or 1.0)
    return filled.withColumns(scaled)


# Points are whole millionths of a standard deviation, so that sums are exact in any order.
_UNIT = 1_000_000
_ROUNDS = 100
# Axes along which seeds are dealt, one start each.
_STARTS = ("Recency", "MonetaryValue", "Frequency", "AvgOrderValue", "TotalQuantity", "CustomerLifespan")
_RESTARTS = 2
_AXES = [f"x{i}" for i in range(len(FEATURES))]
_SUMS = ", ".join(["run int", "label int", "n bigint", *(f"{x} bigint" for x in _AXES)])


def _points(features: DataFrame) -> DataFrame:
    """The customers with their standardised features as whole numbers x0, x1 …, written once."""
    scaled = standardise(features)
    return stage(scaled.withColumns({x: F.round(F.col(f"scaled_{c}") * _UNIT).cast("long") for x, c in zip(_AXES, FEATURES)}), "points")


def seed_ranks(total: int, k: int) -> list[int]:
    """0-based ranks of the middle rows of k equal parts."""
    return [(2 * i + 1) * total // (2 * k) for i in range(k)] if total else []


def _seeds(points: DataFrame, ks: Sequence[int], starts: Sequence[str]) -> dict[tuple[str, int], np.ndarray]:
    """Per start and k the points at equal steps along the start's axis; ties go by the other axes and the customer."""
    found = {}
    for start in starts:
        first = _AXES[FEATURES.index(start)]
        order = [first, *[x for x in _AXES if x != first], "CustomerID"]
        total, rows = rows_at(points, order, lambda n: {r for k in ks for r in seed_ranks(n, k)})
        for k in ks:
            found[start, k] = np.array([[float(rows[r][x]) for x in _AXES] for r in seed_ranks(total, k)]).reshape(-1, len(_AXES))
    return found


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The first of the nearest centres; squares are added axis by axis."""
    away = np.zeros((len(rows), len(centres)))
    for axis in range(rows.shape[1]):
        away += (rows[:, axis, None] - centres[None, :, axis]) ** 2
    return away.argmin(axis=1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(x).to_numpy() for x in _AXES]).astype(float)


def lloyd(points: DataFrame, ks: Sequence[int], restarts: int = _RESTARTS, rounds: int = _ROUNDS) -> dict:
    """K-means for several numbers of clusters side by side: (centres, inertia) of the best start per k.

    A round is one pass that sums the points of every cluster per task; one row per cluster reaches the
    driver.  A start is done when its centres, and so its rows, no longer move.  A cluster without rows keeps
    its centre.  Of equal starts the first named is taken.
    """
    centres = _seeds(points, ks, _STARTS[:restarts])
    runs = [run for run in centres if len(centres[run])]
    sizes: dict = {}
    moving = list(runs)
    for _ in range(rounds):
        if not moving:
            break
        moved = []
        sums = _cluster_sums(points, [centres[run] for run in moving])
        for number, run in enumerate(moving):
            new = centres[run].copy()
            sizes[run] = []
            for row in sums.get(number, []):
                new[row.label] = [row[x] / row.n for x in _AXES]
                sizes[run].append((row.n, [row[x] for x in _AXES]))
            if not np.array_equal(new, centres[run]):
                moved.append(run)
            centres[run] = new
        moving = moved
    if moving:  # sizes must belong to the last centres
        sums = _cluster_sums(points, [centres[run] for run in moving])
        sizes |= {run: [(r.n, [r[x] for x in _AXES]) for r in sums.get(i, [])] for i, run in enumerate(moving)}
    squares = points.agg(F.sum(reduce(add, [(F.col(x).cast("decimal(38, 0)") * F.col(x)).cast("decimal(38, 0)") for x in _AXES]))).first()[0]
    best = {}
    for start, k in runs:
        # Sum of squares minus that of the cluster means.
        between = sum(sum(float(s) * float(s) for s in sums) / n for n, sums in sizes[start, k])
        inertia = round((float(squares) - between) / _UNIT**2, 6)
        if k not in best or inertia < best[k][1]:
            best[k] = (centres[start, k], inertia)
    return best


def _cluster_sums(points: DataFrame, centres: list[np.ndarray]) -> dict[int, list]:
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch)
            out = []
            for run, mine in enumerate(shared.value):
                labels = _nearest(rows, mine)
                n = np.bincount(labels, minlength=len(mine))
                sums = [np.bincount(labels, weights=rows[:, a], minlength=len(mine)) for a in range(len(_AXES))]
                out += [(run, c, int(n[c]), *(int(s[c]) for s in sums)) for c in np.flatnonzero(n).tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(v), pa.int32() if i < 2 else pa.int64()) for i, v in enumerate(zip(*out))] if out
                else [pa.array([], pa.int32() if i < 2 else pa.int64()) for i in range(3 + len(_AXES))],
                names=["run", "label", "n", *_AXES],
            )

    sums = points.select(*_AXES).mapInArrow(partial, _SUMS).groupBy("run", "label")
    found: dict[int, list] = {}
    for row in sums.agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in _AXES]).orderBy("run", "label").collect():
        found.setdefault(row.run, []).append(row)
    return found


def _assigned(points: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Adds `labels`: the nearest centre for every k, in the order of `centres`."""
    shared = points.sparkSession.sparkContext.broadcast(list(centres.values()))

    @F.arrow_udf("array<int>")
    def nearest(*axes: pa.Array) -> pa.Array:
        rows = np.column_stack([a.to_numpy() for a in axes]).astype(float)
        labels = np.column_stack([_nearest(rows, mine) for mine in shared.value]).astype(np.int32)
        offsets = np.arange(0, labels.size + 1, labels.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(labels.ravel()))

    return points.withColumn("labels", nearest(*[F.col(x) for x in _AXES]))


def elbow(features: DataFrame, max_k: int = 10, restarts: int = _RESTARTS) -> DataFrame:
    """Inertia and silhouette (squared Euclidean, all customers) for 2 to `max_k` clusters.

    Both follow from the number, the sum and the sum of squares of each cluster's points: one pass finds
    these for all k, a second one the mean silhouettes.
    """
    points = _points(features)
    spark = features.sparkSession
    best = lloyd(points, range(2, max_k + 1), restarts)
    if not best:
        return spark.createDataFrame([], "k int, inertia double, silhouette double")
    ks = list(best)
    labelled = stage(_assigned(points, {k: best[k][0] for k in ks}).select("labels", *_AXES), "labels")
    square = reduce(add, [(F.col(x) / _UNIT) ** 2 for x in _AXES])
    scaled = [(F.col(x) / _UNIT).alias(x) for x in _AXES]
    flat = labelled.select(square.alias("square"), *scaled, F.posexplode("labels").alias("at", "label"))
    stats = flat.groupBy("at", "label").agg(F.count("*").alias("n"), F.sum("square").alias("q"), *[F.sum(x).alias(x) for x in _AXES])
    by_k: dict[int, list] = {}
    for row in stats.orderBy("at", "label").collect():  # one per cluster
        by_k.setdefault(row["at"], []).append(row)
    widths = [_width(ks[at], rows, F.get("labels", F.lit(at))) for at, rows in sorted(by_k.items())]
    means = labelled.select("labels", square.alias("square"), *scaled).agg(*[F.avg(w).alias(str(k)) for k, w in zip(ks, widths)]).first()
    return spark.createDataFrame([(k, best[k][1], means[str(k)]) for k in ks], "k int, inertia double, silhouette double")


def _width(k: int, clusters: list, label: Column) -> Column:
    """Silhouette of a row: mean squared distance to the other points of its cluster and to those of the nearest other."""
    mean = {}
    for c in clusters:
        crossed = reduce(add, [F.col(x) * F.lit(c[x] / c["n"]) for x in _AXES])
        mean[c["label"]] = (F.col("square") - 2 * crossed + F.lit(c["q"] / c["n"]), c["n"])
    nothing = F.lit(None).cast("double")
    inside = F.coalesce(nothing, *[F.when((label == c) & F.lit(n > 1), d * F.lit(n / max(n - 1, 1))) for c, (d, n) in mean.items()])
    outside = F.least(nothing, nothing, *[F.when(label != c, d) for c, (d, _) in mean.items()])
    return F.coalesce(safe_ratio(outside - inside, F.greatest(outside, inside)), F.lit(0.0))


def cluster_customers(features: DataFrame, k: int = 5, restarts: int = _RESTARTS) -> DataFrame:
    """Add `Cluster`, numbered by falling mean value."""
    points = _points(features)
    best = lloyd(points, [k], restarts)
    if not best:
        return features.withColumn("Cluster", F.lit(None).cast("int"))
    assigned = _assigned(points, {k: best[k][0]}).withColumn("Cluster", F.get("labels", F.lit(0)))
    assigned = stage(assigned.select(*features.columns, "Cluster"), "clusters")
    means = assigned.groupBy("Cluster").agg(F.avg("MonetaryValue").alias("value")).collect()
    by_value = sorted(means, key=lambda row: (-row["value"], row["Cluster"]))
    position = F.create_map(*[F.lit(v) for place, row in enumerate(by_value) for v in (row["Cluster"], place)])
    return assigned.withColumn("Cluster", position[F.col("Cluster")])


def silhouette(clustered: DataFrame) -> DataFrame:
    """Mean silhouette of given assignments, as a metric row."""
    vectors = VectorAssembler(inputCols=[f"scaled_{c}" for c in FEATURES], outputCol="features").transform(
        standardise(clustered)
    )
    score = ClusteringEvaluator(featuresCol="features", predictionCol="Cluster").evaluate(vectors.select("features", "Cluster"))
    row = clustered.sparkSession.createDataFrame([(float(score),)], "silhouette double")
    return as_metrics(row, {"silhouette_squared_euclidean": "silhouette"})


def centroid_silhouette(clustered: DataFrame) -> DataFrame:
    """Mean silhouette with plain distances to centroids, as a metric row.

    Every customer is compared with the mean of the own and of the nearest other cluster: one pass
    over all customers, and one row per cluster on the driver.
    """
    scaled = [f"scaled_{c}" for c in FEATURES]
    points = standardise(clustered).select("Cluster", *scaled)
    means = points.groupBy("Cluster").agg(*[F.avg(c).alias(c) for c in scaled]).collect()
    away = {
        m["Cluster"]: F.sqrt(reduce(add, [(F.col(c) - F.lit(m[c])) ** 2 for c in scaled])) for m in means
    }
    nothing = F.lit(None).cast("double")
    inside = F.coalesce(nothing, *[F.when(F.col("Cluster") == k, d) for k, d in away.items()])
    others = [F.when(F.col("Cluster") != k, d) for k, d in away.items()]
    outside = F.least(nothing, nothing, *others)
    width = F.coalesce(safe_ratio(outside - inside, F.greatest(outside, inside)), F.lit(0.0))
    return as_metrics(points.agg(F.avg(width).alias("silhouette")), {"silhouette_centroid": "silhouette"})


def cluster_profile(clustered: DataFrame) -> DataFrame:
    """Size, means, revenue and shares per cluster, with name and advice.

    Shares divide by totals over the profile, which has one row per cluster.
    """
    profile = clustered.groupBy("Cluster").agg(
        F.count("CustomerID").alias("Customers"),
        half_even(F.avg("Recency"), 2).alias("Avg_Recency"),
        half_even(F.avg("Frequency"), 2).alias("Avg_Frequency"),
        half_even(F.avg("MonetaryValue"), 2).alias("Avg_MonetaryValue"),
        half_even(F.sum("MonetaryValue"), 2).alias("Total_Revenue"),
        half_even(F.avg("AvgOrderValue"), 2).alias("Avg_OrderValue"),
        half_even(F.avg("TotalQuantity"), 2).alias("Avg_Quantity"),
        half_even(F.avg("CustomerLifespan"), 2).alias("Avg_Lifespan"),
    )
    return share_of_total(
        share_of_total(profile, "Customers", "Customer_Pct"), "Total_Revenue", "Revenue_Pct"
    ).withColumns({"Cluster_Name": cluster_name()}).withColumn("Strategy", strategy("Cluster_Name"))


def share_of_total(small: DataFrame, value: str, name: str, digits: int = 1) -> DataFrame:
    """Add the percentage of the column's total; for aggregates of a few rows."""
    total = small.agg(F.sum(value)).scalar()
    return small.withColumn(name, half_even(safe_ratio(F.col(value) * 100.0, total), digits))


def cluster_name(recency="Avg_Recency", frequency="Avg_Frequency", money="Avg_MonetaryValue"):
    """Name of a cluster from its means."""
    recency, frequency, money = F.col(recency), F.col(frequency), F.col(money)
    # The limits of each name.
    return (
        F.when((recency < 50) & (frequency > 10) & (money > 3000), VIP)
        .when((recency < 80) & (frequency > 5), LOYAL)
        .when((recency < 100) & (money > 2000), HIGH_VALUE)
        .when(recency > 150, LOST)
        .otherwise(GROWERS)
    )


def strategy(name="Cluster_Name"):
    """Marketing advice for a cluster name."""
    return F.create_map(*[F.lit(part) for pair in STRATEGIES.items() for part in pair])[F.col(name)]


def cluster_sizes(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("Cluster").agg(F.count("*").alias("customers")).orderBy("Cluster")


def labelled_customers(clustered: DataFrame) -> DataFrame:
    """The customer table with cluster ids and names, in the layout of `CUSTOMER_CLUSTERS`.

    The broadcast side has one row per cluster.
    """
    names = cluster_profile(clustered).select("Cluster", F.col("Cluster_Name").alias("ClusterName"))
    return clustered.join(F.broadcast(names), "Cluster", "left").select(*CUSTOMER_CLUSTERS.fieldNames())

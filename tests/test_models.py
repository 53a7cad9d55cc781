import hashlib
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.data import as_dicts, at, transactions
from tillroll.models import anomalies, churn, clusters, forecast, forest, importance


def series(spark, values, name="a"):
    rows = [(name, date(2020, 1, 1) + timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "name string, Date date, Revenue double")


def test_weekly_pattern_with_trend_is_forecast(spark):
    values = [100 + 2 * t + 30 * (t % 7 == 5) - 20 * (t % 7 == 6) for t in range(140)]
    fitted = forecast.holt_winters(series(spark, values), ["name"])
    (errors,) = as_dicts(forecast.forecast_errors(fitted, ["name"]))
    assert errors["mape"] < 2.0
    future = sorted(as_dicts(fitted.filter("part = 'future'")), key=lambda r: r["Date"])
    assert len(future) == 30 and future[0]["Date"] == date(2020, 1, 1) + timedelta(days=140)
    expected = [100 + 2 * t + 30 * (t % 7 == 5) - 20 * (t % 7 == 6) for t in range(140, 170)]
    assert np.abs(np.array([r["forecast"] for r in future]) - expected).max() < 15
    (totals,) = as_dicts(forecast.forecast_totals(fitted, ["name"]))
    assert totals["total"] == pytest.approx(30 * totals["daily_mean"])


def test_arima_finds_the_coefficients(spark):
    random = np.random.default_rng(3)
    changes, noise = [0.0], random.normal(size=1500)
    for t in range(1, 1500):
        changes.append(0.6 * changes[-1] + noise[t] + 0.3 * noise[t - 1])
    values = 1000 + np.cumsum(changes)
    best = forecast.fitted_series(series(spark, values), ["name"], forecast.Arima).first()["_best"]
    ar, ma = best["ar"], best["ma"]
    assert ar == pytest.approx(0.6, abs=0.1) and ma == pytest.approx(0.3, abs=0.12)
    fitted = forecast.arima(series(spark, values), origin=forecast.TRAIN_END)
    first = fitted.filter("part = 'future'").agg(F.min("Date")).first()[0]
    assert first == date(2020, 1, 1) + timedelta(days=1200)


def test_a_short_series_says_so_and_has_no_forecast(spark):
    both = series(spark, range(50)).unionByName(series(spark, [4.0, 6.0], "short"))
    for method in (forecast.arima, forecast.holt_winters):
        future = method(both, ["name"], 5).filter("part = 'future'").groupBy("name", "status")
        counts = {(r["name"], r["status"], r["n"]) for r in future.agg(F.count("forecast").alias("n")).collect()}
        assert counts == {("a", forecast.FITTED, 5), ("short", forecast.TOO_SHORT, 0)}


def test_demand_needs_seven_days(spark):
    rows = [
        {"Description": name, "InvoiceDate": at(f"2020-01-{d:02d} 10:00"), "Quantity": q}
        for name, days, q in (("six", 6, 50), ("seven", 7, 10))
        for d in range(1, days + 1)
    ]
    found = {r["Product"]: r for r in as_dicts(forecast.product_demand(transactions(spark, rows)))}
    assert found["six"]["Forecasted_Demand"] is None and found["six"]["Total_Sold"] == 300
    assert found["seven"]["Forecasted_Demand"] == 10.0


def churn_input(spark, size=200):
    rows = [
        (f"c{i:03d}", 1 + i % 5, 10.0 * (i % 7), 2.0, 3, 200 if i % 4 == 0 else 5, 30 if i % 4 == 0 else 300, int(i % 4 == 0))
        for i in range(size)
    ]
    names = ", ".join(f"{c} double" if c in ("TotalSpent", "AvgOrderValue") else f"{c} long" for c in churn.FEATURES)
    return spark.createDataFrame(rows, f"CustomerID string, {names}, Churned int")


def test_split_keeps_class_shares_and_is_stable(spark):
    data = churn_input(spark)
    split = churn.stratified_split(data)
    sizes = {r["Churned"]: (r["test"], r["all"]) for r in split.groupBy("Churned").agg(F.count_if("is_test").alias("test"), F.count("*").alias("all")).collect()}
    assert sizes == {0: (30, 150), 1: (10, 50)}
    test = {r["CustomerID"] for r in split.filter("is_test").collect()}
    again = {r["CustomerID"] for r in churn.stratified_split(data.repartition(7)).filter("is_test").collect()}
    assert test == again


def test_forest_separates_churned_customers(spark):
    model = churn.fit_churn(churn_input(spark), trees=10, depth=4)
    report = {r["class"]: r for r in as_dicts(churn.evaluate(model))}
    assert report["Churned"]["f1"] == 1.0 and report["Active"]["support"] == 30
    importance = as_dicts(churn.feature_importance(model))
    assert {importance[0]["Feature"], importance[1]["Feature"]} <= {"Recency", "CustomerLifetime"}
    assert churn.at_risk(model.scored).count() == 0
    assert as_dicts(churn.risk_summary(model.scored)) == [{"at_risk_customers": 0, "revenue_at_risk": 0.0}]
    leak_free = churn.fit_churn(churn_input(spark), leak_free=True, trees=5, depth=3)
    assert "Recency" not in leak_free.features


def test_forest_of_one_class_or_nothing(spark):
    data = churn_input(spark).withColumn("Churned", F.lit(0))
    for rows in (data, data.limit(0)):
        grown = forest.fit(rows, "CustomerID", "Churned", ["Recency", "TotalSpent"], trees=3, depth=2)
        assert grown.nodes.filter("feature >= 0").count() == 0
        assert forest.score(data, grown, "p").agg(F.max("p")).first()[0] == 0.0


def test_forest_walks_cuts_as_they_were_counted(spark):
    """Rows per class in every node, counted again by plain steps over bins and bootstrap weights."""
    random = np.random.default_rng(3)
    rows = [(f"k{i}", float(random.integers(0, 9)), None if i % 11 == 0 else float(random.normal()), int(random.random() < 0.3)) for i in range(300)]
    data = spark.createDataFrame(rows, "k string, a double, b double, y int").repartition(3)
    grown = forest.fit(data, "k", "y", ["a", "b"], trees=4, depth=3, bins=8, seed=5)
    nodes = {(n.tree, n.node): n for n in grown.nodes.collect()}
    assert max(n for _, n in nodes) > 2
    counted = {}
    for k, a, b, y in rows:
        bins = [sum(e < round(x or 0.0, 6) for e in cuts) for x, cuts in zip((a, b), grown.edges)]
        for tree in range(4):
            u = int(hashlib.md5(f"{k}|5|{tree}".encode()).hexdigest()[:8], 16)
            at, weight = 0, sum(u >= cut for cut in forest.POISSON)
            while weight:
                counted.setdefault((tree, at), [0, 0])[y] += weight
                node = nodes[tree, at]
                if node.feature < 0:
                    break
                at = 2 * at + 1 + (bins[node.feature] > node.cut)
    assert {at: [n.active, n.positive] for at, n in nodes.items()} == counted


def blobs(spark, per_blob=20):
    random = np.random.default_rng(0)
    rows = []
    for b in range(3):
        for i in range(per_blob):
            jitter = random.normal(scale=0.1, size=6)
            rows.append((f"b{b}-{i}", *[float(100 * b * (c + 1) + jitter[c]) for c in range(6)]))
    return spark.createDataFrame(rows, "CustomerID string, " + ", ".join(f"{c} double" for c in clusters.FEATURES))


def test_kmeans_recovers_blobs_and_orders_them_by_value(spark):
    found = clusters.cluster_customers(blobs(spark), k=3, restarts=3)
    groups = {(r["CustomerID"][:2], r["Cluster"]) for r in found.collect()}
    assert groups == {("b2", 0), ("b1", 1), ("b0", 2)}
    curve = {r["k"]: r for r in as_dicts(clusters.elbow(blobs(spark), max_k=4, restarts=2))}
    assert curve[3]["silhouette"] > 0.99 and curve[3]["inertia"] < curve[2]["inertia"] / 100


def test_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, flat double")
    rows = clusters.standardise(df, ["x", "flat"]).orderBy("x").collect()
    assert [(r["scaled_x"], r["scaled_flat"]) for r in rows] == [(-1.0, 0.0), (1.0, 0.0)]


def test_planted_spikes_are_flagged(spark):
    random = np.random.default_rng(5)
    rows = [
        {"InvoiceNo": str(i), "Quantity": int(random.integers(1, 10)), "UnitPrice": float(random.integers(1, 10)), "InvoiceDate": at("2020-01-06 10:00") + timedelta(hours=int(random.integers(0, 8)), days=int(random.integers(0, 5)))}
        for i in range(2000)
    ]
    rows += [{"InvoiceNo": f"spike{i}", "Quantity": 5000 + i, "UnitPrice": 900.0} for i in range(10)]
    sales = transactions(spark, rows)
    flagged = anomalies.detect_anomalies(sales, trees=50)
    assert flagged.count() == 2010
    spikes = flagged.filter("InvoiceNo LIKE 'spike%'")
    assert spikes.filter("Anomaly = -1").count() == 10
    (summary,) = as_dicts(anomalies.anomaly_summary(sales, trees=50))
    assert summary["total_transactions"] == 2010 and 10 <= summary["anomalies"] <= 21
    assert summary["anomalies"] == flagged.filter("Anomaly = -1").count()
    assert summary["avg_quantity_anomalous"] > 100 * summary["avg_quantity_normal"] / 10


def test_expected_path_length():
    assert anomalies._expected_path([1, 2]).tolist() == [0.0, 1.0]
    assert float(anomalies._expected_path(256)) == pytest.approx(10.24, abs=0.02)


def silhouette_by_pairs(frame, power):
    names = [f"scaled_{c}" for c in clusters.FEATURES]
    points, labels = frame[names].to_numpy(), frame["Cluster"].to_numpy()
    distances = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2)) ** power
    widths = []
    for i, label in enumerate(labels):
        own = labels == label
        if own.sum() == 1:
            widths.append(0.0)
            continue
        inside = distances[i][own].sum() / (own.sum() - 1)
        outside = min(distances[i][labels == other].mean() for other in set(labels) - {label})
        widths.append((outside - inside) / max(inside, outside))
    return np.mean(widths)


def test_silhouettes_equal_all_pairs(spark):
    random = np.random.default_rng(11)
    rows = [(f"c{i}", *map(float, random.normal(size=6)), int(i % 3)) for i in range(60)] + [("alone", *[9.0] * 6, 3)]
    names = ", ".join(f"{c} double" for c in clusters.FEATURES)
    df = spark.createDataFrame(rows, f"CustomerID string, {names}, Cluster int")
    scaled = clusters.standardise(df).toPandas()
    names = [f"scaled_{c}" for c in clusters.FEATURES]
    centres = scaled.groupby("Cluster")[names].mean()
    away = np.sqrt(((scaled[names].to_numpy()[:, None] - centres.to_numpy()[None]) ** 2).sum(axis=2))
    own = scaled["Cluster"].to_numpy()[:, None] == centres.index.to_numpy()[None]
    inside, outside = away[own], np.where(own, np.inf, away).min(axis=1)
    expected = ((outside - inside) / np.maximum(outside, inside)).mean()
    assert clusters.centroid_silhouette(df).first()["number"] == pytest.approx(expected)
    assert clusters.silhouette(df).first()["number"] == pytest.approx(silhouette_by_pairs(scaled, 2))


@pytest.mark.parametrize("n", [1, 50, 700, 5000])
def test_every_tree_has_its_rows_at_any_size(spark, n):
    rows = spark.range(n).select(
        *[F.col("id").cast("string").alias(c) for c in anomalies.DUPLICATE_KEY if c not in anomalies.FEATURES],
        *[(F.col("id") * (k + 3) % 101).cast("double").alias(c) for k, c in enumerate(anomalies.FEATURES)],
    )
    forest = anomalies.fit_forest(rows, n, trees=10)
    assert len(forest["feature"]) == 10
    assert forest["scale"] == (float(anomalies._expected_path(min(256, n))) or 1.0)
    assert forest["height"] == int(np.ceil(np.log2(max(min(256, n), 2))))


def test_a_tuple_that_half_of_all_rows_share(spark):
    base = spark.range(4000).select(
        F.col("id").cast("string").alias("InvoiceNo"), F.lit("s").alias("StockCode"), F.lit("c").alias("CustomerID"),
        F.when(F.col("id") % 2 == 0, 5).when(F.col("id") == 777, 90000).otherwise((F.col("id") % 97).cast("int")).alias("Quantity"),
        F.when(F.col("id") % 2 == 0, 2.0).when(F.col("id") == 777, 9000.0).otherwise(F.col("id") % 13 + 0.5).alias("UnitPrice"),
        F.timestamp_seconds(1_600_000_000 + F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") * 3600)).alias("InvoiceDate"),
    )
    sales = base.withColumn("TotalPrice", F.col("Quantity") * F.col("UnitPrice")).repartition(6)
    found = anomalies.detect_anomalies(sales, trees=20)
    assert found.count() == 4000
    (plan,) = [found._jdf.queryExecution().executedPlan().toString()]
    assert "Join" not in plan  # rows are scored where they are
    odd = {r.InvoiceNo for r in anomalies.flagged(sales, trees=20).collect()}
    assert "777" in odd and len(odd) <= 40
    assert not any(int(i) % 2 == 0 for i in odd)


def test_permuted_inputs_keep_their_values(spark):
    rows = [(str(i), i % 2, float(i) if i % 5 else None, i % 3) for i in range(25)]
    data = spark.createDataFrame(rows, "id string, label int, x double, y int")
    found = importance.permuted(data, "id", ["x", "y"], block=10).collect()
    before = sorted(map(str, (tuple(r[1:]) for r in found if r["Permuted"] is None)))
    assert before == sorted(map(str, rows))
    for name, other in (("x", "y"), ("y", "x")):
        dealt = {r["id"]: r for r in found if r["Permuted"] == name}
        assert sorted(str(r[name]) for r in dealt.values()) == sorted(str(r[name]) for r in data.collect())
        assert all(dealt[i][other] == (x, y)[other == "y"] and dealt[i]["label"] == label for i, label, x, y in rows)
        assert any(dealt[i][name] != (x, y)[name == "y"] for i, _, x, y in rows)
    assert importance.permuted(data.limit(0), "id", ["x"]).isEmpty()


def test_an_input_the_model_reads_matters_and_another_does_not(spark):
    data = spark.range(2000).selectExpr("CAST(id AS string) AS id", "CAST(id % 2 AS int) AS label", "id % 2 AS x", "id % 7 AS y")
    falls = importance.permutation_importance(
        data, lambda rows: rows.withColumn("prediction", F.col("x").cast("int")), "id", "label", ["x", "y"]
    )
    by = {r["Feature"]: r for r in falls.collect()}
    assert 0.4 < by["x"]["Importance"] < 0.6 and by["y"]["Importance"] == 0.0 and by["y"]["Accuracy"] == 1.0


def test_permutation_importance_of_the_churn_forest(spark):
    rows = [(str(i), float(i % 10), float(i % 7), i % 5, i % 3, i % 120, i % 11, int(i % 120 > 90)) for i in range(400)]
    columns = "CustomerID string, TotalSpent double, AvgOrderValue double, PurchaseFrequency int, TotalQuantity int, Recency int, CustomerLifetime int, Churned int"
    model = churn.fit_churn(spark.createDataFrame(rows, columns), trees=10, depth=3)
    falls = as_dicts(churn.permutation_importance(model))
    assert falls[0]["Feature"] == "Recency" and falls[0]["Importance"] > 0.1 and len(falls) == len(churn.FEATURES)


def test_a_level_is_counted_without_repeating_rows_per_tree(spark):
    rows = [(str(i), i % 3 % 2, float(i % 7), float(i % 5)) for i in range(300)]
    edges = [[1.0, 4.0], [2.0]]
    plain = spark.createDataFrame(rows, "k string, y int, a double, b double").withColumn("_label", F.col("y"))
    data = forest._drawn(plain.repartition(3), "k", ["a", "b"], edges, 4, 5)
    level = forest._level({}, [(tree, 0) for tree in range(4)], 4, 0, 2, 5)
    cells = forest._cells(data, level, 3)
    assert "Generate" not in cells._jdf.queryExecution().executedPlan().toString()
    expected = {}
    for key, y, *values in rows:
        for tree in range(4):
            drawn = int(hashlib.md5(f"{key}|5|{tree}".encode()).hexdigest()[:8], 16)
            weight = sum(drawn >= cut for cut in forest.POISSON)
            for f in forest.tried(2, 5, tree, 0):
                cell = expected.setdefault((tree, f, sum(e < values[f] for e in edges[f])), [0, 0])
                cell[y] += weight
    assert {tuple(r)[:3]: list(r)[3:] for r in cells.collect()} == {k: v for k, v in expected.items() if any(v)}


@pytest.mark.parametrize("find", [anomalies.detect_anomalies, anomalies.anomaly_summary])
def test_anomalies_make_sales_once(spark, find):
    lines = transactions(spark, [{"InvoiceNo": str(i), "Quantity": 1 + i % 7} for i in range(40)])
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    assert find(lines.mapInArrow(counted, lines.schema), trees=3).count() in (1, 40)
    assert made.value == 40

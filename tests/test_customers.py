import pytest

from tests.data import as_dicts, at, metrics, transactions
from tillroll.operators import cohorts, customers, explore, ranking, reports


def sale(customer, when, price=10.0, **more):
    return {"CustomerID": customer, "InvoiceDate": at(when), "InvoiceNo": f"{customer}{when}", "UnitPrice": price, **more}


def test_single_purchase_has_no_lifetime_value(spark):
    sales = transactions(
        spark,
        [sale("once", "2020-01-01 10:00"), sale("twice", "2020-01-01 10:00"), sale("twice", "2020-03-01 10:00")],
    )
    clv = customers.lifetime_value(sales)
    values = {r["CustomerID"]: r for r in as_dicts(clv)}
    assert values["once"]["CLV"] == 0.0 and values["once"]["PurchaseFrequency"] is None
    assert values["twice"]["CLV"] == pytest.approx(20.0)
    assert as_dicts(customers.lifetime_value_bands(clv)) == [{"band": "<$100", "customers": 1}]
    summary = metrics(customers.lifetime_value_summary(clv))
    assert summary["avg_purchase_frequency"][0] is None and summary["zero_lifespan_customers"][0] == 1


def test_equal_frequencies_are_scored_by_id(spark):
    sales = transactions(spark, [sale(f"c{i}", f"2020-01-{i + 1:02d} 10:00", 10.0 * (i + 1)) for i in range(10)])
    rfm = {r["CustomerID"]: r for r in as_dicts(customers.rfm_scores(sales))}
    assert [rfm[f"c{i}"]["F_Score"] for i in range(10)] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert rfm["c9"]["Segment"] == "Champions" and rfm["c0"]["RFM_Score"] == 3
    assert rfm["c9"]["Recency"] == 1


def test_reference_date_counts_guests_and_can_be_given(spark):
    sales = transactions(spark, [sale("a", "2020-01-01 10:00"), sale("Guest", "2020-01-11 09:00")])
    assert as_dicts(customers.rfm_scores(sales))[0]["Recency"] == 10
    assert as_dicts(customers.rfm_scores(sales, at("2020-01-03 09:00")))[0]["Recency"] == 1
    assert [r["CustomerID"] for r in as_dicts(customers.rfm_scores(sales))] == ["a"]


def test_churn_label_and_guests(spark):
    sales = transactions(
        spark,
        [sale("Guest", "2020-01-01 10:00"), sale("gone", "2020-01-02 10:00"), sale("here", "2020-04-01 10:00")],
    )
    labels = {r["CustomerID"]: r["Churned"] for r in as_dicts(customers.churn_features(sales))}
    assert labels == {"Guest": 1, "gone": 0, "here": 0}


def test_cluster_features_drop_guests_and_refunds(spark):
    tx = transactions(
        spark,
        [sale("Guest", "2020-01-01 10:00"), sale("a", "2020-01-01 10:00"), sale("b", "2020-01-01 10:00", Quantity=-1)],
    )
    assert [r["CustomerID"] for r in as_dicts(customers.cluster_features(tx))] == ["a"]


def test_histogram_has_all_bins_and_closes_the_last(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.99,), (10.0,)], "v double")
    assert [r["rows"] for r in sorted(as_dicts(customers.histogram(df, "v", 10)), key=lambda r: r["bin"])] == [
        1, 1, 0, 0, 0, 0, 0, 0, 0, 2,
    ]
    flat = as_dicts(customers.histogram(df.filter("v = 1"), "v", 2))
    assert sorted((r["lower"], r["rows"]) for r in flat) == [(0.5, 0), (1.0, 1)]


def test_cohorts(spark):
    sales = transactions(
        spark,
        [
            sale("a", "2019-12-31 10:00"),
            sale("a", "2020-01-01 10:00"),
            sale("b", "2019-12-01 10:00"),
            sale("c", "2020-01-05 10:00"),
            sale("Guest", "2019-11-01 10:00"),
        ],
    )
    found = {(r["CohortMonth"], r["CohortIndex"]): (r["CustomerCount"], r["RetentionPct"]) for r in as_dicts(cohorts.retention(sales))}
    assert found == {("2019-12", 0): (2, 100.0), ("2019-12", 1): (1, 50.0), ("2020-01", 0): (1, 100.0)}
    summary = metrics(cohorts.retention_summary(cohorts.retention(sales)))
    assert summary["best_cohort"] == (2.0, "2019-12") and summary["avg_month1_retention"][0] == 50.0
    every = cohorts.retention_matrix(cohorts.retention(sales))
    assert every.columns == ["CohortMonth", *(f"month_{k}" for k in range(len(every.columns) - 1))]
    (first, second) = as_dicts(cohorts.retention_matrix(cohorts.retention(sales), [0, 1]))
    assert (first["month_1"], second["month_1"]) == (50.0, None)
    (row, _) = as_dicts(reports.cohort_retention(sales))
    assert (row["Month_0"], row["Month_1"], row["Retention_M1"], row["Retention_M2"]) == (2, 1, 50.0, 0.0)


def test_segments_use_calendar_days(spark):
    tx = transactions(spark, [sale("a", "2020-03-01 23:00"), sale("Guest", "2020-03-03 01:00")])
    (row,) = as_dicts(reports.customer_segments(tx))
    assert row["AvgDaysSinceLast"] == 2.0


def test_idxmax_takes_the_first_on_a_tie(spark):
    sales = transactions(spark, [sale("b", "2020-01-01 10:00"), sale("a", "2020-01-01 10:00")])
    assert metrics(explore.customers(sales))["top_customer"] == (10.0, "a")


def test_customers_of_equal_value_are_ties_whatever_the_order_of_their_sums(spark):
    prices = [0.1, 0.2, 0.3]
    rows = [{"CustomerID": c, "InvoiceNo": c, "UnitPrice": p} for c, order in (("b", prices), ("a", prices[::-1])) for p in order]
    tx = transactions(spark, rows).coalesce(1)
    ranked = ranking.number_rows(customers.customer_aggregate(tx), [("MonetaryValue", False), "CustomerID"], "rank")
    assert {r["CustomerID"]: r["rank"] for r in ranked.collect()} == {"a": 1, "b": 2}

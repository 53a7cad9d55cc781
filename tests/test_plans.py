"""Physical plans of registered queries that must hold at any size."""

import pytest

import __spark_entry__ as driver

CHECKED = [
    "q1_revenue_by_country",
    "q4_customer_segments",
    "q6_top_customers",
    "q7_product_affinity",
    "q8_cohort_retention",
    "r1_rfm_scores",
    "w3_rank_first",
    "x1_top_pairs",
    "e7_insights",
    "p7_top_values",
    "m8_product_demand",
    "d1_kpis",
]


def nodes_above(plan, name):
    lines = plan.split("\n")
    return [(lines[i - 1], lines[i + 1]) for i, line in enumerate(lines) if name in line and i]


@pytest.mark.parametrize("name", CHECKED)
def test_no_crossing_and_no_table_in_one_task(spark, name):
    df = driver.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for above, below in nodes_above(plan, "SinglePartition"):
        # Partial aggregates may meet in one task, and so may the sizes of range partitions.
        assert "Aggregate" in above or "_run" in below


def test_columns_and_filters_reach_the_scan(spark):
    df = driver.queries()["b2_month_totals"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "p_name" not in plan.split("part.parquet")[1] and "n_name" not in plan
    # The report reads no text, so duplicates are found by a hash aggregate.
    assert "SortAggregate" not in plan


@pytest.mark.parametrize("name", ["v1_lifetime_value", "h1_cohort_matrix"])
def test_sales_are_found_without_their_texts(spark, name):
    df = driver.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "p_name" not in plan and "n_name" not in plan


@pytest.mark.parametrize("name", ["e1_revenue_series", "e2_products", "e5_time_patterns", "d2_revenue_trend"])
def test_sales_are_built_once(spark, name):
    def scans(key):
        df = driver.queries()[key](spark, "/root/testdata/sf0.001")
        return df._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet")

    assert scans(name) == scans("q1_revenue_by_country")


@pytest.mark.parametrize("name", ["e6_summary_panels", "e7_insights", "e8_viewer", "x1_top_pairs", "x2_affinity_summary", "m8_product_demand"])
def test_several_reports_read_staged_sales(spark, name):
    df = driver.queries()[name](spark, "/root/testdata/sf0.001")
    assert "lineitem.parquet" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["p6_distinct_values", "c11_cleaned_kpis"])
def test_distinct_counts_copy_no_rows(spark, name):
    df = driver.queries()[name](spark, "/root/testdata/sf0.001")
    assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_forecast_shuffles_each_series_once(spark):
    df = driver.queries()["m1_arima"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "Pandas" not in plan


def test_the_centroid_silhouette_has_a_name_of_its_own():
    names = [n for n in driver.queries() if n.startswith("k5_")]
    assert "k5_centroid_silhouette" in names and "k5_euclidean_silhouette" not in names
    assert "k5_centroid_silhouette" in driver.oracle_sql()

"""Times headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores).  Queries named `stored_*`
read the cleaned table that `clean_and_write` wrote; all others start from the base tables.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from tillroll.operators import baskets, cohorts, customers, dashboard, explore, reports
from tillroll.plans import catalogue
from tillroll.plans.registry import Frames
from tillroll.sources import tables
from tillroll.staging import clear, new_path

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 2

FROM_BASE_TABLES = [
    "b1_country_totals",
    "b2_month_totals",
    "q1_revenue_by_country",
    "q2_monthly_trends",
    "q3_top_products",
    "q4_customer_segments",
    "q5_hourly_patterns",
    "q6_top_customers",
    "q7_product_affinity",
    "q8_cohort_retention",
    "c9_cleaning_summary",
    "p8_quality_issues",
    "r1_rfm_scores",
    "v1_lifetime_value",
    "h1_cohort_matrix",
    "x1_top_pairs",
    "e1_revenue_trends",
    "m8_product_demand",
    "m2_holt_winters_by_country",
    "m1_arima_by_country",
    "e6_summary_panels",
    "e7_insights",
    "x2_affinity_summary",
    "p6_distinct_values",
]


def stored_queries(tx):
    sales = tx.filter("NOT IsReturn")
    return {
        "stored_b1": lambda: reports.country_totals(tx),
        "stored_b2": lambda: reports.month_totals(tx),
        "stored_q1": lambda: reports.revenue_by_country(tx),
        "stored_q4": lambda: reports.customer_segments(tx),
        "stored_q7": lambda: baskets.product_affinity(tx),
        "stored_q8": lambda: reports.cohort_retention(tx),
        "stored_r1": lambda: customers.rfm_scores(sales),
        "stored_h1": lambda: cohorts.retention(sales),
        "stored_e7": lambda: explore.insights(sales),
        "stored_d1": lambda: dashboard.kpis(dashboard.filter_sales(sales, "1996-01-01", "1999-06-30")),
    }


def main():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def best_of(build):
        seconds = []
        for _ in range(REPEATS):
            started = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - started)
        return round(min(seconds), 3)

    timings = {}
    for name in FROM_BASE_TABLES:
        timings[name] = best_of(lambda: catalogue.QUERIES[name](spark, FOLDER))
    path = new_path(spark, "bench")
    started = time.perf_counter()
    tables.write_transactions(Frames(spark, FOLDER).tx, path)
    timings["clean_and_write"] = round(time.perf_counter() - started, 3)
    for name, build in stored_queries(tables.read_transactions(spark, path)).items():
        timings[name] = best_of(build)
    clear(spark)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()

"""The analysis as jobs: read a table, run the operators, write one result per operator.

    spark-submit --py-files tillroll.zip tillroll/jobs.py clean RAW OUT
    python -m tillroll.jobs reports OUT/transactions RESULTS
"""

import argparse
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tillroll.models import anomalies, churn, clusters, forecast
from tillroll.operators import baskets, cleaning, cohorts, customers, explore, profiling, reports
from tillroll.sources import tables
from tillroll.staging import clear


def _write_all(results: Mapping[str, DataFrame], folder: str) -> None:
    for name, df in results.items():
        tables.write_result(df, f"{folder}/{name}")


def clean(spark: SparkSession, source: str, folder: str, kind: str = "parquet") -> None:
    """Raw table to cleaned table, sales table and cleaning report."""
    raw = tables.read_raw(spark, source, kind)
    tables.write_cleaned(raw, f"{folder}/transactions")
    # From here on the written table is read, so cleaning runs once.
    tx = tables.read_transactions(spark, f"{folder}/transactions")
    tables.write_sales(tx, f"{folder}/sales")
    _write_all(
        {
            "cleaning_summary": cleaning.cleaning_summary(raw),
            "validation": cleaning.validate(tx),
            "cleaned_kpis": cleaning.cleaned_kpis(tx),
        },
        folder,
    )


def append(spark: SparkSession, source: str, folder: str, kind: str = "parquet") -> None:
    """More raw lines into the tables that `clean` wrote (or the first ones); only their months are written again."""
    months = tables.append_transactions(tables.read_raw(spark, source, kind), f"{folder}/transactions")
    if months:
        tables.append_sales(spark, f"{folder}/transactions", f"{folder}/sales", months)


def profile(spark: SparkSession, source: str, folder: str, kind: str = "parquet") -> None:
    """Profile of the raw table."""
    raw = tables.read_raw(spark, source, kind)
    _write_all(
        {
            "overview": profiling.overview(raw),
            "first_rows": profiling.preview(raw),
            "last_rows": profiling.preview(raw, last=True),
            "column_nulls": profiling.column_nulls(raw),
            "missing_values": profiling.missing_values(raw),
            "numeric_summary": profiling.numeric_summary(raw),
            "distinct_values": profiling.distinct_values(raw),
            "top_values": profiling.top_values(raw),
            "quality_issues": profiling.quality_issues(raw),
            "cancellations": profiling.cancellations(raw),
            "country_rows": profiling.country_rows(raw),
        },
        folder,
    )


def report(spark: SparkSession, source: str, folder: str) -> None:
    """The report catalogue over cleaned transactions."""
    tx = tables.read_transactions(spark, source)
    _write_all(
        {
            "revenue_by_country": reports.revenue_by_country(tx),
            "monthly_trends": reports.monthly_trends(tx),
            "top_products": reports.top_products(tx),
            "customer_segments": reports.customer_segments(tx),
            "hourly_patterns": reports.hourly_patterns(tx),
            "top_customers": reports.top_customers(tx),
            "product_affinity": baskets.product_affinity(tx),
            "cohort_retention": reports.cohort_retention(tx),
            "business_kpis": reports.business_kpis(tx),
        },
        folder,
    )


def explore_sales(spark: SparkSession, source: str, folder: str) -> None:
    """Exploratory key figures, panels and rankings over sales."""
    sales = tables.read_transactions(spark, source)
    _write_all(
        {
            "insights": explore.insights(sales),
            "summary_panels": explore.summary_panels(sales),
            "top_products": explore.top_products(sales),
            "top_customers": explore.top_customers(sales),
            "countries": explore.country_totals(sales),
            "hourly": explore.hourly(sales),
            "weekdays": explore.weekday_revenue(sales),
        },
        folder,
    )


def customer_analytics(spark: SparkSession, source: str, folder: str) -> None:
    """Scores, lifetime value, cohorts and baskets over sales."""
    sales = tables.read_transactions(spark, source)
    tables.write_result(customers.rfm_scores(sales), f"{folder}/rfm", "parquet")
    tables.write_result(customers.lifetime_value(sales), f"{folder}/lifetime_value", "parquet")
    rfm = spark.read.parquet(f"{folder}/rfm")
    clv = spark.read.parquet(f"{folder}/lifetime_value")
    retention = cohorts.retention(sales)
    _write_all(
        {
            "rfm_summary": customers.rfm_summary(rfm),
            "rfm_insights": customers.rfm_insights(rfm),
            "lifetime_value_summary": customers.lifetime_value_summary(clv),
            "lifetime_value_bands": customers.lifetime_value_bands(clv),
            "retention": retention,
            "retention_matrix": cohorts.retention_matrix(retention),
            "retention_summary": cohorts.retention_summary(retention),
            "top_pairs": baskets.top_pairs(baskets.best_seller_pairs(sales)),
            "affinity_summary": baskets.affinity_summary(sales),
        },
        folder,
    )


def predict(spark: SparkSession, source: str, folder: str) -> None:
    """Forecasts, churn, demand and anomalies over sales."""
    sales = tables.read_transactions(spark, source)
    tables.write_result(forecast.daily_series(sales), f"{folder}/daily_series", "parquet")
    series = spark.read.parquet(f"{folder}/daily_series")
    arima, smoothed = forecast.arima(series), forecast.holt_winters(series)
    tables.write_result(forecast.daily_series(sales, "Country"), f"{folder}/daily_series_by_country", "parquet")
    by_country = spark.read.parquet(f"{folder}/daily_series_by_country")
    model = churn.fit_churn(customers.churn_features(sales))
    _write_all(
        {
            "arima_forecast": arima,
            "arima_errors": forecast.forecast_errors(arima),
            "holt_winters_forecast": smoothed,
            "holt_winters_errors": forecast.forecast_errors(smoothed),
            "holt_winters_totals": forecast.forecast_totals(smoothed),
            "arima_forecast_by_country": forecast.arima(by_country, ["Country"]),
            "holt_winters_forecast_by_country": forecast.holt_winters(by_country, ["Country"]),
            "churn_report": churn.evaluate(model),
            "churn_feature_importance": churn.feature_importance(model),
            "churn_permutation_importance": churn.permutation_importance(model),
            "at_risk_customers": churn.at_risk(model.scored),
            "churn_risk": churn.risk_summary(model.scored),
            "demand_forecast": forecast.product_demand(sales),
            "anomaly_summary": anomalies.anomaly_summary(sales),
            "anomalous_transactions": anomalies.flagged(sales),
        },
        folder,
    )


def cluster(spark: SparkSession, source: str, folder: str, table: str | None = None) -> None:
    """Customer clusters over cleaned transactions; `table` names a catalog table to replace by them."""
    features = customers.cluster_features(tables.read_transactions(spark, source))
    found = clusters.cluster_customers(features)
    tables.write_result(clusters.labelled_customers(found), f"{folder}/customer_clusters", "parquet")
    labelled = tables.read_clusters(spark, f"{folder}/customer_clusters")
    if table:
        tables.replace_table(labelled, table)
    _write_all(
        {
            "elbow": clusters.elbow(features),
            "cluster_profile": clusters.cluster_profile(found),
            "cluster_sizes": clusters.cluster_sizes(found),
            "silhouette": clusters.silhouette(found).unionByName(clusters.centroid_silhouette(found)),
            "cluster_rollup": reports.cluster_rollup(labelled),
            "cluster_personas": reports.cluster_personas(labelled),
        },
        folder,
    )


JOBS = {
    "clean": clean,
    "append": append,
    "profile": profile,
    "reports": report,
    "explore": explore_sales,
    "customers": customer_analytics,
    "predict": predict,
    "clusters": cluster,
}


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("job", choices=JOBS)
    parser.add_argument("source", help="table to read")
    parser.add_argument("folder", help="folder for the results")
    parser.add_argument("--kind", default="parquet", help="format of the raw table (clean, append, profile)")
    parser.add_argument("--table", help="catalog table to replace by the clustered customers (clusters)")
    chosen = parser.parse_args()
    spark = SparkSession.builder.getOrCreate()
    try:
        options = {"kind": chosen.kind} if chosen.job in ("clean", "append", "profile") else {}
        options |= {"table": chosen.table} if chosen.job == "clusters" else {}
        JOBS[chosen.job](spark, chosen.source, chosen.folder, **options)
    finally:
        clear(spark)


if __name__ == "__main__":
    main()

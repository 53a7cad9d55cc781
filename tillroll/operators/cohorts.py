"""Customers grouped by the month of their first purchase."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import dates
from tillroll.functions.numbers import safe_ratio
from tillroll.operators import rollups
from tillroll.schema import GUEST


def _month_of(index: Column) -> Column:
    return F.make_date(F.floor((index - 1) / 12).cast("int"), (index - 1) % 12 + 1, F.lit(1))


def activity_months(tx: DataFrame) -> DataFrame:
    """One row per registered customer and month with a purchase, next to the cohort.

    Tasks reduce the transactions to distinct customers and months before the shuffle.  The
    first month is then the minimum over a customer's few months, so neither the window nor
    a join back sees the transactions.
    """
    months = (
        tx.filter(F.col("CustomerID") != GUEST)
        .select("CustomerID", dates.month_index("InvoiceDate").alias("month"))
        .distinct()
        .withColumn("first", F.min("month").over(Window.partitionBy("CustomerID")))
    )
    return months.select(
        "CustomerID",
        _month_of(F.col("first")).alias("CohortMonth"),
        _month_of(F.col("month")).alias("PurchaseMonth"),
        (F.col("month") - F.col("first")).alias("CohortIndex"),
    )


def retention(sales: DataFrame) -> DataFrame:
    """Customers per cohort and month offset, and their share of the cohort.

    The window runs over the aggregate: one row per cohort and offset.
    """
    counts = (
        activity_months(sales)
        .groupBy(dates.year_month("CohortMonth").alias("CohortMonth"), "CohortIndex")
        .agg(F.count("*").alias("CustomerCount"))
    )
    size = F.first_value("CustomerCount").over(Window.partitionBy("CohortMonth").orderBy("CohortIndex"))
    return counts.withColumn("CohortSize", size).withColumn(
        "RetentionPct", safe_ratio(F.col("CustomerCount") * 100.0, F.col("CohortSize"))
    )


def retention_matrix(
    cohorts: DataFrame, offsets: Sequence[int] | None = None, value: str = "RetentionPct"
) -> DataFrame:
    """One row per cohort, one column per offset; null where nobody came.

    Without a list, all offsets up to the largest in the data, which is bounded by the months it spans.
    """
    if offsets is None:
        offsets = range((cohorts.agg(F.max("CohortIndex")).first()[0] or 0) + 1)
    pivoted = cohorts.groupBy("CohortMonth").pivot("CohortIndex", list(offsets)).agg(F.first(value))
    renamed = [F.col(f"`{offset}`").alias(f"month_{offset}") for offset in offsets]
    return pivoted.select("CohortMonth", *renamed).orderBy(F.col("CohortMonth").asc_nulls_last())


def retention_summary(cohorts: DataFrame) -> DataFrame:
    """Cohorts, mean retention after one and three months, and the largest cohort."""

    def mean_after(month):
        return F.coalesce(F.avg(F.when(F.col("CohortIndex") == month, F.col("RetentionPct"))), F.lit(0.0))

    starts = cohorts.withColumn("_size", F.when(F.col("CohortIndex") == 0, F.col("CustomerCount")))
    by_size = F.when(F.col("_size").isNotNull(), F.struct(-F.col("_size"), F.col("CohortMonth")))
    totals = starts.agg(
        F.count("_size").alias("cohorts"),
        mean_after(1).alias("month1"),
        mean_after(3).alias("month3"),
        F.min_by("CohortMonth", by_size).alias("largest"),
        F.max("_size").alias("size"),
    )
    return rollups.as_metrics(
        totals,
        {
            "total_cohorts": "cohorts",
            "avg_month1_retention": "month1",
            "avg_month3_retention": "month3",
            "best_cohort": "size",
        },
        {"best_cohort": "largest"},
    )

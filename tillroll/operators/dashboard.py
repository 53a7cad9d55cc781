"""Frames behind the interactive page: filter once, then aggregate."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.dates import moment
from tillroll.functions.numbers import as_printed, half_even, safe_ratio
from tillroll.functions.text import count_label, money_label
from tillroll.operators import explore, rollups
from tillroll.schema import GUEST

EVERY = "All"


def filter_sales(
    sales: DataFrame,
    start=None,
    end=None,
    country: str = EVERY,
    product: str = EVERY,
    customer_type: str = EVERY,
) -> DataFrame:
    """Conjunction of the chosen filters.

    A date without a time is the midnight that starts it, also as the end of the range.
    """
    if start is not None:
        sales = sales.filter(F.col("InvoiceDate") >= moment(start))
    if end is not None:
        sales = sales.filter(F.col("InvoiceDate") <= moment(end))
    if country != EVERY:
        sales = sales.filter(F.col("Country") == country)
    if product != EVERY:
        sales = sales.filter(F.col("Description") == product)
    if customer_type == "Guest":
        sales = sales.filter(F.col("CustomerID") == GUEST)
    elif customer_type == "Registered":
        sales = sales.filter(F.col("CustomerID") != GUEST)
    return sales


def kpis(sales: DataFrame) -> DataFrame:
    """Revenue, rows, customers and mean invoice total; zeros when nothing is left."""
    zero = F.lit(0.0)
    return rollups.invoice_rollup(sales).agg(
        F.coalesce(F.sum("revenue"), zero).alias("total_revenue"),
        F.coalesce(F.sum("lines"), F.lit(0)).alias("total_transactions"),
        rollups.customers().alias("total_customers"),
        F.coalesce(safe_ratio(F.sum("revenue"), rollups.orders()), zero).alias("avg_order_value"),
    )


def top_products(sales: DataFrame, n: int = 10) -> DataFrame:
    return explore.top_products(sales, n)


def top_countries(sales: DataFrame, n: int = 10) -> DataFrame:
    totals = sales.groupBy("Country").agg(F.sum("TotalPrice").alias("Revenue"))
    return rollups.top(totals, n, "Revenue", "Country")


def hourly_revenue(sales: DataFrame) -> DataFrame:
    return sales.groupBy("Hour").agg(F.sum("TotalPrice").alias("Revenue"))


def segment_summary(clusters: DataFrame) -> DataFrame:
    """Customers and averages per cluster name, with display labels.

    Money is summed as decimals, so that a half is one whatever the order of the rows.
    """
    money = F.sum(F.col("MonetaryValue").cast("decimal(28,6)"))
    rounded = (
        clusters.groupBy("ClusterName")
        .agg(
            F.count("CustomerID").alias("Customers"),
            half_even(money, 2).cast("double").alias("Total_Revenue"),
            half_even(money.cast("double") / F.count("MonetaryValue"), 2).alias("Avg_Revenue"),
            half_even(F.avg("Frequency"), 2).alias("Avg_Frequency"),
            half_even(F.avg("Recency"), 2).alias("Avg_Recency"),
        )
    )
    return rounded.withColumns(
        {
            "Customers_Label": count_label(F.col("Customers")),
            "Total_Revenue_Label": money_label(F.col("Total_Revenue")),
            "Avg_Revenue_Label": money_label(F.col("Avg_Revenue")),
            "Avg_Recency_Label": F.format_string("%.0f days", as_printed(F.col("Avg_Recency"), 0)),
            "Avg_Frequency_Label": F.format_string("%.1f orders", as_printed(F.col("Avg_Frequency"), 1)),
        }
    )


def stable_sample(df: DataFrame, key: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """At most `n` rows in the order of a seeded hash of the key."""
    return df.orderBy(F.md5(F.concat_ws("|", key, F.lit(seed))), key).limit(n)

"""The report catalogue over cleaned transactions, returns included."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import dates
from tillroll.functions.numbers import half_up, safe_ratio
from tillroll.operators import rollups
from tillroll.operators.customers import customer_aggregate, customer_table, registered
from tillroll.operators.cohorts import activity_months
from tillroll.operators.ranking import ntile
from tillroll.schema import POSTAGE


def revenue_by_country(tx: DataFrame, min_revenue: float = 10000.0, n: int = 10) -> DataFrame:
    invoices = rollups.invoice_rollup(tx, F.col("Country"))
    countries = invoices.groupBy("Country").agg(
        rollups.orders().alias("Orders"),
        rollups.customers().alias("Customers"),
        F.sum("revenue").alias("Revenue"),
        rollups.average_line().alias("AvgOrderValue"),
        F.sum("units").alias("TotalUnits"),
    )
    return rollups.top(countries.filter(F.col("Revenue") > min_revenue), n, "Revenue", "Country")


def monthly_trends(tx: DataFrame) -> DataFrame:
    invoices = rollups.invoice_rollup(tx, dates.month_start("InvoiceDate").alias("Month"))
    return (
        invoices.groupBy("Month")
        .agg(
            rollups.orders().alias("Orders"),
            rollups.customers().alias("Customers"),
            F.sum("revenue").alias("Revenue"),
            rollups.average_line().alias("AvgTransaction"),
            F.sum("units").alias("Units"),
        )
        .orderBy("Month")
    )


def top_products(tx: DataFrame, n: int = 15) -> DataFrame:
    described = tx.filter(F.col("Description").isNotNull() & (F.col("Description") != POSTAGE))
    products = described.groupBy(F.col("Description").alias("Product")).agg(
        F.count_distinct("InvoiceNo").alias("TimesSold"),
        F.sum("Quantity").alias("UnitsSold"),
        half_up(F.avg("UnitPrice"), 2).alias("AvgPrice"),
        half_up(F.sum("TotalPrice"), 2).alias("TotalRevenue"),
    )
    return rollups.top(products, n, "TotalRevenue", "Product")


def customer_segments(tx: DataFrame, buckets: int = 5) -> DataFrame:
    """Recency and frequency tiles of registered customers, rolled up to segments.

    Money is reported but does not decide the segment, so it is not tiled.  Days since the last purchase are calendar days up to the last sale of any customer.
    Equal values are tiled by CustomerID.
    """
    everyone = customer_table(tx)
    newest = everyone.agg(F.max("LastPurchase")).scalar()
    members = registered(everyone).select(
        "CustomerID",
        "Frequency",
        "MonetaryValue",
        dates.calendar_days(newest, F.col("LastPurchase")).alias("Recency"),
    )
    scored = members.withColumns(
        {
            "R": ntile(members, [("Recency", False), "CustomerID"], buckets),
            "F": ntile(members, ["Frequency", "CustomerID"], buckets),
        }
    )
    recent, frequent = F.col("R"), F.col("F")
    # Segment names and the tiles they start at.
    segment = (
        F.when((recent >= 4) & (frequent >= 4), "Champions")
        .when((recent >= 3) & (frequent >= 3), "Loyal")
        .when((recent >= 3) & (frequent < 3), "Potential")
        .when((recent < 3) & (frequent >= 3), "At Risk")
        .otherwise("Lost")
    )
    return (
        scored.groupBy(segment.alias("Segment"))
        .agg(
            F.count("*").alias("Customers"),
            half_up(F.avg("MonetaryValue"), 2).alias("AvgRevenue"),
            half_up(F.sum("MonetaryValue"), 2).alias("TotalRevenue"),
            half_up(F.avg("Frequency"), 1).alias("AvgOrders"),
            half_up(F.avg("Recency"), 0).alias("AvgDaysSinceLast"),
        )
        .orderBy(F.desc("TotalRevenue"))
    )


def hourly_patterns(tx: DataFrame, n: int = 20) -> DataFrame:
    """Busiest hours of the week; sums are exact, so a half is rounded alike in every run."""
    slots = tx.groupBy(
        F.hour("InvoiceDate").alias("Hour"), dates.day_name("InvoiceDate").alias("DayOfWeek")
    ).agg(
        F.count_distinct("InvoiceNo").alias("Orders"),
        half_up(F.sum(F.col("TotalPrice").cast("decimal(28,8)")).cast("double"), 2).alias("Revenue"),
        half_up(F.avg("TotalPrice"), 2).alias("AvgTransaction"),
    )
    return rollups.top(slots, n, "Revenue", "Hour", "DayOfWeek")


def top_customers(tx: DataFrame, min_orders: int = 5, n: int = 20) -> DataFrame:
    """Registered customers by lifetime value.

    The rank is a number over the same sort as the limit, so it is given after the limit:
    the window sees `n` rows.
    """
    members = customer_aggregate(registered(tx)).filter(F.col("Frequency") >= min_orders)
    best = rollups.top(members, n, "MonetaryValue", "CustomerID")
    position = F.row_number().over(Window.orderBy(F.desc("MonetaryValue"), "CustomerID"))
    return best.select(
        "CustomerID",
        F.col("Frequency").alias("TotalOrders"),
        half_up("MonetaryValue", 2).alias("LifetimeValue"),
        half_up("AvgOrderValue", 2).alias("AvgOrderValue"),
        "FirstPurchase",
        "LastPurchase",
        dates.calendar_days("LastPurchase", "FirstPurchase").alias("CustomerLifespanDays"),
        position.alias("Rank"),
    )


def cohort_retention(tx: DataFrame, months: int = 3) -> DataFrame:
    """Customers of each first-purchase month that bought again 1 to `months` months later."""
    active = activity_months(tx)
    later = range(1, months + 1)

    def came_back(month):
        return F.count_if(F.col("CohortIndex") == month)

    counts = active.groupBy("CohortMonth").agg(
        came_back(0).alias("Month_0"), *[came_back(m).alias(f"Month_{m}") for m in later]
    )
    rates = {
        f"Retention_M{m}": half_up(safe_ratio(F.col(f"Month_{m}") * 100.0, F.nullif("Month_0", F.lit(0))), 1)
        for m in later
    }
    return counts.withColumns(rates).orderBy("CohortMonth")


def country_totals(tx: DataFrame) -> DataFrame:
    """Benchmark: revenue per country."""
    return tx.groupBy("Country").agg(F.sum("TotalPrice").alias("Revenue")).orderBy(F.desc("Revenue"), "Country")


def month_totals(tx: DataFrame) -> DataFrame:
    """Benchmark: lines and revenue per month."""
    return (
        tx.groupBy(dates.month_start("InvoiceDate").alias("Month"))
        .agg(F.count("*").alias("Orders"), F.sum("TotalPrice").alias("Revenue"))
        .orderBy("Month")
    )


def business_kpis(tx: DataFrame) -> DataFrame:
    return rollups.invoice_rollup(tx).agg(
        rollups.orders().alias("total_orders"),
        rollups.customers().alias("total_customers"),
        F.sum("revenue").alias("total_revenue"),
        rollups.average_line().alias("avg_transaction"),
    )


def cluster_rollup(clusters: DataFrame) -> DataFrame:
    return (
        clusters.groupBy("ClusterName")
        .agg(
            F.count("*").alias("customers"),
            F.sum("MonetaryValue").alias("revenue"),
            F.avg("MonetaryValue").alias("avg_value"),
            F.avg("Recency").alias("avg_recency"),
            F.avg("Frequency").alias("avg_frequency"),
        )
        .orderBy(F.desc("revenue"), "ClusterName")
    )


def cluster_personas(clusters: DataFrame) -> DataFrame:
    return (
        clusters.groupBy("ClusterName")
        .agg(
            F.count("*").alias("customer_count"),
            half_up(F.avg("MonetaryValue"), 2).alias("avg_lifetime_value"),
            half_up(F.avg("Frequency"), 1).alias("avg_orders"),
            half_up(F.avg("Recency"), 0).alias("avg_days_since_purchase"),
            half_up(F.avg("AvgOrderValue"), 2).alias("avg_order_size"),
            half_up(F.sum("MonetaryValue"), 2).alias("total_revenue"),
        )
        .orderBy(F.desc("total_revenue"), "ClusterName")
    )


def cluster_sample(clusters: DataFrame, n: int = 5) -> DataFrame:
    """First customers by id."""
    return clusters.select("CustomerID", "Cluster", "ClusterName", "MonetaryValue").orderBy("CustomerID").limit(n)

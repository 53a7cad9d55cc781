"""Customer-level aggregates: value, recency, loyalty."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions import dates
from tillroll.functions.numbers import finite_or_zero, right_closed_band, safe_ratio
from tillroll.operators import rollups
from tillroll.operators.ranking import (
    exact_quantiles,
    quantiles_of,
    inner_fractions,
    quantile_score,
    rank_quantile_score,
)
from tillroll.schema import GUEST
from tillroll.staging import stage

CHURN_DAYS = 90
DAYS_PER_MONTH = 30.0
_MONEY_DIGITS = 6

# Lower edges and labels of the lifetime value bands.
CLV_EDGES = [0, 100, 500, 1000, 5000]
CLV_LABELS = ["<$100", "$100-500", "$500-1K", "$1K-5K", ">$5K"]


def registered(df: DataFrame) -> DataFrame:
    return df.filter(F.col("CustomerID") != GUEST)


def customer_aggregate(tx: DataFrame) -> DataFrame:
    """Orders, money, units and purchase dates per customer.

    The distinct count groups by customer and invoice before it groups by customer, so a
    customer with a large share of all rows is spread over its invoices first.  Money is
    without the noise of the order of its sum, so that customers of equal value are ties.
    """
    return tx.groupBy("CustomerID").agg(
        F.count_distinct("InvoiceNo").alias("Frequency"),
        F.round(F.sum("TotalPrice"), _MONEY_DIGITS).alias("MonetaryValue"),
        F.avg("TotalPrice").alias("AvgOrderValue"),
        F.sum("Quantity").alias("TotalQuantity"),
        F.min("InvoiceDate").alias("FirstPurchase"),
        F.max("InvoiceDate").alias("LastPurchase"),
    )


def customer_table(tx: DataFrame) -> DataFrame:
    """The same, written once for the operators that read it several times."""
    return stage(customer_aggregate(tx), "customers")


def _newest(customers: DataFrame) -> Column:
    """Last sale of any customer, as a scalar subquery on the staged table."""
    return customers.agg(F.max("LastPurchase")).scalar()


def rfm_scores(sales: DataFrame, reference_date=None, buckets: int = 5) -> DataFrame:
    """Recency, frequency and money scores, their sum and a segment per registered customer.

    Recency and money are cut at their quantiles.  Frequency has too many equal values for
    that, so its row number is cut; equal frequencies are numbered by CustomerID.
    """
    everyone = customer_table(sales)
    if reference_date is None:
        reference = _newest(everyone) + F.expr("INTERVAL 1 DAY")
    else:
        reference = dates.moment(reference_date)
    members = registered(everyone).select(
        "CustomerID",
        dates.elapsed_days(reference, F.col("LastPurchase")).alias("Recency"),
        "Frequency",
        F.col("MonetaryValue").alias("Monetary"),
    )
    cuts = inner_fractions(buckets)
    edges = quantiles_of(members, ["Recency", "Monetary"], cuts)
    recency_bin = quantile_score(F.col("Recency"), edges["Recency"])
    money_bin = quantile_score(F.col("Monetary"), edges["Monetary"])
    frequency_bin = rank_quantile_score(members, ["Frequency", "CustomerID"], buckets)
    scored = members.withColumns(
        {"R_Score": F.lit(buckets + 1) - recency_bin, "F_Score": frequency_bin, "M_Score": money_bin}
    ).withColumn("RFM_Score", F.col("R_Score") + F.col("F_Score") + F.col("M_Score"))
    score = F.col("RFM_Score")
    # Segment names and the lowest score of each.
    segment = (
        F.when(score >= 13, "Champions")
        .when(score >= 11, "Loyal Customers")
        .when(score >= 9, "Potential Loyalists")
        .when(score >= 7, "Recent Customers")
        .when(score >= 5, "At Risk")
        .otherwise("Lost")
    )
    return scored.withColumn("Segment", segment)


def rfm_summary(rfm: DataFrame) -> DataFrame:
    """Customers and money per segment, with averages."""
    return (
        rfm.groupBy("Segment")
        .agg(
            F.count("*").alias("customers"),
            F.sum("Monetary").alias("revenue"),
            F.avg("Recency").alias("avg_recency"),
            F.avg("Frequency").alias("avg_frequency"),
            F.avg("Monetary").alias("avg_monetary"),
        )
        .orderBy(F.desc("revenue"))
    )


def rfm_insights(rfm: DataFrame) -> DataFrame:
    """Totals over all segments as metrics."""

    def members(segment):
        return F.count_if(F.col("Segment") == segment)

    totals = rfm.agg(
        F.count("*").alias("total_customers_analyzed"),
        members("Champions").alias("champions_count"),
        F.coalesce(F.sum(F.when(F.col("Segment") == "Champions", F.col("Monetary"))), F.lit(0.0)).alias(
            "champions_revenue"
        ),
        members("At Risk").alias("at_risk_count"),
        members("Lost").alias("lost_count"),
        F.avg("Recency").alias("avg_recency"),
        F.avg("Frequency").alias("avg_frequency"),
        F.avg("Monetary").alias("avg_monetary"),
    )
    return rollups.as_metrics(totals, {name: name for name in totals.columns})


def lifetime_value(sales: DataFrame) -> DataFrame:
    """Average order value times monthly frequency times months of life, per registered customer.

    A customer who bought on one day only has no frequency, hence value 0.
    """
    per_customer = (
        registered(sales)
        .groupBy("CustomerID")
        .agg(
            F.count_distinct("InvoiceNo").alias("PurchaseCount"),
            F.sum("TotalPrice").alias("TotalRevenue"),
            dates.elapsed_days(F.max("InvoiceDate"), F.min("InvoiceDate")).alias("LifespanDays"),
        )
    )
    return (
        per_customer.withColumn("LifespanMonths", F.col("LifespanDays") / DAYS_PER_MONTH)
        .withColumn("AvgOrderValue", safe_ratio("TotalRevenue", "PurchaseCount"))
        .withColumn("PurchaseFrequency", safe_ratio("PurchaseCount", "LifespanMonths"))
        .withColumn(
            "CLV", finite_or_zero(F.col("AvgOrderValue") * F.col("PurchaseFrequency") * F.col("LifespanMonths"))
        )
        .select(
            "CustomerID",
            "PurchaseCount",
            "TotalRevenue",
            "LifespanDays",
            "AvgOrderValue",
            "PurchaseFrequency",
            "LifespanMonths",
            "CLV",
        )
    )


def lifetime_value_summary(clv: DataFrame) -> DataFrame:
    """Mean, exact median, maximum and total value.

    The mean frequency is infinite as soon as one customer has no lifespan: it is null then,
    next to the number of such customers.
    """
    clv = stage(clv, "clv")
    (median,) = exact_quantiles(clv, "CLV", [0.5])
    without_life = F.count_if(F.col("LifespanDays") == 0)
    totals = clv.agg(
        F.avg("CLV").alias("avg_clv"),
        F.lit(median).cast("double").alias("median_clv"),
        F.max("CLV").alias("top_clv"),
        F.avg("AvgOrderValue").alias("avg_order_value"),
        F.when(without_life == 0, F.avg("PurchaseFrequency")).alias("avg_purchase_frequency"),
        without_life.alias("zero_lifespan_customers"),
        F.sum("CLV").alias("total_customer_value"),
    )
    return rollups.as_metrics(totals, {name: name for name in totals.columns})


def lifetime_value_bands(clv: DataFrame) -> DataFrame:
    """Customers per value band; a value of 0 lies in none."""
    band = right_closed_band(F.col("CLV"), CLV_EDGES, CLV_LABELS)
    return clv.groupBy(band.alias("band")).agg(F.count("*").alias("customers")).filter("band IS NOT NULL")


def top_lifetime_values(clv: DataFrame, n: int = 20) -> DataFrame:
    return rollups.top(clv, n, "CLV", "CustomerID")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Rows per equal-width bin between minimum and maximum, the last bin closed.

    One grouping by value feeds both the range and the counts; empty bins are listed.
    """
    values = stage(df.groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("copies")), "values")
    values = values.filter("value IS NOT NULL")
    extent = values.agg(F.min("value").alias("low"), F.max("value").alias("high"))
    # A single value gets the unit interval around it.
    flat = F.col("low") == F.col("high")
    low = extent.select(F.when(flat, F.col("low") - 0.5).otherwise(F.col("low"))).scalar()
    high = extent.select(F.when(flat, F.col("high") + 0.5).otherwise(F.col("high"))).scalar()
    counted = (
        values.select(F.least(F.width_bucket("value", low, high, F.lit(bins)), F.lit(bins)).alias("bin"), "copies")
        .groupBy("bin")
        .agg(F.sum("copies").alias("rows"))
    )
    width = (high - low) / bins
    edges = df.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin"))
    return edges.join(counted, "bin", "left").select(
        "bin",
        (low + (F.col("bin") - 1) * width).alias("lower"),
        (low + F.col("bin") * width).alias("upper"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


def churn_features(sales: DataFrame, churn_days: int = CHURN_DAYS) -> DataFrame:
    """Model inputs per customer, guests as one customer, labelled by days since the last purchase."""
    everyone = customer_table(sales)
    recency = dates.elapsed_days(_newest(everyone), F.col("LastPurchase"))
    return everyone.select(
        "CustomerID",
        F.col("Frequency").alias("PurchaseFrequency"),
        F.col("MonetaryValue").alias("TotalSpent"),
        "AvgOrderValue",
        "TotalQuantity",
        "FirstPurchase",
        "LastPurchase",
        recency.alias("Recency"),
        dates.elapsed_days(F.col("LastPurchase"), F.col("FirstPurchase")).alias("CustomerLifetime"),
        F.when(recency > churn_days, 1).otherwise(0).alias("Churned"),
    )


def churn_distribution(features: DataFrame) -> DataFrame:
    churned = F.count_if(F.col("Churned") == 1)
    return features.agg(
        F.count_if(F.col("Churned") == 0).alias("active"),
        churned.alias("churned"),
        (safe_ratio(churned * 100.0, F.count("*"))).alias("churn_rate_pct"),
    )


def cluster_features(tx: DataFrame) -> DataFrame:
    """Model inputs per registered customer with positive value, returns netted."""
    everyone = customer_table(tx)
    return (
        registered(everyone)
        .filter(F.col("MonetaryValue") > 0)
        .select(
            "CustomerID",
            "Frequency",
            "MonetaryValue",
            "AvgOrderValue",
            "TotalQuantity",
            "FirstPurchase",
            "LastPurchase",
            dates.elapsed_days(_newest(everyone), F.col("LastPurchase")).alias("Recency"),
            dates.elapsed_days(F.col("LastPurchase"), F.col("FirstPurchase")).alias("CustomerLifespan"),
        )
    )

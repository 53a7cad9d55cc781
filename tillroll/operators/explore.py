"""Exploratory reports over sales.

Key figures come as `(metric, number, label)` rows; series and rankings as their own frames.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import dates
from tillroll.functions.numbers import safe_ratio
from tillroll.operators import rollups
from tillroll.schema import GUEST, WEEKDAYS

# The country whose revenue is not international.
HOME_COUNTRY = "United Kingdom"

# What `summary_panels` and `insights` read of sales, for callers that store it first.
READ_COLUMNS = [
    "InvoiceNo", "InvoiceDate", "CustomerID", "StockCode", "Description", "Country", "Quantity", "TotalPrice", "Hour",
    "DayOfWeek", "DayName",
]

_GRAINS = {
    "Daily": lambda: F.date_format("InvoiceDate", "yyyy-MM-dd"),
    "Weekly": lambda: dates.week_label("InvoiceDate"),
    "Monthly": lambda: dates.year_month("InvoiceDate"),
}


def _revenue() -> Column:
    return F.sum("TotalPrice")


def revenue_series(sales: DataFrame, grain: str = "Monthly") -> DataFrame:
    """Revenue per day, week (`monday/sunday`) or month."""
    period = _GRAINS[grain]().alias("Date")
    return sales.groupBy(period).agg(_revenue().alias("Revenue")).orderBy("Date")


def all_series(sales: DataFrame) -> DataFrame:
    """The series of all grains, from one daily aggregate."""
    daily = daily_revenue(sales).withColumnRenamed("Date", "InvoiceDate")
    grains = [F.struct(F.lit(name).alias("grain"), period().alias("Date"), "Revenue") for name, period in _GRAINS.items()]
    return daily.select(F.inline(F.array(*grains))).groupBy("grain", "Date").agg(F.sum("Revenue").alias("Revenue"))


def _by_each(rolled: DataFrame, keys: dict[str, str], *values: str, named: str | None = None) -> DataFrame:
    """Sums of an aggregate by each of several keys, as rows of `side` and `key`; its source is read once."""
    extra = [F.lit(None).cast("string").alias("name")] if named is None else [F.col(named).alias("name")]
    sides = [F.struct(F.lit(side).alias("side"), F.col(key).alias("key"), *extra, *values) for side, key in keys.items()]
    sums = [F.sum(value).alias(value) for value in values]
    return rolled.select(F.inline(F.array(*sides))).groupBy("side", "key").agg(F.max("name").alias("name"), *sums)


def daily_revenue(sales: DataFrame) -> DataFrame:
    return sales.groupBy(F.to_date("InvoiceDate").alias("Date")).agg(_revenue().alias("Revenue"))


def revenue_trends(sales: DataFrame) -> DataFrame:
    """Total, daily and monthly averages and extremes, all from one daily aggregate."""
    months = (
        daily_revenue(sales)
        .groupBy(dates.year_month("Date").alias("Month"))
        .agg(
            F.sum("Revenue").alias("Revenue"),
            F.count("*").alias("Days"),
            F.max("Revenue").alias("BestDay"),
            F.min("Revenue").alias("WorstDay"),
        )
    )
    totals = months.agg(
        F.sum("Revenue").alias("total"),
        safe_ratio(F.sum("Revenue"), F.sum("Days")).alias("daily_avg"),
        F.max("BestDay").alias("daily_max"),
        F.min("WorstDay").alias("daily_min"),
        F.avg("Revenue").alias("monthly_avg"),
        rollups.largest("Month", "Revenue").alias("best"),
        F.max("Revenue").alias("best_revenue"),
        rollups.smallest("Month", "Revenue").alias("worst"),
        F.min("Revenue").alias("worst_revenue"),
    )
    plain = ["total", "daily_avg", "daily_max", "daily_min", "monthly_avg"]
    return rollups.as_metrics(
        totals,
        {**{name: name for name in plain}, "best_month": "best_revenue", "worst_month": "worst_revenue"},
        {"best_month": "best", "worst_month": "worst"},
    )


def product_totals(sales: DataFrame) -> DataFrame:
    return sales.groupBy("Description").agg(_revenue().alias("Revenue"), F.sum("Quantity").alias("Quantity"))


def top_products(sales: DataFrame, n: int = 20, by: str = "Revenue") -> DataFrame:
    """Products with most `Revenue` or `Quantity`."""
    return rollups.top(product_totals(sales), n, by, "Description").select(
        F.col("Description").alias("Product"), by
    )


def products(sales: DataFrame) -> DataFrame:
    """Distinct stock codes, mean product revenue, best products by revenue and quantity.

    One aggregate by product and code is counted by code and by product side by side.
    """
    rolled = sales.groupBy("Description", "StockCode").agg(_revenue().alias("Revenue"), F.sum("Quantity").alias("Quantity"))
    sides = _by_each(rolled, {"code": "StockCode", "product": "Description"}, "Revenue", "Quantity")
    product = F.col("side") == "product"

    def best(value):
        order = F.struct(-F.col(value), F.col("key"))
        return F.min_by("key", F.when(product, order))

    totals = sides.agg(
        F.count_if(~product & F.col("key").isNotNull()).alias("codes"),
        best("Revenue").alias("by_revenue"),
        F.max(F.when(product, F.col("Revenue"))).alias("revenue"),
        F.avg(F.when(product, F.col("Revenue"))).alias("mean"),
        best("Quantity").alias("by_quantity"),
        F.max(F.when(product, F.col("Quantity"))).alias("quantity"),
    )
    return rollups.as_metrics(
        totals,
        {"total_unique": "codes", "top_product": "revenue", "avg_product_revenue": "mean", "top_quantity_product": "quantity"},
        {"top_product": "by_revenue", "top_quantity_product": "by_quantity"},
    )


def top_customers(sales: DataFrame, n: int = 20) -> DataFrame:
    """Customers with most revenue, guests as one."""
    return rollups.top(
        sales.groupBy("CustomerID").agg(_revenue().alias("Revenue")), n, "Revenue", "CustomerID"
    )


def customers(sales: DataFrame) -> DataFrame:
    """Guests against registered buyers, the top customer, mean revenue and frequency."""
    each = sales.groupBy("CustomerID").agg(
        F.count("*").alias("rows"),
        _revenue().alias("Revenue"),
        F.count_distinct("InvoiceNo").alias("Orders"),
    )
    guest = F.col("CustomerID") == GUEST

    def share(column, condition):
        return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0))

    totals = each.agg(
        F.count("*").alias("total_unique"),
        share("rows", guest).alias("guest_transactions"),
        share("rows", ~guest).alias("registered_transactions"),
        share("Revenue", guest).alias("guest_revenue"),
        share("Revenue", ~guest).alias("registered_revenue"),
        rollups.largest("CustomerID", "Revenue").alias("top"),
        F.max("Revenue").alias("top_revenue"),
        F.avg("Revenue").alias("avg_customer_revenue"),
        F.avg("Orders").alias("avg_purchase_frequency"),
    )
    plain = [c for c in totals.columns if c not in ("top", "top_revenue")]
    return rollups.as_metrics(
        totals, {**{name: name for name in plain}, "top_customer": "top_revenue"}, {"top_customer": "top"}
    )


def country_totals(sales: DataFrame) -> DataFrame:
    return sales.groupBy("Country").agg(_revenue().alias("Revenue"), F.count("*").alias("Transactions"))


def geography(sales: DataFrame, home: str = HOME_COUNTRY) -> DataFrame:
    """Countries, the top market and its share, revenue outside the home country."""
    totals = country_totals(sales).agg(
        F.count("Country").alias("countries"),
        rollups.largest("Country", "Revenue").alias("top"),
        F.max("Revenue").alias("top_revenue"),
        safe_ratio(F.max("Revenue") * 100.0, F.sum("Revenue")).alias("share"),
        F.coalesce(F.sum(F.when(F.col("Country") != home, F.col("Revenue"))), F.lit(0.0)).alias("abroad"),
    )
    return rollups.as_metrics(
        totals,
        {
            "total_countries": "countries",
            "top_country": "top_revenue",
            "top_country_share": "share",
            "international_revenue": "abroad",
        },
        {"top_country": "top"},
    )


def top_with_others(totals: DataFrame, key: str, value: str, n: int = 5, others: str = "Others") -> DataFrame:
    """The `n` largest keys and one row for all the rest.

    The rest is the difference to the total, so nothing needs to be ranked beyond `n`.
    """
    best = rollups.top(totals.select(key, value), n, value, key)
    beyond = (
        totals.agg(F.sum(value).alias("all"), F.count("*").alias("keys"))
        .filter(F.col("keys") > n)
        .select(F.lit(others).alias(key), (F.col("all") - best.agg(F.sum(value)).scalar()).alias(value))
    )
    return best.unionByName(beyond)


def hourly(sales: DataFrame) -> DataFrame:
    return sales.groupBy("Hour").agg(_revenue().alias("Revenue"), F.count("*").alias("Transactions"))


def weekday_revenue(sales: DataFrame) -> DataFrame:
    """Revenue per weekday, Monday first, null for a day without sales."""
    week = sales.sparkSession.createDataFrame(list(enumerate(WEEKDAYS, start=1)), "position int, Day string")
    totals = sales.groupBy(F.col("DayName").alias("Day")).agg(_revenue().alias("Revenue"))
    return week.join(totals, "Day", "left").select("position", "Day", "Revenue").orderBy("position")


def time_patterns(sales: DataFrame) -> DataFrame:
    """Peak and slowest hour, best and worst weekday, from one hour by weekday aggregate."""
    slots = sales.groupBy("Hour", "DayOfWeek", "DayName").agg(_revenue().alias("Revenue"))
    # Days are known by their place in the week; of equal days the first wins.
    sides = _by_each(slots, {"hour": "Hour", "day": "DayOfWeek"}, "Revenue", named="DayName")

    def of(side):
        def only(column):
            return F.when(F.col("side") == side, column)

        label = F.col("name") if side == "day" else F.col("key").cast("string")
        return [
            F.min_by(label, only(F.struct(-F.col("Revenue"), F.col("key")))).alias(f"most_{side}"),
            F.max(only(F.col("Revenue"))).alias(f"most_{side}_revenue"),
            F.min_by(label, only(F.struct(F.col("Revenue"), F.col("key")))).alias(f"least_{side}"),
            F.min(only(F.col("Revenue"))).alias(f"least_{side}_revenue"),
        ]

    names = {"peak_hour": "most_hour", "slowest_hour": "least_hour", "best_day": "most_day", "worst_day": "least_day"}
    return rollups.as_metrics(
        sides.agg(*of("hour"), *of("day")), {metric: f"{name}_revenue" for metric, name in names.items()}, names
    )


def guest_split(sales: DataFrame) -> DataFrame:
    """Revenue of guests and of registered customers; both rows always exist."""
    guest = F.col("CustomerID") == GUEST

    def part(name, condition):
        revenue = F.coalesce(F.sum(F.when(condition, F.col("TotalPrice"))), F.lit(0.0))
        return F.struct(F.lit(name).alias("CustomerType"), revenue.alias("Revenue"))

    return sales.agg(F.array(part("Guest", guest), part("Registered", ~guest)).alias("parts")).select(
        F.inline("parts")
    )


def summary_kpis(sales: DataFrame) -> DataFrame:
    """Revenue, rows, customers, products and mean invoice total."""
    rolled = sales.groupBy("InvoiceNo", "CustomerID", "StockCode").agg(
        F.count("*").alias("lines"), _revenue().alias("revenue")
    )
    totals = rolled.agg(
        F.sum("revenue").alias("total_revenue"),
        F.sum("lines").alias("total_transactions"),
        rollups.customers().alias("total_customers"),
        F.count_distinct("StockCode").alias("total_products"),
        safe_ratio(F.sum("revenue"), rollups.orders()).alias("avg_transaction"),
    )
    return rollups.as_metrics(totals, {name: name for name in totals.columns})


def _as_panel(panel: str, df: DataFrame, key: str, value: str = "Revenue") -> DataFrame:
    return df.select(F.lit(panel).alias("panel"), F.col(key).cast("string").alias("key"), F.col(value).alias("value"))


def summary_panels(sales: DataFrame, n: int = 5) -> DataFrame:
    """The executive summary as `(panel, key, value)` rows.

    Every panel scans its columns of sales, so sales should be a stored table.
    """
    panels = [
        _as_panel("kpi", summary_kpis(sales), "metric", "number"),
        _as_panel("monthly", revenue_series(sales, "Monthly"), "Date"),
        _as_panel("products", top_products(sales, n), "Product"),
        _as_panel("countries", rollups.top(country_totals(sales), n, "Revenue", "Country"), "Country"),
        _as_panel("hourly", hourly(sales), "Hour"),
        _as_panel("customers", guest_split(sales), "CustomerType"),
    ]
    return reduce(DataFrame.unionByName, panels)


def insights(sales: DataFrame, home: str = HOME_COUNTRY) -> DataFrame:
    """All exploratory key figures with their section; every section scans its columns of sales, a stored table."""
    sections = {
        "revenue": revenue_trends(sales),
        "products": products(sales),
        "customers": customers(sales),
        "geography": geography(sales, home),
        "time_patterns": time_patterns(sales),
    }
    parts = [df.select(F.lit(name).alias("section"), "metric", "number", "label") for name, df in sections.items()]
    return reduce(DataFrame.unionByName, parts)


def table_counts(tx: DataFrame) -> DataFrame:
    """Rows, sales and returns of the cleaned table."""
    returns = F.count_if("IsReturn")
    return tx.agg(
        F.count("*").alias("total_transactions"),
        (F.count("*") - returns).alias("sales_only"),
        returns.alias("returns"),
    )


def category_choices(totals: DataFrame, key: str, n: int | None = None, every: str = "All") -> DataFrame:
    """`All` followed by the sorted keys, or by the sorted `n` keys with most revenue."""
    keys = totals if n is None else rollups.top(totals, n, "Revenue", key)
    literal = totals.sparkSession.createDataFrame([(0, every)], "position int, choice string")
    listed = keys.select(F.lit(1).alias("position"), F.col(key).alias("choice")).distinct()
    return literal.unionByName(listed).orderBy("position", "choice")


def rolling_mean(df: DataFrame, value: str, series, order: str, window: int) -> Column:
    """Mean of the last `window` observations of each series, null while there are fewer."""
    frame = Window.partitionBy(*series).orderBy(order).rowsBetween(1 - window, 0)
    return F.when(F.count("*").over(frame) >= window, F.avg(value).over(frame))

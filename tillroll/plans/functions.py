"""Scalar functions, each applied to every row of a table."""

from pyspark.sql import functions as F

from tillroll.functions import dates, numbers, text
from tillroll.operators import cleaning, customers
from tillroll.plans import sql
from tillroll.plans.registry import query
from tillroll.plans.sql import compared, day, half_even, rounded, with_tables


def _by_value(name, source, column, expression, digits=2):
    """Register a query that counts the rows of `source` per value of a function.

    The column comes as a function, since there is no session when this module is loaded.
    """
    statement = with_tables(f"SELECT {expression} AS value, count(*) AS rows FROM {source} GROUP BY 1")

    @query(name, statement, digits)
    def _(f):
        return getattr(f, source).groupBy(column().alias("value")).agg(F.count("*").alias("rows"))


_TS = "InvoiceDate"

_by_value("f1_month_start", "tx", lambda: dates.month_start(_TS), day("date_trunc('month', InvoiceDate)"))
_by_value("f5_month_index", "tx", lambda: dates.month_index(_TS), "CAST(year(InvoiceDate) * 12 + month(InvoiceDate) AS INT)")
_by_value("f7_weekday", "tx", lambda: dates.day_of_week(_TS), "CAST(isodow(InvoiceDate) - 1 AS INT)")
_by_value(
    "f8_day_and_month_name",
    "tx",
    lambda: F.concat_ws(" ", dates.day_name(_TS), dates.month_name(_TS)),
    "dayname(InvoiceDate) || ' ' || monthname(InvoiceDate)",
)
_by_value("f9_year_month", "tx", lambda: dates.year_month(_TS), "strftime(InvoiceDate, '%Y-%m')")
_by_value(
    "f10_week_label",
    "tx",
    lambda: dates.week_label(_TS),
    f"""{day("date_trunc('week', InvoiceDate)")} || '/' ||
        {day("date_trunc('week', InvoiceDate) + INTERVAL 6 DAY")}""",
)
_by_value("f11_date", "tx", lambda: F.to_date(_TS), day("InvoiceDate"))
_by_value("f12_round_half_up", "tx", lambda: numbers.half_up("UnitPrice", 1), rounded("UnitPrice", 1))
_by_value("f13_round_half_even", "tx", lambda: numbers.half_even("UnitPrice", 1), half_even("UnitPrice", 1))
_by_value(
    "f17_single_spaced",
    "raw",
    lambda: text.single_spaced("Description"),
    r"trim(regexp_replace(Description, '\s+', ' ', 'g'))",
)
_by_value("f18_cancellation", "raw", lambda: text.is_cancellation(F.col("InvoiceNo")), "starts_with(InvoiceNo, 'C')")
_by_value("f19_prefix", "raw", lambda: text.shortened("Description", 8), "substr(Description, 1, 8)")
_by_value(
    "f20_string_order",
    "tx",
    lambda: F.concat_ws(" ", (F.col("Description") < "old").cast("string"), (F.col("InvoiceNo") < "C").cast("string")),
    """concat(CAST(Description < 'old' AS VARCHAR), ' ', CAST(InvoiceNo < 'C' AS VARCHAR))""",
)
_by_value(
    "f21_right_closed_bands",
    "tx",
    lambda: numbers.right_closed_band(F.col("TotalPrice"), customers.CLV_EDGES, customers.CLV_LABELS),
    """CASE WHEN TotalPrice > 0 AND TotalPrice <= 100 THEN '<$100'
            WHEN TotalPrice > 100 AND TotalPrice <= 500 THEN '$100-500'
            WHEN TotalPrice > 500 AND TotalPrice <= 1000 THEN '$500-1K'
            WHEN TotalPrice > 1000 AND TotalPrice <= 5000 THEN '$1K-5K'
            WHEN TotalPrice > 5000 THEN '>$5K' END""",
)
_by_value("f23_marker_size", "tx", lambda: numbers.marker_size(F.col("Quantity")), "abs(Quantity) + 1")


@query(
    "f2_calendar_days",
    with_tables(
        """SELECT CustomerID, CAST(datediff('day', min(InvoiceDate), max(InvoiceDate)) AS INT) AS days
           FROM tx GROUP BY CustomerID"""
    ),
)
def _(f):
    return f.tx.groupBy("CustomerID").agg(dates.calendar_days(F.max(_TS), F.min(_TS)).alias("days"))


@query(
    "f3_elapsed_days",
    with_tables(
        f"""SELECT CustomerID, {sql.elapsed('min(InvoiceDate)', 'max(InvoiceDate)')} AS days
            FROM tx GROUP BY CustomerID"""
    ),
)
def _(f):
    return f.tx.groupBy("CustomerID").agg(dates.elapsed_days(F.max(_TS), F.min(_TS)).alias("days"))


@query(
    "f4_month_boundaries",
    with_tables(
        """SELECT CustomerID, CAST(datediff('month', date_trunc('month', min(InvoiceDate)),
             date_trunc('month', max(InvoiceDate))) AS INT) AS months FROM tx GROUP BY CustomerID"""
    ),
)
def _(f):
    return f.tx.groupBy("CustomerID").agg(dates.months_between_starts(F.max(_TS), F.min(_TS)).alias("months"))


@query(
    "f6_date_parts",
    with_tables(
        """SELECT CAST(year(InvoiceDate) AS INT) AS y, CAST(month(InvoiceDate) AS INT) AS m,
             CAST(day(InvoiceDate) AS INT) AS d, CAST(hour(InvoiceDate) AS INT) AS h, count(*) AS rows
           FROM tx GROUP BY ALL"""
    ),
)
def _(f):
    parts = {"y": F.year(_TS), "m": F.month(_TS), "d": F.day(_TS), "h": F.hour(_TS)}
    return f.tx.groupBy(*[c.alias(n) for n, c in parts.items()]).agg(F.count("*").alias("rows"))


@query(
    "f14_safe_division",
    with_tables(
        f"""SELECT CustomerID, {compared('sum(TotalPrice) / nullif(count(*) FILTER (IsReturn), 0)')} AS per_return
            FROM tx GROUP BY CustomerID"""
    ),
)
def _(f):
    return f.tx.groupBy("CustomerID").agg(
        numbers.safe_ratio(F.sum("TotalPrice"), F.count_if("IsReturn")).alias("per_return")
    )


@query(
    "f15_finite_or_zero",
    with_tables(
        f"""SELECT CustomerID, CASE WHEN life = 0 THEN 0.0 ELSE {compared('orders / (life / 30.0)', 4)} END AS per_month
            FROM (SELECT CustomerID, count(DISTINCT InvoiceNo) AS orders,
                    {sql.elapsed('min(InvoiceDate)', 'max(InvoiceDate)')} AS life FROM sales GROUP BY CustomerID)"""
    ),
    digits=4,
)
def _(f):
    each = f.sales.groupBy("CustomerID").agg(
        F.count_distinct("InvoiceNo").alias("orders"), dates.elapsed_days(F.max(_TS), F.min(_TS)).alias("life")
    )
    ratio = numbers.safe_ratio(F.col("orders"), F.col("life") / customers.DAYS_PER_MONTH)
    return each.select("CustomerID", numbers.finite_or_zero(ratio).alias("per_month"))


@query(
    "f16_case_chain",
    with_tables(
        """SELECT CASE WHEN Frequency >= 20 THEN 'often' WHEN Frequency >= 10 THEN 'regular' ELSE 'rare' END AS kind,
             count(*) AS customers FROM c GROUP BY 1""",
        c=sql.customers("tx"),
    ),
)
def _(f):
    orders = F.col("Frequency")
    kind = F.when(orders >= 20, "often").when(orders >= 10, "regular").otherwise("rare")
    return customers.customer_aggregate(f.tx).groupBy(kind.alias("kind")).agg(F.count("*").alias("customers"))


@query(
    "f22_fill_and_drop_nulls",
    with_tables(
        """SELECT Country, sum(CASE WHEN Description IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS kept,
             count(*) FILTER (coalesce(CustomerID, '0') = '0') AS filled FROM raw GROUP BY Country"""
    ),
)
def _(f):
    filled = f.raw.fillna({"CustomerID": "0"}).withColumn("_filled", F.col("CustomerID") == "0")
    kept = cleaning.handle_missing_descriptions(filled, "remove").groupBy("Country").agg(F.count("*").alias("kept"))
    return kept.join(filled.groupBy("Country").agg(F.count_if("_filled").alias("filled")), "Country")


@query(
    "f24_display_labels",
    with_tables(
        """SELECT StockCode,
             CASE WHEN m >= 1000000 THEN printf('$%.2fM', m / 1000000.0)
                  WHEN m >= 1000 THEN printf('$%.1fK', m / 1000.0)
                  ELSE printf('$%.0f', m) END AS money,
             CASE WHEN u >= 1000000 THEN printf('%.1fM', u / 1000000.0)
                  WHEN u >= 1000 THEN printf('%.0fK', u / 1000.0)
                  ELSE printf('%d', u) END AS units
           FROM (SELECT StockCode, sum(TotalPrice) AS m, CAST(sum(Quantity) AS BIGINT) AS u
                 FROM sales GROUP BY StockCode)"""
    ),
)
def _(f):
    totals = f.sales.groupBy("StockCode").agg(F.sum("TotalPrice").alias("m"), F.sum("Quantity").alias("u"))
    return totals.select(
        "StockCode", text.money_label(F.col("m")).alias("money"), text.count_label(F.col("u")).alias("units")
    )


@query(
    "f25_following_days",
    with_tables(
        f"""SELECT Country, {day('last + to_days(CAST(n AS INT))')} AS Date
            FROM (SELECT Country, date_trunc('day', max(InvoiceDate)) AS last FROM tx GROUP BY Country),
                 range(1, 31) AS r(n)"""
    ),
)
def _(f):
    last = f.tx.groupBy("Country").agg(F.to_date(F.max(_TS)).alias("last"))
    return last.select("Country", dates.following_days(F.col("last"), 30).alias("Date"))

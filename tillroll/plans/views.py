"""Exploratory reports, rankings, samples and dashboard frames."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators import cube, dashboard, explore, profiling, rollups
from tillroll.plans import sql
from tillroll.plans.registry import query
from tillroll.plans.sql import compared, day, metric, metrics, with_tables
from tillroll.schema import WEEKDAYS
from tillroll.staging import stage

_LATEST = "sum(TotalPrice) AS Revenue"


def _group(key, source="sales", extra=""):
    return f"SELECT {key}, sum(TotalPrice) AS Revenue, count(*) AS rows{extra} FROM {source} GROUP BY 1"


_TABLES = {
    "by_day": _group("CAST(InvoiceDate AS DATE) AS Date"),
    "by_month": _group("YearMonth"),
    "by_product": _group("Description", extra=", sum(Quantity) AS Quantity"),
    "by_customer": _group("CustomerID", extra=", count(DISTINCT InvoiceNo) AS Orders"),
    "by_country": _group("Country"),
    "by_hour": _group("Hour"),
    "by_weekday": _group("DayName", extra=", min(DayOfWeek) AS position"),
    "by_invoice": _group("InvoiceNo"),
}


def _first(table, key, value, order):
    """Key and value of the first row, as the metric's label and number."""
    return f"(SELECT * FROM {table} ORDER BY {value} {order}, {key} LIMIT 1)"


_REVENUE = [
    metric("total", "sum(TotalPrice)", source="FROM sales"),
    metric("daily_avg", "avg(Revenue)", source="FROM by_day"),
    metric("daily_max", "max(Revenue)", source="FROM by_day"),
    metric("daily_min", "min(Revenue)", source="FROM by_day"),
    metric("monthly_avg", "avg(Revenue)", source="FROM by_month"),
    metric("best_month", "Revenue", "YearMonth", "FROM " + _first("by_month", "YearMonth", "Revenue", "DESC")),
    metric("worst_month", "Revenue", "YearMonth", "FROM " + _first("by_month", "YearMonth", "Revenue", "ASC")),
]
_PRODUCTS = [
    metric("total_unique", "count(DISTINCT StockCode)", source="FROM sales"),
    metric("top_product", "Revenue", "Description", "FROM " + _first("by_product", "Description", "Revenue", "DESC")),
    metric("avg_product_revenue", "avg(Revenue)", source="FROM by_product"),
    metric(
        "top_quantity_product",
        "Quantity",
        "Description",
        "FROM " + _first("by_product", "Description", "Quantity", "DESC"),
    ),
]
_CUSTOMERS = [
    metric("total_unique", "count(DISTINCT CustomerID)", source="FROM sales"),
    metric("guest_transactions", "count(*)", source="FROM sales WHERE CustomerID = 'Guest'"),
    metric("registered_transactions", "count(*)", source="FROM sales WHERE CustomerID != 'Guest'"),
    metric("guest_revenue", "sum(TotalPrice)", source="FROM sales WHERE CustomerID = 'Guest'"),
    metric("registered_revenue", "sum(TotalPrice)", source="FROM sales WHERE CustomerID != 'Guest'"),
    metric("top_customer", "Revenue", "CustomerID", "FROM " + _first("by_customer", "CustomerID", "Revenue", "DESC")),
    metric("avg_customer_revenue", "avg(Revenue)", source="FROM by_customer"),
    metric("avg_purchase_frequency", "avg(Orders)", source="FROM by_customer"),
]


def _geography(home):
    return [
        metric("total_countries", "count(DISTINCT Country)", source="FROM sales"),
        metric("top_country", "Revenue", "Country", "FROM " + _first("by_country", "Country", "Revenue", "DESC")),
        metric("top_country_share", "max(Revenue) / sum(Revenue) * 100", source="FROM by_country"),
        metric("international_revenue", "sum(TotalPrice)", source=f"FROM sales WHERE Country != '{home}'"),
    ]


_TIME = [
    metric("peak_hour", "Revenue", "Hour", "FROM " + _first("by_hour", "Hour", "Revenue", "DESC")),
    metric("slowest_hour", "Revenue", "Hour", "FROM " + _first("by_hour", "Hour", "Revenue", "ASC")),
    metric("best_day", "Revenue", "DayName", "FROM " + _first("by_weekday", "position", "Revenue", "DESC")),
    metric("worst_day", "Revenue", "DayName", "FROM " + _first("by_weekday", "position", "Revenue", "ASC")),
]

# The test data has no country of the usual name.
_HOME = "NATION_7"


@query("e1_revenue_trends", with_tables(metrics(*_REVENUE), **_TABLES))
def _(f):
    return explore.revenue_trends(f.sales)


_SERIES_SQL = {
    "Daily": "strftime(InvoiceDate, '%Y-%m-%d')",
    "Weekly": """strftime(date_trunc('week', InvoiceDate), '%Y-%m-%d') || '/' ||
                 strftime(date_trunc('week', InvoiceDate) + INTERVAL 6 DAY, '%Y-%m-%d')""",
    "Monthly": "strftime(InvoiceDate, '%Y-%m')",
}


def _series_sql(source):
    return " UNION ALL ".join(
        f"SELECT '{grain}' AS grain, {period} AS Date, {compared('sum(TotalPrice)')} AS Revenue FROM {source} GROUP BY 2"
        for grain, period in _SERIES_SQL.items()
    )


@query("e1_revenue_series", with_tables(_series_sql("sales")))
def _(f):
    return explore.all_series(f.sales)


@query("e2_products", with_tables(metrics(*_PRODUCTS), **_TABLES))
def _(f):
    return explore.products(f.sales)


@query(
    "e2_top_products",
    with_tables(
        f"""(SELECT 'Revenue' AS ranking, Description AS Product, {compared('Revenue')} AS value FROM by_product
             ORDER BY Revenue DESC, Description LIMIT 20)
            UNION ALL
            (SELECT 'Quantity', Description, CAST(Quantity AS DOUBLE) FROM by_product
             ORDER BY Quantity DESC, Description LIMIT 20)""",
        **_TABLES,
    ),
)
def _(f):
    def ranked(by):
        best = explore.top_products(f.sales, 20, by)
        return best.select(F.lit(by).alias("ranking"), "Product", F.col(by).cast("double").alias("value"))

    return ranked("Revenue").unionByName(ranked("Quantity"))


@query("e3_customers", with_tables(metrics(*_CUSTOMERS), **_TABLES))
def _(f):
    return explore.customers(f.sales)


@query(
    "e3_top_customers",
    with_tables(
        f"""SELECT CustomerID, {compared('Revenue')} AS Revenue FROM by_customer
            ORDER BY by_customer.Revenue DESC, CustomerID LIMIT 20""",
        **_TABLES,
    ),
)
def _(f):
    return explore.top_customers(f.sales)


@query("e4_geography", with_tables(metrics(*_geography(_HOME)), **_TABLES))
def _(f):
    return explore.geography(f.sales, _HOME)


@query(
    "e4_country_totals",
    with_tables(
        f"SELECT Country, {compared('Revenue')} AS Revenue, rows AS Transactions FROM by_country", **_TABLES
    ),
)
def _(f):
    return explore.country_totals(f.sales)


@query("e5_time_patterns", with_tables(metrics(*_TIME), **_TABLES))
def _(f):
    return explore.time_patterns(f.sales)


@query(
    "e5_hourly",
    with_tables(f"SELECT Hour, {compared('Revenue')} AS Revenue, rows AS Transactions FROM by_hour", **_TABLES),
)
def _(f):
    return explore.hourly(f.sales)


def _panel(name, key, value, source):
    return f"""(SELECT '{name}' AS panel, CAST({key} AS VARCHAR) AS key, {compared(value)} AS value FROM {source})"""


@query(
    "e6_summary_panels",
    with_tables(
        " UNION ALL ".join(
            [
                _panel("kpi", "'total_revenue'", "sum(TotalPrice)", "sales"),
                _panel("kpi", "'total_transactions'", "count(*)", "sales"),
                _panel("kpi", "'total_customers'", "count(DISTINCT CustomerID)", "sales"),
                _panel("kpi", "'total_products'", "count(DISTINCT StockCode)", "sales"),
                _panel("kpi", "'avg_transaction'", "avg(Revenue)", "by_invoice"),
                _panel("monthly", "YearMonth", "Revenue", "by_month"),
                _panel(
                    "products",
                    "Description",
                    "Revenue",
                    "(SELECT * FROM by_product ORDER BY Revenue DESC, Description LIMIT 5)",
                ),
                _panel(
                    "countries",
                    "Country",
                    "Revenue",
                    "(SELECT * FROM by_country ORDER BY Revenue DESC, Country LIMIT 5)",
                ),
                _panel("hourly", "Hour", "Revenue", "by_hour"),
                _panel("customers", "'Guest'", "sum(TotalPrice)", "sales WHERE CustomerID = 'Guest'"),
                _panel("customers", "'Registered'", "sum(TotalPrice)", "sales WHERE CustomerID != 'Guest'"),
            ]
        ),
        **_TABLES,
    ),
)
def _(f):
    return explore.summary_panels(stage(f.sales.select(*explore.READ_COLUMNS), "sales"))


def _section(name, rows):
    return f"SELECT '{name}' AS section, metric, number, label FROM ({metrics(*rows)})"


@query(
    "e7_insights",
    with_tables(
        " UNION ALL ".join(
            [
                _section("revenue", _REVENUE),
                _section("products", _PRODUCTS),
                _section("customers", _CUSTOMERS),
                _section("geography", _geography(_HOME)),
                _section("time_patterns", _TIME),
            ]
        ),
        **_TABLES,
    ),
)
def _(f):
    return explore.insights(stage(f.sales.select(*explore.READ_COLUMNS), "sales"), _HOME)


@query(
    "e8_viewer",
    with_tables(
        f"""SELECT 'total' AS part, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM tx
            UNION ALL SELECT 'sales', '', CAST(count(*) AS DOUBLE) FROM sales
            UNION ALL SELECT 'returns', '', CAST(count(*) AS DOUBLE) FROM tx WHERE IsReturn
            UNION ALL (SELECT 'customers', CustomerID, {compared('Revenue')} FROM by_customer
                       ORDER BY Revenue DESC, CustomerID LIMIT 5)
            UNION ALL (SELECT 'products', Description, CAST(Quantity AS DOUBLE) FROM by_product
                       ORDER BY Quantity DESC, Description LIMIT 5)""",
        **_TABLES,
    ),
)
def _(f):
    tx = stage(f.tx.select("IsReturn", "CustomerID", "Description", "TotalPrice", "Quantity"), "viewer")
    sales = tx.filter("NOT IsReturn")
    counts = explore.table_counts(tx)
    entries = {"total": "total_transactions", "sales": "sales_only", "returns": "returns"}
    pairs = [
        F.struct(F.lit(p).alias("part"), F.lit("").alias("key"), F.col(c).cast("double").alias("value"))
        for p, c in entries.items()
    ]
    best = explore.top_customers(sales, 5).select(
        F.lit("customers").alias("part"), F.col("CustomerID").alias("key"), F.col("Revenue").alias("value")
    )
    sold = explore.top_products(sales, 5, "Quantity").select(
        F.lit("products").alias("part"), F.col("Product").alias("key"), F.col("Quantity").cast("double").alias("value")
    )
    return counts.select(F.inline(F.array(*pairs))).unionByName(best).unionByName(sold)


@query(
    "t1_order_and_limit",
    with_tables(
        f"""SELECT StockCode, {compared('r')} AS Revenue FROM (
              SELECT StockCode, sum(TotalPrice) AS r FROM tx GROUP BY StockCode) ORDER BY r DESC, StockCode LIMIT 25"""
    ),
)
def _(f):
    totals = f.tx.groupBy("StockCode").agg(F.sum("TotalPrice").alias("Revenue"))
    return rollups.top(totals, 25, "Revenue", "StockCode")


@query(
    "t2_n_largest",
    with_tables(
        """SELECT InvoiceNo, CAST(sum(Quantity) AS BIGINT) AS units FROM sales GROUP BY InvoiceNo
           ORDER BY units DESC, InvoiceNo LIMIT 50"""
    ),
)
def _(f):
    return rollups.top(f.sales.groupBy("InvoiceNo").agg(F.sum("Quantity").alias("units")), 50, "units", "InvoiceNo")


@query(
    "t3_sorted_head",
    with_tables(
        """SELECT CustomerID, count(DISTINCT StockCode) AS products FROM sales GROUP BY CustomerID
           ORDER BY products DESC, CustomerID LIMIT 20"""
    ),
)
def _(f):
    counts = f.sales.groupBy("CustomerID").agg(F.count_distinct("StockCode").alias("products"))
    return rollups.top(counts, 20, "products", "CustomerID")


_WEEK = ", ".join(f"({i}, '{name}')" for i, name in enumerate(WEEKDAYS, start=1))


def _weekday_sql(source):
    return f"""SELECT w.position, w.day AS Day, {compared('r')} AS Revenue
               FROM (VALUES {_WEEK}) AS w(position, day)
               LEFT JOIN (SELECT DayName, sum(TotalPrice) AS r FROM {source} GROUP BY 1) ON w.day = DayName"""


@query("t5_weekday_frame", with_tables(_weekday_sql("sales")))
def _(f):
    return explore.weekday_revenue(f.sales)


@query(
    "t6_stable_sample",
    with_tables(
        f"""SELECT CustomerID, {compared('sum(TotalPrice)')} AS Revenue FROM sales GROUP BY CustomerID
            ORDER BY md5(CustomerID || '|42'), CustomerID LIMIT 1000"""
    ),
)
def _(f):
    each = f.sales.groupBy("CustomerID").agg(F.sum("TotalPrice").alias("Revenue"))
    return dashboard.stable_sample(each, "CustomerID")


@query("u1_distinct", with_tables("SELECT DISTINCT CustomerID, YearMonth FROM tx"))
def _(f):
    return f.tx.select("CustomerID", "YearMonth").distinct()


@query(
    "u2_top_and_others",
    with_tables(
        f"""SELECT CASE WHEN rank <= 5 THEN Country ELSE 'Others' END AS Country, {compared('sum(Revenue)')} AS Revenue
            FROM (SELECT *, row_number() OVER (ORDER BY Revenue DESC, Country) AS rank FROM by_country) GROUP BY 1""",
        **_TABLES,
    ),
)
def _(f):
    return explore.top_with_others(explore.country_totals(f.sales), "Country", "Revenue")


@query(
    "u3_filter_choices",
    with_tables(
        """SELECT 'country' AS filter, 0 AS position, 'All' AS choice
           UNION ALL SELECT DISTINCT 'country', 1, Country FROM sales
           UNION ALL SELECT 'product', 0, 'All'
           UNION ALL (SELECT 'product', 1, Description FROM by_product ORDER BY Revenue DESC, Description LIMIT 50)""",
        **_TABLES,
    ),
)
def _(f):
    countries = explore.category_choices(explore.country_totals(f.sales), "Country")
    products = explore.category_choices(explore.product_totals(f.sales), "Description", 50)
    return countries.select(F.lit("country").alias("filter"), "*").unionByName(
        products.select(F.lit("product").alias("filter"), "*")
    )


# One choice of every filter.
_CHOICE = {
    "start": "1996-01-01",
    "end": "1999-06-30",
    "country": "NATION_7",
    "customer_type": "Registered",
}
_CHOSEN = """sales WHERE InvoiceDate >= TIMESTAMP '1996-01-01 00:00:00'
             AND InvoiceDate <= TIMESTAMP '1999-06-30 00:00:00' AND Country = 'NATION_7' AND CustomerID != 'Guest'"""


@query(
    "d0_filtered_sales",
    with_tables(
        f"""SELECT InvoiceNo, StockCode, Description, CustomerID, InvoiceDate, Quantity,
              {compared('TotalPrice')} AS TotalPrice FROM {_CHOSEN}"""
    ),
)
def _(f):
    return dashboard.filter_sales(f.sales, **_CHOICE).select(
        "InvoiceNo", "StockCode", "Description", "CustomerID", "InvoiceDate", "Quantity", "TotalPrice"
    )


@query(
    "d1_kpis",
    with_tables(
        f"""SELECT {compared('sum(TotalPrice)')} AS total_revenue, count(*) AS total_transactions,
              count(DISTINCT CustomerID) AS total_customers,
              {compared('(SELECT avg(t) FROM (SELECT sum(TotalPrice) AS t FROM chosen GROUP BY InvoiceNo))')}
                AS avg_order_value FROM chosen""",
        chosen=f"SELECT * FROM {_CHOSEN}",
    ),
)
def _(f):
    return dashboard.kpis(dashboard.filter_sales(f.sales, **_CHOICE))


@query("d2_revenue_trend", with_tables(_series_sql("chosen"), chosen=f"SELECT * FROM {_CHOSEN}"))
def _(f):
    return explore.all_series(dashboard.filter_sales(f.sales, **_CHOICE))


def _top_sql(key, name):
    return f"""SELECT {key} AS {name}, {compared('r')} AS Revenue FROM (
                 SELECT {key}, sum(TotalPrice) AS r FROM sales GROUP BY 1) ORDER BY r DESC, {key} LIMIT 10"""


@query("d3_top_products", with_tables(_top_sql("Description", "Product")))
def _(f):
    return dashboard.top_products(f.sales)


@query("d4_top_countries", with_tables(_top_sql("Country", "Country")))
def _(f):
    return dashboard.top_countries(f.sales)


@query(
    "d5_hourly_revenue", with_tables(f"SELECT Hour, {compared('sum(TotalPrice)')} AS Revenue FROM sales GROUP BY Hour")
)
def _(f):
    return dashboard.hourly_revenue(f.sales)


@query(
    "d6_guest_split",
    with_tables(
        f"""SELECT t AS CustomerType, coalesce({compared('sum(TotalPrice)')}, 0.0) AS Revenue
            FROM (VALUES ('Guest'), ('Registered')) AS v(t)
            LEFT JOIN sales ON (CustomerID = 'Guest') = (t = 'Guest') GROUP BY t"""
    ),
)
def _(f):
    return explore.guest_split(f.sales)


@query("d7_weekday_revenue", with_tables(_weekday_sql("sales")))
def _(f):
    return explore.weekday_revenue(f.sales)


# The same figures from the cube, under several choices of one cube.
_CUBE_CHOICES = {
    "everything": ({}, "TRUE"),
    "all filters": (_CHOICE, _CHOSEN.split("WHERE", 1)[1]),
    "guests": ({"customer_type": "Guest"}, "CustomerID = 'Guest'"),
    "a day and its midnight": (
        {"start": "1997-03-01", "end": "1997-03-02"},
        "InvoiceDate >= TIMESTAMP '1997-03-01 00:00:00' AND InvoiceDate <= TIMESTAMP '1997-03-02 00:00:00'",
    ),
    "nothing": ({"country": "nowhere"}, "FALSE"),
}


def _cube_kpis_sql(name, condition):
    return f"""SELECT '{name}' AS choice, coalesce({compared('sum(TotalPrice)')}, 0) AS total_revenue,
                 count(*) AS total_transactions, count(DISTINCT CustomerID) AS total_customers,
                 coalesce({compared('sum(TotalPrice) / nullif(count(DISTINCT InvoiceNo), 0)')}, 0) AS avg_order_value
               FROM sales WHERE {condition}"""


@query(
    "d1_cube_kpis",
    with_tables(" UNION ALL ".join(_cube_kpis_sql(name, condition) for name, (_, condition) in _CUBE_CHOICES.items())),
)
def _(f):
    figures = cube.build(stage(f.sales.select(*cube.COLUMNS), "sales"))
    rows = [
        cube.kpis(cube.choose(figures, **choice)).select(F.lit(name).alias("choice"), "*")
        for name, (choice, _) in _CUBE_CHOICES.items()
    ]
    return reduce(DataFrame.unionByName, rows)


@query(
    "d1_cube_countries",
    with_tables(
        """SELECT Country, count(DISTINCT InvoiceNo) AS invoices, count(DISTINCT CustomerID) AS customers
           FROM sales GROUP BY Country"""
    ),
)
def _(f):
    return cube.distinct_members(cube.build(stage(f.sales.select(*cube.COLUMNS), "sales")), "Country")


@query(
    "d2_cube_panels",
    with_tables(
        " UNION ALL ".join(
            [
                f"SELECT 'day' AS panel, {day('InvoiceDate')} AS key, {compared('sum(TotalPrice)')} AS value FROM chosen GROUP BY 2",
                f"SELECT 'month', YearMonth, {compared('sum(TotalPrice)')} FROM chosen GROUP BY 2",
                f"SELECT 'hour', CAST(Hour AS VARCHAR), {compared('sum(TotalPrice)')} FROM chosen GROUP BY 2",
                f"SELECT 'weekday', DayName, {compared('sum(TotalPrice)')} FROM chosen GROUP BY 2",
                f"SELECT 'type', CASE WHEN CustomerID = 'Guest' THEN 'Guest' ELSE 'Registered' END, {compared('sum(TotalPrice)')} FROM chosen GROUP BY 2",
                f"""SELECT * FROM (SELECT 'product', Description, {compared('r')} FROM (
                      SELECT Description, sum(TotalPrice) AS r FROM chosen GROUP BY 1) ORDER BY r DESC, Description LIMIT 10)""",
                f"""SELECT * FROM (SELECT 'country', Country, {compared('r')} FROM (
                      SELECT Country, sum(TotalPrice) AS r FROM chosen GROUP BY 1) ORDER BY r DESC, Country LIMIT 10)""",
            ]
        ),
        chosen="SELECT * FROM sales WHERE InvoiceDate >= TIMESTAMP '1996-01-01 00:00:00'",
    ),
)
def _(f):
    cells = cube.choose(cube.build(stage(f.sales.select(*cube.COLUMNS), "sales")), start="1996-01-01").cells
    panels = {
        "day": (explore.revenue_series(cells, "Daily"), "Date"),
        "month": (explore.revenue_series(cells, "Monthly"), "Date"),
        "hour": (dashboard.hourly_revenue(cells), "Hour"),
        "weekday": (explore.weekday_revenue(cells), "Day"),
        "type": (explore.guest_split(cells), "CustomerType"),
        "product": (dashboard.top_products(cells), "Product"),
        "country": (dashboard.top_countries(cells), "Country"),
    }
    rows = [
        df.select(F.lit(panel).alias("panel"), F.col(key).cast("string").alias("key"), F.col("Revenue").alias("value"))
        for panel, (df, key) in panels.items()
    ]
    return reduce(DataFrame.unionByName, rows)

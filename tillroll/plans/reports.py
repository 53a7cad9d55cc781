"""The report catalogue, joins, aggregates and windows."""

from pyspark.sql import functions as F

from tillroll.functions import dates
from tillroll.models import clusters as cluster_model
from tillroll.models import forecast
from tillroll.operators import baskets, cohorts, customers, explore, ranking, reports, rollups
from tillroll.plans import sql
from tillroll.plans.registry import query
from tillroll.plans.sql import compared, day, rounded, with_tables
from tillroll.staging import stage


@query(
    "q1_revenue_by_country",
    with_tables(
        f"""SELECT Country, count(DISTINCT InvoiceNo) AS Orders, count(DISTINCT CustomerID) AS Customers,
              {compared('sum(TotalPrice)')} AS Revenue, {compared('avg(TotalPrice)')} AS AvgOrderValue,
              CAST(sum(Quantity) AS BIGINT) AS TotalUnits
            FROM tx GROUP BY Country HAVING sum(TotalPrice) > 10000 ORDER BY sum(TotalPrice) DESC LIMIT 10"""
    ),
)
def _(f):
    return reports.revenue_by_country(f.tx)


@query(
    "q2_monthly_trends",
    with_tables(
        f"""SELECT {day("date_trunc('month', InvoiceDate)")} AS Month, count(DISTINCT InvoiceNo) AS Orders,
              count(DISTINCT CustomerID) AS Customers, {compared('sum(TotalPrice)')} AS Revenue,
              {compared('avg(TotalPrice)')} AS AvgTransaction, CAST(sum(Quantity) AS BIGINT) AS Units
            FROM tx GROUP BY date_trunc('month', InvoiceDate) ORDER BY 1"""
    ),
)
def _(f):
    return reports.monthly_trends(f.tx)


@query(
    "q3_top_products",
    with_tables(
        f"""SELECT Description AS Product, count(DISTINCT InvoiceNo) AS TimesSold,
              CAST(sum(Quantity) AS BIGINT) AS UnitsSold, {rounded('avg(UnitPrice)')} AS AvgPrice,
              {rounded('sum(TotalPrice)')} AS TotalRevenue
            FROM tx WHERE Description IS NOT NULL AND Description != 'POSTAGE'
            GROUP BY Description ORDER BY TotalRevenue DESC, Product LIMIT 15"""
    ),
)
def _(f):
    return reports.top_products(f.tx)


@query(
    "q4_customer_segments",
    with_tables(
        f"""SELECT CASE WHEN R_Score >= 4 AND F_Score >= 4 THEN 'Champions'
                        WHEN R_Score >= 3 AND F_Score >= 3 THEN 'Loyal'
                        WHEN R_Score >= 3 AND F_Score < 3 THEN 'Potential'
                        WHEN R_Score < 3 AND F_Score >= 3 THEN 'At Risk'
                        ELSE 'Lost' END AS Segment,
              count(*) AS Customers, {rounded('avg(MonetaryValue)')} AS AvgRevenue,
              {rounded('sum(MonetaryValue)')} AS TotalRevenue, {rounded('avg(Frequency)', 1)} AS AvgOrders,
              {rounded('avg(Recency)', 0)} AS AvgDaysSinceLast
            FROM rfm_scores GROUP BY Segment""",
        customer_metrics=sql.customers("tx") + " HAVING CustomerID != 'Guest'",
        rfm_metrics="""SELECT *, datediff('day', LastPurchase, (SELECT max(InvoiceDate) FROM tx)) AS Recency
                       FROM customer_metrics""",
        rfm_scores="""SELECT *, ntile(5) OVER (ORDER BY Recency DESC, CustomerID) AS R_Score,
                        ntile(5) OVER (ORDER BY Frequency, CustomerID) AS F_Score,
                        ntile(5) OVER (ORDER BY MonetaryValue, CustomerID) AS M_Score FROM rfm_metrics""",
    ),
)
def _(f):
    return reports.customer_segments(f.tx)


@query(
    "q5_hourly_patterns",
    with_tables(
        f"""SELECT CAST(extract(hour FROM InvoiceDate) AS INT) AS Hour, dayname(InvoiceDate) AS DayOfWeek,
              count(DISTINCT InvoiceNo) AS Orders, {rounded('sum(CAST(TotalPrice AS DECIMAL(28, 8)))')} AS Revenue,
              {rounded('avg(TotalPrice)')} AS AvgTransaction
            FROM tx GROUP BY 1, 2 ORDER BY Revenue DESC, Hour, DayOfWeek LIMIT 20"""
    ),
)
def _(f):
    return reports.hourly_patterns(f.tx)


@query(
    "q6_top_customers",
    with_tables(
        f"""SELECT CustomerID, Frequency AS TotalOrders, {rounded('MonetaryValue')} AS LifetimeValue,
              {rounded('AvgOrderValue')} AS AvgOrderValue, FirstPurchase, LastPurchase,
              CAST(datediff('day', FirstPurchase, LastPurchase) AS INT) AS CustomerLifespanDays,
              CAST(row_number() OVER (ORDER BY MonetaryValue DESC, CustomerID) AS INT) AS Rank
            FROM stats WHERE Frequency >= 5 ORDER BY MonetaryValue DESC LIMIT 20""",
        stats=sql.customers("tx") + " HAVING CustomerID != 'Guest'",
    ),
)
def _(f):
    return reports.top_customers(f.tx)


def _affinity_sql(min_together, n):
    return with_tables(
        f"""SELECT t1.Description AS Product_A, t2.Description AS Product_B,
              count(DISTINCT t1.InvoiceNo) AS TimesBoughtTogether,
              {rounded('sum(CAST(t1.TotalPrice AS DECIMAL(24, 8)) + CAST(t2.TotalPrice AS DECIMAL(24, 8)))')} AS CombinedRevenue
            FROM tx t1 JOIN tx t2 ON t1.InvoiceNo = t2.InvoiceNo AND t1.Description < t2.Description
            WHERE t1.Description != 'POSTAGE' AND t2.Description != 'POSTAGE'
            GROUP BY 1, 2 HAVING count(DISTINCT t1.InvoiceNo) >= {min_together}
            ORDER BY TimesBoughtTogether DESC, Product_A, Product_B LIMIT {n}"""
    )


@query("q7_product_affinity", _affinity_sql(50, 15))
def _(f):
    return baskets.product_affinity(f.tx)


@query(
    "q8_cohort_retention",
    with_tables(
        f"""SELECT {day('CohortMonth')} AS CohortMonth,
              count(DISTINCT CASE WHEN MonthNumber = 0 THEN CustomerID END) AS Month_0,
              count(DISTINCT CASE WHEN MonthNumber = 1 THEN CustomerID END) AS Month_1,
              count(DISTINCT CASE WHEN MonthNumber = 2 THEN CustomerID END) AS Month_2,
              count(DISTINCT CASE WHEN MonthNumber = 3 THEN CustomerID END) AS Month_3,
              {rounded('100.0 * Month_1 / nullif(Month_0, 0)', 1)} AS Retention_M1,
              {rounded('100.0 * Month_2 / nullif(Month_0, 0)', 1)} AS Retention_M2,
              {rounded('100.0 * Month_3 / nullif(Month_0, 0)', 1)} AS Retention_M3
            FROM purchase_months GROUP BY purchase_months.CohortMonth""",
        first_purchase="""SELECT CustomerID, date_trunc('month', min(InvoiceDate)) AS CohortMonth
                          FROM tx WHERE CustomerID != 'Guest' GROUP BY CustomerID""",
        purchase_months="""SELECT DISTINCT t.CustomerID, fp.CohortMonth,
                             datediff('month', fp.CohortMonth, date_trunc('month', t.InvoiceDate)) AS MonthNumber
                           FROM tx t JOIN first_purchase fp ON t.CustomerID = fp.CustomerID""",
    ),
)
def _(f):
    return reports.cohort_retention(f.tx)


@query(
    "b1_country_totals",
    with_tables(f"SELECT Country, {compared('sum(TotalPrice)')} AS Revenue FROM tx GROUP BY Country"),
)
def _(f):
    return reports.country_totals(f.tx)


@query(
    "b2_month_totals",
    with_tables(
        f"""SELECT {day("date_trunc('month', InvoiceDate)")} AS Month, count(*) AS Orders,
              {compared('sum(TotalPrice)')} AS Revenue FROM tx GROUP BY date_trunc('month', InvoiceDate)"""
    ),
)
def _(f):
    return reports.month_totals(f.tx)


@query(
    "l1_business_kpis",
    with_tables(
        f"""SELECT count(DISTINCT InvoiceNo) AS total_orders, count(DISTINCT CustomerID) AS total_customers,
              {compared('sum(TotalPrice)')} AS total_revenue, {compared('avg(TotalPrice)')} AS avg_transaction FROM tx"""
    ),
)
def _(f):
    return reports.business_kpis(f.tx)


@query(
    "j1_cohort_join",
    with_tables(
        f"""SELECT DISTINCT t.CustomerID, {day('CohortMonth')} AS CohortMonth,
              {day("date_trunc('month', t.InvoiceDate)")} AS PurchaseMonth
            FROM tx t JOIN first_purchase fp ON t.CustomerID = fp.CustomerID""",
        first_purchase="""SELECT CustomerID, date_trunc('month', min(InvoiceDate)) AS CohortMonth
                          FROM tx WHERE CustomerID != 'Guest' GROUP BY CustomerID""",
    ),
)
def _(f):
    return cohorts.activity_months(f.tx).select("CustomerID", "CohortMonth", "PurchaseMonth")


# Small blocks, so that baskets are spread on the test data too.
@query("j2_basket_self_join", _affinity_sql(30, 500))
def _(f):
    return baskets.product_affinity(f.tx, min_together=30, n=500, block=2)


@query(
    "j3_scalar_subquery",
    with_tables(
        """SELECT CustomerID, CAST(datediff('day', max(InvoiceDate), (SELECT max(InvoiceDate) FROM tx)) AS INT)
             AS Recency FROM tx GROUP BY CustomerID"""
    ),
)
def _(f):
    everyone = customers.customer_table(f.tx)
    newest = everyone.agg(F.max("LastPurchase")).scalar()
    return everyone.select("CustomerID", dates.calendar_days(newest, F.col("LastPurchase")).alias("Recency"))


@query(
    "j5_cohort_share",
    with_tables(
        f"""SELECT c.CohortMonth, c.CohortIndex, c.CustomerCount, s.CustomerCount AS CohortSize,
              {compared('c.CustomerCount * 100.0 / s.CustomerCount')} AS RetentionPct
            FROM cohort_data c JOIN cohort_data s ON c.CohortMonth = s.CohortMonth AND s.CohortIndex = 0""",
        dated="""SELECT CustomerID, InvoiceDate, min(InvoiceDate) OVER (PARTITION BY CustomerID) AS first
                 FROM tx WHERE CustomerID != 'Guest'""",
        cohort_data="""SELECT strftime(first, '%Y-%m') AS CohortMonth,
                         CAST((year(InvoiceDate) * 12 + month(InvoiceDate)) - (year(first) * 12 + month(first)) AS INT)
                           AS CohortIndex, count(DISTINCT CustomerID) AS CustomerCount FROM dated GROUP BY 1, 2""",
    ),
)
def _(f):
    return cohorts.retention(f.tx)


@query(
    "j6_best_seller_lines",
    with_tables(
        f"""SELECT Description, count(*) AS rows, {compared('sum(TotalPrice)')} AS revenue FROM sales
            WHERE Description IN (SELECT Description FROM sales GROUP BY Description
                                  ORDER BY sum(Quantity) DESC, Description LIMIT 50)
            GROUP BY Description"""
    ),
)
def _(f):
    best = baskets.best_sellers(f.sales, 50).select("Description")
    kept = f.sales.join(F.broadcast(best), "Description", "left_semi")
    return kept.groupBy("Description").agg(F.count("*").alias("rows"), F.sum("TotalPrice").alias("revenue"))


BASKET_TABLES = {
    "top50": """SELECT Description FROM sales GROUP BY Description
                ORDER BY sum(Quantity) DESC, Description LIMIT 50""",
    "basket": """SELECT InvoiceNo, Description, sum(Quantity) AS units FROM sales GROUP BY InvoiceNo, Description""",
    "bought": "SELECT * FROM basket WHERE units > 0 AND Description IN (SELECT Description FROM top50)",
    "pairs": """SELECT a.Description AS Product_A, b.Description AS Product_B, count(*) AS Count
                FROM bought a JOIN bought b ON a.InvoiceNo = b.InvoiceNo AND a.Description < b.Description
                GROUP BY 1, 2""",
}


@query("j7_best_seller_pairs", with_tables("SELECT * FROM pairs", **BASKET_TABLES))
def _(f):
    return baskets.best_seller_pairs(f.sales)


@query(
    "a1_basic_aggregates",
    with_tables(
        f"""SELECT StockCode, {compared('sum(TotalPrice)')} AS total, {compared('avg(TotalPrice)')} AS mean,
              count(*) AS rows, min(InvoiceDate) AS first, max(InvoiceDate) AS last FROM tx GROUP BY StockCode"""
    ),
)
def _(f):
    return f.tx.groupBy("StockCode").agg(
        F.sum("TotalPrice").alias("total"),
        F.avg("TotalPrice").alias("mean"),
        F.count("*").alias("rows"),
        F.min("InvoiceDate").alias("first"),
        F.max("InvoiceDate").alias("last"),
    )


@query(
    "a2_distinct_counts",
    with_tables(
        """SELECT Country, count(DISTINCT InvoiceNo) AS orders, count(DISTINCT CustomerID) AS customers
           FROM tx GROUP BY Country"""
    ),
)
def _(f):
    invoices = rollups.invoice_rollup(f.tx, F.col("Country"))
    return invoices.groupBy("Country").agg(
        rollups.orders().alias("orders"), rollups.customers().alias("customers")
    )


@query(
    "a3_conditional_distinct",
    with_tables(
        """SELECT Country, count(DISTINCT CASE WHEN IsReturn THEN CustomerID END) AS returning_customers,
             count(DISTINCT CASE WHEN NOT IsReturn THEN CustomerID END) AS buying_customers
           FROM tx GROUP BY Country"""
    ),
)
def _(f):
    each = f.tx.groupBy("Country", "CustomerID").agg(
        F.some("IsReturn").alias("returned"), F.some(~F.col("IsReturn")).alias("bought")
    )
    return each.groupBy("Country").agg(
        F.count_if("returned").alias("returning_customers"), F.count_if("bought").alias("buying_customers")
    )


@query(
    "a4_having",
    with_tables(
        f"""SELECT Country, {compared('sum(TotalPrice)')} AS Revenue FROM tx GROUP BY Country
            HAVING sum(TotalPrice) > (SELECT sum(TotalPrice) / 25 FROM tx)"""
    ),
)
def _(f):
    totals = f.tx.groupBy("Country").agg(F.sum("TotalPrice").alias("Revenue"))
    return totals.filter(F.col("Revenue") > totals.agg(F.sum("Revenue") / 25).scalar())


@query(
    "a5_extreme_keys",
    with_tables(
        """SELECT Country, (array_agg(YearMonth ORDER BY r DESC, YearMonth))[1] AS best,
             (array_agg(YearMonth ORDER BY r, YearMonth))[1] AS worst
           FROM (SELECT Country, YearMonth, sum(TotalPrice) AS r FROM sales GROUP BY 1, 2) GROUP BY Country"""
    ),
)
def _(f):
    months = f.sales.groupBy("Country", "YearMonth").agg(F.sum("TotalPrice").alias("Revenue"))
    return months.groupBy("Country").agg(
        rollups.largest("YearMonth", "Revenue").alias("best"), rollups.smallest("YearMonth", "Revenue").alias("worst")
    )


@query(
    "a6_two_level_aggregate",
    with_tables(
        f"""SELECT Country, {compared('avg(t)')} AS mean_invoice, {compared('max(t)')} AS largest_invoice
            FROM (SELECT Country, InvoiceNo, sum(TotalPrice) AS t FROM sales GROUP BY 1, 2) GROUP BY Country"""
    ),
)
def _(f):
    invoices = f.sales.groupBy("Country", "InvoiceNo").agg(F.sum("TotalPrice").alias("total"))
    return invoices.groupBy("Country").agg(
        F.avg("total").alias("mean_invoice"), F.max("total").alias("largest_invoice")
    )


@query(
    "a7_median",
    with_tables(f"SELECT {compared('median(TotalPrice)')} AS median_line FROM sales"),
)
def _(f):
    # Selection reads its input several times; here sales is a view over five tables.
    lines = stage(f.sales.select("TotalPrice"), "lines")
    (median,) = ranking.exact_quantiles(lines, "TotalPrice", [0.5])
    return f.spark.createDataFrame([(median,)], "median_line double")


@query(
    "a8_quantile_edges",
    with_tables(
        " UNION ALL ".join(
            f"SELECT CAST({p} AS DOUBLE) AS fraction, {compared(f'quantile_cont(UnitPrice, {p})', 4)} AS edge FROM sales"
            for p in (0.2, 0.4, 0.6, 0.8)
        )
    ),
    digits=4,
)
def _(f):
    fractions = [0.2, 0.4, 0.6, 0.8]
    edges = ranking.exact_quantiles(stage(f.sales.select("UnitPrice"), "lines"), "UnitPrice", fractions)
    return f.spark.createDataFrame(list(zip(fractions, edges)), "fraction double, edge double")


@query("a9_group_sizes", with_tables("SELECT CustomerID, count(*) AS rows FROM tx GROUP BY CustomerID"))
def _(f):
    return f.tx.groupBy("CustomerID").count().withColumnRenamed("count", "rows")


# Every offset between two of the seven years of the data, so that the columns are the same at any size.
_OFFSETS = range(7 * 12)


@query(
    "a10_pivot",
    with_tables(
        "SELECT CohortMonth, "
        + ", ".join(f"max(CASE WHEN i = {i} THEN n END) AS month_{i}" for i in _OFFSETS)
        + " FROM cohort_data GROUP BY CohortMonth",
        dated="""SELECT CustomerID, InvoiceDate, min(InvoiceDate) OVER (PARTITION BY CustomerID) AS first
                 FROM sales WHERE CustomerID != 'Guest'""",
        cohort_data="""SELECT strftime(first, '%Y-%m') AS CohortMonth,
                         (year(InvoiceDate) * 12 + month(InvoiceDate)) - (year(first) * 12 + month(first)) AS i,
                         count(DISTINCT CustomerID) AS n FROM dated GROUP BY 1, 2""",
    ),
)
def _(f):
    return cohorts.retention_matrix(cohorts.retention(f.sales), _OFFSETS, "CustomerCount")


@query(
    "a11_share_of_total",
    with_tables(
        f"""SELECT Country, {compared('sum(TotalPrice)')} AS Revenue,
              {sql.half_even('sum(TotalPrice) * 100.0 / (SELECT sum(TotalPrice) FROM sales)', 1)} AS Revenue_Pct
            FROM sales GROUP BY Country"""
    ),
)
def _(f):
    totals = f.sales.groupBy("Country").agg(F.sum("TotalPrice").alias("Revenue"))
    return cluster_model.share_of_total(totals, "Revenue", "Revenue_Pct")


@query(
    "a12_customer_aggregate",
    with_tables(
        f"""SELECT CustomerID, Frequency, {compared('MonetaryValue')} AS MonetaryValue,
              {compared('AvgOrderValue')} AS AvgOrderValue, TotalQuantity, FirstPurchase, LastPurchase FROM c""",
        c=sql.customers("tx"),
    ),
)
def _(f):
    return customers.customer_aggregate(f.tx)


@query(
    "a13_day_spans",
    with_tables(
        f"""SELECT CustomerID, {sql.elapsed('min(InvoiceDate)', 'max(InvoiceDate)')} AS lifespan,
              {sql.elapsed('max(InvoiceDate)', '(SELECT max(InvoiceDate) FROM sales)')} AS recency
            FROM sales GROUP BY CustomerID"""
    ),
)
def _(f):
    everyone = customers.customer_table(f.sales)
    newest = everyone.agg(F.max("LastPurchase")).scalar()
    return everyone.select(
        "CustomerID",
        dates.elapsed_days(F.col("LastPurchase"), F.col("FirstPurchase")).alias("lifespan"),
        dates.elapsed_days(newest, F.col("LastPurchase")).alias("recency"),
    )


@query(
    "w1_ntile",
    with_tables(
        """SELECT CustomerID, CAST(ntile(5) OVER (ORDER BY Frequency, CustomerID) AS INT) AS frequency_tile,
             CAST(ntile(5) OVER (ORDER BY MonetaryValue, CustomerID) AS INT) AS money_tile FROM c""",
        c=sql.customers("tx"),
    ),
)
def _(f):
    everyone = customers.customer_table(f.tx)
    return everyone.select(
        "CustomerID",
        ranking.ntile(everyone, ["Frequency", "CustomerID"], 5).alias("frequency_tile"),
        ranking.ntile(everyone, ["MonetaryValue", "CustomerID"], 5).alias("money_tile"),
    )


@query(
    "w2_rank_by_value",
    with_tables(
        """SELECT CustomerID, row_number() OVER (ORDER BY MonetaryValue DESC, CustomerID) AS rank FROM c""",
        c=sql.customers("tx"),
    ),
)
def _(f):
    everyone = customers.customer_aggregate(f.tx).select("CustomerID", "MonetaryValue")
    return ranking.number_rows(everyone, [("MonetaryValue", False), "CustomerID"], "rank").drop("MonetaryValue")


@query(
    "w3_rank_first",
    with_tables(
        """SELECT CustomerID, row_number() OVER (ORDER BY Frequency, CustomerID) AS rank FROM c""",
        c=sql.customers("sales") + " HAVING CustomerID != 'Guest'",
    ),
)
def _(f):
    members = customers.customer_aggregate(customers.registered(f.sales)).select("CustomerID", "Frequency")
    return ranking.number_rows(members, ["Frequency", "CustomerID"], "rank").drop("Frequency")


@query(
    "w4_first_purchase",
    with_tables(
        """SELECT CustomerID, YearMonth, strftime(first, '%Y-%m') AS CohortMonth FROM (
             SELECT *, min(InvoiceDate) OVER (PARTITION BY CustomerID) AS first
             FROM sales WHERE CustomerID != 'Guest') GROUP BY ALL"""
    ),
)
def _(f):
    active = cohorts.activity_months(f.sales)
    return active.select(
        "CustomerID",
        dates.year_month("PurchaseMonth").alias("YearMonth"),
        dates.year_month("CohortMonth").alias("CohortMonth"),
    )


DAILY_DEMAND = """SELECT Description AS Product, CAST(InvoiceDate AS DATE) AS Date, sum(Quantity) AS units
                  FROM sales GROUP BY 1, 2"""


@query(
    "w5_rolling_mean",
    with_tables(
        f"""SELECT Product, {day('Date')} AS Date, CAST(units AS BIGINT) AS units,
              CASE WHEN count(*) OVER w >= 7 THEN {compared('avg(units) OVER w')} END AS smooth
            FROM daily WINDOW w AS (PARTITION BY Product ORDER BY Date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
        daily=DAILY_DEMAND,
    ),
)
def _(f):
    daily = f.sales.groupBy(F.col("Description").alias("Product"), F.to_date("InvoiceDate").alias("Date")).agg(
        F.sum("Quantity").alias("units")
    )
    return daily.withColumn("smooth", explore.rolling_mean(daily, "units", ["Product"], "Date", 7))


@query(
    "w6_chronological_split",
    with_tables(
        f"""SELECT Country, {day('Date')} AS Date, CASE WHEN row_number() OVER (PARTITION BY Country ORDER BY Date)
              <= floor(count(*) OVER (PARTITION BY Country) * 0.8) THEN 'train' ELSE 'test' END AS part
            FROM (SELECT DISTINCT Country, CAST(InvoiceDate AS DATE) AS Date FROM sales)"""
    ),
)
def _(f):
    series = forecast.daily_series(f.sales, "Country")
    return forecast.split_by_time(series, ["Country"]).select("Country", "Date", "part")

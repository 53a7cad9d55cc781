"""Customer analytics, baskets, models and clusters."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll.models import anomalies, churn, clusters, forecast, forest, importance
from tillroll.operators import baskets, cleaning, cohorts, customers, dashboard, profiling, ranking, reports
from tillroll.plans import forests, isolation, kmeans, sql
from tillroll.plans.registry import query
from tillroll.plans.reports import BASKET_TABLES, DAILY_DEMAND
from tillroll.plans.sql import compared, day, half_even, metric, metrics, with_tables

_RFM = {
    "members": f"""SELECT CustomerID,
                     {sql.elapsed('LastPurchase', "(SELECT max(InvoiceDate) FROM sales) + INTERVAL 1 DAY")} AS Recency,
                     Frequency, MonetaryValue AS Monetary
                   FROM ({sql.customers('sales')}) WHERE CustomerID != 'Guest'""",
    "ranked": "SELECT *, row_number() OVER (ORDER BY Frequency, CustomerID) AS place FROM members",
    "edges": """SELECT quantile_cont(Recency, [0.2, 0.4, 0.6, 0.8]) AS r,
                  quantile_cont(place, [0.2, 0.4, 0.6, 0.8]) AS f,
                  quantile_cont(Monetary, [0.2, 0.4, 0.6, 0.8]) AS m FROM ranked""",
    "scored": """SELECT CustomerID, Recency, Frequency, Monetary,
                   CAST(5 - len(list_filter(r, lambda e: Recency > e)) AS INT) AS R_Score,
                   CAST(1 + len(list_filter(f, lambda e: place > e)) AS INT) AS F_Score,
                   CAST(1 + len(list_filter(m, lambda e: Monetary > e)) AS INT) AS M_Score
                 FROM ranked, edges""",
    "rfm": """SELECT *, R_Score + F_Score + M_Score AS RFM_Score,
                CASE WHEN RFM_Score >= 13 THEN 'Champions'
                     WHEN RFM_Score >= 11 THEN 'Loyal Customers'
                     WHEN RFM_Score >= 9 THEN 'Potential Loyalists'
                     WHEN RFM_Score >= 7 THEN 'Recent Customers'
                     WHEN RFM_Score >= 5 THEN 'At Risk'
                     ELSE 'Lost' END AS Segment FROM scored""",
}


@query(
    "r1_rfm_scores",
    with_tables(f"SELECT * REPLACE ({compared('Monetary')} AS Monetary) FROM rfm", **_RFM),
)
def _(f):
    return customers.rfm_scores(f.sales)


@query(
    "r2_rfm_summary",
    with_tables(
        f"""SELECT Segment, count(*) AS customers, {compared('sum(Monetary)')} AS revenue,
              {compared('avg(Recency)')} AS avg_recency, {compared('avg(Frequency)')} AS avg_frequency,
              {compared('avg(Monetary)')} AS avg_monetary FROM rfm GROUP BY Segment""",
        **_RFM,
    ),
)
def _(f):
    return customers.rfm_summary(customers.rfm_scores(f.sales))


@query(
    "r2_rfm_insights",
    with_tables(
        metrics(
            metric("total_customers_analyzed", "count(*)", source="FROM rfm"),
            metric("champions_count", "count(*)", source="FROM rfm WHERE Segment = 'Champions'"),
            metric("champions_revenue", "sum(Monetary)", source="FROM rfm WHERE Segment = 'Champions'"),
            metric("at_risk_count", "count(*)", source="FROM rfm WHERE Segment = 'At Risk'"),
            metric("lost_count", "count(*)", source="FROM rfm WHERE Segment = 'Lost'"),
            metric("avg_recency", "avg(Recency)", source="FROM rfm"),
            metric("avg_frequency", "avg(Frequency)", source="FROM rfm"),
            metric("avg_monetary", "avg(Monetary)", source="FROM rfm"),
        ),
        **_RFM,
    ),
)
def _(f):
    return customers.rfm_insights(customers.rfm_scores(f.sales))


_CLV = {
    "lives": f"""SELECT CustomerID, Frequency AS PurchaseCount, MonetaryValue AS TotalRevenue,
                   {sql.elapsed('FirstPurchase', 'LastPurchase')} AS LifespanDays
                 FROM ({sql.customers('sales')}) WHERE CustomerID != 'Guest'""",
    "clv": """SELECT *, LifespanDays / 30.0 AS LifespanMonths, TotalRevenue / PurchaseCount AS AvgOrderValue,
                PurchaseCount / nullif(LifespanDays / 30.0, 0) AS PurchaseFrequency,
                coalesce(AvgOrderValue * PurchaseFrequency * LifespanMonths, 0) AS CLV FROM lives""",
}
_CLV_COLUMNS = f"""CustomerID, PurchaseCount, {compared('TotalRevenue')} AS TotalRevenue, LifespanDays,
  {compared('AvgOrderValue')} AS AvgOrderValue, {compared('PurchaseFrequency')} AS PurchaseFrequency,
  {compared('LifespanMonths')} AS LifespanMonths, {compared('CLV')} AS CLV"""


@query("v1_lifetime_value", with_tables(f"SELECT {_CLV_COLUMNS} FROM clv", **_CLV))
def _(f):
    return customers.lifetime_value(f.sales)


@query(
    "v2_lifetime_value_summary",
    with_tables(
        metrics(
            metric("avg_clv", "avg(CLV)", source="FROM clv"),
            metric("median_clv", "median(CLV)", source="FROM clv"),
            metric("top_clv", "max(CLV)", source="FROM clv"),
            metric("avg_order_value", "avg(AvgOrderValue)", source="FROM clv"),
            metric(
                "avg_purchase_frequency",
                "CASE WHEN count(*) FILTER (LifespanDays = 0) = 0 THEN avg(PurchaseFrequency) END",
                source="FROM clv",
            ),
            metric("zero_lifespan_customers", "count(*) FILTER (LifespanDays = 0)", source="FROM clv"),
            metric("total_customer_value", "sum(CLV)", source="FROM clv"),
        ),
        **_CLV,
    ),
)
def _(f):
    return customers.lifetime_value_summary(customers.lifetime_value(f.sales))


@query(
    "v3_value_bands",
    with_tables(
        """SELECT CASE WHEN CLV <= 100 THEN '<$100' WHEN CLV <= 500 THEN '$100-500' WHEN CLV <= 1000 THEN '$500-1K'
                       WHEN CLV <= 5000 THEN '$1K-5K' ELSE '>$5K' END AS band, count(*) AS customers
           FROM clv WHERE CLV > 0 GROUP BY 1""",
        **_CLV,
    ),
)
def _(f):
    return customers.lifetime_value_bands(customers.lifetime_value(f.sales))


@query(
    "v3_top_lifetime_values",
    with_tables(f"SELECT {_CLV_COLUMNS} FROM clv ORDER BY clv.CLV DESC, CustomerID LIMIT 20", **_CLV),
)
def _(f):
    return customers.top_lifetime_values(customers.lifetime_value(f.sales))


def _histogram_sql(column, bins, source, **extra):
    return with_tables(
        f"""SELECT bin, {compared(f'low + (bin - 1) * (high - low) / {bins}.0')} AS lower,
              {compared(f'low + bin * (high - low) / {bins}.0')} AS upper, count({column}) AS rows
            FROM range(1, {bins + 1}) AS r(bin) CROSS JOIN extent
            LEFT JOIN placed USING (bin) GROUP BY bin, low, high""",
        **extra,
        extent=f"SELECT min({column}) AS low, max({column}) AS high FROM {source}",
        placed=f"""SELECT {column},
                     least(1 + CAST(floor(({column} - low) * {bins} / (high - low)) AS BIGINT), {bins}) AS bin
                   FROM {source}, extent""",
    )


@query("v4_frequency_histogram", _histogram_sql("PurchaseCount", 30, "lives", **_CLV))
def _(f):
    members = customers.customer_aggregate(customers.registered(f.sales))
    return customers.histogram(members, "Frequency", 30)


@query("v4_value_histogram", _histogram_sql("CLV", 50, "clv", **_CLV))
def _(f):
    return customers.histogram(customers.lifetime_value(f.sales), "CLV", 50)


_COHORTS = {
    "dated": """SELECT CustomerID, InvoiceDate, min(InvoiceDate) OVER (PARTITION BY CustomerID) AS first
                FROM sales WHERE CustomerID != 'Guest'""",
    "cohort_data": """SELECT strftime(first, '%Y-%m') AS CohortMonth,
                        CAST((year(InvoiceDate) * 12 + month(InvoiceDate)) - (year(first) * 12 + month(first)) AS INT)
                          AS CohortIndex, count(DISTINCT CustomerID) AS CustomerCount FROM dated GROUP BY 1, 2""",
    "sized": """SELECT *, first_value(CustomerCount) OVER (PARTITION BY CohortMonth ORDER BY CohortIndex) AS CohortSize
                FROM cohort_data""",
}


@query(
    "h1_cohort_matrix",
    with_tables(
        f"""SELECT CohortMonth, CohortIndex, CustomerCount, CohortSize,
              {compared('CustomerCount * 100.0 / CohortSize')} AS RetentionPct FROM sized""",
        **_COHORTS,
    ),
)
def _(f):
    return cohorts.retention(f.sales)


@query(
    "h2_cohort_summary",
    with_tables(
        metrics(
            metric("total_cohorts", "count(DISTINCT CohortMonth)", source="FROM sized"),
            metric(
                "avg_month1_retention",
                "avg(CustomerCount * 100.0 / CohortSize)",
                source="FROM sized WHERE CohortIndex = 1",
            ),
            metric(
                "avg_month3_retention",
                "avg(CustomerCount * 100.0 / CohortSize)",
                source="FROM sized WHERE CohortIndex = 3",
            ),
            metric(
                "best_cohort",
                "CohortSize",
                "CohortMonth",
                "FROM (SELECT * FROM sized WHERE CohortIndex = 0 ORDER BY CohortSize DESC, CohortMonth LIMIT 1)",
            ),
        ),
        **_COHORTS,
    ),
)
def _(f):
    return cohorts.retention_summary(cohorts.retention(f.sales))


_TOP_PAIRS = """SELECT Product_A, Product_B, Count, substr(Product_A, 1, 30) AS Product1,
                  substr(Product_B, 1, 30) AS Product2
                FROM pairs ORDER BY Count DESC, Product_A, Product_B LIMIT 20"""


@query("x1_top_pairs", with_tables(_TOP_PAIRS, **BASKET_TABLES))
def _(f):
    return baskets.top_pairs(baskets.best_seller_pairs(f.sales))


@query("t4_most_common", with_tables(_TOP_PAIRS.replace("LIMIT 20", "LIMIT 40"), **BASKET_TABLES))
def _(f):
    return baskets.top_pairs(baskets.best_seller_pairs(f.sales), 40)


@query(
    "x2_affinity_summary",
    with_tables(
        metrics(
            metric("total_unique_pairs", "count(*)", source="FROM pairs"),
            metric(
                "top_pair",
                "Count",
                "Product_A || ' + ' || Product_B",
                "FROM (SELECT * FROM pairs ORDER BY Count DESC, Product_A, Product_B LIMIT 1)",
            ),
            metric("nonempty_basket_share", "avg(CASE WHEN items > 0 THEN 1.0 ELSE 0.0 END)", source="FROM sizes"),
            metric("mean_basket_size", "avg(items)", source="FROM sizes"),
        ),
        **BASKET_TABLES,
        sizes="SELECT InvoiceNo, count(*) FILTER (units > 0) AS items FROM basket GROUP BY InvoiceNo",
    ),
)
def _(f):
    return baskets.affinity_summary(f.sales)


@query(
    "m0_daily_series",
    with_tables(
        f"""SELECT {day('InvoiceDate')} AS Date, {compared('sum(TotalPrice)')} AS Revenue,
              count(DISTINCT InvoiceNo) AS Orders, count(DISTINCT CustomerID) AS Customers
            FROM sales GROUP BY {day('InvoiceDate')}"""
    ),
)
def _(f):
    return forecast.daily_series(f.sales)


_CHURN = f"""SELECT *, CASE WHEN Recency > 90 THEN 1 ELSE 0 END AS Churned FROM (
               SELECT CustomerID, Frequency AS PurchaseFrequency, MonetaryValue AS TotalSpent, AvgOrderValue,
                 TotalQuantity, FirstPurchase, LastPurchase,
                 {sql.elapsed('LastPurchase', '(SELECT max(InvoiceDate) FROM sales)')} AS Recency,
                 {sql.elapsed('FirstPurchase', 'LastPurchase')} AS CustomerLifetime FROM ({sql.customers('sales')}))"""


@query(
    "m3_churn_features",
    with_tables(
        f"""SELECT * REPLACE ({compared('TotalSpent')} AS TotalSpent, {compared('AvgOrderValue')} AS AvgOrderValue)
            FROM features""",
        features=_CHURN,
    ),
)
def _(f):
    return customers.churn_features(f.sales)


@query(
    "m3_churn_distribution",
    with_tables(
        f"""SELECT count(*) FILTER (Churned = 0) AS active, count(*) FILTER (Churned = 1) AS churned,
              {compared('avg(Churned) * 100')} AS churn_rate_pct FROM features""",
        features=_CHURN,
    ),
)
def _(f):
    return customers.churn_distribution(customers.churn_features(f.sales))


@query(
    "m4_split_sizes",
    with_tables(
        """SELECT Churned, CAST(round_even(count(*) * 0.2, 0) AS BIGINT) AS test_rows,
             count(*) - test_rows AS train_rows FROM features GROUP BY Churned""",
        features=_CHURN,
    ),
)
def _(f):
    split = churn.stratified_split(customers.churn_features(f.sales))
    return split.groupBy("Churned").agg(
        F.count_if("is_test").alias("test_rows"), F.count_if(~F.col("is_test")).alias("train_rows")
    )


@query(
    "m4_split_members",
    with_tables(
        """SELECT CustomerID, Churned, row_number() OVER (PARTITION BY Churned ORDER BY md5(CustomerID || '|42'), CustomerID)
             <= round_even(count(*) OVER (PARTITION BY Churned) * 0.2, 0) AS is_test FROM features""",
        features=_CHURN,
    ),
)
def _(f):
    return churn.stratified_split(customers.churn_features(f.sales)).select("CustomerID", "Churned", "is_test")


_SCORED = f"""CustomerID, PurchaseFrequency, {compared('TotalSpent')} AS TotalSpent, {compared('AvgOrderValue')} AS AvgOrderValue,
  TotalQuantity, FirstPurchase, LastPurchase, Recency, CustomerLifetime, Churned, is_test,
  {compared('ChurnProbability')} AS ChurnProbability, prediction"""


@query("m4_churn_scores", sql.with_stored(f"SELECT {_SCORED} FROM scores", forests.churn_tables(_CHURN, forests.FEATURES)))
def _(f):
    return churn.fit_churn(customers.churn_features(f.sales)).scored


# Probabilities and cuts to more digits, from a forest without Recency.
@query(
    "m4_forest_probabilities",
    sql.with_stored(
        f"SELECT CustomerID, {compared('ChurnProbability', 6)} AS ChurnProbability FROM scores",
        forests.churn_tables(_CHURN, forests.LEAK_FREE, trees=20, depth=6, bins=16, seed=7),
    ),
    digits=6,
)
def _(f):
    data = churn.stratified_split(customers.churn_features(f.sales).fillna(0, forests.FEATURES), seed=7)
    train = data.filter(~F.col("is_test"))
    grown = forest.fit(train, "CustomerID", churn.LABEL, forests.LEAK_FREE, trees=20, depth=6, bins=16, seed=7)
    return forest.score(data, grown, "ChurnProbability").select("CustomerID", "ChurnProbability")


@query(
    "m4_forest_cuts",
    sql.with_stored(
        f"""SELECT CAST(tree AS INT) AS tree, CAST(node AS INT) AS node, CAST(f AS INT) AS feature, CAST(bin AS INT) AS cut,
              CAST(n0 AS BIGINT) AS active, CAST(n1 AS BIGINT) AS positive, {compared('score - own', 6)} AS gain FROM cuts""",
        forests.churn_tables(_CHURN, forests.FEATURES, trees=10, depth=5),
    ),
    digits=6,
)
def _(f):
    model = churn.fit_churn(customers.churn_features(f.sales), trees=10, depth=5)
    return model.forest.nodes.filter("feature >= 0")


# The report over a rule instead of the forest, which SQL cannot fit.
@query(
    "m5_rule_report",
    with_tables(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS class,
                  {compared(f'coalesce(sum(hit) * 1.0 / nullif(sum(said), 0), 0)')} AS precision,
                  {compared(f'coalesce(sum(hit) * 1.0 / nullif(sum(actual), 0), 0)')} AS recall,
                  {compared(f'coalesce(sum(hit) * 2.0 / nullif(sum(said) + sum(actual), 0), 0)')} AS f1,
                  CAST(sum(actual) AS BIGINT) AS support
                FROM (SELECT CAST(Churned = {value} AS INT) AS actual, CAST(rule = {value} AS INT) AS said,
                        CAST(Churned = {value} AND rule = {value} AS INT) AS hit
                      FROM (SELECT *, CASE WHEN PurchaseFrequency < 9 THEN 1 ELSE 0 END AS rule FROM features))"""
            for value, name in churn.CLASS_NAMES.items()
        ),
        features=_CHURN,
    ),
)
def _(f):
    rule = F.when(F.col("PurchaseFrequency") < 9, 1).otherwise(0)
    return churn.classification_report(customers.churn_features(f.sales).withColumn("prediction", rule))


_FOREST = forests.churn_tables(_CHURN, forests.FEATURES)
_LEAK_FREE_FOREST = forests.churn_tables(_CHURN, forests.LEAK_FREE)


def _report(source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS class, {compared('coalesce(sum(hit) * 1.0 / nullif(sum(said), 0), 0)', 6)} AS precision,
              {compared('coalesce(sum(hit) * 1.0 / nullif(sum(actual), 0), 0)', 6)} AS recall,
              {compared('coalesce(sum(hit) * 2.0 / nullif(sum(said) + sum(actual), 0), 0)', 6)} AS f1,
              CAST(coalesce(sum(actual), 0) AS BIGINT) AS support
            FROM (SELECT CAST(Churned = {value} AS INT) AS actual, CAST(prediction = {value} AS INT) AS said,
                    CAST(Churned = {value} AND prediction = {value} AS INT) AS hit FROM {source} WHERE is_test)"""
        for value, name in churn.CLASS_NAMES.items()
    )


@query("m5_churn_report", sql.with_stored(_report("scores"), _LEAK_FREE_FOREST), digits=6)
def _(f):
    return churn.evaluate(churn.fit_churn(customers.churn_features(f.sales), leak_free=True))


@query("m5_full_report", sql.with_stored(_report("scores"), _FOREST), digits=6)
def _(f):
    return churn.evaluate(churn.fit_churn(customers.churn_features(f.sales)))


@query(
    "m6_feature_importance",
    sql.with_stored(f"SELECT Feature, {compared('Importance', 6)} AS Importance FROM importances", _FOREST),
    digits=6,
)
def _(f):
    return churn.feature_importance(churn.fit_churn(customers.churn_features(f.sales)))


# Inputs dealt anew in blocks, seen through a fixed rule with two inputs that matter and one that hardly does.
_PERMUTED_BLOCK = 100
_RULE = "Recency > 45 AND PurchaseFrequency < 12 OR TotalSpent < 500"
_PERMUTED = {
    "people": f"""SELECT *, (place - 1) * greatest(1, n // {_PERMUTED_BLOCK}) // n AS block FROM (
                    SELECT *, row_number() OVER (ORDER BY md5(CustomerID || '|42'), CustomerID) AS place, count(*) OVER () AS n
                    FROM ({_CHURN}))""",
    "slots": "SELECT *, row_number() OVER (PARTITION BY block ORDER BY place) AS slot FROM people",
    "dealt": "SELECT CustomerID, Churned, CAST(NULL AS VARCHAR) AS Permuted, Recency, PurchaseFrequency, TotalSpent, CustomerLifetime FROM people"
    + "".join(
        f""" UNION ALL SELECT s.CustomerID, s.Churned, '{c}', {', '.join(('o.' if c == x else 's.') + x for x in ('Recency', 'PurchaseFrequency', 'TotalSpent', 'CustomerLifetime'))}
             FROM slots s JOIN (SELECT block, {c}, row_number() OVER (
               PARTITION BY block ORDER BY md5(CustomerID || '|{c}|42'), CustomerID) AS slot FROM people) o USING (block, slot)"""
        for c in ("Recency", "PurchaseFrequency", "TotalSpent", "CustomerLifetime")
    ),
    "shares": f"SELECT Permuted, avg(CAST((({_RULE}) = (Churned = 1)) AS DOUBLE)) AS share FROM dealt GROUP BY Permuted",
}
_PERMUTED_INPUTS = ["Recency", "PurchaseFrequency", "TotalSpent", "CustomerLifetime"]


@query(
    "m6_permuted_inputs",
    sql.with_stored(
        f"""SELECT CustomerID, Churned, coalesce(Permuted, '') AS Permuted, Recency, PurchaseFrequency,
              {compared('TotalSpent')} AS TotalSpent, CustomerLifetime FROM dealt""",
        _PERMUTED,
    ),
)
def _(f):
    data = customers.churn_features(f.sales).select("CustomerID", "Churned", *_PERMUTED_INPUTS)
    dealt = importance.permuted(data, "CustomerID", _PERMUTED_INPUTS, block=_PERMUTED_BLOCK)
    return dealt.fillna("", importance.INPUT)


@query(
    "m6_permutation_importance",
    sql.with_stored(
        f"""SELECT Permuted AS Feature, {compared('share', 6)} AS Accuracy,
              {compared('(SELECT share FROM shares WHERE Permuted IS NULL) - share', 6)} AS Importance
            FROM shares WHERE Permuted IS NOT NULL""",
        _PERMUTED,
    ),
    digits=6,
)
def _(f):
    data = customers.churn_features(f.sales).select("CustomerID", "Churned", *_PERMUTED_INPUTS)

    def rule(rows):
        return rows.withColumn("prediction", F.expr(f"CAST(({_RULE}) AS INT)"))

    return importance.permutation_importance(data, rule, "CustomerID", "Churned", _PERMUTED_INPUTS, block=_PERMUTED_BLOCK)


@query("m7_at_risk", sql.with_stored(f"SELECT {_SCORED} FROM scores WHERE Churned = 0 AND ChurnProbability > 0.3", _LEAK_FREE_FOREST))
def _(f):
    return churn.at_risk(churn.fit_churn(customers.churn_features(f.sales), leak_free=True).scored, 0.3)


# The threshold in use, on the model with all inputs.
@query("m7_at_risk_full", sql.with_stored(f"SELECT {_SCORED} FROM scores WHERE Churned = 0 AND ChurnProbability > 0.7", _FOREST))
def _(f):
    return churn.at_risk(churn.fit_churn(customers.churn_features(f.sales)).scored, 0.7)


# The list for a given probability: days since the last purchase over the churn limit.
_RISK = f"SELECT *, Recency / 90.0 AS ChurnProbability FROM ({_CHURN})"


@query(
    "m7_risk_summary",
    with_tables(
        f"""SELECT count(*) AS at_risk_customers, coalesce({compared('sum(TotalSpent)')}, 0.0) AS revenue_at_risk
            FROM scored WHERE Churned = 0 AND ChurnProbability > 0.7""",
        scored=_RISK,
    ),
)
def _(f):
    scored = customers.churn_features(f.sales).withColumn("ChurnProbability", F.col("Recency") / 90.0)
    return churn.risk_summary(scored)


@query(
    "m8_product_demand",
    with_tables(
        f"""SELECT Product, {compared('avg(units)')} AS Avg_Daily_Demand,
              (array_agg({compared('smooth')} ORDER BY Date DESC))[1] AS Forecasted_Demand,
              CAST(sum(units) AS BIGINT) AS Total_Sold
            FROM (SELECT *, CASE WHEN count(*) OVER w >= 7 THEN avg(units) OVER w END AS smooth FROM daily
                  WINDOW w AS (PARTITION BY Product ORDER BY Date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
            GROUP BY Product ORDER BY sum(units) DESC, Product LIMIT 20""",
        daily=DAILY_DEMAND,
    ),
)
def _(f):
    return forecast.product_demand(f.sales)


_ISOLATION = isolation.tables("sales")
_ON = ", ".join(anomalies.FEATURES)


@query(
    "m9_anomalies",
    sql.with_stored(
        f"""SELECT {', '.join(f's.{c}' for c in cleaning.DUPLICATE_KEY if c not in anomalies.FEATURES)}, Quantity,
              {compared('UnitPrice')} AS UnitPrice, {compared('TotalPrice')} AS TotalPrice, Hour, DayOfWeek,
              CASE WHEN score > cutoff THEN -1 ELSE 1 END AS Anomaly
            FROM inputs s JOIN scored_tuples USING ({_ON}), limits""",
        _ISOLATION,
    ),
)
def _(f):
    return anomalies.detect_anomalies(f.sales)


def _mean_where(column, condition):
    return compared(f"sum({column} * copies) FILTER ({condition}) / nullif(sum(copies) FILTER ({condition}), 0)")


@query(
    "m9_anomaly_summary",
    sql.with_stored(
        f"""SELECT CAST(sum(copies) AS BIGINT) AS total_transactions, CAST(coalesce(sum(copies) FILTER (score > cutoff), 0) AS BIGINT) AS anomalies,
              {compared('coalesce(sum(copies) FILTER (score > cutoff), 0) * 1.0 / sum(copies)')} AS anomaly_rate,
              {_mean_where('Quantity', 'score > cutoff')} AS avg_quantity_anomalous,
              {_mean_where('Quantity', 'score <= cutoff')} AS avg_quantity_normal,
              {_mean_where('TotalPrice', 'score > cutoff')} AS avg_total_price_anomalous,
              {_mean_where('TotalPrice', 'score <= cutoff')} AS avg_total_price_normal FROM scored_tuples, limits""",
        _ISOLATION,
    ),
)
def _(f):
    return anomalies.anomaly_summary(f.sales)


@query(
    "m9_anomaly_features",
    with_tables(
        f"""SELECT Quantity, {compared('UnitPrice', 4)} AS UnitPrice, {compared('TotalPrice', 4)} AS TotalPrice,
              CAST(hour(InvoiceDate) AS INT) AS Hour, CAST(isodow(InvoiceDate) - 1 AS INT) AS DayOfWeek
            FROM sales"""
    ),
    digits=4,
)
def _(f):
    return anomalies.anomaly_features(f.sales).select(*anomalies.FEATURES)


# Errors of a forecast that SQL can make: the mean of the seven days before.
@query(
    "m10_forecast_errors",
    with_tables(
        f"""SELECT Country, {compared('avg(abs(e))')} AS mae, {compared('sqrt(avg(e * e))')} AS rmse,
              {compared('avg(abs(e / nullif(actual, 0))) * 100')} AS mape
            FROM (SELECT Country, actual, actual - avg(actual) OVER (PARTITION BY Country ORDER BY Date
                    ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS e,
                    row_number() OVER (PARTITION BY Country ORDER BY Date) AS place,
                    count(*) OVER (PARTITION BY Country) AS n
                  FROM (SELECT Country, CAST(InvoiceDate AS DATE) AS Date, sum(TotalPrice) AS actual
                        FROM sales GROUP BY 1, 2))
            WHERE place > floor(n * 0.8) GROUP BY Country"""
    ),
)
def _(f):
    series = forecast.split_by_time(forecast.daily_series(f.sales, "Country"), ["Country"])
    before = Window.partitionBy("Country").orderBy("Date").rowsBetween(-7, -1)
    guessed = series.withColumn("forecast", F.avg("Revenue").over(before)).withColumnRenamed("Revenue", "actual")
    return forecast.forecast_errors(guessed, ["Country"])


_FEATURES = f"""SELECT CustomerID, Frequency, MonetaryValue, AvgOrderValue, TotalQuantity, FirstPurchase, LastPurchase,
                  {sql.elapsed('LastPurchase', '(SELECT max(InvoiceDate) FROM tx)')} AS Recency,
                  {sql.elapsed('FirstPurchase', 'LastPurchase')} AS CustomerLifespan
                FROM ({sql.customers('tx')}) WHERE CustomerID != 'Guest' AND MonetaryValue > 0"""
_TIERS = f"SELECT *, CAST(ntile(5) OVER (ORDER BY MonetaryValue DESC, CustomerID) - 1 AS INT) AS Cluster FROM features"
_PROFILE = f"""SELECT Cluster, count(*) AS Customers, {half_even('avg(Recency)')} AS Avg_Recency,
                 {half_even('avg(Frequency)')} AS Avg_Frequency, {half_even('avg(MonetaryValue)')} AS Avg_MonetaryValue,
                 {half_even('sum(MonetaryValue)')} AS Total_Revenue, {half_even('avg(AvgOrderValue)')} AS Avg_OrderValue,
                 {half_even('avg(TotalQuantity)')} AS Avg_Quantity, {half_even('avg(CustomerLifespan)')} AS Avg_Lifespan,
                 CASE WHEN Avg_Recency < 50 AND Avg_Frequency > 10 AND Avg_MonetaryValue > 3000
                        THEN '{clusters.VIP}'
                      WHEN Avg_Recency < 80 AND Avg_Frequency > 5 THEN '{clusters.LOYAL}'
                      WHEN Avg_Recency < 100 AND Avg_MonetaryValue > 2000 THEN '{clusters.HIGH_VALUE}'
                      WHEN Avg_Recency > 150 THEN '{clusters.LOST}'
                      ELSE '{clusters.GROWERS}' END AS Cluster_Name
               FROM tiers GROUP BY Cluster"""
_CLUSTERS = {"features": _FEATURES, "tiers": _TIERS, "profile": _PROFILE}
_LABELLED = {
    **_CLUSTERS,
    "labelled": """SELECT t.*, p.Cluster_Name AS ClusterName FROM tiers t LEFT JOIN profile p USING (Cluster)""",
}


def _tiers(f):
    """Assignments that SQL can make too: five tiers of customer value."""
    members = customers.cluster_features(f.tx)
    tier = ranking.ntile(members, [("MonetaryValue", False), "CustomerID"], 5) - 1
    return members.withColumn("Cluster", tier)


def _labelled(f):
    return clusters.labelled_customers(_tiers(f))


@query(
    "k1_cluster_features",
    with_tables(
        f"""SELECT * REPLACE ({compared('MonetaryValue')} AS MonetaryValue, {compared('AvgOrderValue')} AS AvgOrderValue)
            FROM features""",
        features=_FEATURES,
    ),
)
def _(f):
    return customers.cluster_features(f.tx)


@query(
    "k1_feature_summary",
    with_tables(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count({c}) AS count, {compared(f'avg({c})')} AS mean,
                  {compared(f'stddev_samp({c})')} AS std, {compared(f'min({c})')} AS min,
                  {compared(f'quantile_cont({c}, 0.25)')} AS q25, {compared(f'quantile_cont({c}, 0.5)')} AS median,
                  {compared(f'quantile_cont({c}, 0.75)')} AS q75, {compared(f'max({c})')} AS max FROM features"""
            for c in clusters.FEATURES
        ),
        features=_FEATURES,
    ),
)
def _(f):
    return profiling.numeric_summary(customers.cluster_features(f.tx), clusters.FEATURES)


@query(
    "k2_standardised",
    with_tables(
        "SELECT CustomerID, "
        + ", ".join(
            f"""{compared(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()', 4)} AS scaled_{c}"""
            for c in clusters.FEATURES
        )
        + " FROM features",
        features=_FEATURES,
    ),
    digits=4,
)
def _(f):
    scaled = clusters.standardise(customers.cluster_features(f.tx))
    return scaled.select("CustomerID", *[f"scaled_{c}" for c in clusters.FEATURES])


_ELBOW, _ELBOW_TABLES = kmeans.elbow()


@query("k3_elbow", sql.with_recursive(_ELBOW, {"features": _FEATURES, **_ELBOW_TABLES}), digits=4)
def _(f):
    found = clusters.elbow(customers.cluster_features(f.tx))
    return found.withColumn("inertia", F.round("inertia", 2))


_KMEANS = {"features": _FEATURES, **kmeans.clustered(), "profile": _PROFILE}


@query(
    "k4_clusters",
    sql.with_recursive(
        f"""SELECT * REPLACE ({compared('MonetaryValue')} AS MonetaryValue, {compared('AvgOrderValue')} AS AvgOrderValue) FROM tiers""",
        _KMEANS,
    ),
)
def _(f):
    return clusters.cluster_customers(customers.cluster_features(f.tx))


def _silhouette_sql(name, distance):
    """All pairs of customers, which is what the score is defined on."""
    scaled = ", ".join(
        f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS x{i}" for i, c in enumerate(clusters.FEATURES)
    )
    squares = " + ".join(f"(a.x{i} - b.x{i}) ** 2" for i in range(len(clusters.FEATURES)))
    return with_tables(
        f"""SELECT '{name}' AS metric, {compared('avg(width)')} AS number, CAST(NULL AS VARCHAR) AS label FROM (
              SELECT CustomerID, min(mean) FILTER (Cluster != other) AS outside,
                any_value(mean) FILTER (Cluster = other) AS inside,
                coalesce((outside - inside) / greatest(outside, inside), 0) AS width
              FROM distances GROUP BY CustomerID)""",
        **_CLUSTERS,
        points=f"SELECT CustomerID, Cluster, {scaled} FROM tiers",
        distances=f"""SELECT a.CustomerID, a.Cluster, b.Cluster AS other,
                        sum({distance.format(squares)}) / nullif(count(*) - CAST(a.Cluster = b.Cluster AS INT), 0)
                          AS mean
                      FROM points a, points b GROUP BY a.CustomerID, a.Cluster, b.Cluster""",
    )


@query("k5_silhouette", _silhouette_sql("silhouette_squared_euclidean", "{}"))
def _(f):
    return clusters.silhouette(_tiers(f))


_SCALED = [f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS x{i}" for i, c in enumerate(clusters.FEATURES)]
_AXES = range(len(clusters.FEATURES))


@query(
    "k5_centroid_silhouette",
    with_tables(
        f"""SELECT 'silhouette_centroid' AS metric, {compared('avg(coalesce((outside - inside) / greatest(outside, inside), 0))')} AS number,
              CAST(NULL AS VARCHAR) AS label
            FROM (SELECT min(d) FILTER (own != other) AS outside, any_value(d) FILTER (own = other) AS inside
                  FROM distances GROUP BY CustomerID)""",
        **_CLUSTERS,
        points=f"SELECT CustomerID, Cluster, {', '.join(_SCALED)} FROM tiers",
        centres=f"SELECT Cluster, {', '.join(f'avg(x{i}) AS m{i}' for i in _AXES)} FROM points GROUP BY Cluster",
        distances=f"""SELECT CustomerID, p.Cluster AS own, c.Cluster AS other,
                        sqrt({' + '.join(f'(x{i} - m{i}) ** 2' for i in _AXES)}) AS d FROM points p, centres c""",
    ),
)
def _(f):
    return clusters.centroid_silhouette(_tiers(f))


_PROFILE_SELECT = f"""SELECT *, {half_even('Customers * 100.0 / sum(Customers) OVER ()', 1)} AS Customer_Pct,
  {half_even('Total_Revenue * 100.0 / sum(Total_Revenue) OVER ()', 1)} AS Revenue_Pct,
  CASE Cluster_Name {' '.join(f"WHEN '{name}' THEN '{advice}'" for name, advice in clusters.STRATEGIES.items())} END
    AS Strategy FROM profile"""


@query("k6_cluster_profile", with_tables(_PROFILE_SELECT, **_CLUSTERS))
def _(f):
    return clusters.cluster_profile(_tiers(f))


@query("k6_kmeans_profile", sql.with_recursive(_PROFILE_SELECT, _KMEANS))
def _(f):
    return clusters.cluster_profile(clusters.cluster_customers(customers.cluster_features(f.tx)))


# The naming rule on single customers reaches more of its branches than on five clusters.
@query(
    "k7_names",
    with_tables(
        f"""SELECT CustomerID, CASE WHEN Recency < 50 AND Frequency > 10 AND MonetaryValue > 3000
                                      THEN '{clusters.VIP}'
                                    WHEN Recency < 80 AND Frequency > 5 THEN '{clusters.LOYAL}'
                                    WHEN Recency < 100 AND MonetaryValue > 2000 THEN '{clusters.HIGH_VALUE}'
                                    WHEN Recency > 150 THEN '{clusters.LOST}'
                                    ELSE '{clusters.GROWERS}' END AS Cluster_Name FROM features""",
        features=_FEATURES,
    ),
)
def _(f):
    members = customers.cluster_features(f.tx)
    return members.select(
        "CustomerID", clusters.cluster_name("Recency", "Frequency", "MonetaryValue").alias("Cluster_Name")
    )


@query(
    "k8_strategies",
    with_tables(f"SELECT Cluster, Cluster_Name, Strategy FROM ({_PROFILE_SELECT})", **_CLUSTERS),
)
def _(f):
    return clusters.cluster_profile(_tiers(f)).select("Cluster", "Cluster_Name", "Strategy")


_LABELLED_COLUMNS = f"""CustomerID, Cluster, Recency, Frequency, {compared('MonetaryValue')} AS MonetaryValue,
  {compared('AvgOrderValue')} AS AvgOrderValue, TotalQuantity, CustomerLifespan, ClusterName"""


@query("k9_labelled_customers", with_tables(f"SELECT {_LABELLED_COLUMNS} FROM labelled", **_LABELLED))
def _(f):
    return _labelled(f)


@query(
    "k9_cluster_sizes",
    with_tables("SELECT Cluster, count(*) AS customers FROM tiers GROUP BY Cluster", **_CLUSTERS),
)
def _(f):
    return clusters.cluster_sizes(_tiers(f))


@query(
    "j4_label_lookup",
    with_tables("SELECT CustomerID, ClusterName FROM labelled", **_LABELLED),
)
def _(f):
    return _labelled(f).select("CustomerID", "ClusterName")


@query(
    "l2_cluster_rollup",
    with_tables(
        f"""SELECT ClusterName, count(*) AS customers, {compared('sum(MonetaryValue)')} AS revenue,
              {compared('avg(MonetaryValue)')} AS avg_value, {compared('avg(Recency)')} AS avg_recency,
              {compared('avg(Frequency)')} AS avg_frequency FROM labelled GROUP BY ClusterName""",
        **_LABELLED,
    ),
)
def _(f):
    return reports.cluster_rollup(_labelled(f))


@query(
    "l3_cluster_personas",
    with_tables(
        f"""SELECT ClusterName, count(*) AS customer_count, {compared('avg(MonetaryValue)')} AS avg_lifetime_value,
              {compared('avg(Frequency)', 1)} AS avg_orders, {compared('avg(Recency)', 0)} AS avg_days_since_purchase,
              {compared('avg(AvgOrderValue)')} AS avg_order_size, {compared('sum(MonetaryValue)')} AS total_revenue
            FROM labelled GROUP BY ClusterName""",
        **_LABELLED,
    ),
)
def _(f):
    return reports.cluster_personas(_labelled(f))


@query(
    "l4_cluster_sample",
    with_tables(
        f"""SELECT CustomerID, Cluster, ClusterName, {compared('MonetaryValue')} AS MonetaryValue FROM labelled
            ORDER BY CustomerID LIMIT 5""",
        **_LABELLED,
    ),
)
def _(f):
    return reports.cluster_sample(_labelled(f))


_MONEY = """CASE WHEN {0} >= 1000000 THEN printf('$%.2fM', {0} / 1000000.0)
                 WHEN {0} >= 1000 THEN printf('$%.1fK', {0} / 1000.0) ELSE printf('$%.0f', {0}) END"""


@query(
    "d8_segment_summary",
    with_tables(
        f"""SELECT *,
              CASE WHEN Customers >= 1000 THEN printf('%.0fK', Customers / 1000.0)
                   ELSE printf('%d', Customers) END AS Customers_Label,
              {_MONEY.format('Total_Revenue')} AS Total_Revenue_Label,
              {_MONEY.format('Avg_Revenue')} AS Avg_Revenue_Label,
              printf('%.0f days', Avg_Recency) AS Avg_Recency_Label,
              printf('%.1f orders', Avg_Frequency) AS Avg_Frequency_Label
            FROM (SELECT ClusterName, count(CustomerID) AS Customers,
                    {half_even('sum(MonetaryValue)')} AS Total_Revenue, {half_even('avg(MonetaryValue)')} AS Avg_Revenue,
                    {half_even('avg(Frequency)')} AS Avg_Frequency, {half_even('avg(Recency)')} AS Avg_Recency
                  FROM labelled GROUP BY ClusterName)""",
        **_LABELLED,
    ),
)
def _(f):
    return dashboard.segment_summary(_labelled(f))


# The same reports with a name per customer instead of one per cluster, so that several names occur.
_NAMED = {
    "features": _FEATURES,
    "labelled": f"""SELECT *, CASE WHEN Recency < 50 AND Frequency > 10 AND MonetaryValue > 3000 THEN '{clusters.VIP}'
                                   WHEN Recency < 80 AND Frequency > 5 THEN '{clusters.LOYAL}'
                                   WHEN Recency < 100 AND MonetaryValue > 2000 THEN '{clusters.HIGH_VALUE}'
                                   WHEN Recency > 150 THEN '{clusters.LOST}'
                                   ELSE '{clusters.GROWERS}' END AS ClusterName FROM features""",
}


def _named(f):
    name = clusters.cluster_name("Recency", "Frequency", "MonetaryValue")
    return customers.cluster_features(f.tx).withColumn("ClusterName", name)


@query(
    "l2_named_customers",
    with_tables(
        f"""SELECT ClusterName, count(*) AS customers, {compared('sum(MonetaryValue)')} AS revenue,
              {compared('avg(MonetaryValue)')} AS avg_value, {compared('avg(Recency)')} AS avg_recency,
              {compared('avg(Frequency)')} AS avg_frequency FROM labelled GROUP BY ClusterName""",
        **_NAMED,
    ),
)
def _(f):
    return reports.cluster_rollup(_named(f))


@query(
    "l3_named_customers",
    with_tables(
        f"""SELECT ClusterName, count(*) AS customer_count, {compared('avg(MonetaryValue)')} AS avg_lifetime_value,
              {compared('avg(Frequency)', 1)} AS avg_orders, {compared('avg(Recency)', 0)} AS avg_days_since_purchase,
              {compared('avg(AvgOrderValue)')} AS avg_order_size, {compared('sum(MonetaryValue)')} AS total_revenue
            FROM labelled GROUP BY ClusterName""",
        **_NAMED,
    ),
)
def _(f):
    return reports.cluster_personas(_named(f))


@query(
    "d8_named_customers",
    with_tables(
        f"""SELECT *,
              CASE WHEN Customers >= 1000 THEN printf('%.0fK', Customers / 1000.0)
                   ELSE printf('%d', Customers) END AS Customers_Label,
              {_MONEY.format('Total_Revenue')} AS Total_Revenue_Label,
              {_MONEY.format('Avg_Revenue')} AS Avg_Revenue_Label,
              printf('%.0f days', Avg_Recency) AS Avg_Recency_Label,
              printf('%.1f orders', Avg_Frequency) AS Avg_Frequency_Label
            FROM (SELECT ClusterName, count(CustomerID) AS Customers,
                    {half_even('sum(MonetaryValue)')} AS Total_Revenue, {half_even('avg(MonetaryValue)')} AS Avg_Revenue,
                    {half_even('avg(Frequency)')} AS Avg_Frequency, {half_even('avg(Recency)')} AS Avg_Recency
                  FROM labelled GROUP BY ClusterName)""",
        **_NAMED,
    ),
)
def _(f):
    return dashboard.segment_summary(_named(f))

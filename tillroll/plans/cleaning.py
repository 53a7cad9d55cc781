"""Sources, sinks, cleaning and profiling."""

import uuid

from pyspark.sql import functions as F

from tillroll.operators import cleaning, profiling
from tillroll.plans.registry import query
from tillroll.plans.sql import compared, half_even, with_tables
from tillroll.schema import RAW, TRANSACTIONS
from tillroll.sources import tables
from tillroll.staging import new_path

_BY_COUNTRY = """SELECT Country, count(*) AS rows, count(CustomerID) AS named, count(Description) AS described,
  CAST(sum(Quantity) AS BIGINT) AS units, {price} AS prices, min(InvoiceDate) AS first, max(InvoiceDate) AS last
FROM {source} GROUP BY Country"""


def _by_country(df):
    return df.groupBy("Country").agg(
        F.count("*").alias("rows"),
        F.count("CustomerID").alias("named"),
        F.count("Description").alias("described"),
        F.sum("Quantity").alias("units"),
        F.sum("UnitPrice").alias("prices"),
        F.min("InvoiceDate").alias("first"),
        F.max("InvoiceDate").alias("last"),
    )


def _by_country_sql(source):
    return with_tables(_BY_COUNTRY.format(price=compared("sum(UnitPrice)"), source=source))


@query("s1_raw_scan", _by_country_sql("raw"))
def _(f):
    path = new_path(f.spark, "raw")
    f.raw.write.parquet(path)
    return _by_country(tables.read_raw(f.spark, path))


@query("s2_csv_table", _by_country_sql("tx"))
def _(f):
    path = new_path(f.spark, "csv")
    tables.write_result(f.tx, path)
    view = f"transactions_{uuid.uuid4().hex}"  # runs side by side share no names
    result = _by_country(tables.register_transactions(tables.read_transactions(f.spark, path, "csv"), view))
    f.spark.catalog.dropTempView(view)
    return result


@query("s3_csv_timestamps", with_tables("SELECT InvoiceDate, count(*) AS rows FROM raw GROUP BY InvoiceDate"))
def _(f):
    path = new_path(f.spark, "csv")
    tables.write_result(f.raw, path)
    return tables.read_raw(f.spark, path, "csv").groupBy("InvoiceDate").agg(F.count("*").alias("rows"))


_SPARK_TYPES = ", ".join(
    f"({i}, '{field.name}', '{field.dataType.simpleString()}')" for i, field in enumerate(TRANSACTIONS, start=1)
)


@query(
    "s4_table_schema",
    with_tables(
        f"""SELECT position, column_name, column_type, (SELECT count(*) FROM tx) AS row_count
            FROM (VALUES {_SPARK_TYPES}) AS v(position, column_name, column_type)"""
    ),
)
def _(f):
    return tables.describe_table(f.tx)


@query(
    "s5_partitioned_sink",
    with_tables(
        f"""SELECT 'all' AS part, YearMonth, count(*) AS rows, {compared('sum(TotalPrice)')} AS revenue
            FROM tx GROUP BY YearMonth
            UNION ALL
            SELECT 'sales', YearMonth, count(*), {compared('sum(TotalPrice)')} FROM sales GROUP BY YearMonth"""
    ),
)
def _(f):
    everything, sold = new_path(f.spark, "tx"), new_path(f.spark, "sales")
    tables.write_cleaned(f.raw, everything, sources=False)
    tx = tables.read_transactions(f.spark, everything)
    tables.write_sales(tx, sold)

    def totals(part, df):
        return df.groupBy(F.lit(part).alias("part"), "YearMonth").agg(
            F.count("*").alias("rows"), F.sum("TotalPrice").alias("revenue")
        )

    return totals("all", tx).unionByName(totals("sales", tables.read_transactions(f.spark, sold)))


# Two loads that share lines, months and duplicates give what one load of everything gives.
@query(
    "s5_incremental_loads",
    with_tables(
        f"""SELECT InvoiceNo, StockCode, CustomerID, Description, Country, Quantity, IsReturn, YearMonth, InvoiceDate,
              {compared('UnitPrice')} AS UnitPrice, {compared('TotalPrice')} AS TotalPrice FROM tx"""
    ),
)
def _(f):
    path = new_path(f.spark, "growing")
    part = F.pmod(F.hash("InvoiceNo"), F.lit(4))
    tables.append_transactions(f.raw.filter(part < 3), path)
    tables.append_transactions(f.raw.filter(part > 1), path)
    stored = tables.read_transactions(f.spark, path)
    return stored.select(
        "InvoiceNo", "StockCode", "CustomerID", "Description", "Country", "Quantity", "IsReturn", "YearMonth",
        "InvoiceDate", "UnitPrice", "TotalPrice",
    )


@query(
    "s6_csv_sink",
    with_tables(f"SELECT Country, {compared('sum(TotalPrice)')} AS Revenue FROM tx GROUP BY Country"),
)
def _(f):
    path = new_path(f.spark, "result")
    tables.write_result(f.tx.groupBy("Country").agg(F.sum("TotalPrice").alias("Revenue")), path)
    return f.spark.read.schema("Country string, Revenue double").csv(path, header=True)


@query("s7_replace_table", with_tables("SELECT CustomerID, count(*) AS rows FROM tx GROUP BY CustomerID"))
def _(f):
    counts = f.tx.groupBy("CustomerID").agg(F.count("*").alias("rows"))
    name = f"customers_{uuid.uuid4().hex}"
    tables.replace_table(counts.limit(0), name, new_path(f.spark, "table"))
    result = tables.replace_table(counts, name, new_path(f.spark, "table"))
    f.spark.sql(f"DROP TABLE {name}")  # the files stay
    return result


_RAW_COLUMNS = ", ".join(RAW.fieldNames())


@query(
    "c1_missing_customers",
    with_tables(
        """SELECT 'guest' AS strategy, coalesce(CustomerID, 'Guest') AS CustomerID, count(*) AS rows
           FROM raw GROUP BY ALL
           UNION ALL
           SELECT 'remove', CustomerID, count(*) FROM raw WHERE CustomerID IS NOT NULL GROUP BY ALL"""
    ),
)
def _(f):
    def counted(strategy):
        kept = cleaning.handle_missing_customers(f.raw, strategy)
        return kept.groupBy(F.lit(strategy).alias("strategy"), "CustomerID").agg(F.count("*").alias("rows"))

    return counted("guest").unionByName(counted("remove"))


@query(
    "c2_flag_returns",
    with_tables("SELECT Quantity < 0 AS IsReturn, Quantity, count(*) AS rows FROM raw GROUP BY ALL"),
)
def _(f):
    return cleaning.flag_returns(f.raw).groupBy("IsReturn", "Quantity").agg(F.count("*").alias("rows"))


@query(
    "c3_bad_prices",
    with_tables(
        f"""SELECT StockCode, count(*) AS rows, {compared('sum(UnitPrice)')} AS prices
            FROM raw WHERE NOT coalesce(UnitPrice <= 0 OR UnitPrice > 10000, FALSE) GROUP BY StockCode"""
    ),
)
def _(f):
    kept = cleaning.remove_bad_prices(f.raw)
    return kept.groupBy("StockCode").agg(F.count("*").alias("rows"), F.sum("UnitPrice").alias("prices"))


@query(
    "c4_duplicates",
    with_tables(
        f"""SELECT {_RAW_COLUMNS.replace('UnitPrice', compared('UnitPrice') + ' AS UnitPrice')}
            FROM (SELECT *, row_number() OVER (
                    PARTITION BY InvoiceNo, StockCode, CustomerID, Quantity, UnitPrice, InvoiceDate
                    ORDER BY Description NULLS LAST, Country NULLS LAST) AS copy FROM raw)
            WHERE copy = 1"""
    ),
)
def _(f):
    return cleaning.remove_duplicates(f.raw)


@query(
    "c5_missing_descriptions",
    with_tables(
        """SELECT 'unknown' AS strategy, coalesce(Description, 'Unknown Product') AS Description, count(*) AS rows
           FROM raw GROUP BY ALL
           UNION ALL
           SELECT 'remove', Description, count(*) FROM raw WHERE Description IS NOT NULL GROUP BY ALL"""
    ),
)
def _(f):
    def counted(strategy):
        kept = cleaning.handle_missing_descriptions(f.raw, strategy)
        return kept.groupBy(F.lit(strategy).alias("strategy"), "Description").agg(F.count("*").alias("rows"))

    return counted("unknown").unionByName(counted("remove"))


_CALENDAR = ["Year", "Month", "Day", "DayOfWeek", "Hour", "MonthName", "DayName", "YearMonth"]


@query(
    "c6_calculated_fields",
    with_tables(
        f"""SELECT {', '.join(_CALENDAR)}, count(*) AS rows, {compared('sum(TotalPrice)')} AS TotalPrice
            FROM tx GROUP BY ALL"""
    ),
)
def _(f):
    return f.tx.groupBy(*_CALENDAR).agg(F.count("*").alias("rows"), F.sum("TotalPrice").alias("TotalPrice"))


@query(
    "c7_clean_text",
    with_tables(
        r"""SELECT regexp_replace(regexp_replace(Description, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS Description,
              Country, count(*) AS rows FROM raw GROUP BY ALL"""
    ),
)
def _(f):
    return cleaning.clean_text(f.raw).groupBy("Description", "Country").agg(F.count("*").alias("rows"))


@query(
    "c8_validation",
    with_tables(
        """SELECT 'no_null_customerid' AS "check", bool_and(CustomerID IS NOT NULL) AS passed FROM tx
           UNION ALL SELECT 'no_null_description', bool_and(Description IS NOT NULL) FROM tx
           UNION ALL SELECT 'positive_prices', bool_and(UnitPrice > 0) FROM tx
           UNION ALL SELECT 'valid_quantities', bool_and(Quantity IS NOT NULL) FROM tx
           UNION ALL SELECT 'has_total_price', TRUE
           UNION ALL SELECT 'has_date_fields', TRUE"""
    ),
)
def _(f):
    return cleaning.validate(f.tx)


@query(
    "c9_cleaning_summary",
    with_tables(
        f"""SELECT original_rows, 8 AS original_columns, final_rows, 18 AS final_columns,
              original_rows - final_rows AS rows_removed,
              {compared('(original_rows - final_rows) * 100.0 / original_rows')} AS removal_percentage,
              missing_customers_original, returns_identified,
              original_rows - priced_rows AS bad_prices_removed, priced_rows - final_rows AS duplicates_removed,
              missing_descriptions_original
            FROM (SELECT (SELECT count(*) FROM raw) AS original_rows, (SELECT count(*) FROM tx) AS final_rows,
                    (SELECT count(*) FROM priced) AS priced_rows,
                    (SELECT count(*) FROM raw WHERE CustomerID IS NULL) AS missing_customers_original,
                    (SELECT count(*) FROM guested WHERE Quantity < 0) AS returns_identified,
                    (SELECT count(*) FROM numbered WHERE copy = 1 AND Description IS NULL)
                      AS missing_descriptions_original)"""
    ),
)
def _(f):
    return cleaning.cleaning_summary(f.raw)


@query(
    "c10_remove_returns",
    with_tables(
        f"""SELECT Country, count(*) AS rows, {compared('sum(TotalPrice)')} AS revenue
            FROM tx WHERE NOT IsReturn GROUP BY Country"""
    ),
)
def _(f):
    kept = cleaning.clean_transactions(f.raw, drop_returns=True)
    return kept.groupBy("Country").agg(F.count("*").alias("rows"), F.sum("TotalPrice").alias("revenue"))


@query(
    "c11_cleaned_kpis",
    with_tables(
        f"""SELECT count(*) AS total_transactions,
              (SELECT count(*) FROM sales) AS sales_transactions,
              (SELECT count(*) FROM tx WHERE IsReturn) AS return_transactions,
              count(DISTINCT CustomerID) AS unique_customers,
              count(DISTINCT StockCode) AS unique_products,
              count(DISTINCT InvoiceNo) AS unique_invoices,
              min(InvoiceDate) AS first_date, max(InvoiceDate) AS last_date,
              (SELECT {compared('sum(TotalPrice)')} FROM sales) AS total_revenue,
              (SELECT {compared('avg(t)')} FROM (SELECT sum(TotalPrice) AS t FROM sales GROUP BY InvoiceNo))
                AS avg_invoice_total,
              (SELECT {compared('avg(UnitPrice)')} FROM sales) AS avg_item_price
            FROM tx"""
    ),
)
def _(f):
    return cleaning.cleaned_kpis(f.tx)


@query(
    "p1_overview",
    with_tables(
        """SELECT count(*) AS row_count, 8 AS column_count, min(InvoiceDate) AS first_date,
             max(InvoiceDate) AS last_date FROM raw"""
    ),
)
def _(f):
    return profiling.overview(f.raw)


def _preview_sql(direction):
    order = ", ".join(
        f"{c} {direction} NULLS LAST"
        for c in ["InvoiceDate", "InvoiceNo", "StockCode", "Description", "Quantity", "UnitPrice", "CustomerID"]
    )
    columns = _RAW_COLUMNS.replace("UnitPrice", compared("UnitPrice") + " AS UnitPrice")
    return f"(SELECT {columns} FROM raw ORDER BY {order}, Country {direction} LIMIT 5)"


@query("p2_preview", with_tables(f"{_preview_sql('ASC')} UNION ALL {_preview_sql('DESC')}"))
def _(f):
    return profiling.preview(f.raw).unionByName(profiling.preview(f.raw, last=True))


def _nulls_sql(select):
    parts = [
        f"""SELECT '{field.name}' AS "column", '{field.dataType.simpleString()}' AS data_type,
              count({field.name}) AS non_null, count(*) - count({field.name}) AS null_count,
              {half_even(f'(count(*) - count({field.name})) * 100.0 / count(*)')} AS null_pct FROM raw"""
        for field in RAW
    ]
    return with_tables(select, profile=" UNION ALL ".join(parts))


@query("p3_column_nulls", _nulls_sql("SELECT * FROM profile"))
def _(f):
    return profiling.column_nulls(f.raw)


@query(
    "p4_missing_values",
    _nulls_sql(
        """SELECT "column", null_count AS missing_count, null_pct AS missing_pct, non_null AS present_count
           FROM profile ORDER BY missing_count DESC, "column" """
    ),
)
def _(f):
    return profiling.missing_values(f.raw)


def _describe_sql(source, columns):
    return with_tables(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count({c}) AS count, {compared(f'avg({c})')} AS mean,
                  {compared(f'stddev_samp({c})')} AS std, {compared(f'min({c})')} AS min,
                  {compared(f'quantile_cont({c}, 0.25)')} AS q25, {compared(f'quantile_cont({c}, 0.5)')} AS median,
                  {compared(f'quantile_cont({c}, 0.75)')} AS q75, {compared(f'max({c})')} AS max FROM {source}"""
            for c in columns
        )
    )


@query("p5_numeric_summary", _describe_sql("raw", ["Quantity", "UnitPrice"]))
def _(f):
    return profiling.numeric_summary(f.raw)


@query("p5_cleaned_summary", _describe_sql("tx", ["Quantity", "UnitPrice", "TotalPrice"]))
def _(f):
    return profiling.numeric_summary(f.tx, ["Quantity", "UnitPrice", "TotalPrice"])


@query(
    "p6_distinct_values",
    with_tables(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count,
                  {half_even(f'count(DISTINCT {c}) * 100.0 / count(*)')} AS unique_pct FROM raw"""
            for c in RAW.fieldNames()
        )
    ),
)
def _(f):
    return profiling.distinct_values(f.raw)


@query(
    "p7_top_values",
    with_tables(
        """SELECT "column", value, count, rank FROM (
             SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM ("""
        + " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS count FROM raw WHERE {c} IS NOT NULL GROUP BY {c}"""
            for c in ["InvoiceNo", "StockCode", "Description", "CustomerID", "Country"]
        )
        + ")) WHERE rank <= 10"
    ),
)
def _(f):
    return profiling.top_values(f.raw)


def _issue_sql(issue, count, severity):
    return f"""SELECT '{issue}' AS issue, {count} AS count,
      {half_even(f'{count} * 100.0 / count(*)')} AS percentage, {severity} AS severity FROM raw"""


@query(
    "p8_quality_issues",
    with_tables(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            [
                _issue_sql(
                    "Missing CustomerID",
                    "count(*) FILTER (CustomerID IS NULL)",
                    "CASE WHEN avg(CASE WHEN CustomerID IS NULL THEN 100.0 ELSE 0 END) > 20 "
                    "THEN 'HIGH' ELSE 'MEDIUM' END",
                ),
                _issue_sql("Negative Quantity", "count(*) FILTER (Quantity < 0)", "'MEDIUM'"),
                _issue_sql("Zero/Negative Price", "count(*) FILTER (UnitPrice <= 0)", "'HIGH'"),
                _issue_sql("Missing Description", "count(*) FILTER (Description IS NULL)", "'LOW'"),
                _issue_sql(
                    "Duplicate Rows", "(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)))", "'MEDIUM'"
                ),
            ]
        )
        + ") WHERE count > 0"
    ),
)
def _(f):
    return profiling.quality_issues(f.raw)


@query(
    "p9_cancellations",
    with_tables(
        f"""SELECT count(*) FILTER (InvoiceNo NOT LIKE 'C%') AS normal_rows,
              {half_even("count(*) FILTER (InvoiceNo NOT LIKE 'C%') * 100.0 / count(*)")} AS normal_pct,
              count(*) FILTER (InvoiceNo LIKE 'C%') AS cancelled_rows,
              {half_even("count(*) FILTER (InvoiceNo LIKE 'C%') * 100.0 / count(*)")} AS cancelled_pct FROM raw"""
    ),
)
def _(f):
    return profiling.cancellations(f.raw)


@query(
    "p10_country_rows",
    with_tables(
        """SELECT Country, count(*) AS rows, (SELECT count(DISTINCT Country) FROM raw) AS total_countries
           FROM raw GROUP BY Country ORDER BY rows DESC, Country LIMIT 10"""
    ),
)
def _(f):
    return profiling.country_rows(f.raw)

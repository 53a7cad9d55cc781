"""Cleaning steps, in the order in which `clean_transactions` applies them."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions import dates, text
from tillroll.functions.numbers import safe_ratio
from tillroll.schema import CALCULATED, GUEST, UNKNOWN_PRODUCT
from tillroll.staging import stage

MAX_PRICE = 10000.0

# The columns whose equality makes two lines duplicates.
DUPLICATE_KEY = ["InvoiceNo", "StockCode", "CustomerID", "Quantity", "UnitPrice", "InvoiceDate"]

# Columns that a cleaned table must have.
_DATE_FIELDS = ["Year", "Month", "Day", "YearMonth"]


def handle_missing_customers(df: DataFrame, strategy: str = "guest") -> DataFrame:
    """Name buyers without an id `Guest`, or remove their rows."""
    if strategy == "remove":
        return df.dropna(subset=["CustomerID"])
    return df.fillna({"CustomerID": GUEST})


def flag_returns(df: DataFrame) -> DataFrame:
    return df.withColumn("IsReturn", F.col("Quantity") < 0)


def _bad_price(max_price: float) -> Column:
    price = F.col("UnitPrice")
    # A missing price is not bad, be it null or NaN (which Spark sorts above every number).
    return F.coalesce(~F.isnan(price) & ((price <= 0) | (price > max_price)), F.lit(False))


def remove_bad_prices(df: DataFrame, max_price: float = MAX_PRICE) -> DataFrame:
    return df.filter(~_bad_price(max_price))


def remove_duplicates(df: DataFrame, key=tuple(DUPLICATE_KEY), month_parts: int | None = None) -> DataFrame:
    """Keep one row per key: the first by Description (missing last), then Country.

    Copies are combined before the shuffle, so a group holding a large share of all rows
    sends one row per task.  Plans that read neither Description nor Country reduce this to
    a hash aggregate on the key.

    With `month_parts` the rows of a month come out in at most that many tasks, ready to be written by month:
    this one shuffle also does what the sink's would, but copies are combined behind it.
    """
    if month_parts is not None:
        # The part follows from the key, so that the groups stay the same.  Lines of an invoice stay together.
        hashed = F.pmod(F.xxhash64("InvoiceNo", "InvoiceDate"), F.lit(month_parts))
        month = F.coalesce(dates.month_index("InvoiceDate"), F.lit(0))
        dealt = df.withColumn("_part", (month * month_parts + hashed).cast("int")).repartition("_part")
        return remove_duplicates(dealt, ("_part", *key)).drop("_part")
    rest = [c for c in df.columns if c not in key]
    first = [c for c in ("Description", "Country") if c in rest]
    rest = first + [c for c in rest if c not in first]
    missing_last = [F.col(c).isNull().alias(f"_no_{c}") for c in first]
    ordered = [c for pair in zip(missing_last, first) for c in pair] + rest[len(first) :]
    kept = df.groupBy(*key).agg(F.min(F.struct(*ordered)).alias("_kept"))
    return kept.select(*[F.col(c) if c in key else F.col(f"_kept.{c}") for c in df.columns])


def handle_missing_descriptions(df: DataFrame, strategy: str = "unknown") -> DataFrame:
    """Name products without a description `Unknown Product`, or remove their rows."""
    if strategy == "remove":
        return df.dropna(subset=["Description"])
    return df.fillna({"Description": UNKNOWN_PRODUCT})


def add_calculated_fields(df: DataFrame) -> DataFrame:
    """Line total and calendar fields."""
    ts = F.col("InvoiceDate")
    return df.withColumns(
        {
            "TotalPrice": F.col("Quantity") * F.col("UnitPrice"),
            "Year": F.year(ts),
            "Month": F.month(ts),
            "Day": F.day(ts),
            "DayOfWeek": dates.day_of_week(ts),
            "Hour": F.hour(ts),
            "MonthName": dates.month_name(ts),
            "DayName": dates.day_name(ts),
            "YearMonth": dates.year_month(ts),
        }
    )


def clean_text(df: DataFrame) -> DataFrame:
    """Tidy whitespace in Description and at the ends of Country."""
    tidy = {"Description": text.single_spaced("Description")}
    if "Country" in df.columns:
        tidy["Country"] = text.stripped("Country")
    return df.withColumns(tidy)


def remove_returns(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("IsReturn"))


def keep_sources(raw: DataFrame) -> DataFrame:
    """Add the texts that cleaning changes as they came, from which a stored table can be cleaned again."""
    return raw.withColumns({"SourceDescription": F.col("Description"), "SourceCountry": F.col("Country")})


def clean_transactions(
    raw: DataFrame,
    max_price: float = MAX_PRICE,
    drop_returns: bool = False,
    month_parts: int | None = None,
    sources: bool = False,
) -> DataFrame:
    """Raw to cleaned transactions: one lazy plan with one shuffle.

    Returns are flagged after de-duplication: the flag follows from Quantity, which is in the key,
    and would otherwise be carried, and ordered by, through the shuffle.  `sources` keeps the texts as they
    came (`keep_sources`), which are not shuffled twice either.  For `month_parts` see `remove_duplicates`.
    """
    kept = (
        raw.transform(handle_missing_customers)
        .transform(remove_bad_prices, max_price)
        .transform(remove_duplicates, month_parts=month_parts)
    )
    tx = (
        (keep_sources(kept) if sources else kept)
        .transform(flag_returns)
        .transform(handle_missing_descriptions)
        .transform(add_calculated_fields)
        .transform(clean_text)
    )
    return remove_returns(tx) if drop_returns else tx


def validate(tx: DataFrame) -> DataFrame:
    """`(check, passed)` rows; all row checks come from one pass."""
    price = F.col("UnitPrice")
    checks = {
        "no_null_customerid": F.every(F.col("CustomerID").isNotNull()),
        "no_null_description": F.every(F.col("Description").isNotNull()),
        "positive_prices": F.every(F.coalesce((price > 0) & ~F.isnan(price), F.lit(False))),
        "valid_quantities": F.every(F.col("Quantity").isNotNull()),
        "has_total_price": F.lit("TotalPrice" in tx.columns),
        "has_date_fields": F.lit(all(c in tx.columns for c in _DATE_FIELDS)),
    }
    verdicts = tx.agg(*[F.coalesce(check, F.lit(True)).alias(name) for name, check in checks.items()])
    pairs = [F.struct(F.lit(name).alias("check"), F.col(name).alias("passed")) for name in checks]
    return verdicts.select(F.inline(F.array(*pairs)))


def cleaning_summary(raw: DataFrame, max_price: float = MAX_PRICE) -> DataFrame:
    """What each cleaning step found or removed, as one row.

    All counts come from one grouping by the duplicate key, whose buffers are numbers: rows
    beyond the first of a key are the duplicates, and a key's price tells whether its rows
    were removed before.
    """
    named = handle_missing_customers(raw.withColumn("_anonymous", F.col("CustomerID").isNull()))
    groups = named.groupBy(*DUPLICATE_KEY).agg(
        F.count("*").alias("rows"),
        F.count_if("_anonymous").alias("anonymous"),
        F.every(F.col("Description").isNull()).alias("undescribed"),
    )
    groups = groups.withColumn("bad", _bad_price(max_price))
    kept = F.count_if(~F.col("bad"))
    original = F.sum("rows")
    columns = len(raw.columns)
    return groups.agg(
        original.alias("original_rows"),
        F.lit(columns).alias("original_columns"),
        kept.alias("final_rows"),
        F.lit(columns + len(CALCULATED)).alias("final_columns"),
        (original - kept).alias("rows_removed"),
        safe_ratio((original - kept) * 100.0, original).alias("removal_percentage"),
        F.sum("anonymous").alias("missing_customers_original"),
        F.sum(F.when(F.col("Quantity") < 0, F.col("rows")).otherwise(0)).alias("returns_identified"),
        F.sum(F.when(F.col("bad"), F.col("rows")).otherwise(0)).alias("bad_prices_removed"),
        F.sum(F.when(~F.col("bad"), F.col("rows") - 1).otherwise(0)).alias("duplicates_removed"),
        F.count_if(~F.col("bad") & F.col("undescribed")).alias("missing_descriptions_original"),
    )


def cleaned_kpis(tx: DataFrame) -> DataFrame:
    """Size, range and money of the cleaned table, as one row.

    Lines are first rolled up per invoice, product and customer.  The rollup is staged, and each
    distinct count reads only its column of it.  The mean invoice total is revenue over sold invoices.
    """
    sold = ~F.col("IsReturn")
    rolled = tx.groupBy("InvoiceNo", "StockCode", "CustomerID").agg(
        F.count("*").alias("rows"),
        F.count_if(sold).alias("sales"),
        F.sum(F.when(sold, F.col("TotalPrice"))).alias("revenue"),
        F.sum(F.when(sold, F.col("UnitPrice"))).alias("prices"),
        F.count(F.when(sold, F.col("UnitPrice"))).alias("priced"),
        F.min("InvoiceDate").alias("first"),
        F.max("InvoiceDate").alias("last"),
    )
    rolled = stage(rolled, "rollup")
    counted = {
        "unique_customers": F.col("CustomerID"),
        "unique_products": F.col("StockCode"),
        "unique_invoices": F.col("InvoiceNo"),
        "_sold_invoices": F.when(F.col("sales") > 0, F.col("InvoiceNo")),
    }
    # As rows of their own; as columns they would become one aggregate over four copies of each row.
    counts = [rolled.agg(F.count_distinct(c).alias("n")).select(F.lit(name).alias("name"), "n") for name, c in counted.items()]
    found = reduce(DataFrame.unionByName, counts).agg(F.map_from_entries(F.collect_list(F.struct("name", "n")))).scalar()
    totals = rolled.agg(
        F.sum("rows").alias("total_transactions"),
        F.sum("sales").alias("sales_transactions"),
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
        F.sum("revenue").alias("total_revenue"),
        F.sum("prices").alias("_prices"),
        F.sum("priced").alias("_priced"),
    )
    totals = totals.select("*", *[found[name].alias(name) for name in counted])
    return totals.select(
        "total_transactions",
        "sales_transactions",
        (F.col("total_transactions") - F.col("sales_transactions")).alias("return_transactions"),
        "unique_customers",
        "unique_products",
        "unique_invoices",
        "first_date",
        "last_date",
        "total_revenue",
        safe_ratio("total_revenue", "_sold_invoices").alias("avg_invoice_total"),
        safe_ratio("_prices", "_priced").alias("avg_item_price"),
    )

"""Table schemas and the fixed values shared by several operators."""

from pyspark.sql import types as T

# Labels that stand for missing data and special rows.
GUEST = "Guest"
UNKNOWN_PRODUCT = "Unknown Product"
POSTAGE = "POSTAGE"

# Weekday names, Monday first.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

RAW = T.StructType(
    [
        T.StructField("InvoiceNo", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.IntegerType()),
        T.StructField("InvoiceDate", T.TimestampNTZType()),
        T.StructField("UnitPrice", T.DoubleType()),
        T.StructField("CustomerID", T.StringType()),
        T.StructField("Country", T.StringType()),
    ]
)

CALCULATED = T.StructType(
    [
        T.StructField("IsReturn", T.BooleanType()),
        T.StructField("TotalPrice", T.DoubleType()),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Month", T.IntegerType()),
        T.StructField("Day", T.IntegerType()),
        T.StructField("DayOfWeek", T.IntegerType()),
        T.StructField("Hour", T.IntegerType()),
        T.StructField("MonthName", T.StringType()),
        T.StructField("DayName", T.StringType()),
        T.StructField("YearMonth", T.StringType()),
    ]
)

TRANSACTIONS = T.StructType(RAW.fields + CALCULATED.fields)

# Texts as they came, kept in tables that grow; readers of the cleaned table leave them out.
SOURCES = T.StructType(
    [T.StructField("SourceDescription", T.StringType()), T.StructField("SourceCountry", T.StringType())]
)

CUSTOMER_CLUSTERS = T.StructType(
    [
        T.StructField("CustomerID", T.StringType()),
        T.StructField("Cluster", T.IntegerType()),
        T.StructField("Recency", T.LongType()),
        T.StructField("Frequency", T.LongType()),
        T.StructField("MonetaryValue", T.DoubleType()),
        T.StructField("AvgOrderValue", T.DoubleType()),
        T.StructField("TotalQuantity", T.LongType()),
        T.StructField("CustomerLifespan", T.LongType()),
        T.StructField("ClusterName", T.StringType()),
    ]
)

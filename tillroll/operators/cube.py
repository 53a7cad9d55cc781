"""A small copy of sales behind the interactive page: sums per cell, and distinct counts as bits.

Every invoice and customer gets a number.  A cell (day, country, product, kind of customer) keeps which of them
occur in it as 64-bit words, so the distinct count under any filter is the number of bits in the union of the
words: exact, and summed up per task before it is shuffled.  Invoices are numbered by time and country and customers
by country, so that those of a cell lie in few words.
"""

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions import dates
from tillroll.functions.numbers import safe_ratio
from tillroll.operators import dashboard
from tillroll.operators.ranking import number_rows
from tillroll.schema import GUEST
from tillroll.staging import new_path, stage

_CELL = ["InvoiceDate", "Country", "Description", "CustomerID"]
_WORD = 6  # bits of a number that are its place in a word
_REGISTERED = "Registered"
_TOGETHER = ["InvoiceNo", "_customer", "Country"]
_SUMS = "sums"
_MEMBERS = {"invoice": "_invoice_no", "customer": "_customer_no"}
# Sums have their hour in place of a word.
_STORED = """InvoiceDate timestamp_ntz, Country string, Description string, CustomerID string, Kind string, Word bigint,
             TotalPrice double, Quantity bigint, Lines bigint, Bits bigint, Part int"""

# What a cube needs of sales.
COLUMNS = ["InvoiceNo", "CustomerID", "InvoiceDate", "Country", "Description", "Hour", "TotalPrice", "Quantity"]


class Cube(NamedTuple):
    cells: DataFrame  # sums, in columns named as those of sales
    members: DataFrame  # per cell and kind (invoice, customer) the words that are not empty


def _cell_of(sales: DataFrame) -> DataFrame:
    """Sales with the cell's values in place of a line's.

    A filter ends at the midnight that starts its last day, so lines of that very moment are kept apart: they stay at
    midnight, all others of a day move to its noon.
    """
    day = F.date_trunc("day", F.col("InvoiceDate")).cast("timestamp_ntz")
    at = F.when(F.col("InvoiceDate") == day, day).otherwise(day + F.expr("INTERVAL 12 HOURS"))
    kind = F.when(F.col("CustomerID") == GUEST, GUEST).when(F.col("CustomerID").isNotNull(), _REGISTERED)
    return sales.withColumns({"_customer": F.col("CustomerID"), "_moment": F.col("InvoiceDate"), "InvoiceDate": at, "CustomerID": kind})


def build(sales: DataFrame, path: str | None = None) -> Cube:
    """The cube of `sales`, written to `path` (or staged) and read back.

    Sales are read twice, so they should be a stored table.  Nulls in any column are values of a cell; null
    invoices and customers are not counted, as in SQL.  Lines get both numbers in one join and are dealt by cell
    once; what a cell keeps is then added up where its lines are.
    """
    spark = sales.sparkSession
    path = path or new_path(spark, "cube")
    lines = _cell_of(sales)
    named = _numbers(lines).alias("named")
    same = reduce(Column.__and__, [F.col(f"lines.{c}").eqNullSafe(F.col(f"named.{c}")) for c in _TOGETHER])
    numbered = lines.alias("lines").join(named.hint("merge"), same)
    numbered = numbered.select(*[f"lines.{c}" for c in [*_CELL, "Hour", "TotalPrice", "Quantity"]], *_MEMBERS.values())
    # A line becomes three rows, so partitions are not merged into larger ones, as they would be without their number.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = numbered.repartitionByRange(tasks, "Country", "InvoiceDate", "Description", "CustomerID")
    kept = [
        _kept(_SUMS, F.col("Hour"), F.col("TotalPrice"), F.col("Quantity"), F.lit(None)),
        *[_kept(kind, F.shiftright(n, _WORD), F.lit(None), F.lit(None), _bit(n)) for kind, n in _MEMBERS.items()],
    ]
    entries = dealt.select(*_CELL, F.inline(F.array(*kept))).filter((F.col("Kind") == _SUMS) | F.col("Bits").isNotNull())
    rows = entries.groupBy(*_CELL, "Kind", "Word").agg(
        F.sum("TotalPrice").alias("TotalPrice"),
        F.sum("Quantity").alias("Quantity"),
        F.count("*").alias("Lines"),
        F.bit_or("Bits").alias("Bits"),
    )
    # Files hold few countries and short stretches of time, so that filters skip most of them.
    part = F.when(F.col("Kind") == _SUMS, 0).otherwise(1).alias("Part")
    ordered = rows.select("*", part).sortWithinPartitions("Part", "Country", "InvoiceDate")
    ordered.write.mode("overwrite").partitionBy("Part").parquet(path)
    return read(spark, path)


def read(spark: SparkSession, path: str) -> Cube:
    """A cube that `build` wrote."""
    stored = spark.read.schema(_STORED).parquet(path)
    days = [dates.day_name("InvoiceDate").alias("DayName"), dates.day_of_week("InvoiceDate").alias("DayOfWeek")]
    hour = F.col("Word").cast("int").alias("Hour")
    return Cube(
        stored.filter("Part = 0").select(*_CELL, hour, "TotalPrice", "Quantity", "Lines", *days),
        stored.filter("Part = 1").select(*_CELL, "Kind", "Word", "Bits"),
    )


def _kept(kind: str, word: Column, price: Column, quantity: Column, bits: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("Kind"),
        word.cast("long").alias("Word"),
        price.cast("double").alias("TotalPrice"),
        quantity.cast("long").alias("Quantity"),
        bits.cast("long").alias("Bits"),
    )


def _bit(number: str) -> Column:
    place = F.col(number).bitwiseAND((1 << _WORD) - 1).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _numbers(lines: DataFrame) -> DataFrame:
    """Every invoice, customer and country that occur together, with their numbers; what is null has none.

    The country is a key here, as the least of texts cannot be found by hashing.
    """
    together = stage(lines.groupBy(*_TOGETHER).agg(F.min("_moment").alias("_first")), "members")
    invoices = together.groupBy("InvoiceNo").agg(F.min("_first").alias("_first"), F.min("Country").alias("Country"))
    invoices = number_rows(invoices.filter("InvoiceNo IS NOT NULL"), ["_first", "Country", "InvoiceNo"], "_invoice_no")
    # Guests are one member of very many cells: they are number 0, which no other has, without a join.
    other = F.coalesce(F.col("_customer") != GUEST, F.lit(False))
    customers = together.filter(other).groupBy("_customer").agg(F.min("Country").alias("Country"))
    customers = number_rows(customers, ["Country", "_customer"], "_customer_no").select("_customer", "_customer_no")
    guest = F.when(F.col("_customer") == GUEST, F.lit(0).cast("long")).alias("_customer_no")
    keys = together.select(*_TOGETHER)
    numbered = keys.filter(other).join(customers, "_customer").select(*_TOGETHER, "_customer_no")
    numbered = numbered.unionByName(keys.filter(~other).select(*_TOGETHER, guest))
    return numbered.join(invoices.select("InvoiceNo", "_invoice_no"), "InvoiceNo", "left")


def choose(cube: Cube, start=None, end=None, **choices) -> Cube:
    """The part of the cube that the filters of `dashboard.filter_sales` leave; dates have no time of day."""
    for value in (start, end):
        if value is not None and str(value)[10:].strip(" T0:."):
            raise ValueError(f"a cube holds whole days, not the moment {value}")
    return Cube(*[dashboard.filter_sales(part, start, end, **choices) for part in cube])


def kpis(cube: Cube) -> DataFrame:
    """The same row as `dashboard.kpis`, without the sales."""
    zero = F.lit(0.0)
    counts = distinct_members(cube)
    sums = cube.cells.agg(
        F.coalesce(F.sum("TotalPrice"), zero).alias("total_revenue"),
        F.coalesce(F.sum("Lines"), F.lit(0)).cast("long").alias("total_transactions"),
    )
    return sums.select(
        "*",
        counts.select("customers").scalar().alias("total_customers"),
        F.coalesce(safe_ratio("total_revenue", counts.select("invoices").scalar()), zero).alias("avg_order_value"),
    )


def distinct_members(cube: Cube, *by: str) -> DataFrame:
    """Distinct `invoices` and `customers` of the cells, in all or per value of the columns `by`."""
    union = cube.members.groupBy(*by, "Kind", "Word").agg(F.bit_or("Bits").alias("Bits"))

    def bits(kind) -> Column:
        counted = F.sum(F.when(F.col("Kind") == kind, F.bit_count("Bits")))
        return F.coalesce(counted, F.lit(0)).cast("long")

    return union.groupBy(*by).agg(bits("invoice").alias("invoices"), bits("customer").alias("customers"))

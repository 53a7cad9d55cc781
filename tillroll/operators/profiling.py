"""Profile of a raw table."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.numbers import half_even, safe_ratio
from tillroll.functions.text import is_cancellation
from tillroll.operators.ranking import exact_quantiles
from tillroll.staging import stage

# Share of rows without a customer above which the issue is severe.
_SEVERE_MISSING_PERCENT = 20.0

_QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def _per_column(totals: DataFrame, columns: Sequence[str], **values) -> DataFrame:
    """Long form of one wide row: `values` maps an output name to a function of the column."""
    rows = [
        F.struct(F.lit(c).alias("column"), *[make(c).alias(name) for name, make in values.items()]) for c in columns
    ]
    return totals.select(F.inline(F.array(*rows)))


def overview(df: DataFrame, date: str = "InvoiceDate") -> DataFrame:
    """Rows, columns and date range."""
    return df.agg(
        F.count("*").alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
    )


def preview(df: DataFrame, n: int = 5, last: bool = False) -> DataFrame:
    """First or last rows by date; remaining columns break ties."""
    leading = ["InvoiceDate", "InvoiceNo", "StockCode"]
    order = leading + [c for c in df.columns if c not in leading]
    return df.orderBy(*[F.col(c).desc_nulls_last() if last else F.col(c).asc_nulls_last() for c in order]).limit(n)


def column_nulls(df: DataFrame) -> DataFrame:
    """Type, non-null count, null count and null percentage per column, in one pass."""
    types = dict(df.dtypes)
    totals = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in df.columns])
    return _per_column(
        totals,
        df.columns,
        data_type=lambda c: F.lit(types[c]),
        non_null=F.col,
        null_count=lambda c: F.col("_rows") - F.col(c),
        null_pct=lambda c: half_even(safe_ratio((F.col("_rows") - F.col(c)) * 100.0, F.col("_rows")), 2),
    )


def missing_values(df: DataFrame) -> DataFrame:
    """Columns by number of missing values."""
    return (
        column_nulls(df)
        .select(
            "column",
            F.col("null_count").alias("missing_count"),
            F.col("null_pct").alias("missing_pct"),
            F.col("non_null").alias("present_count"),
        )
        .orderBy(F.desc("missing_count"), "column")
    )


def _exact_quartiles(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    counted = (
        df.select(F.inline(F.array(*pairs)))
        .filter("value IS NOT NULL")
        .groupBy("column", "value")
        .agg(F.count("*").alias("copies"))
    )
    counted = stage(counted, "values")
    fractions = list(_QUARTILES.values())
    return {
        c: exact_quantiles(counted.filter(F.col("column") == c), "value", fractions, "copies") for c in columns
    }


def numeric_summary(
    df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False
) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum per column.

    Values are counted first, so exact quartiles come from the table of distinct values, which
    is sorted over all tasks.  Approximate ones come from sketches in a single pass.
    """
    if columns is None:
        columns = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]

    def sketched(c):
        return [F.percentile_approx(c, list(_QUARTILES.values())).alias("sketched")] if approximate else []

    moments = df.agg(
        *[
            F.struct(
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
                *sketched(c),
            ).alias(c)
            for c in columns
        ]
    )
    quartiles = None if approximate else _exact_quartiles(df, columns)

    def quartile(position):
        if approximate:
            return lambda c: F.col(c)["sketched"][position].cast("double")
        return lambda c: F.lit(quartiles[c][position]).cast("double")

    def moment(name):
        return lambda c: F.col(c)[name]

    return _per_column(
        moments,
        columns,
        count=moment("count"),
        mean=moment("mean"),
        std=moment("std"),
        min=moment("min"),
        **{name: quartile(i) for i, name in enumerate(_QUARTILES)},
        max=moment("max"),
    )


def distinct_values(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct values and their share of all rows per column.

    Sketches take one pass.  Exact counts stage the frame and read one column at a time, so that each
    is combined before its shuffle and no row is copied once per column.
    """

    def share(unique):
        return half_even(safe_ratio(F.col(unique) * 100.0, F.col("_rows")), 2)

    if approximate:
        totals = df.agg(F.count("*").alias("_rows"), *[F.approx_count_distinct(c).alias(c) for c in df.columns])
        return _per_column(totals, df.columns, unique_count=F.col, unique_pct=share)
    staged = stage(df, "profiled")
    counts = [
        staged.agg(F.count("*").alias("_rows"), F.count_distinct(c).alias("unique_count")).select(
            F.lit(c).alias("column"), "unique_count", share("unique_count").alias("unique_pct")
        )
        for c in df.columns
    ]
    return reduce(DataFrame.unionByName, counts)


def top_values(df: DataFrame, n: int = 10, columns: Sequence[str] | None = None) -> DataFrame:
    """Most frequent values of every text column.

    The columns are staged and counted one at a time, so that a task holds the values of one column, and no row is
    copied once per column.  The rank filter is applied before the last shuffle too, so each task sends `n` rows per column.
    """
    if columns is None:
        columns = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    staged = stage(df.select(*columns), "texts")
    values = [staged.select(F.lit(c).alias("column"), F.col(c).alias("value")).filter("value IS NOT NULL") for c in columns]
    counts = [v.groupBy("column", "value").agg(F.count("*").alias("count")) for v in values]
    by_count = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    ranked = reduce(DataFrame.unionByName, counts).withColumn("rank", F.row_number().over(by_count))
    return ranked.filter(F.col("rank") <= n)


def quality_issues(raw: DataFrame) -> DataFrame:
    """Data problems that occur: count, percentage of rows, severity.

    Grouping by all columns finds exact copies; every other count is a sum over the groups.
    """
    groups = raw.groupBy(*raw.columns).agg(F.count("*").alias("_n"))

    def rows_where(condition: Column):
        return F.sum(F.when(condition, F.col("_n")).otherwise(0))

    totals = groups.agg(
        F.sum("_n").alias("rows"),
        rows_where(F.col("CustomerID").isNull()).alias("customer"),
        rows_where(F.col("Quantity") < 0).alias("quantity"),
        rows_where(F.col("UnitPrice") <= 0).alias("price"),
        rows_where(F.col("Description").isNull()).alias("description"),
        F.sum(F.col("_n") - 1).alias("copies"),
    )

    def percent(name):
        return safe_ratio(F.col(name) * 100.0, F.col("rows"))

    severe = F.when(percent("customer") > _SEVERE_MISSING_PERCENT, "HIGH").otherwise("MEDIUM")
    # Issue names and severities.
    issues = [
        ("Missing CustomerID", "customer", severe),
        ("Negative Quantity", "quantity", F.lit("MEDIUM")),
        ("Zero/Negative Price", "price", F.lit("HIGH")),
        ("Missing Description", "description", F.lit("LOW")),
        ("Duplicate Rows", "copies", F.lit("MEDIUM")),
    ]
    rows = [
        F.struct(
            F.lit(label).alias("issue"),
            F.col(name).alias("count"),
            half_even(percent(name), 2).alias("percentage"),
            severity.alias("severity"),
        )
        for label, name, severity in issues
    ]
    return totals.select(F.inline(F.array(*rows))).filter(F.col("count") > 0)


def cancellations(raw: DataFrame) -> DataFrame:
    """Normal and cancelled lines by invoice prefix, with percentages."""
    cancelled = F.count_if(is_cancellation(F.col("InvoiceNo")))
    rows = F.count("*")
    return raw.agg(
        (rows - cancelled).alias("normal_rows"),
        half_even(safe_ratio((rows - cancelled) * 100.0, rows), 2).alias("normal_pct"),
        cancelled.alias("cancelled_rows"),
        half_even(safe_ratio(cancelled * 100.0, rows), 2).alias("cancelled_pct"),
    )


def country_rows(df: DataFrame, n: int = 10) -> DataFrame:
    """Countries with most rows, next to the number of countries."""
    counts = df.groupBy("Country").agg(F.count("*").alias("rows"))
    total = counts.agg(F.count("Country").alias("countries")).select("countries").scalar()
    return counts.orderBy(F.desc("rows"), "Country").limit(n).withColumn("total_countries", total)

"""Shared aggregates and small result shapes."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numbers import safe_ratio


def invoice_rollup(tx: DataFrame, *dimensions: Column) -> DataFrame:
    """Lines, units and revenue per invoice, customer and extra dimensions.

    Two distinct counts in one aggregate repeat every input row three times; on the invoices
    instead of the lines that is a fraction of the data.
    """
    return tx.groupBy("InvoiceNo", "CustomerID", *dimensions).agg(
        F.count("*").alias("lines"),
        F.count("TotalPrice").alias("priced_lines"),
        F.sum("Quantity").alias("units"),
        F.sum("TotalPrice").alias("revenue"),
    )


def orders() -> Column:
    return F.count_distinct("InvoiceNo")


def customers() -> Column:
    return F.count_distinct("CustomerID")


def average_line() -> Column:
    """Mean line total of rolled-up invoices."""
    return safe_ratio(F.sum("revenue"), F.sum("priced_lines"))


def top(df: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    """The `n` rows with the largest `by`; `ties` decide between equals."""
    return df.orderBy(F.col(by).desc_nulls_last(), *ties).limit(n)


def largest(key: str, value: str) -> Column:
    """Key of the largest value, the smallest such key on a tie."""
    return F.min_by(key, F.struct(-F.col(value), F.col(key)))


def smallest(key: str, value: str) -> Column:
    """Key of the smallest value, the smallest such key on a tie."""
    return F.min_by(key, F.struct(F.col(value), F.col(key)))


def as_metrics(row: DataFrame, numbers: Mapping[str, str], labels: Mapping[str, str] | None = None) -> DataFrame:
    """`(metric, number, label)` rows of a one-row frame.

    `numbers` maps a metric to its numeric column, `labels` to the column that names it.
    """
    labels = labels or {}
    names = list(dict.fromkeys([*numbers, *labels]))
    entries = [
        F.struct(
            F.lit(name).alias("metric"),
            (F.col(numbers[name]) if name in numbers else F.lit(None)).cast("double").alias("number"),
            (F.col(labels[name]) if name in labels else F.lit(None)).cast("string").alias("label"),
        )
        for name in names
    ]
    return row.select(F.inline(F.array(*entries)))

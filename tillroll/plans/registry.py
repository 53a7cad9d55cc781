"""Registration of queries and the frames they start from."""

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.operators.cleaning import clean_transactions, remove_returns
from tillroll.sources.retail import raw_transactions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Digits at which the float noise of a sum is removed before results are compared.
_NOISE_DIGITS = 6


class Frames:
    """Raw, cleaned and sold transactions of one data folder, as lazy plans."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    @cached_property
    def raw(self) -> DataFrame:
        return raw_transactions(self.spark, self.folder)

    @cached_property
    def tx(self) -> DataFrame:
        return clean_transactions(self.raw)

    @cached_property
    def sales(self) -> DataFrame:
        return remove_returns(self.tx)


def comparable(df: DataFrame, digits: int = 2) -> DataFrame:
    """Doubles rounded, because sums of doubles differ in their last bits, and dates as text."""
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            column = F.round(F.round(column, _NOISE_DIGITS), digits)
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None, digits: int = 2):
    """Register a function of `Frames` under `name`, with the SQL that must give the same rows."""

    def register(build: Callable[[Frames], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return comparable(build(Frames(spark, folder)), digits)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register

"""Readers and writers with declared schemas."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll import schema
from tillroll.functions import dates
from tillroll.operators import cleaning
from tillroll.staging import stage

_CSV = {"header": True, "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss", "escape": '"'}


def read_raw(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Raw transactions from parquet or CSV."""
    return _read(spark, path, kind, schema.RAW)


def read_transactions(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Cleaned transactions from parquet or CSV."""
    return _read(spark, path, kind, schema.TRANSACTIONS)


def read_clusters(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Clustered customers from parquet or CSV."""
    return _read(spark, path, kind, schema.CUSTOMER_CLUSTERS)


def _read(spark, path, kind, columns: T.StructType) -> DataFrame:
    reader = spark.read.schema(columns)
    return reader.options(**_CSV).csv(path) if kind == "csv" else reader.parquet(path)


def register_transactions(df: DataFrame, name: str = "transactions") -> DataFrame:
    """Give the frame a name that SQL text can use."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def describe_table(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, and the row count of the table."""
    columns = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("column_type"),
        )
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    counted = df.agg(F.count("*").alias("row_count"))
    return counted.select(F.inline(F.array(*columns)), "row_count")


def write_transactions(tx: DataFrame, path: str) -> None:
    """Cleaned transactions as parquet, one folder per month.

    The rebalance lets adaptive execution split a hot month over several tasks and merge
    small ones, instead of every task writing a file into every month.
    """
    tx.hint("rebalance", "YearMonth").write.mode("overwrite").partitionBy("YearMonth").parquet(path)


# Tasks, and so files, that the rows of one month are dealt to when raw lines are cleaned into a table.
MONTH_PARTS = 8


def write_cleaned(raw: DataFrame, path: str, sources: bool = True, **options) -> None:
    """Clean raw lines into a table as `write_transactions` writes it, in one shuffle instead of two.

    The table holds the texts its lines came with, unless `sources` is false, so that it can grow
    (`append_transactions`).  `options` go to `cleaning.clean_transactions`.
    """
    cleaned = cleaning.clean_transactions(raw, month_parts=MONTH_PARTS, sources=sources, **options)
    cleaned.write.mode("overwrite").partitionBy("YearMonth").parquet(path)


def write_sales(tx: DataFrame, path: str) -> None:
    """The same without returns, from a written table.

    Its files hold one month each, so a task that reads some of them writes few files and nothing is shuffled.
    """
    tx.filter(~F.col("IsReturn")).write.mode("overwrite").partitionBy("YearMonth").parquet(path)


def append_transactions(raw: DataFrame, path: str, **options) -> list[str | None]:
    """Add raw lines to the cleaned table at `path` and return the months that were written again.

    The outcome is that of cleaning all raw lines at once, in whatever order and however often they arrive.
    A duplicate has the date of its twin, so only the months of the new lines are read, as the raw lines they
    came from, cleaned together with the new ones and overwritten; all other months keep their files.
    The new lines are staged, as their months are looked up first.  The months of one call reach the driver,
    nothing else.  A call that was broken off may be repeated.

    The table must hold the texts its lines came with (`cleaning.keep_sources`); a table that does not exist
    begins empty, and no lines leave it as it is.  `options` go to `cleaning.clean_transactions`.  There must be
    one writer at a time.
    """
    spark = raw.sparkSession
    fresh = stage(raw.select(*schema.RAW.fieldNames()), "lines")
    month = dates.year_month("InvoiceDate")
    months = [row[0] for row in fresh.select(month.alias("month")).distinct().orderBy("month").collect()]
    if not months:
        return months
    if _has_files(spark, path):
        stored = _stored_lines(spark, path, months)
        fresh = stored.unionByName(fresh)
    cleaned = cleaning.clean_transactions(fresh, month_parts=MONTH_PARTS, sources=True, **options)
    _replace_months(cleaned, path)
    return months


def append_sales(spark: SparkSession, source: str, path: str, months: list[str | None]) -> None:
    """Bring the given months of the table without returns up to date with the cleaned table at `source`."""
    changed = read_transactions(spark, source).filter(_in_months(months) & ~F.col("IsReturn"))
    _replace_months(changed, path)


def _in_months(months: list[str | None]):
    named = F.col("YearMonth").isin([m for m in months if m is not None])
    return named | F.col("YearMonth").isNull() if None in months else named


def _replace_months(df: DataFrame, path: str) -> None:
    """Overwrite the months that occur in `df`, and no others; its tasks hold few months each."""
    writer = df.write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("YearMonth").parquet(path)


def _stored_lines(spark: SparkSession, path: str, months: list[str | None]) -> DataFrame:
    """The raw lines behind the given months of a cleaned table."""
    if not set(schema.SOURCES.fieldNames()) <= set(spark.read.parquet(path).columns):
        raise ValueError(f"{path} does not hold the texts its lines came with; write it with keep_sources")
    everything = T.StructType(schema.TRANSACTIONS.fields + schema.SOURCES.fields)
    stored = spark.read.schema(everything).parquet(path).filter(_in_months(months))
    source = {"Description": "SourceDescription", "Country": "SourceCountry"}
    return stored.select(*[F.col(source.get(c, c)).alias(c) for c in schema.RAW.fieldNames()])


def _has_files(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to the folder: an empty one has no columns to read."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(folder) and bool(spark.read.schema(schema.TRANSACTIONS).parquet(path).inputFiles())


def write_result(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A result table as CSV with a header, or as parquet."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.options(**_CSV).csv(path)
    else:
        writer.parquet(path)


def replace_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Replace the catalog table `name` by the frame and read it back.

    The frame is written as a new version below `path` (default: beside the warehouse's tables), then the
    table's location is switched to it, so readers find the old rows or the new ones, never no table.
    Older versions stay for readers that have begun; delete them when none is left.  Only a table with
    other columns has to be created anew.
    """
    spark = df.sparkSession
    root = path or f"{spark.conf.get('spark.sql.warehouse.dir')}/{name}-versions"
    version = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(version)
    location = "'" + version.replace("\\", "\\\\").replace("'", "\\'") + "'"
    columns = [(f.name, f.dataType) for f in df.schema.fields]
    if spark.catalog.tableExists(name) and [(f.name, f.dataType) for f in spark.table(name).schema.fields] == columns:
        spark.sql(f"ALTER TABLE {name} SET LOCATION {location}")
    else:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE {name} USING parquet LOCATION {location}")
    spark.catalog.refreshTable(name)
    return spark.table(name)

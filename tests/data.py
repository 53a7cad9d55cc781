"""Small hand-written inputs."""

from datetime import datetime

from tillroll import schema

RAW_NAMES = schema.RAW.fieldNames()


def at(text):
    return datetime.fromisoformat(text)


def raw(spark, rows):
    """Raw transactions; missing fields get defaults."""
    defaults = {
        "InvoiceNo": "1",
        "StockCode": "s",
        "Description": "thing",
        "Quantity": 1,
        "InvoiceDate": at("2020-01-06 10:00"),
        "UnitPrice": 1.0,
        "CustomerID": "c",
        "Country": "Home",
    }
    return spark.createDataFrame([tuple({**defaults, **row}[n] for n in RAW_NAMES) for row in rows], schema.RAW)


def transactions(spark, rows):
    """The same with the calculated fields, but not de-duplicated."""
    from tillroll.operators import cleaning

    return cleaning.add_calculated_fields(cleaning.flag_returns(raw(spark, rows)))


def as_dicts(df):
    return [row.asDict() for row in df.collect()]


def metrics(df):
    return {row["metric"]: (row["number"], row["label"]) for row in df.collect()}

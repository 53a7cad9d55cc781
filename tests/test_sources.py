import threading

import pytest
from pyspark.sql import functions as F

from tests.data import as_dicts, at, raw, transactions
from tillroll import staging
from tillroll.operators import cleaning
from tillroll.sources import tables


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = raw(spark, [{"Description": 'a "quoted", one', "CustomerID": None}, {"UnitPrice": 0.005}])
    tables.write_result(df, path)
    assert sorted(map(str, tables.read_raw(spark, path, "csv").collect())) == sorted(map(str, df.collect()))


def test_months_are_pruned(spark, tmp_path):
    path = str(tmp_path / "tx")
    tables.write_transactions(transactions(spark, [{}, {"Quantity": -1}]), path)
    assert (tmp_path / "tx" / "YearMonth=2020-01").is_dir()
    month = tables.read_transactions(spark, path).filter("YearMonth = '2020-01'")
    assert "PartitionFilters: [isnotnull(YearMonth" in month._jdf.queryExecution().executedPlan().toString()
    tables.write_sales(tables.read_transactions(spark, path), str(tmp_path / "sales"))
    assert tables.read_transactions(spark, str(tmp_path / "sales")).count() == 1


def test_replacing_a_table_overwrites_it(spark, tmp_path):
    tables.replace_table(spark.range(5), "tillroll_test", str(tmp_path / "a"))
    assert tables.replace_table(spark.range(2), "tillroll_test", str(tmp_path / "b")).count() == 2
    spark.sql("DROP TABLE tillroll_test")


def test_describe(spark):
    described = as_dicts(tables.describe_table(spark.range(3)))
    assert described == [{"position": 1, "column_name": "id", "column_type": "bigint", "row_count": 3}]


def test_staged_tables_lie_in_the_checkpoint_folder(spark):
    staged = staging.stage(spark.range(3), "test")
    assert staging.staging_root(spark) in staged.inputFiles()[0]
    assert staged.count() == 3


def test_readers_never_miss_a_table_that_is_replaced(spark, tmp_path):
    name = "tillroll_polled"
    tables.replace_table(spark.range(3), name, str(tmp_path / "it's"))
    seen, problems, done = set(), [], threading.Event()

    def poll():
        while not done.is_set():
            try:
                seen.add(spark.table(name).count())
            except Exception as error:  # any failure of a reader counts
                problems.append(str(error)[:300])

    reader = threading.Thread(target=poll)
    reader.start()
    try:
        for n in (4, 5, 6, 7):
            assert tables.replace_table(spark.range(n), name, str(tmp_path / "it's")).count() == n
    finally:
        done.set()
        reader.join()
    assert not problems and seen <= {3, 4, 5, 6, 7}
    other = tables.replace_table(spark.range(2).selectExpr("id AS other"), name, str(tmp_path / "b"))
    assert other.columns == ["other"] and other.count() == 2
    spark.sql(f"DROP TABLE {name}")


def _files(folder):
    return sorted(str(f) for f in folder.glob("*.parquet"))


def _lines(spark, path):
    return sorted(map(str, tables.read_transactions(spark, path).collect()))


def test_loads_in_parts_equal_one_load(spark, tmp_path):
    may, june = at("2020-05-03 10:00"), at("2020-06-03 10:00")
    first = [
        {"InvoiceDate": may, "Description": None, "Country": " Home"},
        {"InvoiceDate": may, "StockCode": "t", "Description": "  b  b "},
        {"InvoiceDate": june},
        {"InvoiceDate": None, "StockCode": "undated"},
    ]
    # Twins of stored lines whose texts come before those stored, or after; a new month; a price that is dropped.
    second = [
        {"InvoiceDate": may, "Description": "zzz", "Country": "Away"},
        {"InvoiceDate": may, "StockCode": "t", "Description": "a"},
        {"InvoiceDate": may, "StockCode": "t", "Description": "a"},
        {"InvoiceDate": may, "StockCode": "u", "UnitPrice": -1.0},
        {"InvoiceDate": None, "StockCode": "undated", "Quantity": -2},
        {"InvoiceDate": at("2020-07-01 00:00"), "CustomerID": None},
    ]
    parts, whole = str(tmp_path / "parts"), str(tmp_path / "whole")
    assert tables.append_transactions(raw(spark, []), parts) == []
    assert tables.append_transactions(raw(spark, first), parts) == [None, "2020-05", "2020-06"]
    kept = _files(tmp_path / "parts" / "YearMonth=2020-06")
    more = raw(spark, second).withColumn("SourceDescription", F.lit("clash"))
    assert tables.append_transactions(more, parts) == [None, "2020-05", "2020-07"]
    tables.append_transactions(raw(spark, first + second), whole)
    assert _lines(spark, parts) == _lines(spark, whole) and len(_lines(spark, whole)) == 6
    assert _files(tmp_path / "parts" / "YearMonth=2020-06") == kept
    again = _lines(spark, parts)
    tables.append_transactions(raw(spark, second), parts)
    assert _lines(spark, parts) == again


def test_only_touched_months_are_read(spark, tmp_path):
    path = str(tmp_path / "tx")
    tables.append_transactions(raw(spark, [{}, {"InvoiceDate": at("2021-01-01 00:00")}]), path)
    plan = tables._stored_lines(spark, path, ["2020-01"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(YearMonth" in plan and "2020-01" in plan


def test_tables_without_their_source_texts_are_refused(spark, tmp_path):
    path = str(tmp_path / "tx")
    tables.write_transactions(cleaning.clean_transactions(raw(spark, [{}])), path)
    with pytest.raises(ValueError, match="keep_sources"):
        tables.append_transactions(raw(spark, [{}]), path)


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_a_table_is_cleaned_and_written_in_one_shuffle(spark, tmp_path, monkeypatch):
    days = [None, *[at(f"2020-0{m}-0{d} 10:00") for m in (1, 2) for d in range(1, 9)]]
    rows = [{"InvoiceDate": day, "InvoiceNo": i, "Description": d} for day in days for i in ("a", None) for d in (" b", "a ")]
    rows.append({"InvoiceDate": days[1], "CustomerID": None, "Quantity": -1})
    lines = raw(spark, rows * 3)
    dealt = cleaning.clean_transactions(lines, month_parts=tables.MONTH_PARTS)
    plain = cleaning.clean_transactions(lines)
    assert _shuffles(dealt) == _shuffles(plain) == 1
    tables.write_cleaned(lines, str(tmp_path / "tx"))
    assert _lines(spark, str(tmp_path / "tx")) == sorted(map(str, plain.collect()))
    plans, write = [], tables._replace_months
    monkeypatch.setattr(tables, "_replace_months", lambda df, path: (plans.append(_shuffles(df)), write(df, path)))
    tables.append_transactions(lines, str(tmp_path / "tx"))
    assert _lines(spark, str(tmp_path / "tx")) == sorted(map(str, plain.collect()))
    assert plans == [1]
    stored = tables.read_transactions(spark, str(tmp_path / "tx"))
    tables.write_sales(stored, str(tmp_path / "sales"))
    assert _lines(spark, str(tmp_path / "sales")) == sorted(map(str, stored.filter("NOT IsReturn").collect()))

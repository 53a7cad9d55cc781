from pyspark.sql import functions as F

from tests.data import as_dicts, at, raw
from tillroll.operators import cleaning


def test_price_limits_keep_missing_prices(spark):
    prices = [-1.0, 0.0, 0.005, 10000.0, 10000.01, None, float("nan")]
    df = raw(spark, [{"UnitPrice": p, "StockCode": str(i)} for i, p in enumerate(prices)])
    kept = {row["StockCode"] for row in cleaning.remove_bad_prices(df).collect()}
    assert kept == {"2", "3", "5", "6"}


def test_duplicates_keep_first_description(spark):
    rows = [{"Description": d, "Country": c} for d, c in [(None, "A"), ("b", "A"), ("a", "Z"), ("a", "B")]]
    kept = as_dicts(cleaning.remove_duplicates(raw(spark, rows * 50)))
    assert [(r["Description"], r["Country"]) for r in kept] == [("a", "B")]


def test_duplicates_treat_missing_customers_as_equal(spark):
    df = raw(spark, [{"CustomerID": None}] * 3 + [{"CustomerID": "x"}])
    assert cleaning.remove_duplicates(df).count() == 2


def test_strategies(spark):
    df = raw(spark, [{"CustomerID": None}, {"Description": None}, {}])
    assert cleaning.handle_missing_customers(df, "remove").count() == 2
    assert cleaning.handle_missing_descriptions(df, "remove").count() == 2
    assert cleaning.handle_missing_customers(df).filter("CustomerID = 'Guest'").count() == 1
    assert cleaning.handle_missing_descriptions(df).filter("Description = 'Unknown Product'").count() == 1


def test_text_and_calendar(spark):
    df = raw(spark, [{"Description": "\t red   big \n plate ", "Country": " Old  Land ", "Quantity": -3}])
    (row,) = as_dicts(cleaning.clean_transactions(df))
    assert row["Description"] == "red big plate"
    assert row["Country"] == "Old  Land"
    assert row["IsReturn"] and row["TotalPrice"] == -3.0
    assert (row["DayOfWeek"], row["DayName"], row["MonthName"], row["YearMonth"], row["Hour"]) == (
        0,
        "Monday",
        "January",
        "2020-01",
        10,
    )


def test_summary_counts_match_the_steps(spark):
    rows = [
        {},
        {},
        {"CustomerID": None},
        {"CustomerID": None},
        {"UnitPrice": 0.0},
        {"UnitPrice": 0.0},
        {"Quantity": -2},
        {"Description": None, "StockCode": "t"},
        {"Description": None, "StockCode": "u"},
        {"Description": "known", "StockCode": "u"},
    ]
    df = raw(spark, rows)
    (summary,) = as_dicts(cleaning.cleaning_summary(df))
    tx = cleaning.clean_transactions(df)
    assert summary["original_rows"] == 10 and summary["final_rows"] == tx.count() == 5
    assert summary["bad_prices_removed"] == 2 and summary["duplicates_removed"] == 3
    assert summary["missing_customers_original"] == 2 and summary["returns_identified"] == 1
    assert summary["missing_descriptions_original"] == tx.filter("Description = 'Unknown Product'").count() == 1
    assert len(tx.columns) == summary["final_columns"]


def test_validation_reports_failures(spark):
    tx = cleaning.add_calculated_fields(raw(spark, [{"UnitPrice": None}, {"CustomerID": None}]))
    verdicts = {row["check"]: row["passed"] for row in cleaning.validate(tx.drop("TotalPrice")).collect()}
    assert not verdicts["positive_prices"] and not verdicts["no_null_customerid"]
    assert not verdicts["has_total_price"] and verdicts["has_date_fields"]


def test_one_hot_group_of_copies_is_combined_before_the_shuffle(spark):
    plan = cleaning.remove_duplicates(raw(spark, [{}]))._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan


def test_kpis_of_sales_ignore_returns(spark):
    rows = [
        {"InvoiceNo": "1", "UnitPrice": 4.0},
        {"InvoiceNo": "1", "StockCode": "b", "UnitPrice": 6.0},
        {"InvoiceNo": "C2", "Quantity": -1, "UnitPrice": 100.0, "InvoiceDate": at("2020-02-01 00:00")},
    ]
    (kpis,) = as_dicts(cleaning.cleaned_kpis(cleaning.clean_transactions(raw(spark, rows))))
    assert (kpis["total_transactions"], kpis["sales_transactions"], kpis["return_transactions"]) == (3, 2, 1)
    assert kpis["avg_invoice_total"] == 10.0 and kpis["avg_item_price"] == 5.0
    assert kpis["last_date"] == at("2020-02-01 00:00")


def test_dropping_returns(spark):
    df = raw(spark, [{"Quantity": -1}, {"Quantity": 0}])
    assert cleaning.clean_transactions(df, drop_returns=True).agg(F.sum("Quantity")).first()[0] == 0

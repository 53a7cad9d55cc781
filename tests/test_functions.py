import pytest
from pyspark.sql import functions as F

from tests.data import at
from tillroll.functions import dates, numbers, text
from tillroll.operators import dashboard


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def ts(text):
    return F.lit(at(text)).cast("timestamp_ntz")


def test_calendar_days_and_elapsed_days_differ(spark):
    early, late = ts("2020-03-01 23:00"), ts("2020-03-03 01:00")
    assert value(spark, dates.calendar_days(late, early)) == 2
    assert value(spark, dates.elapsed_days(late, early)) == 1


def test_elapsed_days_round_down_below_zero(spark):
    assert value(spark, dates.elapsed_days(ts("2020-03-01 00:00"), ts("2020-03-01 01:00"))) == -1
    assert value(spark, dates.elapsed_days(ts("2020-03-01 00:00"), ts("2020-03-02 00:00"))) == -1
    assert value(spark, dates.elapsed_days(ts("2020-03-01 00:00"), ts("2020-03-02 00:01"))) == -2


def test_months_count_boundaries(spark):
    assert value(spark, dates.months_between_starts(ts("2020-02-01 00:00"), ts("2020-01-31 00:00"))) == 1


def test_week_label_starts_on_monday(spark):
    assert value(spark, dates.week_label(ts("2020-03-01 12:00"))) == "2020-02-24/2020-03-01"


@pytest.mark.parametrize(
    "number, digits, up, even",
    [(2.675, 2, 2.68, 2.68), (2.665, 2, 2.67, 2.66), (0.125, 2, 0.13, 0.12), (-2.5, 0, -3.0, -2.0), (2.4999999, 0, 2.0, 2.0), (0.0049999996, 2, 0.0, 0.0)],
)
def test_rounding(spark, number, digits, up, even):
    assert value(spark, numbers.half_up(F.lit(number), digits)) == up
    assert value(spark, numbers.half_even(F.lit(number), digits)) == even


def test_zero_lies_in_no_band(spark):
    edges, labels = [0, 100, 500], ["low", "middle", "high"]
    found = [value(spark, numbers.right_closed_band(F.lit(x), edges, labels)) for x in (0, 100, 101, 500, 501)]
    assert found == [None, "low", "middle", "middle", "high"]


def test_division_by_zero(spark):
    assert value(spark, numbers.safe_ratio(F.lit(1.0), F.lit(0.0))) is None
    for bad in (float("inf"), float("nan"), None):
        assert value(spark, numbers.finite_or_zero(F.lit(bad).cast("double"))) == 0.0


def test_labels(spark):
    amounts = {1_250_000.0: "$1.25M", 1200.0: "$1.2K", 950.0: "$950", -1200.0: "$-1,200"}
    for amount, label in amounts.items():
        assert value(spark, text.money_label(F.lit(amount))) == label
    for number, label in {1_200_000: "1.2M", 12_000: "12K", 950: "950"}.items():
        assert value(spark, text.count_label(F.lit(number))) == label


def test_following_days(spark):
    days = spark.range(1).select(dates.following_days(F.lit("2020-02-28").cast("date"), 3)).collect()
    assert [str(row[0]) for row in days] == ["2020-02-29", "2020-03-01", "2020-03-02"]


def test_labels_print_the_binary_value_with_halves_to_even(spark):
    numbers_of = [0.25, 0.15, 3.25, 3.35, 3.15, 44.5, 45.5, 0.05, 1.005, 1.125, 0.0, -2.5, -0.2, 0.4999999999999999, 1e17, 1234567.895]
    rows = spark.createDataFrame([(v,) for v in numbers_of], "v double")
    for digits in (0, 1, 2):
        label = F.format_string(f"%.{digits}f", numbers.as_printed(F.col("v"), digits))
        assert [r[0] for r in rows.select(label).collect()] == [f"%.{digits}f" % v for v in numbers_of]
    assert value(spark, text.money_label(F.lit(3250.0))) == "$3.2K"
    assert value(spark, text.count_label(F.lit(2500))) == "2K"


def test_segment_labels_of_halves(spark):
    rows = [("a", 3, 44, 1000.0), ("a", 3, 45, 1000.0), ("a", 3, 44, 1000.0), ("a", 4, 45, 1000.0)]
    columns = "CustomerID string, Frequency int, Recency int, MonetaryValue double"
    named = spark.createDataFrame(rows, columns).withColumn("ClusterName", F.lit("x"))
    (row,) = dashboard.segment_summary(named).collect()
    assert (row["Avg_Frequency_Label"], row["Avg_Recency_Label"]) == ("3.2 orders", "44 days")

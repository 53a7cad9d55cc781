"""Calendar arithmetic on TIMESTAMP_NTZ columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(value) -> Column:
    """A date, datetime or text as TIMESTAMP_NTZ; a date without a time is its midnight."""
    return F.to_timestamp_ntz(F.lit(str(value)))


def month_start(ts) -> Column:
    """First day of the month, as DATE."""
    return F.trunc(F.to_date(ts), "month")


def week_start(ts) -> Column:
    """Monday of the week, as DATE."""
    return F.trunc(F.to_date(ts), "week")


def week_label(ts) -> Column:
    """`monday/sunday` text of the week."""
    start = week_start(ts)
    return F.concat(
        F.date_format(start, "yyyy-MM-dd"), F.lit("/"), F.date_format(F.date_add(start, 6), "yyyy-MM-dd")
    )


def year_month(ts) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_name(ts) -> Column:
    return F.date_format(ts, "MMMM")


def day_name(ts) -> Column:
    return F.date_format(ts, "EEEE")


def day_of_week(ts) -> Column:
    """Monday = 0."""
    return F.weekday(ts)


def calendar_days(later, earlier) -> Column:
    """Midnights crossed between two timestamps."""
    return F.datediff(later, earlier)


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole 24 h periods between two timestamps, rounded down also below zero."""
    gap = later - earlier
    days = F.extract(F.lit("DAY"), gap).cast("int")
    return F.when(gap < F.make_dt_interval(days), days - 1).otherwise(days).cast("long")


def month_index(ts) -> Column:
    """Running month number, so that a difference counts month boundaries."""
    return F.year(ts) * 12 + F.month(ts)


def months_between_starts(later, earlier) -> Column:
    return month_index(later) - month_index(earlier)


def following_days(last: Column, count: int) -> Column:
    """One DATE row for each of the `count` days after `last`."""
    return F.explode(F.sequence(F.date_add(last, 1), F.date_add(last, count)))

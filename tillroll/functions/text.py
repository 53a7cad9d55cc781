"""Text normalisation and display labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.functions.numbers import as_printed

# All Unicode whitespace plus the four ASCII separators.
_WHITESPACE = r"(?U)[\s\x1c-\x1f]+"


def single_spaced(text) -> Column:
    """Runs of whitespace become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, _WHITESPACE, " "))


def stripped(text) -> Column:
    """No whitespace at the ends, inner whitespace untouched."""
    return F.regexp_replace(text, rf"^{_WHITESPACE}|{_WHITESPACE}$", "")


def shortened(text, length: int) -> Column:
    return F.substring(text, 1, length)


def is_cancellation(invoice: Column) -> Column:
    return invoice.startswith("C")


def money_label(amount: Column) -> Column:
    """`$1.25M`, `$1.2K` or `$950`."""
    return (
        F.when(amount >= 1e6, F.format_string("$%.2fM", as_printed(amount / 1e6, 2)))
        .when(amount >= 1e3, F.format_string("$%.1fK", as_printed(amount / 1e3, 1)))
        .otherwise(F.format_string("$%,.0f", as_printed(amount, 0)))
    )


def count_label(number: Column) -> Column:
    """`1.2M`, `12K` or `950`."""
    number = number.cast("double")
    return (
        F.when(number >= 1e6, F.format_string("%.1fM", as_printed(number / 1e6, 1)))
        .when(number >= 1e3, F.format_string("%.0fK", as_printed(number / 1e3, 0)))
        .otherwise(F.format_string("%,.0f", as_printed(number, 0)))
    )

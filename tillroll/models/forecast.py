"""Daily series, their forecasts and forecast errors.

A series is the daily aggregate of one key, so its length is the number of calendar days in
the data.  It becomes one sorted array, and a model is a recursion over that array: Spark
aggregates it for every point of a grid of parameters and keeps the point of least error.
"""

from collections.abc import Sequence
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.numbers import safe_ratio
from tillroll.operators import rollups
from tillroll.operators.baskets import best_sellers
from tillroll.operators.explore import rolling_mean
from tillroll.staging import stage

TRAIN_SHARE = 0.8
SEASON = 7
DEMAND_WINDOW = 7

TRAIN_END = "train_end"
SERIES_END = "series_end"

# A series shorter than its model needs has no forecast.
FITTED = "fitted"
TOO_SHORT = "too_short"


def daily_series(sales: DataFrame, *keys: str) -> DataFrame:
    """Revenue, orders and customers per observed day, for each value of the keys."""
    rolled = rollups.invoice_rollup(sales, F.to_date("InvoiceDate").alias("Date"), *[F.col(k) for k in keys])
    return rolled.groupBy(*keys, "Date").agg(
        F.sum("revenue").alias("Revenue"), rollups.orders().alias("Orders"), rollups.customers().alias("Customers")
    )


def split_by_time(series: DataFrame, keys: Sequence[str] = (), order: str = "Date", share: float = TRAIN_SHARE):
    """Add `part`: the first `share` of each series is `train`, the rest `test`.

    The windows hold the days of one series.
    """
    days = Window.partitionBy(*keys)
    position = F.row_number().over(days.orderBy(order))
    size = F.floor(F.count("*").over(days) * F.lit(share))
    return series.withColumn("part", F.when(position <= size, "train").otherwise("test"))


def arima(series: DataFrame, keys: Sequence[str] = (), days_ahead: int = 30, origin: str = SERIES_END) -> DataFrame:
    """ARIMA(1,1,1) per series: `test` rows with the actual value and `future` rows.

    The differenced series has one autoregressive and one moving-average coefficient, fitted
    by conditional least squares on the first 80 % of the days.  `origin='train_end'` starts
    the future right after those instead of after the last day.
    """
    return _forecast(series, keys, Arima, days_ahead, origin)


def holt_winters(
    series: DataFrame, keys: Sequence[str] = (), days_ahead: int = 30, origin: str = SERIES_END
) -> DataFrame:
    """Additive trend and additive weekly season per series, rows as in `arima`.

    Smoothing weights minimise the squared one-step error over a refined grid.
    """
    return _forecast(series, keys, HoltWinters, days_ahead, origin)


def forecast_errors(forecast: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and MAPE (percent) over the test rows."""
    error = F.col("actual") - F.col("forecast")
    return (
        forecast.filter(F.col("part") == "test")
        .groupBy(*keys)
        .agg(
            F.avg(F.abs(error)).alias("mae"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
            (F.avg(F.abs(safe_ratio(error, F.col("actual")))) * 100.0).alias("mape"),
        )
    )


def forecast_totals(forecast: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum and daily mean of the future rows."""
    return (
        forecast.filter(F.col("part") == "future")
        .groupBy(*keys)
        .agg(F.sum("forecast").alias("total"), F.avg("forecast").alias("daily_mean"))
    )


def product_demand(sales: DataFrame, top_n: int = 20, window: int = DEMAND_WINDOW) -> DataFrame:
    """Mean daily demand, moving mean at the last day and total units of the best sellers.

    One plan handles all products.  The list of best sellers, bounded by `top_n`, is broadcast
    to the scan, so only their lines are grouped by day.  Both read the staged columns of sales.
    """
    sales = stage(sales.select("InvoiceDate", "Description", "Quantity"), "lines")
    best = best_sellers(sales, top_n).withColumnRenamed("units", "Total_Sold")
    daily = (
        sales.join(F.broadcast(best), "Description")
        .groupBy(F.col("Description").alias("Product"), "Total_Sold", F.to_date("InvoiceDate").alias("Date"))
        .agg(F.sum("Quantity").alias("units"))
    )
    observed = daily.withColumn("smooth", rolling_mean(daily, "units", ["Product"], "Date", window))
    return observed.groupBy("Product", "Total_Sold").agg(
        F.avg("units").alias("Avg_Daily_Demand"), F.max_by("smooth", "Date").alias("Forecasted_Demand")
    )


class Axis(NamedTuple):
    """Values of a parameter in the first grid, and the limits of its refinement."""

    name: str
    values: tuple[float, ...]
    low: float
    high: float

    @property
    def step(self) -> float:
        return round(self.values[1] - self.values[0], 6)


# After the first grid, the neighbours of the best point at half the step, this many times.
REFINEMENTS = 3


class Arima:
    """Differences with one autoregressive and one moving-average coefficient."""

    shortest = 4
    used = 2
    axes = tuple(Axis(name, (-0.8, -0.6, -0.4, -0.2, 0.0, 0.2, 0.4, 0.6, 0.8), -0.95, 0.95) for name in ("ar", "ma"))

    @staticmethod
    def start(values: Column) -> Column:
        """State after the first `used` values."""
        second = F.get(values, F.lit(1))
        return F.struct(
            second.alias("last"),
            (second - F.get(values, F.lit(0))).alias("change"),
            F.lit(0.0).alias("error"),
            F.lit(0.0).alias("loss"),
        )

    @staticmethod
    def step(state: Column, value: Column, at: Column) -> Column:
        change = value - state["last"]
        error = change - at["ar"] * state["change"] - at["ma"] * state["error"]
        return F.struct(
            value.alias("last"), change.alias("change"), error.alias("error"), (state["loss"] + error * error).alias("loss")
        )

    @staticmethod
    def ahead(state: Column, at: Column, days: Column) -> Column:
        following = at["ar"] * state["change"] + at["ma"] * state["error"]
        return state["last"] + following * (1 - F.pow(at["ar"], days)) / (1 - at["ar"])


_WEEK = [f"s{k}" for k in range(SEASON)]


class HoltWinters:
    """Level, trend and one value per weekday: `s0` belongs to the next day, `s1` to the one after."""

    shortest = 2 * SEASON
    used = SEASON
    axes = (
        Axis("level", (0.1, 0.4, 0.7), 0.01, 0.99),
        Axis("trend", (0.0, 0.2, 0.4), 0.0, 0.5),
        Axis("season", (0.0, 0.3, 0.6, 0.9), 0.0, 0.9),
    )

    @staticmethod
    def start(values: Column) -> Column:
        def mean(first):
            return F.aggregate(F.slice(values, first, SEASON), F.lit(0.0), lambda a, b: a + b) / SEASON

        return F.struct(
            mean(1).alias("level"),
            ((mean(SEASON + 1) - mean(1)) / SEASON).alias("trend"),
            F.lit(0.0).alias("loss"),
            *[(F.get(values, F.lit(k)) - mean(1)).alias(day) for k, day in enumerate(_WEEK)],
        )

    @staticmethod
    def step(state: Column, value: Column, at: Column) -> Column:
        expected = state["level"] + state["trend"]
        gap = value - expected - state["s0"]
        return F.struct(
            (expected + at["level"] * gap).alias("level"),
            (state["trend"] + at["level"] * at["trend"] * gap).alias("trend"),
            (state["loss"] + gap * gap).alias("loss"),
            *[state[following].alias(day) for day, following in zip(_WEEK, _WEEK[1:])],
            (state["s0"] + at["season"] * gap).alias(_WEEK[-1]),
        )

    @staticmethod
    def ahead(state: Column, at: Column, days: Column) -> Column:
        due = F.get(F.array(*[state[day] for day in _WEEK]), ((days - 1) % SEASON).cast("int"))
        return state["level"] + days * state["trend"] + due


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are evaluated once per row, however often lambdas use them.

    Projections would be merged into the lambdas; no expression moves across a generator.
    """
    made = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*df.columns, F.inline(F.array(made)))


def _through(model, values: Column, at: Column) -> Column:
    """State of a model at the end of the values."""
    rest = F.slice(values, model.used + 1, F.greatest(F.size(values) - model.used, F.lit(0)))
    return F.aggregate(rest, model.start(values), lambda state, value: model.step(state, value, at))


def _best(model, grid: Column) -> Column:
    """Point of least loss, of equals the smallest."""
    names = [axis.name for axis in model.axes]
    tried = F.transform(
        grid, lambda p: F.struct(_through(model, F.col("_train"), p)["loss"].alias("loss"), *[p[n].alias(n) for n in names])
    )
    return F.array_min(tried)


def _points(model, points) -> Column:
    """An array of literal parameter points."""
    fields = [", ".join(f"'{a.name}', {v!r}D" for a, v in zip(model.axes, point)) for point in points]
    return F.expr(f"array({', '.join(f'named_struct({text})' for text in fields)})")


def _grid(model) -> Column:
    return _points(model, product(*[axis.values for axis in model.axes]))


def _around(model, best: Column, part: float) -> Column:
    """The point and its neighbours, at a part of each axis' step."""
    moves = _points(model, product(*[(-part * a.step, 0.0, part * a.step) for a in model.axes]))

    def moved(by, axis):
        return F.least(F.greatest(best[axis.name] + by[axis.name], F.lit(axis.low)), F.lit(axis.high)).alias(axis.name)

    return F.transform(moves, lambda by: F.struct(*[moved(by, axis) for axis in model.axes]))


def fitted_series(series: DataFrame, keys: Sequence[str], model) -> DataFrame:
    """One row per series: its days in order, the number `_cut` of training days and the parameters `_best`.

    The series are dealt over all shuffle partitions by key, as the search costs far more than its bytes tell.
    """
    partitions = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    days = F.struct("Date", F.col("Revenue").cast("double").alias("value"))
    found = series.repartition(partitions, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(days)).alias("_days"))
    found = _once(found, _cut=F.floor(F.size("_days") * F.lit(TRAIN_SHARE)).cast("int"))
    found = _once(found, _values=F.transform("_days", lambda d: d["value"]))
    found = _once(found, _train=F.slice("_values", 1, F.col("_cut")))
    found = _once(found, _best=_best(model, _grid(model)))
    for k in range(REFINEMENTS):
        found = _once(found, _next=_best(model, _around(model, F.col("_best"), 0.5 ** (k + 1))))
        found = found.withColumn("_best", F.col("_next")).drop("_next")
    return found


def _forecast(series: DataFrame, keys: Sequence[str], model, days_ahead: int, origin: str) -> DataFrame:
    groups = list(keys)
    if not groups:
        series, groups = series.withColumn("series", F.lit("all")), ["series"]
    ready = F.col("_cut") >= model.shortest
    seen = F.col("_train") if origin == TRAIN_END else F.col("_values")
    found = fitted_series(series, groups, model)
    found = _once(
        found,
        _trained=_through(model, F.col("_train"), F.col("_best")),
        _last=_through(model, seen, F.col("_best")),
        _until=F.get("_days", F.greatest(F.size(seen), F.lit(1)) - 1)["Date"],
    )

    def row(part, date, actual, state, days):
        guess = F.when(ready, model.ahead(F.col(state), F.col("_best"), days))
        status = F.when(ready, F.lit(FITTED)).otherwise(F.lit(TOO_SHORT))
        return F.struct(
            F.lit(part).alias("part"), date.alias("Date"), actual.alias("actual"), guess.alias("forecast"), status.alias("status")
        )

    tested = F.transform(
        F.sequence(F.lit(1), F.size("_days") - F.col("_cut")),
        lambda h: row(
            "test",
            F.get("_days", F.col("_cut") + h - 1)["Date"],
            F.get("_values", F.col("_cut") + h - 1),
            "_trained",
            h,
        ),
    )
    future = F.transform(
        F.sequence(F.lit(1), F.lit(days_ahead)),
        lambda h: row("future", F.date_add("_until", h), F.lit(None).cast("double"), "_last", h),
    )
    return found.select(*groups, F.inline(F.concat(tested, future)))

"""Forecasts per country; the statements run the same recursions row by row."""

from itertools import product

from pyspark.sql import functions as F

from tillroll.models import forecast
from tillroll.plans.registry import query
from tillroll.plans.sql import compared, with_tables

_AHEAD = 30


def _series(f):
    """Daily revenue to the cent: a model must not see the noise of the sums."""
    daily = forecast.daily_series(f.sales, "Country")
    return daily.withColumn("Revenue", F.round(F.round("Revenue", 6), 2))


def _values(points) -> str:
    return ", ".join("(" + ", ".join(f"{v!r}e0" for v in point) + ")" for point in points)


def _forecast_sql(model, start: str, state: list[str], gap: str, following: list[str], ahead: str) -> dict[str, str]:
    """Named subqueries up to `forecasts`, for a model given by its first state and one step of it."""
    names = [a.name for a in model.axes]
    listed, states = ", ".join(names), ", ".join(state)
    tables = {
        "series": f"""SELECT Country, Date, v, t, n, CAST(floor(n * {forecast.TRAIN_SHARE}) AS BIGINT) AS cut FROM (
              SELECT Country, CAST(InvoiceDate AS DATE) AS Date, {compared('sum(TotalPrice)')} AS v,
                row_number() OVER (PARTITION BY Country ORDER BY CAST(InvoiceDate AS DATE)) AS t,
                count(*) OVER (PARTITION BY Country) AS n
              FROM sales GROUP BY 1, 2)""",
        "lengths": "SELECT Country, n, cut, max(Date) AS until FROM series GROUP BY 1, 2, 3",
        "starts": start,
        "points0": f"SELECT Country, {listed} FROM starts, (VALUES {_values(product(*[a.values for a in model.axes]))}) p({listed})",
    }

    def run(points, until):
        return f"""SELECT Country, {listed}, CAST({model.used} AS BIGINT) AS t, {states}, 0e0 AS loss
              FROM {points} JOIN starts USING (Country)
              UNION ALL
              SELECT Country, {listed}, t + 1, {', '.join(following)}, loss + gap * gap
              FROM (SELECT r.*, s.v, {gap} AS gap FROM {{0}} r JOIN series s ON s.Country = r.Country AND s.t = r.t + 1
                    WHERE s.t <= s.{until})"""

    for k in range(forecast.REFINEMENTS + 1):
        if k:
            moves = product(*[(-(0.5**k) * a.step, 0.0, 0.5**k * a.step) for a in model.axes])
            moved = ", ".join(f"least(greatest(b.{a.name} + p.{a.name}, {a.low!r}e0), {a.high!r}e0) AS {a.name}" for a in model.axes)
            tables[f"points{k}"] = f"SELECT Country, {moved} FROM best{k - 1} b, (VALUES {_values(moves)}) p({listed})"
        tables[f"run{k}"] = run(f"points{k}", "cut").format(f"run{k}")
        tables[f"best{k}"] = f"""SELECT Country, {listed} FROM run{k} JOIN lengths USING (Country) WHERE t = cut
              QUALIFY row_number() OVER (PARTITION BY Country ORDER BY loss, {listed}) = 1"""
    tables["states"] = run(f"best{forecast.REFINEMENTS}", "n").format("states")
    status = f"CASE WHEN s.Country IS NULL THEN '{forecast.TOO_SHORT}' ELSE '{forecast.FITTED}' END AS status"
    tables["forecasts"] = f"""
      SELECT d.Country, 'test' AS part, d.Date, d.v AS actual, d.t - d.cut AS h, {ahead} AS forecast, {status}
      FROM series d LEFT JOIN states s ON s.Country = d.Country AND s.t = d.cut WHERE d.t > d.cut
      UNION ALL
      SELECT d.Country, 'future', CAST(d.until + CAST(h AS INT) AS DATE), NULL, h, {ahead}, {status}
      FROM (SELECT *, unnest(range(1, {_AHEAD + 1})) AS h FROM lengths) d
      LEFT JOIN states s ON s.Country = d.Country AND s.t = d.n"""
    return tables


def _recursive(select: str, tables: dict[str, str]) -> str:
    statement = with_tables(select, **tables).replace("WITH b AS", "WITH RECURSIVE b AS", 1)
    return statement.replace("series AS (", "series AS MATERIALIZED (", 1)


_ARIMA = _forecast_sql(
    forecast.Arima,
    """SELECT Country, v AS last, v - before AS change, 0e0 AS error
       FROM (SELECT *, lag(v) OVER (PARTITION BY Country ORDER BY t) AS before FROM series) WHERE t = 2 AND cut >= 4""",
    ["last", "change", "error"],
    "s.v - r.last - r.ar * r.change - r.ma * r.error",
    ["v", "v - last", "gap"],
    "s.last + (s.ar * s.change + s.ma * s.error) * (1 - pow(s.ar, h)) / (1 - s.ar)",
)
_WEEK = [f"s{k}" for k in range(forecast.SEASON)]
_HOLT_WINTERS = _forecast_sql(
    forecast.HoltWinters,
    f"""SELECT Country, m1 AS l, (m2 - m1) / 7 AS b, {', '.join(f'days[{k + 1}] - m1 AS s{k}' for k in range(7))}
        FROM (SELECT Country, list(v ORDER BY t) AS days, list_sum(days[1:7]) / 7 AS m1, list_sum(days[8:14]) / 7 AS m2
              FROM series WHERE t <= 14 AND cut >= 14 GROUP BY Country)""",
    ["l", "b", *_WEEK],
    "s.v - (r.l + r.b) - r.s0",
    ["l + b + level * gap", "b + level * trend * gap", *_WEEK[1:], "s0 + season * gap"],
    f"s.l + h * s.b + [{', '.join('s.' + s for s in _WEEK)}][CAST((h - 1) % 7 + 1 AS INT)]",
)

_ROWS = f"""SELECT Country, part, strftime(Date, '%Y-%m-%d') AS Date, {compared('actual')} AS actual,
              {compared('forecast')} AS forecast, status FROM forecasts"""
_ERRORS = f"""SELECT Country, {compared('avg(abs(actual - forecast))')} AS mae,
                {compared('sqrt(avg((actual - forecast) ** 2))')} AS rmse,
                {compared('avg(abs((actual - forecast) / nullif(actual, 0))) * 100')} AS mape
              FROM forecasts WHERE part = 'test' GROUP BY Country"""
_TOTALS = f"""SELECT Country, {compared('sum(forecast)')} AS total, {compared('avg(forecast)')} AS daily_mean
              FROM forecasts WHERE part = 'future' GROUP BY Country"""


@query("m1_arima", _recursive(_ROWS, _ARIMA))
def _(f):
    return forecast.arima(_series(f), ["Country"], _AHEAD)


@query("m1_arima_by_country", _recursive(_ERRORS, _ARIMA))
def _(f):
    return forecast.forecast_errors(forecast.arima(_series(f), ["Country"], _AHEAD), ["Country"])


@query("m2_holt_winters", _recursive(_ROWS, _HOLT_WINTERS))
def _(f):
    return forecast.holt_winters(_series(f), ["Country"], _AHEAD)


@query("m2_holt_winters_by_country", _recursive(_TOTALS, _HOLT_WINTERS))
def _(f):
    return forecast.forecast_totals(forecast.holt_winters(_series(f), ["Country"], _AHEAD), ["Country"])

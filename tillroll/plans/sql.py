"""SQL text of the raw and cleaned tables, and helpers for the statements built on them.

The statements follow the plain definition of each report (window functions, joins,
distinct counts), not the rewrites of the operators, so that they check those.
"""

_TABLES = r"""
WITH b AS (
  SELECT CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F'
              THEN concat('C', CAST(o_orderkey AS VARCHAR))
              ELSE CAST(o_orderkey AS VARCHAR) END AS InvoiceNo,
         CAST(l_partkey AS VARCHAR) AS StockCode,
         CASE WHEN l_orderkey % 97 = 0 THEN NULL
              WHEN l_linenumber = 1 THEN concat('  ', replace(p_name, ' ', '   '), ' ')
              ELSE p_name END AS Description,
         CAST(l_quantity AS INT)
           * (CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN -1 ELSE 1 END) AS Quantity,
         o_orderdate + to_minutes(CAST(360 + (o_orderkey * 37) % 840 AS INT)) AS InvoiceDate,
         CASE WHEN l_partkey % 211 = 0 THEN 0.0E0
              WHEN l_partkey % 223 = 0 THEN 1.2E4
              ELSE l_extendedprice / (l_quantity * 100) END AS UnitPrice,
         CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS CustomerID,
         n_name AS Country,
         l_orderkey
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey),
raw AS (
  SELECT * EXCLUDE (l_orderkey) FROM b
  UNION ALL
  SELECT * EXCLUDE (l_orderkey) FROM b WHERE l_orderkey % 101 = 0),
guested AS (SELECT * REPLACE (coalesce(CustomerID, 'Guest') AS CustomerID) FROM raw),
priced AS (SELECT * FROM guested WHERE NOT coalesce(UnitPrice <= 0 OR UnitPrice > 10000, FALSE)),
numbered AS (
  SELECT *, row_number() OVER (
           PARTITION BY InvoiceNo, StockCode, CustomerID, Quantity, UnitPrice, InvoiceDate
           ORDER BY Description NULLS LAST, Country NULLS LAST) AS copy
  FROM priced),
tx AS (
  SELECT InvoiceNo, StockCode,
         trim(regexp_replace(coalesce(Description, 'Unknown Product'), '\s+', ' ', 'g')) AS Description,
         Quantity, InvoiceDate, UnitPrice, CustomerID, trim(Country) AS Country,
         Quantity < 0 AS IsReturn,
         Quantity * UnitPrice AS TotalPrice,
         CAST(year(InvoiceDate) AS INT) AS Year,
         CAST(month(InvoiceDate) AS INT) AS Month,
         CAST(day(InvoiceDate) AS INT) AS Day,
         CAST(isodow(InvoiceDate) - 1 AS INT) AS DayOfWeek,
         CAST(hour(InvoiceDate) AS INT) AS Hour,
         monthname(InvoiceDate) AS MonthName,
         dayname(InvoiceDate) AS DayName,
         strftime(InvoiceDate, '%Y-%m') AS YearMonth
  FROM numbered WHERE copy = 1),
sales AS (SELECT * FROM tx WHERE NOT IsReturn)"""


def with_tables(select: str, **tables: str) -> str:
    """A statement over `raw`, `tx`, `sales` and further named subqueries."""
    extra = "".join(f",\n{name} AS ({text})" for name, text in tables.items())
    return f"{_TABLES}{extra}\n{select}"


def with_recursive(select: str, tables: dict[str, str]) -> str:
    """The same for subqueries of which some read themselves."""
    return with_stored(select, tables).replace("WITH", "WITH RECURSIVE", 1)


def with_stored(select: str, tables: dict[str, str]) -> str:
    """The same with subqueries that are evaluated once, for chains in which each is read several times."""
    extra = "".join(f",\n{name} AS MATERIALIZED ({text})" for name, text in tables.items())
    return f"{_TABLES}{extra}\n{select}"


def compared(expression: str, digits: int = 2) -> str:
    """What `registry.comparable` makes of a double: float noise goes first."""
    return f"CAST(round(CAST({expression} AS DECIMAL(38, 6)), {digits}) AS DOUBLE)"


def rounded(expression: str, digits: int = 2) -> str:
    """Halves away from zero on the decimal value, where an operator rounds by itself."""
    return f"CAST(round(CAST({expression} AS DECIMAL(38, 12)), {digits}) AS DOUBLE)"


def half_even(expression: str, digits: int = 2) -> str:
    """Halves to the even neighbour on the decimal value."""
    return f"CAST(round_even(CAST({expression} AS DECIMAL(38, 12)), {digits}) AS DOUBLE)"


def day(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d')"


def metric(name: str, number: str = "NULL", label: str = "NULL", source: str = "") -> str:
    """One `(metric, number, label)` row."""
    number = "CAST(NULL AS DOUBLE)" if number == "NULL" else compared(number)
    return f"SELECT '{name}' AS metric, {number} AS number, CAST({label} AS VARCHAR) AS label {source}"


def metrics(*rows: str) -> str:
    return "\nUNION ALL ".join(rows)


# Per customer: orders, money, units, dates.
CUSTOMERS = """
  SELECT CustomerID, count(DISTINCT InvoiceNo) AS Frequency, sum(TotalPrice) AS MonetaryValue,
         avg(TotalPrice) AS AvgOrderValue, CAST(sum(Quantity) AS BIGINT) AS TotalQuantity,
         min(InvoiceDate) AS FirstPurchase, max(InvoiceDate) AS LastPurchase
  FROM {source} GROUP BY CustomerID"""


def customers(source: str) -> str:
    return CUSTOMERS.format(source=source)


# Whole days of 24 hours between two timestamps.
def elapsed(earlier: str, later: str) -> str:
    return f"date_sub('day', {earlier}, {later})"

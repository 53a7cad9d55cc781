"""SQL that grows the isolation forest and scores all rows."""

import math

from tillroll.models import anomalies

_F = anomalies.FEATURES
# Fixed value: the Euler-Mascheroni constant.
_EULER = 0.5772156649015329


def _mean_depth(n: str) -> str:
    return f"""CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + {_EULER}) - 2 * ({n} - 1) / CAST({n} AS DOUBLE) WHEN {n} = 2 THEN 1.0 ELSE 0.0 END"""


def tables(source: str, trees: int = anomalies.TREES, sample: int = anomalies.SAMPLE, contamination: float = anomalies.CONTAMINATION, seed: int = 42):
    """Subqueries from the rows of `source` to `scored` (rows with score) and `limits` (the cutoff)."""
    inputs = "Quantity, UnitPrice, TotalPrice, CAST(hour(InvoiceDate) AS INT) AS Hour, CAST(isodow(InvoiceDate) - 1 AS INT) AS DayOfWeek"
    features = ", ".join(_F)
    height = max(1, math.ceil(math.log2(max(sample, 2))))
    tables = {
        "inputs": f"""SELECT InvoiceNo, StockCode, CustomerID, InvoiceDate, {inputs} FROM {source}
                      WHERE Quantity IS NOT NULL AND UnitPrice IS NOT NULL AND TotalPrice IS NOT NULL AND InvoiceDate IS NOT NULL""",
        "sizes": f"SELECT greatest(1, least({sample}, count(*))) AS per_tree, greatest(1, least(count(*), {trees} * greatest(1, least({sample}, count(*))))) AS wanted FROM inputs",
        "drawn": f"""SELECT {features}, row_number() OVER (ORDER BY draw, {features}) - 1 AS position FROM (
                       SELECT *, md5(concat_ws('|', coalesce(InvoiceNo, ''), coalesce(StockCode, ''), coalesce(CustomerID, ''),
                                               CAST(Quantity AS VARCHAR), strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S'), '{seed}')) AS draw
                       FROM inputs) QUALIFY position < (SELECT wanted FROM sizes)""",
        "at_0": f"""SELECT CAST(t.i // per_tree AS INT) AS tree, 0 AS node, {features}
                    FROM sizes, range({trees} * {sample}) t(i) JOIN drawn ON position = t.i % (SELECT wanted FROM sizes)
                    WHERE t.i < {trees} * per_tree""",
    }
    for level in range(height + 1):
        varying = "[" + ", ".join(f"CASE WHEN min({c}) < max({c}) THEN {i} END" for i, c in enumerate(_F)) + "]"
        lows = "[" + ", ".join(f"CAST(min({c}) AS DOUBLE)" for c in _F) + "]"
        highs = "[" + ", ".join(f"CAST(max({c}) AS DOUBLE)" for c in _F) + "]"
        tables[f"nodes_{level}"] = f"""
          SELECT tree, node, n, f, lows[f + 1] + (highs[f + 1] - lows[f + 1]) * (CAST('0x' || substr(digits, 9, 8) AS BIGINT) / 4294967296.0) AS threshold,
            CASE WHEN f IS NULL THEN round({level} + {_mean_depth('n')}, 9) END AS path
          FROM (SELECT *, {'NULL' if level == height else "varying[CAST(CAST('0x' || substr(digits, 1, 8) AS BIGINT) % nullif(len(varying), 0) AS INT) + 1]"} AS f
                FROM (SELECT tree, node, count(*) AS n, md5('{seed}|' || tree || '|' || node) AS digits,
                        list_filter({varying}, lambda x: x IS NOT NULL) AS varying, {lows} AS lows, {highs} AS highs
                      FROM at_{level} GROUP BY tree, node))"""
        value = "CASE f " + " ".join(f"WHEN {i} THEN CAST({c} AS DOUBLE)" for i, c in enumerate(_F)) + " END"
        tables[f"at_{level + 1}"] = f"""
          SELECT a.tree, 2 * a.node + 1 + CAST({value} > threshold AS INT) AS node, {', '.join(f'a.{c}' for c in _F)}
          FROM at_{level} a JOIN nodes_{level} n ON n.tree = a.tree AND n.node = a.node WHERE f IS NOT NULL"""
    tables["nodes"] = " UNION ALL ".join(f"SELECT * FROM nodes_{level}" for level in range(height + 1))
    tables["tuples"] = f"SELECT {features}, count(*) AS copies, row_number() OVER () AS t FROM inputs GROUP BY {features}"
    tables["to_0"] = "SELECT t, tree, node, f, threshold, path FROM tuples, nodes WHERE node = 0"
    for level in range(height):
        value = "CASE w.f " + " ".join(f"WHEN {i} THEN CAST({c} AS DOUBLE)" for i, c in enumerate(_F)) + " END"
        tables[f"to_{level + 1}"] = f"""
          SELECT w.t, w.tree, n.node, n.f, n.threshold, n.path
          FROM to_{level} w JOIN tuples USING (t) JOIN nodes n ON n.tree = w.tree AND n.node = 2 * w.node + 1 + CAST({value} > w.threshold AS INT)
          WHERE w.f IS NOT NULL"""
    ends = " UNION ALL ".join(f"SELECT t, path FROM to_{level} WHERE f IS NULL" for level in range(height + 1))
    tables["scored_tuples"] = f"""
      SELECT {features}, copies, score FROM tuples JOIN (
        SELECT t, round(pow(2, -(sum(path) / count(*)) / (SELECT {_mean_depth('per_tree')} FROM sizes)), 9) AS score
        FROM ({ends}) GROUP BY t) USING (t)"""
    tables["limits"] = f"""SELECT quantile_cont(score, {1 - contamination}) AS cutoff FROM inputs JOIN scored_tuples USING ({features})"""
    return tables

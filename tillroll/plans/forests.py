"""SQL that grows the churn forest: every level of all trees by joins, counts and windows."""

from tillroll.models import churn, forest


def churn_tables(source: str, features: list[str], trees: int = 100, depth: int = 10, bins: int = forest.BINS, seed: int = 42) -> dict[str, str]:
    """Subqueries `cuts`, `leaves` and `scores` over the customers of `source`, and those they need."""
    size = max(1, round(len(features) ** 0.5))
    weight = " + ".join(f"CAST(u >= {cut} AS INT)" for cut in forest.POISSON)
    tables = {
        "people": f"""SELECT *, row_number() OVER (PARTITION BY Churned ORDER BY md5(CustomerID || '|{seed}'), CustomerID)
                        <= round_even(count(*) OVER (PARTITION BY Churned) * 0.2, 0) AS is_test FROM ({source})""",
        "inputs": " UNION ALL ".join(
            f"SELECT CustomerID, Churned, is_test, {i} AS f, round(coalesce(CAST({c} AS DOUBLE), 0), 6) AS x FROM people"
            for i, c in enumerate(features)
        ),
        "edges": f"""SELECT DISTINCT f, x FROM (
                       SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY x) AS place, count(*) OVER (PARTITION BY f) AS n
                       FROM inputs WHERE NOT is_test) JOIN range(1, {bins}) r(i) ON place = (n * i + {bins - 1}) // {bins}""",
        "binned": """SELECT CustomerID, Churned, is_test, i.f, count(e.x) AS bin
                     FROM inputs i LEFT JOIN edges e ON e.f = i.f AND e.x < i.x GROUP BY ALL""",
        "classes": """SELECT count(*) / (2.0 * count(*) FILTER (Churned = 0)) AS c0,
                        count(*) / (2.0 * count(*) FILTER (Churned = 1)) AS c1 FROM people WHERE NOT is_test""",
        "at_0": f"""SELECT CustomerID, Churned, tree, 0 AS node, w FROM (
                      SELECT *, {weight} AS w FROM (
                        SELECT CustomerID, Churned, CAST(t.tree AS INT) AS tree,
                          CAST('0x' || substr(md5(CustomerID || '|{seed}|' || t.tree), 1, 8) AS BIGINT) AS u
                        FROM people, range({trees}) t(tree) WHERE NOT is_test)) WHERE w > 0""",
    }
    purity = "((c0 * {0}) * (c0 * {0}) + (c1 * {1}) * (c1 * {1})) / (c0 * {0} + c1 * {1})"
    for level in range(depth):
        tables[f"tried_{level}"] = f"""
          SELECT tree, node, f FROM (SELECT DISTINCT tree, node FROM at_{level}), range({len(features)}) r(f)
          QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY md5('{seed}|' || tree || '|' || node || '|' || f)) <= {size}"""
        tables[f"cuts_{level}"] = f"""
          SELECT *, {purity.format('l0', 'l1')} + {purity.format('(n0 - l0)', '(n1 - l1)')} AS score, {purity.format('n0', 'n1')} AS own
          FROM (SELECT tree, node, f, bin, sum(b0) OVER running AS l0, sum(b1) OVER running AS l1,
                  sum(b0) OVER whole AS n0, sum(b1) OVER whole AS n1
                FROM (SELECT a.tree, a.node, b.f, b.bin, sum(CASE WHEN a.Churned = 0 THEN w ELSE 0 END) AS b0,
                        sum(CASE WHEN a.Churned = 1 THEN w ELSE 0 END) AS b1
                      FROM at_{level} a JOIN tried_{level} t ON t.tree = a.tree AND t.node = a.node
                        JOIN binned b ON b.CustomerID = a.CustomerID AND b.f = t.f GROUP BY ALL)
                WINDOW whole AS (PARTITION BY tree, node, f),
                       running AS (PARTITION BY tree, node, f ORDER BY bin ROWS UNBOUNDED PRECEDING)), classes
          WHERE l0 + l1 < n0 + n1
          QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY score DESC, f, bin) = 1"""
        # Rows go on to children that hold both classes.
        tables[f"at_{level + 1}"] = f"""
          SELECT * EXCLUDE (c) FROM (
            SELECT a.CustomerID, a.Churned, a.tree, 2 * a.node + 1 + CAST(b.bin > c.bin AS INT) AS node, a.w,
              CASE WHEN b.bin > c.bin THEN (n0 - l0) * (n1 - l1) ELSE l0 * l1 END AS c
            FROM at_{level} a JOIN cuts_{level} c ON c.tree = a.tree AND c.node = a.node
              JOIN binned b ON b.CustomerID = a.CustomerID AND b.f = c.f) WHERE c > 0"""
    tables["cuts"] = " UNION ALL ".join(f"SELECT * FROM cuts_{level}" for level in range(depth))
    tables["leaves"] = """
      SELECT tree, node, c1 * n1 / (c0 * n0 + c1 * n1) AS share FROM (
        SELECT tree, 0 AS node, sum(CASE WHEN Churned = 0 THEN w ELSE 0 END) AS n0, sum(CASE WHEN Churned = 1 THEN w ELSE 0 END) AS n1
        FROM at_0 GROUP BY tree
        UNION ALL SELECT tree, 2 * node + 1, l0, l1 FROM cuts
        UNION ALL SELECT tree, 2 * node + 2, n0 - l0, n1 - l1 FROM cuts), classes"""
    tables["to_0"] = f"SELECT CustomerID, CAST(t.tree AS INT) AS tree, 0 AS node FROM people, range({trees}) t(tree)"
    for level in range(depth):
        tables[f"to_{level + 1}"] = f"""
          SELECT t.CustomerID, t.tree, coalesce(2 * t.node + 1 + CAST(b.bin > c.bin AS INT), t.node) AS node
          FROM to_{level} t LEFT JOIN cuts_{level} c ON c.tree = t.tree AND c.node = t.node
            LEFT JOIN binned b ON b.CustomerID = t.CustomerID AND b.f = c.f"""
    tables["scores"] = f"""
      SELECT p.*, s.ChurnProbability, CAST(s.ChurnProbability > 0.5 AS INT) AS prediction
      FROM people p JOIN (SELECT CustomerID, round(sum(share) / {trees}, 9) AS ChurnProbability
                          FROM to_{depth} JOIN leaves USING (tree, node) GROUP BY CustomerID) s USING (CustomerID)"""
    names = ", ".join(f"({i}, '{c}')" for i, c in enumerate(features))
    tables["importances"] = f"""
      SELECT Feature, coalesce(sum(share), 0) / {trees} AS Importance FROM (VALUES {names}) names(f, Feature)
      LEFT JOIN (SELECT f, sum(score - own) / nullif(sum(sum(score - own)) OVER (PARTITION BY tree), 0) AS share
                 FROM cuts GROUP BY tree, f) USING (f) GROUP BY Feature"""
    return tables


FEATURES = churn.FEATURES
LEAK_FREE = [f for f in churn.FEATURES if f != "Recency"]

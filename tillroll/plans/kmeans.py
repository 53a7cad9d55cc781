"""SQL that runs the rounds of k-means from the same seeds."""

from tillroll.models import clusters
from tillroll.plans.sql import compared

_AXES = range(len(clusters.FEATURES))
_UNIT = clusters._UNIT


def tables(ks: list[int], restarts: int = clusters._RESTARTS, rounds: int = clusters._ROUNDS) -> dict[str, str]:
    """Subqueries from `features` to `best` (start, k, inertia), `found` (CustomerID, k, label) and `points`."""
    scaled = ", ".join(
        f"CAST(round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) * {_UNIT}) AS BIGINT) AS x{i}"
        for i, c in enumerate(clusters.FEATURES)
    )
    seeds = []
    for number, start in enumerate(clusters._STARTS[:restarts]):
        first = clusters.FEATURES.index(start)
        order = ", ".join([f"x{first}", *[f"x{i}" for i in _AXES if i != first], "CustomerID"])
        seeds += [
            f"""SELECT {number} AS start, {k} AS k, CAST(label AS INT) AS label, {', '.join(f'CAST(x{i} AS DOUBLE) AS c{i}' for i in _AXES)}
                FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS place, count(*) OVER () AS total FROM points),
                  range({k}) r(label) WHERE place = (2 * label + 1) * total // {2 * k}"""
            for k in ks
        ]
    away = " + ".join(f"(p.x{i} - c.c{i}) * (p.x{i} - c.c{i})" for i in _AXES)
    nearest = f"""SELECT {{0}}, CustomerID, {', '.join(f'p.x{i}' for i in _AXES)},
                    arg_min(label, struct_pack(d := {away}, label := label)) AS label
                  FROM points p, {{1}} c GROUP BY ALL"""
    centres = ", ".join(f"coalesce(n.c{i}, o.c{i})" for i in _AXES)
    return {
        "points": f"SELECT *, {scaled} FROM features",
        "seeds": " UNION ALL ".join(seeds),
        # Every round keeps the centres of clusters without rows.
        "rounds": f"""
          SELECT 0 AS round, * FROM seeds
          UNION ALL
          SELECT o.round + 1, o.start, o.k, o.label, {centres}
          FROM rounds o LEFT JOIN (
            SELECT start, k, label, {', '.join(f'CAST(sum(x{i}) AS DOUBLE) / count(*) AS c{i}' for i in _AXES)}
            FROM ({nearest.format('start, k', 'rounds')}) GROUP BY start, k, label) n
            ON n.start = o.start AND n.k = o.k AND n.label = o.label
          WHERE o.round < {rounds}""",
        "ends": f"SELECT * FROM rounds WHERE round = {rounds}",
        "member": nearest.format("start, k", "ends"),
        "sums": f"SELECT start, k, label, count(*) AS n, {', '.join(f'sum(x{i}) AS s{i}' for i in _AXES)} FROM member GROUP BY start, k, label",
        "best": f"""
          SELECT start, k, inertia FROM (
            SELECT start, k, round((CAST((SELECT sum({' + '.join(f'x{i}::HUGEINT * x{i}' for i in _AXES)}) FROM points) AS DOUBLE)
                     - sum(({' + '.join(f'CAST(s{i} AS DOUBLE) * CAST(s{i} AS DOUBLE)' for i in _AXES)}) / n)) / {_UNIT}e0 / {_UNIT}e0, 6) AS inertia
            FROM sums GROUP BY start, k)
          QUALIFY row_number() OVER (PARTITION BY k ORDER BY inertia, start) = 1""",
        "found": "SELECT m.* FROM member m JOIN best USING (start, k)",
    }


def clustered(k: int = 5) -> dict[str, str]:
    """The same and `tiers`: the customers with `Cluster`, numbered by falling mean value."""
    return tables([k]) | {
        "named": """SELECT label, CAST(row_number() OVER (ORDER BY avg(MonetaryValue) DESC, label) - 1 AS INT) AS Cluster
                    FROM found JOIN features USING (CustomerID) GROUP BY label""",
        "tiers": "SELECT f.*, Cluster FROM features f JOIN found USING (CustomerID) JOIN named USING (label)",
    }


def elbow(max_k: int = 10) -> tuple[str, dict[str, str]]:
    """Inertia, and the silhouette as it is defined: mean squared distances between all pairs."""
    square = " + ".join(f"((a.x{i} - b.x{i}) / {_UNIT}.0) ** 2" for i in _AXES)
    select = f"""
      SELECT CAST(k AS INT) AS k, {compared('any_value(inertia)')} AS inertia, {compared('avg(width)', 4)} AS silhouette FROM (
        SELECT k, CustomerID, min(mean) FILTER (own != other) AS outside, any_value(mean) FILTER (own = other) AS inside,
          coalesce((outside - inside) / greatest(outside, inside), 0) AS width
        FROM distances GROUP BY k, CustomerID) JOIN best USING (k) GROUP BY k"""
    return select, tables(list(range(2, max_k + 1))) | {
        "pairs": f"SELECT a.CustomerID AS a, b.CustomerID AS b, {square} AS d FROM points a, points b",
        "distances": """SELECT f.k, a AS CustomerID, f.label AS own, g.label AS other,
                          sum(d) / nullif(count(*) - CAST(f.label = g.label AS INT), 0) AS mean
                        FROM pairs JOIN found f ON f.CustomerID = a JOIN found g ON g.CustomerID = b AND g.k = f.k
                        GROUP BY f.k, a, f.label, g.label""",
    }

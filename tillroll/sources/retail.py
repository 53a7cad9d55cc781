"""Raw transactions as a view over the star schema of the test data.

The view plants the dirt that the cleaning operators look for: guests, returns, bad
prices, missing and padded descriptions, and repeated rows.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def raw_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """One row per sold line, in the layout of `schema.RAW`.

    The order side is joined before the lines, so the widest table moves once per key,
    and repeated rows come from a row generator instead of a second join.  Lines and orders
    both grow with the data, so they are always merged and never broadcast.
    """

    def table(name):
        return spark.read.parquet(f"{folder}/{name}.parquet")

    buyers = table("customer").join(table("nation"), F.expr("c_nationkey = n_nationkey"))
    orders = (
        table("orders")
        .join(buyers, F.expr("o_custkey = c_custkey"))
        .selectExpr(
            "o_orderkey",
            "timestampadd(MINUTE, CAST(360 + (o_orderkey * 37) % 840 AS INT), o_orderdate) AS InvoiceDate",
            "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END AS CustomerID",
            "n_name AS Country",
        )
    )
    returned = "l_returnflag = 'R' AND l_linestatus = 'F'"
    return (
        table("lineitem")
        .join(orders.hint("merge"), F.expr("l_orderkey = o_orderkey"))
        .join(table("part").select("p_partkey", "p_name"), F.expr("l_partkey = p_partkey"))
        .selectExpr(
            f"concat(CASE WHEN {returned} THEN 'C' ELSE '' END, CAST(o_orderkey AS STRING)) AS InvoiceNo",
            "CAST(l_partkey AS STRING) AS StockCode",
            """CASE WHEN l_orderkey % 97 = 0 THEN NULL
                    WHEN l_linenumber = 1 THEN concat('  ', replace(p_name, ' ', '   '), ' ')
                    ELSE p_name END AS Description""",
            f"CAST(l_quantity AS INT) * (CASE WHEN {returned} THEN -1 ELSE 1 END) AS Quantity",
            "InvoiceDate",
            """CASE WHEN l_partkey % 211 = 0 THEN 0.0D
                    WHEN l_partkey % 223 = 0 THEN 12000.0D
                    ELSE l_extendedprice / (l_quantity * 100) END AS UnitPrice""",
            "CustomerID",
            "Country",
            "explode(sequence(1, CASE WHEN l_orderkey % 101 = 0 THEN 2 ELSE 1 END)) AS copy",
        )
        .drop("copy")
    )

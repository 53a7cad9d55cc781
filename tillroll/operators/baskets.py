"""Products bought together."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.numbers import half_up, safe_ratio
from tillroll.functions.text import shortened
from tillroll.operators import rollups
from tillroll.schema import POSTAGE
from tillroll.staging import stage


def basket_lines(tx: DataFrame, exclude: str = POSTAGE) -> DataFrame:
    """Lines and money per invoice and product: a product counts once per invoice.

    Money is a decimal, so that sums do not depend on the order of the rows.
    """
    return (
        tx.filter(F.col("Description").isNotNull() & (F.col("Description") != exclude))
        .groupBy("InvoiceNo", "Description")
        .agg(
            F.count("*").cast("int").alias("lines"),
            F.sum(F.col("TotalPrice").cast("decimal(24,8)")).cast("decimal(24,8)").alias("money"),
        )
    )


def _pairs(lines: DataFrame, block: int) -> DataFrame:
    """Pairs of different products per invoice, smaller name first.

    A basket in the order of its names is cut into salts of `block` products.  One side has its own salt, the other
    is repeated for the salts with smaller names, so a task holds `block` rows of a salt against the basket.
    A basket of up to `block` products has one salt and nothing is repeated.
    """
    place = F.row_number().over(Window.partitionBy("InvoiceNo").orderBy("Description"))
    placed = lines.withColumn("place", place - 1)

    def salt(place):
        return F.floor(place / block).cast("int")

    a = placed.withColumn("salt", salt(F.col("place"))).alias("a")
    smaller = F.sequence(F.lit(0), salt(F.col("place") - 1))
    b = placed.filter("place > 0").withColumn("salt", F.explode(smaller)).alias("b")
    together = (
        (F.col("a.InvoiceNo") == F.col("b.InvoiceNo"))
        & (F.col("a.salt") == F.col("b.salt"))
        & (F.col("a.Description") < F.col("b.Description"))
    )
    return a.join(b, together).select(
        F.col("a.Description").alias("Product_A"),
        F.col("b.Description").alias("Product_B"),
        _joint_money().alias("money"),
    )


def _joint_money():
    """Money of all row pairs of two products in one invoice, from their totals."""
    return F.col("a.money") * F.col("b.lines") + F.col("b.money") * F.col("a.lines")


def _count_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("Product_A", "Product_B").agg(F.count("*").alias("times"), F.sum("money").alias("money"))


def product_affinity(tx: DataFrame, min_together: int = 50, n: int = 15, block: int = 512) -> DataFrame:
    """Product pairs sharing at least `min_together` invoices, with the money of their lines.

    A basket of k products holds k * (k - 1) / 2 pairs.  A product in fewer than `min_together`
    invoices is in no pair that qualifies and goes first, without loss; the pairs of a large basket
    are made by several tasks and combined in each before they are shuffled.
    """
    lines = stage(basket_lines(tx), "baskets")
    common = (
        lines.groupBy("Description").agg(F.count("*").alias("invoices")).filter(F.col("invoices") >= min_together)
    )
    counted = _count_pairs(_pairs(lines.join(common, "Description", "left_semi"), block))
    found = counted.filter(F.col("times") >= min_together).select(
        "Product_A",
        "Product_B",
        F.col("times").alias("TimesBoughtTogether"),
        half_up(F.col("money").cast("double"), 2).alias("CombinedRevenue"),
    )
    return rollups.top(found, n, "TimesBoughtTogether", "Product_A", "Product_B")


def _bought(sales: DataFrame) -> DataFrame:
    """Summed quantity per invoice and product."""
    return (
        sales.filter(F.col("Description").isNotNull())
        .groupBy("InvoiceNo", "Description")
        .agg(F.sum("Quantity").alias("units"))
    )


def best_sellers(sales: DataFrame, n: int = 50) -> DataFrame:
    """Products by quantity."""
    units = sales.groupBy("Description").agg(F.sum("Quantity").alias("units"))
    return rollups.top(units.filter("Description IS NOT NULL"), n, "units", "Description")


def best_seller_pairs(sales: DataFrame, top_products: int = 50) -> DataFrame:
    """Invoices shared by each pair of best sellers.

    Only lines of best sellers are shuffled by invoice, and a basket keeps at most
    `top_products` items, which bounds its pairs.  The parameter bounds the broadcast list too.
    Three columns of sales are staged, as the list and the lines both need them.
    """
    return _best_seller_pairs(_needed(sales), top_products)


def _needed(sales: DataFrame) -> DataFrame:
    return stage(sales.select("InvoiceNo", "Description", "Quantity"), "lines")


def _best_seller_pairs(sales: DataFrame, top_products: int) -> DataFrame:
    sellers = best_sellers(sales, top_products).select("Description")
    baskets = _bought(sales.join(F.broadcast(sellers), "Description", "left_semi")).filter(F.col("units") > 0)
    a, b = baskets.alias("a"), baskets.alias("b")
    together = (F.col("a.InvoiceNo") == F.col("b.InvoiceNo")) & (F.col("a.Description") < F.col("b.Description"))
    return (
        a.join(b, together)
        .groupBy(F.col("a.Description").alias("Product_A"), F.col("b.Description").alias("Product_B"))
        .agg(F.count("*").alias("Count"))
    )


def top_pairs(pairs: DataFrame, n: int = 20, label_length: int = 30) -> DataFrame:
    """Most frequent pairs with shortened display names."""
    return rollups.top(pairs, n, "Count", "Product_A", "Product_B").withColumns(
        {
            "Product1": shortened("Product_A", label_length),
            "Product2": shortened("Product_B", label_length),
        }
    )


def affinity_summary(sales: DataFrame, top_products: int = 50) -> DataFrame:
    """Number of pairs, the top pair, the share of non-empty baskets and the mean basket size."""
    sales = _needed(sales)
    pairs = _best_seller_pairs(sales, top_products).withColumn(
        "pair", F.concat_ws(" + ", "Product_A", "Product_B")
    )
    first = F.min_by("pair", F.struct(-F.col("Count"), F.col("Product_A"), F.col("Product_B")))
    of_pairs = pairs.agg(F.count("*").alias("pairs"), F.max("Count").alias("times"), first.alias("top"))
    sizes = _bought(sales).groupBy("InvoiceNo").agg(F.count_if(F.col("units") > 0).alias("items"))
    of_baskets = sizes.agg(
        safe_ratio(F.count_if(F.col("items") > 0) * 1.0, F.count("*")).alias("share"),
        F.avg("items").alias("size"),
    )
    return rollups.as_metrics(
        of_pairs,
        {"total_unique_pairs": "pairs", "top_pair": "times"},
        {"top_pair": "top"},
    ).unionByName(
        rollups.as_metrics(of_baskets, {"nonempty_basket_share": "share", "mean_basket_size": "size"})
    )

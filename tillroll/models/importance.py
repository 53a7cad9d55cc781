"""How much a model's hits fall when one of its inputs is dealt anew among the rows."""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.ranking import number_rows

BLOCK = 512
INPUT = "Permuted"


def permuted(data: DataFrame, key: str, features: Sequence[str], seed: int = 42, block: int = BLOCK) -> DataFrame:
    """Every row once as it is, with a null in `Permuted`, and once per feature, named there, with that feature's
    value taken from another row.

    Rows are ordered by a hash of `key`, which should be unique, and cut into blocks of `block` to `2 * block`
    rows (all, if fewer).  Inside a block the values of each feature are dealt out in the order of another hash,
    so its distribution stays exactly what it was.  A block is one array, so memory does not depend on the
    number of rows, and one grouping serves all features.  Nulls are dealt like other values.
    """
    order = F.md5(F.concat_ws("|", F.col(key), F.lit(seed)))
    placed = number_rows(data.select(F.struct(*data.columns).alias("_one"), order.alias("_draw"), F.col(key).alias("_key")), ["_draw", "_key"], "_place")
    n = max(1, placed.count())
    numbered = placed.withColumn("_block", F.floor((F.col("_place") - 1) * max(1, n // block) / n))

    def dealt(feature):
        draw = F.md5(F.concat_ws("|", F.col("_key"), F.lit(feature), F.lit(seed)))
        listed = F.collect_list(F.struct(draw.alias("d"), F.col("_key").alias("k"), F.col("_one")[feature].alias("v")))
        return F.transform(F.sort_array(listed), lambda s: s["v"])

    values = [dealt(feature).alias(f"_dealt_{i}") for i, feature in enumerate(features)]
    rows = F.sort_array(F.collect_list(F.struct("_place", "_one"))).alias("_rows")
    blocks = numbered.groupBy("_block").agg(rows, *values)
    slots = blocks.select(F.inline(F.arrays_zip("_rows", *[f"_dealt_{i}" for i in range(len(features))])))

    def version(named, i=None):
        kept = [
            F.col(f"_dealt_{i}" if c == named else f"_rows._one.{c}").alias(c) for c in data.columns
        ]
        return F.struct(F.lit(named).cast("string").alias(INPUT), *kept)

    return slots.select(F.inline(F.array(version(None), *[version(f, i) for i, f in enumerate(features)])))


def permutation_importance(
    data: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    key: str,
    label: str,
    features: Sequence[str],
    seed: int = 42,
    block: int = BLOCK,
) -> DataFrame:
    """Per feature the share of right predictions once it is dealt anew, and the fall from the share before.

    `predict` adds `prediction` to rows that have the columns of `data` and `Permuted`; all versions of all rows
    go through it in one pass.  Without rows there are no features.
    """
    right = (F.col(label) == F.col("prediction")).cast("double")
    shares = predict(permuted(data, key, features, seed, block)).groupBy(INPUT).agg(F.avg(right).alias("share"))
    # One row per feature and one for the rows as they are.
    found = shares.agg(
        F.max(F.when(F.col(INPUT).isNull(), F.col("share"))).alias("_before"),
        F.collect_list(F.when(F.col(INPUT).isNotNull(), F.struct(F.col(INPUT).alias("Feature"), F.col("share").alias("Accuracy")))).alias("_each"),
    )
    each = found.select("_before", F.inline("_each"))
    return each.select("Feature", "Accuracy", (F.col("_before") - F.col("Accuracy")).alias("Importance"))

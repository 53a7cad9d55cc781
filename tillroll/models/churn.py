"""Random forest on customer features that predicts inactivity."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numbers import safe_ratio
from tillroll.models import forest, importance
from tillroll.operators.ranking import bucket_by_last_rows, rows_at
from tillroll.staging import stage

FEATURES = [
    "PurchaseFrequency",
    "TotalSpent",
    "AvgOrderValue",
    "TotalQuantity",
    "Recency",
    "CustomerLifetime",
]
LABEL = "Churned"
CLASS_NAMES = {0: "Active", 1: "Churned"}


class ChurnModel(NamedTuple):
    forest: forest.Forest
    features: list[str]
    scored: DataFrame  # all customers with ChurnProbability, prediction and is_test


def stratified_split(
    customers: DataFrame, label: str = LABEL, key: str = "CustomerID", test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add `is_test`: the given share of each class, drawn in the order of a hash.

    The last drawn row of a class is found by the distributed ranking, so no task sees a
    whole class.
    """
    drawn = stage(customers.withColumn("_draw", F.md5(F.concat_ws("|", key, F.lit(seed)))), "draw")
    order = ["_draw", key]
    is_test = F.lit(False)
    for value in CLASS_NAMES:
        members = drawn.filter(F.col(label) == value).select(*order)
        _, last = rows_at(members, order, lambda n: [round(n * test_share) - 1] if round(n * test_share) else [])
        if last:
            within = bucket_by_last_rows(order, last.values()) == 1
            is_test = is_test | ((F.col(label) == value) & within)
    return drawn.withColumn("is_test", is_test).drop("_draw")


def fit_churn(
    customers: DataFrame,
    leak_free: bool = False,
    trees: int = 100,
    depth: int = 10,
    test_share: float = 0.2,
    seed: int = 42,
    key: str = "CustomerID",
) -> ChurnModel:
    """Fit on the training customers and score all.

    Classes weigh the same in total.  The label is a threshold on Recency; `leak_free` leaves
    Recency out of the inputs.
    """
    features = [f for f in FEATURES if not (leak_free and f == "Recency")]
    data = stratified_split(customers.fillna(0, FEATURES), key=key, test_share=test_share, seed=seed)
    grown = forest.fit(data.filter(~F.col("is_test")), key, LABEL, features, trees, depth, seed=seed)
    scored = forest.score(data, grown, "ChurnProbability")
    scored = scored.withColumn("prediction", (F.col("ChurnProbability") > 0.5).cast("int"))
    return ChurnModel(grown, features, stage(scored, "churn"))


def classification_report(predictions: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, from one aggregate."""

    def both(value) -> Column:
        return F.count_if((F.col(label) == value) & (F.col(prediction) == value))

    def entry(value, name):
        support = F.count_if(F.col(label) == value)
        predicted = F.count_if(F.col(prediction) == value)
        return F.struct(
            F.lit(name).alias("class"),
            F.coalesce(safe_ratio(both(value) * 1.0, predicted), F.lit(0.0)).alias("precision"),
            F.coalesce(safe_ratio(both(value) * 1.0, support), F.lit(0.0)).alias("recall"),
            F.coalesce(safe_ratio(both(value) * 2.0, support + predicted), F.lit(0.0)).alias("f1"),
            support.alias("support"),
        )

    entries = F.array(*[entry(value, name) for value, name in CLASS_NAMES.items()])
    return predictions.agg(entries.alias("classes")).select(F.inline("classes"))


def evaluate(model: ChurnModel) -> DataFrame:
    return classification_report(model.scored.filter("is_test"))


def feature_importance(model: ChurnModel) -> DataFrame:
    """Mean fall of impurity per input, largest first."""
    return forest.importance(model.forest).orderBy(F.desc("Importance"), "Feature")


def permutation_importance(model: ChurnModel, seed: int = 42) -> DataFrame:
    """Fall of the accuracy on the test customers when an input is dealt anew among them, largest first."""

    def predict(rows):
        scored = forest.score(rows, model.forest, "_probability")
        return scored.withColumn("prediction", (F.col("_probability") > 0.5).cast("int"))

    test = model.scored.filter("is_test").select("CustomerID", LABEL, *model.features)
    falls = importance.permutation_importance(test, predict, "CustomerID", LABEL, model.features, seed)
    return falls.orderBy(F.desc("Importance"), "Feature")


def at_risk(scored: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Active customers above the probability threshold, most likely first."""
    return scored.filter((F.col(LABEL) == 0) & (F.col("ChurnProbability") > threshold)).orderBy(
        F.desc("ChurnProbability"), "CustomerID"
    )


def risk_summary(scored: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Number of customers at risk and the revenue they stand for."""
    risky = (F.col(LABEL) == 0) & (F.col("ChurnProbability") > threshold)
    return scored.agg(
        F.count_if(risky).alias("at_risk_customers"),
        F.coalesce(F.sum(F.when(risky, F.col("TotalSpent"))), F.lit(0.0)).alias("revenue_at_risk"),
    )

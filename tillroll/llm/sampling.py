"""Bounded samples of labelled rows on which classifiers are fitted."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def agreed_labels(labels: DataFrame, label: str, learnable: Column) -> DataFrame:
    """doc_id and label (0 or 1); null ids, null labels and ids whose labels contradict each other are left out."""
    return (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & learnable)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .filter("label = other")
        .select("doc_id", "label")
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, per_class: int) -> DataFrame:
    """doc_id, text and label of at most `per_class` labelled rows of each class.

    Of rows repeating an id the one whose text has the smallest hash is taken.  The rows with the smallest hashes of their ids are taken, the same ones in every run.  Only ids are
    ordered (a bounded heap per task); the chosen ids, at most twice `per_class`, are broadcast to the texts.
    """
    known = agreed_labels(labels, label, learnable).withColumn("place", F.xxhash64("doc_id"))
    parts = [known.filter(F.col("label") == k).orderBy("place", "doc_id").limit(per_class) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).select("doc_id", "label")
    return one_per_id(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "label")


def one_per_id(rows: DataFrame, label: str) -> DataFrame:
    """doc_id, text and label with one text for each; repeated ids are combined inside the tasks first."""
    least = F.min(F.struct(F.xxhash64("text").alias("place"), "text"))
    return rows.groupBy("doc_id", label).agg(least.alias("least")).select("doc_id", "least.text", label)

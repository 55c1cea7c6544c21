"""Evaluation of a classifier from its predictions and history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_divide


def confusion(predictions: DataFrame, *keys: str) -> DataFrame:
    """Count of each (target, prediction), within ``keys`` if there are any. Nulls are left out."""
    return predictions.where("target IS NOT NULL AND prediction IS NOT NULL").groupBy(*keys, "target", "prediction").agg(F.count("*").alias("n"))


def class_marginals(matrix: DataFrame, labels: DataFrame, *keys: str) -> DataFrame:
    """Support, predictions and correct ones of every label, zeros included (within every value of ``keys``).

    labels: ``label_index``, one row per label of the project.
    """
    ends = F.array(
        F.struct(F.col("target").alias("label_index"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("target") == F.col("prediction"), F.col("n")).otherwise(F.lit(0)).alias("correct")),
        F.struct(F.col("prediction").alias("label_index"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("correct")),
    )
    sums = ("support", "predicted", "correct")
    said = matrix.select(*keys, F.explode(ends).alias("e")).select(*keys, "e.*").groupBy(*keys, "label_index").agg(*(F.sum(c).alias(c) for c in sums))
    dense = labels.select("label_index")
    if keys:
        indices = [r["label_index"] for r in dense.distinct().collect()]  # a dimension
        every = F.explode(F.array(*map(F.lit, indices)) if indices else F.array().cast("array<int>"))
        dense = matrix.select(*keys).distinct().select(*keys, every.alias("label_index"))
    return dense.join(said, [*keys, "label_index"], "left").fillna(0, list(sums))


def per_class_metrics(marginals: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each label; 0 where a denominator is 0."""
    p, r = safe_divide("correct", "predicted"), safe_divide("correct", "support")
    rated = marginals.withColumns({"precision": p, "recall": r})
    return rated.withColumn("f1", safe_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summary_metrics(per_class: DataFrame, *keys: str) -> DataFrame:
    """Count, accuracy and macro F1, over all labels and over those with support; zeros for no predictions."""
    total = F.sum("support")
    return per_class.groupBy(*keys).agg(
        F.coalesce(total, F.lit(0)).alias("n"),
        F.coalesce(F.try_divide(F.sum("correct").cast("double"), total), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"),
        F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)).alias("macro_f1_supported"),
        F.count_if(F.col("support") > 0).alias("supported_classes"),
    )


def weighted_loss(batches: DataFrame, *keys: str) -> DataFrame:
    """Mean of ``loss`` weighted by ``n``; null losses and empty batches do not count."""
    used = batches.where("loss IS NOT NULL AND n > 0")
    return used.groupBy(*keys).agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"), F.sum("n").alias("n"))


def best_epoch(history: DataFrame) -> DataFrame:
    """The first epoch with the greatest validation macro F1."""
    return history.agg(F.max_by("epoch", F.struct("macro_f1", -F.col("epoch"))).alias("epoch"), F.max("macro_f1").alias("macro_f1"))


def top_errors(matrix: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent confusions; ties by target, then by prediction."""
    wrong = matrix.where("target <> prediction AND n > 0")
    return wrong.orderBy(F.desc("n"), "target", "prediction").limit(limit)


def confusion_wide(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per true label and one column per predicted one, zeros included, in label order."""
    names = [(r["label_index"], r["class_label"]) for r in labels.orderBy("label_index").collect()]  # a dimension
    wide = matrix.groupBy("target").pivot("prediction", [i for i, _ in names]).agg(F.sum("n"))
    rows = labels.select("label_index", F.col("class_label").alias("true / predicted")).join(wide, F.col("label_index") == F.col("target"), "left")
    return rows.orderBy("label_index").select("true / predicted", *(F.coalesce(F.col(f"`{i}`"), F.lit(0)).alias(name) for i, name in names))

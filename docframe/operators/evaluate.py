"""Accuracy and class reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """(accuracy): equal rows over all rows; a null is wrong; null for an empty table."""
    return rows.agg(F.avg(F.coalesce(F.col(label) == F.col(prediction), F.lit(False)).cast("int")).alias("accuracy"))


def accuracy_strip(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """(accuracy) over rows with a prediction, outer blanks aside."""
    return rows.where(F.col(prediction).isNotNull()).agg(F.avg((F.trim(label) == F.trim(prediction)).cast("int")).alias("accuracy"))


def class_report(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, precision, recall, f1, support) of every class that occurs on either side; 0 where undefined."""
    pairs = rows.groupBy(F.col(label).alias("t"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("long")
    as_true = F.struct(F.col("t").alias("label"), hit.alias("tp"), none.alias("said"), F.col("n").alias("support"))
    as_said = F.struct(F.col("p").alias("label"), none.alias("tp"), F.col("n").alias("said"), none.alias("support"))
    rows = pairs.select(F.explode(F.array(as_true, as_said)).alias("x")).select("x.*").where("label is not null")
    both = rows.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "said", "support")))
    precision, recall = F.coalesce(F.try_divide("tp", "said"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return both.select("label", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"), "support")


def report_averages(report: DataFrame) -> DataFrame:
    """(kind, precision, recall, f1): macro and weighted averages of a class report."""
    macro = report.agg(F.lit("macro").alias("kind"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")))
    weighted = report.agg(F.lit("weighted").alias("kind"), *((F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")))
    return macro.unionByName(weighted)

"""Evaluation reports and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

THRESHOLDS = (2, 3, 4, 5)


def thresholds(predictions: DataFrame, course: str = "course", count: str = "aoi_count", ok: str = "ok", ks=THRESHOLDS) -> DataFrame:
    """Per course, how many questions have k options or more, and how many of those are right; one pass."""
    asked = [F.count_if(F.col(count) >= k).alias(f"questions_{k}") for k in ks]
    right = [F.count_if((F.col(count) >= k) & F.col(ok)).alias(f"correct_{k}") for k in ks]
    return predictions.filter(F.col(count) > 1).groupBy(course).agg(*asked, *right)


def summary(report: DataFrame) -> DataFrame:
    """Accuracy over all questions with a choice; null if there are none."""
    return report.agg(F.try_divide(F.sum("correct_2"), F.sum("questions_2")).alias("acc"))


def accuracy(a: Column, b: Column) -> Column:
    return F.avg(T.same_label(a, b).cast("int"))


def audit(pages: DataFrame) -> DataFrame:
    """Totals over pages with ``found`` (k, body), ``expected`` and the key columns: pages, boxes, errors, error ratio."""
    wrong = ~F.coalesce(T.complete(F.col("found"), F.col("expected")), F.lit(False))
    made = pages.agg(F.count("*").alias("pages"), F.sum("expected").alias("boxes"), F.count_if(wrong).alias("errors"))
    return made.withColumn("ratio", F.try_divide(F.col("errors"), F.col("pages")))


def audit_errors(pages: DataFrame, *keys: str) -> DataFrame:
    """Pages to redo, with the first empty description's number, null if it is the count that is wrong."""
    wrong = ~F.coalesce(T.complete(F.col("found"), F.col("expected")), F.lit(False))
    empty = F.try_element_at(F.filter("found", lambda d: d["body"] == ""), F.lit(1))["k"]
    return pages.filter(wrong).select(*keys, F.when(F.size("found") == F.col("expected"), empty).alias("aoi_key"))

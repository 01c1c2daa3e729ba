"""Which page a context belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_asof(contexts: DataFrame, ends: DataFrame, keys: list[str], frame: str = "screenshot_id") -> DataFrame:
    """The smallest page whose end is not before the frame, without a range join: ends and frames are read in one order and
    read from the back, the last end seen is a frame's page. Frames after the last end are dropped."""
    rows = contexts.withColumn("__page", F.lit(None).cast("int")).withColumn("__at", F.col(frame)).withColumn("__end", F.lit(0))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in keys else F.col(f.name) for f in contexts.schema]
    marks = ends.select(*blank, F.col("page").alias("__page"), F.col("page_end").alias("__at"), F.lit(1).alias("__end"))
    back = Window.partitionBy(*keys).orderBy(F.desc("__at"), F.desc("__end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = rows.unionByName(marks).withColumn("page", F.last("__page", ignorenulls=True).over(back))
    return every.filter("__end = 0 and page is not null").drop("__page", "__at", "__end")


def page_fold(contexts: DataFrame, ends: DataFrame, keys: list[str], frame: str = "screenshot_id") -> DataFrame:
    """As the step-by-step reader does it: one page further at most for each context, so it lags where contexts skip pages.

    Page p is left at context t(p), the first past its end but not before t(p - 1) + 1. With f(p) contexts up to the end of p that
    is p + max over q <= p of f(q) - q, a running maximum; a context's page is 1 and the pages left by then.
    """
    before = Window.unboundedPreceding, Window.currentRow
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(frame)) - 1
    seen = contexts.select(*keys, F.col(frame).alias("__frame"), k.alias("__k"))
    marks = seen.select(*keys, F.col("__frame").alias("__at"), F.lit(0).alias("__end"), F.lit(None).cast("int").alias("page"))
    marks = marks.unionByName(ends.select(*keys, F.col("page_end").alias("__at"), F.lit(1).alias("__end"), "page"))
    upto = F.sum(1 - F.col("__end")).over(Window.partitionBy(*keys).orderBy("__at", "__end").rowsBetween(*before))
    passed = marks.withColumn("__f", upto).filter("__end = 1")
    left = passed.select(*keys, (F.col("page") + F.max(F.col("__f") - F.col("page")).over(Window.partitionBy(*keys).orderBy("page").rowsBetween(*before))).alias("__t"))
    line = seen.select(*keys, F.col("__k").cast("bigint").alias("__t"), "__frame").unionByName(left.withColumn("__frame", F.lit(None).cast(seen.schema["__frame"].dataType)))
    order = Window.partitionBy(*keys).orderBy("__t", F.col("__frame").asc_nulls_first()).rowsBetween(*before)
    page = 1 + F.sum(F.col("__frame").isNull().cast("int")).over(order)
    return line.withColumn("page", page.cast("int")).filter("__frame is not null").select(*keys, F.col("__frame").alias(frame), "page")


def link_pages(ends: DataFrame, screenshots: DataFrame, keys: list[str]) -> DataFrame:
    """Page to the path of its last screenshot; null where the image is absent."""
    return ends.join(screenshots.withColumnRenamed("screenshot_id", "page_end"), [*keys, "page_end"], "left")


def with_crops(pages: DataFrame, crops: DataFrame, keys: list[str]) -> DataFrame:
    """Each page image with its region crops, in region order; a page without crops gets an empty array."""
    listed = crops.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("aoi_idx", "path"))).alias("c"))
    made = pages.join(listed.select(*keys, F.transform("c", lambda x: x["path"]).alias("crops")), keys, "left")
    return made.withColumn("crops", F.coalesce("crops", F.array().cast("array<string>")))

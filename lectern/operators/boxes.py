"""Boxes on pages: suppression, and the nearest box to a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import geometry as G

SCORE, CONTAINED, PAD = 0.5, 0.7, 0.2


def grid(boxes: DataFrame, page: list[str]) -> DataFrame:
    """Cell width and height of each page: the mean box, but no more cells than boxes."""
    def side(low: str, high: str) -> Column:
        size = F.greatest(F.avg(F.col(high) - F.col(low)), (F.max(high) - F.min(low)) / F.sqrt(F.count("*")))
        return F.when(size > 0, size).otherwise(1.0)

    return boxes.groupBy(*page).agg(side("x1", "x2").alias("__w"), side("y1", "y2").alias("__h"))


def cells(boxes: DataFrame, b: G.Box) -> DataFrame:
    """A row for each cell that the box touches, ``__x`` and ``__y``."""
    line = lambda low, high, size: F.explode(F.sequence(F.floor(low / F.col(size)), F.floor(high / F.col(size))))
    return boxes.withColumn("__x", line(b.x1, b.x2, "__w")).withColumn("__y", line(b.y1, b.y2, "__h"))


def cell_of(points: DataFrame, x: Column, y: Column) -> DataFrame:
    return points.withColumn("__x", F.floor(x / F.col("__w"))).withColumn("__y", F.floor(y / F.col("__h")))


def suppress_contained(boxes: DataFrame, page: list[str], score: float = SCORE, share: float = CONTAINED) -> DataFrame:
    """Boxes above the score that no larger box on their page covers by ``share`` or more; a covered box still covers others.

    Columns: page keys, det_idx, score, x1, y1, x2, y2. A box without area is kept: no share of it is defined. What covers more than
    half of a box covers its centre, so each box is only held against those that touch its centre's cell.
    """
    if share <= 0.5:
        raise ValueError("a share of a half or less may miss the centre")
    good = boxes.filter(F.col("score") > score)
    size = grid(good, page)
    a, b = G.Box.named(), G.Box.named("o_")
    middle = cell_of(good.join(size, page), *G.centre(a))
    names = [c for c in ("x1", "y1", "x2", "y2")]
    other = cells(good.join(size, page), a).select(*page, "__x", "__y", F.col("det_idx").alias("o_idx"), *[F.col(c).alias(f"o_{c}") for c in names])
    covers = (F.col("o_idx") != F.col("det_idx")) & (G.area(a) > 0) & (G.area(a) < G.area(b)) & (G.intersection(a, b) / G.area(a) >= share)
    for k in [*page, "__x", "__y"]:
        covers = covers & (middle[k] == other[k])
    return middle.join(other, covers, "left_anti").select(*good.columns)


def reindex(boxes: DataFrame, page: list[str]) -> DataFrame:
    """aoi_idx: 0, 1, … in the detector's order among the survivors."""
    return boxes.withColumn("aoi_idx", F.row_number().over(Window.partitionBy(*page).orderBy("det_idx")) - 1)


def last_positive(detections: Column) -> Column:
    """The last detection with positive confidence, null if none. Fields: conf, xywh."""
    return F.try_element_at(F.filter(detections, lambda d: d["conf"] > 0), F.lit(-1))


def strongest(detections: Column) -> Column:
    """The detection with the highest confidence, the first of equals; for those who want what the selection's name promises."""
    positive = F.filter(detections, lambda d: d["conf"] > 0)
    best = F.array_max(F.transform(positive, lambda d: d["conf"]))
    return F.try_element_at(F.filter(positive, lambda d: d["conf"] == best), F.lit(1))


def zip_detections(cls: Column, xywh: Column, conf: Column) -> Column:
    """Parallel arrays as one array of structs, as long as the shortest."""
    n = F.least(F.size(cls), F.size(xywh), F.size(conf))
    return F.arrays_zip(F.slice(cls, F.lit(1), n).alias("cls"), F.slice(xywh, F.lit(1), n).alias("xywh"), F.slice(conf, F.lit(1), n).alias("conf"))


def nearest_box(points: DataFrame, boxes: DataFrame, page: list[str], point: list[str], pad: float = PAD, exclude: Column | None = None) -> DataFrame:
    """``ans``: the box (by aoi_idx) whose centre is nearest among those whose padded box holds the point; ties to the lowest
    index, -1 if there is none. Points have px, py and the key columns ``point``. Points meet the boxes of their cell only."""
    held = G.Box.named()
    cx, cy = G.centre(held)
    on = G.holds_point(G.padded(held, pad), F.col("px"), F.col("py"))
    if exclude is not None:
        on = on & exclude
    rank = F.struct(G.distance(F.col("px"), F.col("py"), cx, cy).alias("d"), F.col("aoi_idx").alias("k"))
    size = grid(boxes, page)
    near = cells(boxes.join(size, page), G.padded(held, pad)).drop("__w", "__h")
    hits = cell_of(points.join(size, page), F.col("px"), F.col("py")).join(near, [*page, "__x", "__y"]).filter(on).groupBy(*page, *point).agg(F.min(rank)["k"].alias("ans"))
    return points.join(hits, [*page, *point], "left").withColumn("ans", F.coalesce("ans", F.lit(-1)))


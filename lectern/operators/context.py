"""Context windows: the unbroken run of neighbours within a time band around each cue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BAND_MS = 15_000
BLOCK = 512  # cues of a timeline that are walked together


def context_runs(cues: DataFrame, keys: list[str], band: int = BAND_MS, i: str = "i", mid: str = "mid", block: int = BLOCK) -> DataFrame:
    """keys, i, mid, previous, next: arrays of (i, mid), ascending.

    A run ends at the first cue outside the band, so cues beyond it stay out even if they are inside. A timeline is cut into blocks of
    ordinals. A run is no longer than the number of cues inside the band, wherever they stand; a block gets as many cues of its
    neighbours as the longest run in it may need, so a long timeline is walked by many tasks.
    """
    inside = F.count("*").over(Window.partitionBy(*keys).orderBy(mid).rangeBetween(-band, band)).cast("int")
    at = (F.row_number().over(Window.partitionBy(*keys).orderBy(i)) - 1).alias("at")
    rows = cues.select(*keys, F.col(i).alias("i"), F.col(mid).alias("mid"), inside.alias("n"), at).withColumn("block", F.expr(f"at div {block}"))
    reach = rows.groupBy(*keys, "block").agg(F.max("n").alias("m"))
    first, last = F.greatest(F.lit(0).cast("long"), F.expr(f"(block * {block} - m) div {block}")), F.expr(f"((block + 1) * {block} - 1 + m) div {block}")
    needs = reach.select(*keys, F.col("block").alias("own"), F.explode(F.sequence(first, last)).alias("block"))
    line = needs.join(rows, [*keys, "block"]).groupBy(*keys, "own").agg(F.array_sort(F.collect_list(F.struct("at", "i", "mid", "n", "block"))).alias("line"))

    def around(c, place):
        reach = F.least(place, c["n"])
        before, after = F.slice("line", place - reach + 1, reach), F.slice("line", place + 2, c["n"])
        out = lambda x: F.abs(x["mid"] - c["mid"]) > band
        far = F.aggregate(F.transform(before, lambda x, k: F.when(out(x), k).otherwise(F.lit(-1))), F.lit(-1), lambda a, b: F.greatest(a, b))
        stop = F.aggregate(F.transform(after, lambda x, k: F.when(out(x), k).otherwise(F.size(after))), F.size(after), lambda a, b: F.least(a, b))
        pair = lambda a: F.transform(a, lambda x: F.struct(x["i"].alias("i"), x["mid"].alias("mid")))
        found = F.struct(c["i"].alias(i), c["mid"].alias(mid), pair(F.slice(before, far + 2, F.size(before))).alias("previous"), pair(F.slice(after, F.lit(1), stop)).alias("next"))
        return F.when(c["block"] == F.col("own"), found)

    return line.select(*keys, F.explode(F.transform("line", around)).alias("c")).filter("c is not null").select(*keys, "c.*")

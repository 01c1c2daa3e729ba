"""Work lists: what is missing, what is done, what matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``wanted`` without a partner; also the to-do set of an incremental run."""
    return wanted.join(have.select(*keys), keys, "left_anti")


def existing(rows: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(have.select(*keys), keys, "left_semi")


def matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys)


def counts(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """total and missing, in one pass over the join."""
    marked = wanted.join(have.select(*keys).distinct().withColumn("found", F.lit(True)), keys, "left")
    return marked.agg(F.count("*").alias("total"), F.count_if(F.col("found").isNull()).alias("missing"))


def whole_source(primary: DataFrame, fallback: DataFrame, page: list[str]) -> DataFrame:
    """All rows of a page from ``primary`` if it has the page at all, else from ``fallback``; never mixed within a page."""
    pages = primary.select(*page).distinct()
    return primary.unionByName(fallback.join(pages, page, "left_anti"))


def best_stream(streams: DataFrame, media: list[str]) -> DataFrame:
    """The audio stream with the highest bit rate of each medium."""
    return streams.groupBy(*media).agg(F.max_by(F.struct(*[c for c in streams.columns if c not in media]), "bitrate").alias("s")).select(*media, "s.*")

"""Sinks: CSV, SRT text, JSON documents."""

from __future__ import annotations

import json
import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import timecode as tc


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """A small report as one file; with a header unless it is appended."""
    df.coalesce(1).write.mode("append" if append else "overwrite").csv(path, header=not append)


def srt_block(i: Column, start: Column, end: Column, text: Column) -> Column:
    """A cue's block; ``i`` counts from 0 and is written from 1, times are seconds."""
    return F.concat((i + 1).cast("string"), F.lit("\n"), tc.format_seconds(start), F.lit(" --> "), tc.format_seconds(end), F.lit("\n"), T.strip(text), F.lit("\n\n"))


def render_srt(segments: DataFrame, *keys: str) -> DataFrame:
    """One text a key from its segments (i, start, end, text)."""
    block = srt_block(F.col("i"), F.col("start"), F.col("end"), F.col("text")).alias("block")
    parts = F.array_sort(F.collect_list(F.struct("i", block)))
    return segments.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["block"]), "").alias("value"))


def write_documents(df: DataFrame, path: str, *partitions: str) -> None:
    """One JSON object a row, split by key folders."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).json(path)


def to_document(*columns: str) -> Column:
    """A row as JSON text; characters outside ASCII stay as they are."""
    return F.to_json(F.struct(*columns))


def export_array(df: DataFrame, path: str, indent: int = 2) -> int:
    """A result as one local JSON array file, for tools that want one; partitions come to the driver one after another, and the
    file appears when it is whole."""
    n = 0
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=os.path.dirname(os.path.abspath(path)), delete=False) as f:
        for row in df.toJSON().toLocalIterator():
            text = json.dumps(json.loads(row), ensure_ascii=False, indent=indent)
            f.write(("[\n" if n == 0 else ",\n") + "\n".join(" " * indent + line for line in text.split("\n")))
            n += 1
        f.write("\n]" if n else "[]")
    shutil.move(f.name, path)
    return n


def page_map(ends: DataFrame, *keys: str) -> DataFrame:
    """The JSON map from page to its last frame, one text a key: what ``readers.page_ends`` reads."""
    entry = F.struct(F.col("page"), F.col("page_end"))
    return number_map(ends, entry, "page", lambda e: e["page_end"].cast("string"), *keys)


def compare_map(compare: DataFrame, *keys: str) -> DataFrame:
    """The JSON map from frame to its two measures, one text a key."""
    entry = F.struct(F.col("screenshot_id"), F.to_json(F.struct("pash", "ssim")).alias("j"))
    return number_map(compare, entry, "screenshot_id", lambda e: e["j"], *keys)


def number_map(rows: DataFrame, entry: Column, number: str, value, *keys: str) -> DataFrame:
    items = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat(F.lit('"'), e[number].cast("string"), F.lit('": '), value(e)))
    return rows.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}")).alias("value"))


def aoi_document(boxes: DataFrame, *keys: str) -> DataFrame:
    """The detector's JSON of each page, boxes in order: what ``readers.aoi`` reads. Columns: aoi_idx, x1, y1, x2, y2, score, class, shape."""
    box = F.struct(F.col("aoi_idx"), F.struct(F.array("x1", "y1", "x2", "y2").alias("boxes"), "score", "class").alias("b"))
    made = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("l"), F.first("shape").alias("shape"))
    return made.select(*keys, F.to_json(F.struct(F.transform("l", lambda x: x["b"]).alias("AOI"), "shape")).alias("value"))


def write_texts(df: DataFrame, path: str, *partitions: str) -> None:
    """One text a row, in folders of the keys."""
    df.write.mode("overwrite").partitionBy(*partitions).text(path)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Written as Parquet, binary content of crops as well, and read again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def updated(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the fields of ``new``, which win where they are not null; a row that ``new`` doesn't have stays as it is."""
    fields = [c for c in new.columns if c not in keys]
    other = new.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in fields])
    put = {c: F.coalesce(f"__new_{c}", c) if c in old.columns else F.col(f"__new_{c}") for c in fields}
    return old.join(other, keys, "left").withColumns(put).drop(*[f"__new_{c}" for c in fields])


def routed(df: DataFrame, path: str, valid_courses: tuple[str, ...]) -> None:
    """Train and valid sets as split=… folders; whatever is not valid is train."""
    split = F.when(F.col("course").isin(*valid_courses), "valid").otherwise("train")
    df.withColumn("split", split).write.mode("overwrite").partitionBy("split").json(path)

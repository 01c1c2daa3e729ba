"""Readers of the file-per-entity layout: every scan is a Spark source, keys come from paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions import text as T
from lectern.functions import timecode as tc
from lectern.operators import models

CUE_TIMES = r"(\d{2,}:\d{2}:\d{2},\d{3}) --> (\d{2,}:\d{2}:\d{2},\d{3})"


def from_path(path: Column, depth: int) -> Column:
    """Path component counted from the end, the file itself being 1."""
    return F.element_at(F.split(path, "/"), -depth)


def scan(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """course, video, name, path, length of every file under ``root``; contents are pruned away."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return files.select(from_path(F.col("path"), 3).alias("course"), from_path(F.col("path"), 2).alias("video"), from_path(F.col("path"), 1).alias("name"), "path", "length")


def folders(files: DataFrame) -> DataFrame:
    """course, video of the folders that hold a file at all: what is not a folder has no files in it."""
    return files.select("course", "video").distinct()


def entities(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """As ``scan``, with the name's stem; a root that is not there has no files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "course string, video string, name string, path string, length long, stem string")
    return scan(spark, root, glob).withColumn("stem", T.stem_last(F.col("name")))


def ending(files: DataFrame, suffix: str) -> DataFrame:
    return files.filter(F.col("name").endswith(suffix))


def beside(files: DataFrame, siblings: DataFrame, keys: list[str]) -> DataFrame:
    """Files whose entity also has a sibling."""
    return files.join(siblings.select(*keys), keys, "left_semi")


def by_name(files: DataFrame) -> DataFrame:
    """In the order of names as texts, ``page_10`` before ``page_2``."""
    return files.orderBy("course", "video", "name")


def images(spark: SparkSession, root: str, glob: str = "*.jpg") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return files.select("path", T.trailing_number(T.basename(F.col("path"))).alias("screenshot_id"), "content")


def csv(spark: SparkSession, path: str, schema: str = schemas.MISSING_SRT) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """path, value: one row a file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")


def cue_blocks(text: Column) -> Column:
    """Array of (i, start_ms, end_ms, text) of SRT text, i counting from 0; a block without a time line is skipped."""
    blocks = F.split(T.strip(F.regexp_replace(text, r"\r\n?", "\n")), r"\n\s*\n")
    timed = F.filter(blocks, lambda b: b.rlike(CUE_TIMES))
    return F.transform(
        timed,
        lambda b, i: F.struct(
            i.cast("int").alias("i"), tc.parse_ms(F.regexp_extract(b, CUE_TIMES, 1)).alias("start_ms"), tc.parse_ms(F.regexp_extract(b, CUE_TIMES, 2)).alias("end_ms"),
            T.strip(F.regexp_replace(b, r"(?s)^.*? --> [^\n]*\n?", "")).alias("text"),
        ),
    )


def parse_cues(files: DataFrame, *keys: str) -> DataFrame:
    """Cues of files with a ``value`` column, keyed by ``keys``."""
    return files.select(*keys, F.explode(cue_blocks(F.col("value"))).alias("c")).select(*keys, "c.*")


def srt(spark: SparkSession, root: str) -> DataFrame:
    files = whole_text(spark, root).filter(F.col("path").contains(".srt"))
    return parse_cues(files.select(from_path(F.col("path"), 2).alias("course"), T.stem_first(T.basename(F.col("path"))).alias("video"), "value"), "course", "video")


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents or arrays of them, with a declared schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def map_rows(spark: SparkSession, path: str, value: str) -> DataFrame:
    """path, key, value of JSON files that are a map with number-like keys."""
    made = whole_text(spark, path).select("path", F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))
    return made.withColumn("key", F.col("key").cast("int"))


def page_ends(spark: SparkSession, path: str) -> DataFrame:
    return map_rows(spark, path, "int").select("path", F.col("key").alias("page"), F.col("value").alias("page_end"))


def aoi(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of detector files, in the detector's order."""
    files = whole_text(spark, path).select("path", F.from_json("value", schemas.AOI_FILE).alias("f"))
    return files.select("path", F.col("f.shape").alias("shape"), F.posexplode("f.AOI").alias("aoi_idx", "b")).select("path", "shape", "aoi_idx", F.col("b.boxes").alias("boxes"), F.col("b.score").alias("score"), F.col("b.class").alias("class"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """name, file_name of a JSON registry of data sets."""
    made = whole_text(spark, path).select(F.explode(F.from_json("value", "map<string,struct<file_name:string,formatting:string>>")).alias("name", "d"))
    return made.select("name", "d.file_name", "d.formatting")


def with_missing(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Every expected entity, its content null where the file is missing."""
    return expected.join(found, keys, "left")


def cardinality(files: DataFrame, *keys: str) -> DataFrame:
    return files.groupBy(*keys).agg(F.count("*").alias("files"))


def playlist(spark: SparkSession, entries: list[tuple[str, str]], listing=None) -> DataFrame:
    """url, name of configured playlists. With ``listing``, a factory of a callable from playlist addresses to lists of (title, url),
    their videos: course, title, url, without banned titles. Downloading media is left to a connector."""
    lists = spark.createDataFrame(entries, "url string, name string")
    if listing is None:
        return lists
    found = models.apply_model(lists, listing, "url", "videos", "array<struct<title:string,url:string>>")
    each = found.select(F.col("name").alias("course"), F.explode("videos").alias("v")).select("course", T.sanitize_title(F.col("v.title")).alias("title"), "v.url")
    return each.filter(T.allowed_title(F.col("title")))

"""Sources and sinks as round trips, model seams, the incremental run, the whole lecture flow with fake models."""

import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import timecode as tc
from lectern.operators import boxes as B
from lectern.operators import context, evaluate, mcq, models, pages, segment, worklist
from lectern.sources import readers, sinks
from lectern.streaming.incremental import process_new


def test_srt_round_trip(spark, tmp_path):
    segments = spark.createDataFrame([("v", 0, 0.0, 1.5, " hi\nthere "), ("v", 1, 2.0, 3.25, "你好")], "video string, i int, start double, end double, text string")
    text = sinks.render_srt(segments, "video").first()["value"]
    assert text.startswith("1\n00:00:00,000 --> 00:00:01,500\nhi\nthere\n\n2\n")
    (tmp_path / "course").mkdir()
    (tmp_path / "course" / "v.srt").write_text(text.replace("\n", "\r\n"), encoding="utf-8")
    rows = readers.srt(spark, str(tmp_path)).orderBy("i").collect()
    assert [(r["course"], r["video"], r["i"], r["start_ms"], r["end_ms"], r["text"]) for r in rows] == [("course", "v", 0, 0, 1500, "hi\nthere"), ("course", "v", 1, 2000, 3250, "你好")]


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"2": 5, "1": 3}))
    got = {r["page"]: r["page_end"] for r in readers.page_ends(spark, str(tmp_path / "a.json")).collect()}
    assert got == {1: 3, 2: 5}
    (tmp_path / "aoi.json").write_text(json.dumps({"AOI": [{"boxes": [1, 2, 3, 4], "score": 0.9, "class": 2}], "shape": [10, 20]}))
    row = readers.aoi(spark, str(tmp_path / "aoi.json")).first()
    assert (row["aoi_idx"], row["boxes"], row["class"]) == (0, [1.0, 2.0, 3.0, 4.0], 2)
    df = spark.createDataFrame([("c", "1", "n")], "course string, video_id string, video_name string")
    sinks.write_csv(df, str(tmp_path / "out"))
    assert readers.csv(spark, str(tmp_path / "out")).collect() == df.collect()
    assert sinks.export_array(df, str(tmp_path / "x.json")) == 1 and json.loads((tmp_path / "x.json").read_text()) == [{"course": "c", "video_id": "1", "video_name": "n"}]


def test_model_seam_reports_and_retries(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "boom")], "k int, t string")
    got = {r["k"]: (r["out"], r["error"]) for r in models.apply_model(df.filter("k < 3"), models.fake(str.upper), "t", "out", "string", retries=1, valid=lambda g, row: g != "BAD").collect()}
    assert got == {1: ("A", None), 2: (None, "invalid output")}

    def broken(_):
        raise ValueError("no")

    assert models.apply_model(df.filter("k = 3"), models.fake(broken), "t", "out", "string").first()["error"] == "ValueError: no"


def test_image_measures():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (80, 90, 3))
    assert abs(segment.ssim(a, a) - 1) < 1e-9 and segment.ssim(a, 255 - a) < 0.5
    assert segment.perceptual_hash(a) == segment.perceptual_hash(a)
    assert bin(segment.perceptual_hash(a) ^ segment.perceptual_hash(255 - a)).count("1") > 20


def test_compare_frames(spark):
    frames = spark.createDataFrame([("v", i, f"p{i}") for i in (1, 2, 4)], "video string, screenshot_id int, path string")
    same = lambda pdf: pd.DataFrame({"pash": (pdf["path"] == pdf["previous_path"]).astype("int32"), "ssim": pdf["previous_path"].isna().astype(float)})
    got = {r["screenshot_id"]: r["previous_path"] for r in segment.compare_frames(frames, ["video"], same).collect()}
    assert got == {1: None, 2: "p1", 4: "p2"}


def test_incremental(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    spark.range(3).write.parquet(src)
    for more, total in ((0, 3), (0, 3), (2, 5)):
        if more:
            spark.range(more).write.mode("append").parquet(src)
        process_new(spark, src, "*.parquet", "id bigint", out, mark)
        assert spark.read.parquet(out).count() == total


def test_work_lists(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    b = spark.createDataFrame([(2,), (2,)], "k int")
    assert sorted(r["k"] for r in worklist.missing(a, b, ["k"]).collect()) == [1, 3]
    assert [r["k"] for r in worklist.existing(a, b, ["k"]).collect()] == [2]
    assert tuple(worklist.counts(a, b, ["k"]).first()) == (3, 2)


def test_whole_flow(spark):
    """Two videos, cues to samples: context runs, pages, laser, nearest box, descriptions, options, report."""
    cues = spark.createDataFrame([(c, v, i, 4000 * i, 4000 * i + 3000, f"t{i}") for c, v in (("C1", "a"), ("ML2022", "b")) for i in range(6)], "course string, video string, i int, start_ms long, end_ms long, text string")
    keys = ["course", "video"]
    runs = context.context_runs(cues.withColumn("mid", tc.midpoint_ms(F.col("start_ms"), F.col("end_ms"))), keys, 5000)
    texts = cues.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]).alias("texts"))
    refs = lambda c: F.transform(c, lambda x: F.struct(x["i"].alias("text_id")))
    contexts = runs.join(texts, keys).select(*keys, (F.col("i") + 1).alias("screenshot_id"), F.col("i").alias("current"), refs("previous").alias("previous"), refs("next").alias("next"), "texts")
    contexts = contexts.withColumn("subtitle", mcq.subtitles(contexts)).select(*keys, "screenshot_id", "subtitle")
    ends = spark.createDataFrame([(c, v, p, e) for c, v in (("C1", "a"), ("ML2022", "b")) for p, e in ((1, 3), (2, 6))], "course string, video string, page int, page_end int")
    placed = pages.page_asof(contexts, ends, keys)
    points = placed.select(*keys, "page", "screenshot_id", "subtitle", F.lit(10.0).alias("px"), (F.col("screenshot_id") * 10.0).alias("py"))
    held = spark.createDataFrame([(c, v, p, k, 0.0, 30.0 * k, 20.0, 30.0 * k + 25.0) for c, v in (("C1", "a"), ("ML2022", "b")) for p in (1, 2) for k in range(2)], "course string, video string, page int, aoi_idx int, x1 double, y1 double, x2 double, y2 double")
    answered = B.nearest_box(points, held, [*keys, "page"], ["screenshot_id"])
    told = mcq.gathered(held.withColumn("body", F.concat(F.lit("d"), F.col("aoi_idx").cast("string"))), [*keys, "page"])
    ready = answered.join(told, [*keys, "page"]).withColumn("key", F.col("screenshot_id").cast("long"))
    made = mcq.samples(ready)
    rows = made.collect()
    assert {r["split"] for r in rows} == {"train", "valid"} and all(r["aoi_count"] == 2 for r in rows)
    first = [r for r in rows if r["split"] == "valid" and "[0]t0[1]t1" in r["conversations"][0]["value"]]
    assert len(first) == 1 and first[0]["conversations"][1]["value"] == T.ANSWER_HEAD + '0"'
    graded = made.select("course", "aoi_count", (T.parse_answer(F.col("conversations")[1]["value"]) >= 0).alias("ok"))
    assert evaluate.summary(evaluate.thresholds(graded)).first()["acc"] == 1.0


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0

"""All stages with fake models, and the small helpers beside them."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import collate as C
from lectern.operators import models, pages, worklist
from lectern.plans import pipeline


def test_all_stages(spark):
    heard = [{"start": 2.0 * k, "end": 2.0 * k + 1, "text": f" t{k} "} for k in range(4)]
    found = [{"boxes": [0.0, 0.0, 10.0, 10.0], "score": 0.9, "class": 1}, {"boxes": [20.0, 20.0, 40.0, 40.0], "score": 0.8, "class": 4}, {"boxes": [0.0, 0.0, 1.0, 1.0], "score": 0.9, "class": 0}]
    tables = {
        "media": spark.createDataFrame([("c", "v", "v.mp3"), ("c", "w", "w.mp3")], "course string, video string, path string"),
        "subtitles": spark.createDataFrame([("c", "w")], "course string, video string"),
        "compare": spark.createDataFrame([("c", "v", k, 25 if k == 3 else 1, 0.9) for k in (1, 2, 3, 4)], "course string, video string, screenshot_id int, pash int, ssim double"),
        "screenshots": spark.createDataFrame([("c", "v", k, f"s{k}") for k in (1, 2, 3, 4)], "course string, video string, screenshot_id int, path string"),
        "detections": spark.createDataFrame([("c", "v", k, [0.0], [[24.0, 20.0, 4.0, 10.0]], [0.5]) for k in (1, 2, 3, 4)], "course string, video string, screenshot_id int, cls array<double>, xywh array<array<double>>, conf array<double>"),
    }
    tell = lambda key: "".join(f"\n\nImage {i}: **d{i}** [END]" for i in range(json.loads(key)["n"]))
    config = pipeline.Config(models={"asr": models.fake(lambda p: heard), "det": models.fake(lambda p: found), "vlm": models.fake(tell)})
    out = pipeline.run("all", tables, config)
    assert {r["page"]: r["page_end"] for r in out["page_ends"].collect()} == {1: 2, 2: 4}
    assert out["aoi"].count() == 4  # the contained box is gone, on both pages
    rows = out["samples"].collect()
    assert len(rows) == 4 and all('"d1"' in r["conversations"][0]["value"] for r in rows)
    for r in rows:
        label = r["conversations"][1]["value"].split('"')[1]
        assert f'\n{label}:"d1"' in r["conversations"][0]["value"]
    with pytest.raises(ValueError):
        pipeline.run("nothing", tables, config)


def test_helpers(spark):
    streams = spark.createDataFrame([("m", 64, "a"), ("m", 128, "b")], "media string, bitrate int, url string")
    assert worklist.best_stream(streams, ["media"]).first()["url"] == "b"
    shown = spark.createDataFrame([(1, "p1"), (2, "p2")], "page int, image string")
    crops = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "page int, aoi_idx int, path string")
    assert {r["page"]: r["crops"] for r in pages.with_crops(shown, crops, ["page"]).collect()} == {1: ["a", "b"], 2: []}
    batches = spark.createDataFrame([(0, 0, [[1, 2]]), (0, 1, [[3], [4]])], "g int, o int, input_ids array<array<bigint>>")
    assert C.stack(batches, "g", "o").select(F.col("input_ids")).first()[0] == [[1, 2], [3, 0], [4, 0]]

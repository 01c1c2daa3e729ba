"""The lecture flow against a plain loop over a fixture with gaps and missing frames, and the small pieces around it."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import models, segment
from lectern.plans import pipeline
from lectern.sources import readers, sinks

CUE = "course string, video string, i int, start_ms long, end_ms long, text string"


def fixture(spark):
    """Two videos; midpoints fall once (so one time is negative), frames are missing, and so is an image later on."""
    starts = {"a": [0, 5000, 10000, 14500, 33000, 31000, 34000, 80000], "b": [0, 4000, 8000, 60000]}
    cues = [("ML2022" if v == "b" else "C1", v, i, s, s + 4000, f"{v}{i}") for v, line in starts.items() for i, s in enumerate(line)]
    frames = [(c, v, i + 1) for c, v, i, *_ in cues if (v, i) != ("a", 2)]
    gone = {("a", 2)}  # frames that were there when the base data set was made
    ends = [("C1", "a", 1, 1), ("C1", "a", 2, 2), ("C1", "a", 3, 6), ("C1", "a", 4, 7), ("ML2022", "b", 1, 4)]
    aoi = [(c, v, p, k, 30.0 * k, 0.0, 30.0 * k + 20, 20.0) for c, v, p, _ in ends for k in range(3)]
    lasers = {1: [30.0, 5.0, 4.0, 2.0], 2: [0.0, 5.0, 4.0, 2.0], 3: [500.0, 500.0, 1.0, 1.0], 0: None}
    tables = {
        "cues": spark.createDataFrame(cues, CUE),
        "screenshots": spark.createDataFrame([(c, v, k, f"{v}/{k}") for c, v, k in frames], "course string, video string, screenshot_id int, path string"),
        "page_ends": spark.createDataFrame(ends, "course string, video string, page int, page_end int"),
        "aoi": spark.createDataFrame(aoi, "course string, video string, page int, aoi_idx int, x1 double, y1 double, x2 double, y2 double"),
        "descriptions": spark.createDataFrame([(c, v, p, k, f"Describe :old{k}") for c, v, p, _ in ends for k in range(3)], "course string, video string, page int, aoi_idx int, body string"),
        "descriptions_aoi": spark.createDataFrame([("C1", "a", 3, k, f"new{k % 2}Describe :") for k in range(3)], "course string, video string, page int, aoi_idx int, body string"),
        "answers": spark.createDataFrame([("C1", "a", 5, 2)], "course string, video string, screenshot_id int, ans int"),
    }
    tables["images"] = tables["screenshots"].filter("not (video = 'a' and screenshot_id = 2)")

    def point(path):
        k = int(path.split("/")[1])
        if path == "b/4":
            raise OSError("unreadable")
        xywh = lasers[k % 4]
        return {"cls": [0.0, 0.0] if xywh else [], "xywh": [xywh, [1.0, 1.0, 1.0, 1.0]] if xywh else [], "conf": [0.4, 0.0] if xywh else []}

    return cues, frames, gone, ends, aoi, tables, lasers, pipeline.Config(models={"laser": models.fake(point)}, laser_batch=1)


def by_hand(cues, frames, gone, ends, aoi, lasers):
    """What each step of the flow does, one context after another."""
    def stamp(ms):
        a = abs(ms)
        return ("-" if ms < 0 else "") + f"{a // 3600000:02}:{a % 3600000 // 60000:02}:{a % 60000 // 1000:02},{a % 1000:03}"

    out, errors = {}, set()
    for course, video in sorted({(c, v) for c, v, *_ in cues}):
        line = [x for x in cues if x[:2] == (course, video)]
        mid = [(x[3] + x[4]) // 2 for x in line]
        last = {p: e for c, v, p, e in ends if (c, v) == (course, video)}
        page = 1
        for i in range(len(line)):
            if (course, video, i + 1) not in frames:
                continue
            previous, following = [], []
            for j in range(i - 1, -1, -1):
                if abs(mid[i] - mid[j]) > 15000:
                    break
                previous.insert(0, (j, stamp(mid[i] - mid[j])))
            for j in range(i + 1, len(line)):
                if abs(mid[j] - mid[i]) > 15000:
                    break
                following.append((j, stamp(mid[j] - mid[i])))
            if page in last and i + 1 > last[page]:
                page += 1
            if page not in last:
                errors.add((video, i + 1))
                continue
            if (video, i + 1) in gone:
                continue
            if (video, i + 1) == ("b", 4):
                continue
            xywh, ans = lasers[(i + 1) % 4], -1
            if xywh:
                px, py, best = xywh[0] + xywh[2] / 2, xywh[1] + xywh[3], None
                for c, v, p, k, x1, y1, x2, y2 in aoi:
                    if (c, v, p) == (course, video, page) and x1 - 4 <= px <= x2 + 4 and y1 - 4 <= py <= y2 + 4:
                        d = ((px - (x1 + x2) / 2) ** 2 + (py - (y1 + y2) / 2) ** 2) ** 0.5
                        if best is None or d < best[0]:
                            best, ans = (d, k), k
            if (video, i + 1) == ("a", 5):
                ans = 2
            out[video, i + 1] = (page, previous, following, stamp(mid[i]), ans)
    return out, errors


def test_dataset_is_the_plain_loop(spark):
    cues, frames, gone, ends, aoi, tables, lasers, config = fixture(spark)
    want, errors = by_hand(cues, frames, gone, ends, aoi, lasers)
    out = pipeline.run("dataset", tables, config)
    base = {r["video"]: r for r in out["base"].collect()}
    got = {}
    for video, r in base.items():
        assert r["texts"] == [x[5] for x in cues if x[1] == video]
        assert [x["screenshot_id"] for x in r["context_list"]] == sorted(x["screenshot_id"] for x in r["context_list"])
        for x in r["context_list"]:
            if (video, x["screenshot_id"]) == ("b", 4):
                assert x["ans"] is None and x["yolo_detect_result"] is None  # unreadable: no detection, no answer
                continue
            pairs = lambda a: [(p["text_id"], p["time"]) for p in a]
            got[video, x["screenshot_id"]] = (x["page"], pairs(x["previous"]), pairs(x["next"]), x["current_midpoint"], x["ans"])
    assert got == want and any(t.startswith("-") for v in want.values() for _, t in v[1] + v[2])
    assert {(r["video"], r["screenshot_id"]) for r in out["page_errors"].collect()} == errors == {("a", 8)}
    assert [(r["video"], r["screenshot_id"]) for r in out["laser_errors"].collect()] == [("b", 4)]
    rows = out["samples"].collect()
    assert len(rows) == sum(a[4] != -1 for a in want.values())
    for r in rows:
        text = r["conversations"][0]["value"] + r["conversations"][1]["value"]
        assert "Describe" not in text and r["split"] == ("valid" if r["video"] == "b" else "train") and ("new" in text) == ("old" not in text)
    # a second run has nothing to detect, and keeps the answers
    again = pipeline.run("dataset", tables | {"detections": out["detections"].filter("video <> 'b' or screenshot_id <> 4"), "answers": out["answers"]}, config)
    assert sorted(map(tuple, again["answers"].collect())) == sorted(map(tuple, out["answers"].collect()))


def test_reports_and_rerun(spark, tmp_path):
    *_, tables, _, config = fixture(spark)
    config.models |= {"answer": models.fake(lambda key: T.ANSWER_HEAD + '1"'), "template": models.fake(lambda m: "<s>" + json.loads(m)[1]["content"])}
    out = pipeline.run("evaluate", pipeline.run("dataset", tables, config), config)
    n = out["samples"].filter("aoi_count > 1").count()
    assert out["predictions"].count() == n and out["report"].agg(F.sum("questions_2")).first()[0] == n
    pipeline.report_csv(out, str(tmp_path / "report"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert len(lines) == 2 + out["report"].count() and sum(x.startswith("course,") for x in lines) == 1
    fresh = {k: v for k, v in tables.items() if k != "descriptions"}
    bad = pipeline.run("vlm", fresh, pipeline.Config(retries=1, models={"vlm": models.fake(lambda k: "Image 0: x [END]")}))
    assert bad["descriptions"].count() == 0 and bad["describe_errors"].count() == 5
    some = fresh | {"describe_errors": bad["describe_errors"].filter("page = 1")}
    good = pipeline.run("vlm", some, pipeline.Config(models={"vlm": models.fake(lambda k: "".join(f"Image {i}: y [END]" for i in range(3)))}))
    assert good["descriptions"].count() == 6 and good["describe_errors"].count() == 0


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"band_ms": 900, "valid_courses": ["X"]}))
    stage, c = pipeline.Config.from_args(["det", "--config", str(tmp_path / "c.json"), "--pad", "0.5"])
    assert (stage, c.band_ms, c.valid_courses, c.pad) == ("det", 900, ("X",), 0.5)
    (tmp_path / "d.json").write_text('{"nothing": 1}')
    with pytest.raises(ValueError):
        pipeline.Config.load(str(tmp_path / "d.json"))
    with pytest.raises(SystemExit):
        pipeline.Config.from_args(["unknown"])


def test_hash_of_64_bits():
    """By hand: areas averaged to 32 x 32, the cosine transform, a bit for each of 8 x 8 low frequencies above their median."""
    rng = np.random.default_rng(1)
    seen = 0
    for shape in ((32, 32), (48, 80, 3), (51, 37)):
        a = rng.integers(0, 256, shape).astype(float)
        grey = 0.299 * a[..., 0] + 0.587 * a[..., 1] + 0.114 * a[..., 2] if a.ndim == 3 else a
        small = np.zeros((32, 32))
        h, w = grey.shape
        fine = np.kron(grey, np.ones((32, 32)))  # each pixel in 32 x 32 parts, so that areas are whole numbers of parts
        for y in range(32):
            for x in range(32):
                small[y, x] = fine[y * h : (y + 1) * h, x * w : (x + 1) * w].mean()
        low = [[sum(small[y, x] * np.cos(np.pi * u * (2 * y + 1) / 64) * np.cos(np.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
        median = np.median(low)
        want = sum(1 << (8 * u + v) for u in range(8) for v in range(8) if low[u][v] > median)
        assert segment.perceptual_hash(a) == want and bin(want).count("1") == 32
        seen |= want
    assert seen >> 63 and segment.signed(1 << 63) == -(1 << 63) and segment.signed(5) == 5


def test_small_images_are_an_error():
    with pytest.raises(ValueError):
        segment.ssim(np.zeros((50, 60)), np.zeros((50, 60)))


def test_images_crops_and_registry(spark, tmp_path):
    for k in (2, 10):
        (tmp_path / f"screenshot_{k}.jpg").write_bytes(bytes([k]))
    got = {r["screenshot_id"]: bytes(r["content"]) for r in readers.images(spark, str(tmp_path)).collect()}
    assert got == {2: b"\x02", 10: b"\x0a"}
    (tmp_path / "r.json").write_text(json.dumps({"train": {"file_name": "t.json", "formatting": "sharegpt"}}))
    assert readers.registry(spark, str(tmp_path / "r.json")).first()["file_name"] == "t.json"
    shown = spark.createDataFrame([("c", "v", 1, "p")], "course string, video string, screenshot_id int, path string")
    found = [{"boxes": [0.5, 1.5, 9.6, 8.0], "score": 0.9, "class": 1}]
    config = pipeline.Config(models={"det": models.fake(lambda p: found), "crop": models.fake(lambda k: json.dumps(json.loads(k)).encode())})
    compare = shown.select("course", "video", "screenshot_id", F.lit(None).cast("int").alias("pash"), F.lit(None).cast("double").alias("ssim"))
    out = pipeline.run("det", {"screenshots": shown, "compare": compare}, config, str(tmp_path / "out"))
    assert json.loads(bytes(out["crops"].first()["content"])) == {"path": "p", "x1": 0, "y1": 2, "x2": 10, "y2": 8}
    assert sinks.export_array(spark.createDataFrame([], "a int"), str(tmp_path / "e.json")) == 0 and json.loads((tmp_path / "e.json").read_text()) == []


def test_compare_keeps_shapes_apart(spark):
    rows = spark.createDataFrame([(1, 5, 0.1, 1, None), (2, 5, 0.1, 1, 1), (3, 50, 0.1, 2, 1)], "k int, p int, s double, shape int, before int")
    p, s = segment.compared(F.col("p"), F.col("s"), F.col("shape"), F.col("before"))
    got = {r["k"]: (r["p"], r["s"], r["cut"]) for r in rows.select("k", p.alias("p"), s.alias("s"), segment.is_cut(p, s).alias("cut")).collect()}
    assert got == {1: (None, None, False), 2: (5, 0.1, True), 3: (-1, -1.0, False)}

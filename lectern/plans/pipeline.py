"""The lecture pipeline: stages asr, det, vlm and dataset, and beside them translate and evaluate; each is a function from named tables
to named tables.

Models come in as factories (``operators.models``); a stage whose model is not configured is an error, unless its result is among the
tables already. Nothing is computed until a table is written, except that a caller should write what a model made before it is used
twice: model calls are neither cheap nor sure to repeat. ``run`` does so where it is given a folder.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.functions import text as T
from lectern.functions import timecode as tc
from lectern.operators import boxes, context, evaluate as scoring, mcq, models, pages, segment, worklist
from lectern.sources import sinks

Tables = dict[str, DataFrame]
VIDEO = ["course", "video"]
PAGE = [*VIDEO, "page"]
SHOT = [*VIDEO, "screenshot_id"]
SEGMENTS = "array<struct<start:double,end:double,text:string>>"
BOXES = "array<struct<boxes:array<double>,score:double,class:int>>"
LASER = "struct<cls:array<double>,xywh:array<array<double>>,conf:array<double>>"


@dataclass
class Config:
    """Thresholds and models of a run."""

    root: str = "."
    band_ms: int = context.BAND_MS
    hash_cut: float = segment.HASH_CUT
    ssim_cut: float = segment.SSIM_CUT
    score: float = boxes.SCORE
    contained: float = boxes.CONTAINED
    pad: float = boxes.PAD
    valid_courses: tuple[str, ...] = mcq.VALID_COURSES
    retries: int = 4
    asr_model: str = "SoybeanMilk/faster-whisper-Breeze-ASR-25"
    asr_beam: int = 5
    laser_batch: int = 30
    text_batch: int = 5000
    models: dict[str, models.Factory] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str, **more) -> Config:
        """From a JSON file, or a YAML one where a reader of it is installed; a name that there is no setting of is an error."""
        with open(path, encoding="utf-8") as f:
            if path.endswith((".yaml", ".yml")):
                import yaml

                values = yaml.safe_load(f)
            else:
                values = json.load(f)
        if unknown := set(values) - {x.name for x in fields(cls)}:
            raise ValueError(f"no setting is called {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}, **more)

    @classmethod
    def from_args(cls, argv: list[str], **more) -> tuple[str, Config]:
        """The stage and the settings of a command line."""
        parser = argparse.ArgumentParser()
        parser.add_argument("stage", choices=["all", *STAGES, *OTHERS])
        parser.add_argument("--config")
        for x in fields(cls):
            if isinstance(x.default, (int, float, str)):
                parser.add_argument(f"--{x.name.replace('_', '-')}", type=type(x.default))
        given = {k: v for k, v in vars(parser.parse_args(argv)).items() if v is not None}
        stage, config = given.pop("stage"), given.pop("config", None)
        base = cls.load(config, **more) if config else cls(**more)
        for name, value in given.items():
            setattr(base, name, value)
        return stage, base


def without(rows: DataFrame, t: Tables, name: str, keys: list[str]) -> DataFrame:
    """What is not done yet."""
    return worklist.missing(rows, t[name], keys) if name in t else rows


def joined(made: DataFrame, t: Tables, name: str) -> DataFrame:
    """What was done before, and what is new."""
    return t[name].select(*made.columns).unionByName(made) if name in t else made


def asr(t: Tables, c: Config) -> Tables:
    """Speech of the media without subtitles, as cues."""
    todo = worklist.missing(t["media"], t["subtitles"], VIDEO)
    heard = models.apply_model(todo.select(*VIDEO, "path"), c.models["asr"], "path", "segments", SEGMENTS)
    cues = heard.select(*VIDEO, F.posexplode("segments").alias("i", "s"))
    ms = lambda x: F.floor(F.col(x) * 1000).cast("bigint")
    cues = cues.select(*VIDEO, "i", ms("s.start").alias("start_ms"), ms("s.end").alias("end_ms"), T.strip(F.col("s.text")).alias("text"))
    return {"cues": joined(cues, t, "cues"), "asr_errors": heard.filter("error is not null").select(*VIDEO, "error")}


def shots(t: Tables, c: Config) -> Tables:
    """A frame for each cue, at its midpoint's second, numbered by the cue from 1; only frames that are not there, of media that are."""
    if "frames" not in c.models:
        return {"screenshots": t["screenshots"]}
    wanted = t["cues"].select(*VIDEO, (F.col("i") + 1).alias("screenshot_id"), tc.screenshot_second(F.col("start_ms"), F.col("end_ms")).alias("second"))
    todo = without(wanted, t, "screenshots", SHOT).join(t["media"].select(*VIDEO, F.col("path").alias("media")), VIDEO)
    asked = todo.withColumn("key", F.to_json(F.struct("media", "second")))
    made = models.apply_model(asked, c.models["frames"], "key", "path", "string")
    return {"screenshots": joined(made.filter("path is not null").select(*SHOT, "path"), t, "screenshots"), "shot_errors": made.filter("path is null").select(*SHOT, "error")}


def det(t: Tables, c: Config) -> Tables:
    """Frames, pages from compared frames; boxes on the last frame of each page, and their crops where there is a model for these."""
    done = shots(t, c)
    found = done["screenshots"]
    compare = t["compare"] if "compare" in t else segment.compare_frames(found, VIDEO, c.models["compare"]()).select(*SHOT, "pash", "ssim")
    frames = compare.withColumn("cut", segment.is_cut(F.col("pash"), F.col("ssim"), c.hash_cut, c.ssim_cut))
    ends = segment.page_ends(segment.number_pages(frames, VIDEO, ["screenshot_id"]), VIDEO)
    shown = pages.link_pages(ends, found, VIDEO)
    seen = models.apply_model(shown.filter("path is not null"), c.models["det"], "path", "found", BOXES)
    each = seen.select(*PAGE, "path", F.posexplode("found").alias("det_idx", "f"))
    flat = each.select(*PAGE, "path", "det_idx", F.col("f.score").alias("score"), F.col("f.class").alias("class"), *[F.col("f.boxes")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])
    aoi = boxes.reindex(boxes.suppress_contained(flat, PAGE, c.score, c.contained), PAGE)
    out = done | {"compare": compare, "page_ends": ends, "page_images": shown, "aoi": aoi.drop("path"), "det_errors": seen.filter("error is not null").select(*PAGE, "error")}
    if "crop" in c.models:
        b = G.rounded(G.Box.named())
        asked = aoi.select(*PAGE, "aoi_idx", F.to_json(F.struct("path", *[x.alias(n) for x, n in zip(b, ("x1", "y1", "x2", "y2"))])).alias("key"))
        out["crops"] = models.apply_model(asked, c.models["crop"], "key", "content", "binary").drop("key")
    return out


def vlm(t: Tables, c: Config) -> Tables:
    """A description of every region. With a model ``aoi`` one call a region; else one a page, and output that doesn't fit the page's
    regions is asked for again. Where a list of errors is given, only its pages are done."""
    regions = t["aoi"] if "describe_errors" not in t else worklist.existing(t["aoi"], t["describe_errors"], PAGE)
    regions = without(regions, t, "descriptions", PAGE)
    if "aoi" in c.models:
        asked = regions.select(*PAGE, "aoi_idx").withColumn("key", F.to_json(F.struct(*PAGE, "aoi_idx")))
        said = models.apply_model(asked, c.models["aoi"], "key", "raw", "string", c.retries)
        made = said.filter("raw is not null").select(*PAGE, "aoi_idx", T.clean_output(F.col("raw")).alias("body"))
    else:
        asked = regions.groupBy(*PAGE).agg(F.count("*").cast("int").alias("n"))
        said = models.apply_model(asked.withColumn("key", F.to_json(F.struct(*PAGE, "n"))), c.models["vlm"], "key", "raw", "string", c.retries, lambda out, row: models.fits_boxes(out, row["n"]))
        each = said.filter("raw is not null").select(*PAGE, F.explode(T.descriptions(F.col("raw"))).alias("d"))
        made = each.select(*PAGE, F.col("d.k").alias("aoi_idx"), F.col("d.body").alias("body"))
    errors = said.filter("error is not null").groupBy(*PAGE).agg(F.first("error").alias("error"))
    return {"descriptions": joined(made, t, "descriptions"), "describe_errors": errors}


def translate(t: Tables, c: Config) -> Tables:
    """``descriptions`` with their text in Traditional Chinese, in batches; what has one already is not asked for again."""
    rows = t["descriptions"]
    todo = rows.filter("chinese is null") if "chinese" in rows.columns else rows
    asked = todo.select(*PAGE, "aoi_idx", models.messages(F.lit(mcq.TRANSLATE_SYSTEM), F.concat(F.lit(mcq.TRANSLATE_USER), F.col("body"))).alias("key"))
    said = models.apply_model(asked, c.models["translate"], "key", "chinese", "string", batch=c.text_batch)
    return {"descriptions": sinks.updated(rows, said.select(*PAGE, "aoi_idx", "chinese"), [*PAGE, "aoi_idx"])}


def texts_of(cues: DataFrame) -> DataFrame:
    """All texts of each video, in order."""
    return cues.groupBy(*VIDEO).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]).alias("texts"))


def contexts(t: Tables, c: Config) -> DataFrame:
    """A row for each cue with a screenshot: current, previous and next with signed distances, the midpoint."""
    cues = t["cues"].withColumn("mid", tc.midpoint_ms(F.col("start_ms"), F.col("end_ms")))
    away = lambda a, ms: F.transform(a, lambda x: F.struct(x["i"].alias("text_id"), tc.format_ms(ms(x)).alias("time")))
    runs = context.context_runs(cues, VIDEO, c.band_ms).withColumn("screenshot_id", F.col("i") + 1)
    runs = worklist.existing(runs, t["screenshots"], SHOT)
    return runs.select(
        *SHOT, F.col("i").alias("current"), away("previous", lambda x: F.col("mid") - x["mid"]).alias("previous"), away("next", lambda x: x["mid"] - F.col("mid")).alias("next"),
        tc.format_ms(F.col("mid")).alias("current_midpoint"),
    )


def nested(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The base data set: a document a video, ``texts`` and ``context_list`` in order."""
    item = F.struct("screenshot_id", *[c for c in rows.columns if c not in SHOT])
    return texts.join(rows.groupBy(*VIDEO).agg(F.array_sort(F.collect_list(item)).alias("context_list")), VIDEO)


def courses(base: DataFrame) -> DataFrame:
    """A document a course: its videos and their results."""
    video = F.struct("video", F.struct("texts", "context_list").alias("result"))
    return base.groupBy("course").agg(F.array_sort(F.collect_list(video)).alias("videos"))


def laser(rows: DataFrame, t: Tables, c: Config) -> Tables:
    """Detections for contexts that have none, in batches. An image that can't be read has no detection and is an error; one
    without a laser has an empty one."""
    todo = without(rows.select(*SHOT), t, "detections", SHOT).join(t["screenshots"], SHOT)
    if "laser" not in c.models:
        return {"detections": t["detections"]}
    found = models.apply_model(todo.select(*SHOT, "path"), c.models["laser"], "path", "found", LASER, batch=c.laser_batch)
    return {"detections": joined(found.filter("found is not null").select(*SHOT, "found.*"), t, "detections"), "laser_errors": found.filter("found is null").select(*SHOT, "error")}


def answers(rows: DataFrame, t: Tables, c: Config) -> DataFrame:
    """``ans`` of each context with a detection: -1 without a laser or a box near it. What has an answer keeps it."""
    pointed = rows.join(t["detections"], SHOT).withColumn("laser", boxes.last_positive(boxes.zip_detections(F.col("cls"), F.col("xywh"), F.col("conf"))))
    px, py = G.laser_anchor(F.col("laser.xywh"))
    points = pointed.select(*PAGE, "screenshot_id", px.alias("px"), py.alias("py"))
    new = boxes.nearest_box(points, t["aoi"].select(*PAGE, "aoi_idx", "x1", "y1", "x2", "y2"), PAGE, ["screenshot_id"], c.pad).select(*SHOT, "ans")
    return sinks.updated(new, t["answers"].select(*SHOT, "ans"), SHOT) if "answers" in t else new


def dataset(t: Tables, c: Config) -> Tables:
    """The base data set, and samples: context runs, pages, the laser's box, options.

    The page of a context is counted before contexts without an image go. Descriptions of a page come from ``descriptions_aoi`` if it
    has the page at all.
    """
    rows = contexts(t, c)
    placed = pages.page_fold(rows, t["page_ends"], VIDEO)
    last = t["page_ends"].groupBy(*VIDEO).agg(F.max("page").alias("last"))
    known = rows.join(placed, SHOT).join(last, VIDEO)
    beyond = known.filter(F.col("page") > F.col("last")).select(*SHOT, F.lit("after the last page").alias("error"))
    there = worklist.existing(known.filter(F.col("page") <= F.col("last")).drop("last"), t.get("images", t["screenshots"]), SHOT)
    t = t | laser(there, t, c)
    answered = answers(there, t, c)
    base = there.join(t["detections"].select(*SHOT, F.struct("cls", "xywh", "conf").alias("yolo_detect_result")), SHOT, "left").join(answered, SHOT, "left")
    told = t["descriptions"].select(*PAGE, "aoi_idx", "body")
    if "descriptions_aoi" in t:
        told = worklist.whole_source(t["descriptions_aoi"].select(*PAGE, "aoi_idx", "body"), told, PAGE)
    told = mcq.gathered(told.withColumn("body", T.drop_literal(F.col("body"), T.DESCRIBE)), PAGE)
    texts = texts_of(t["cues"])
    spoken = there.join(texts, VIDEO)
    ready = spoken.withColumn("subtitle", mcq.subtitles(spoken)).select(*PAGE, "screenshot_id", "subtitle").join(answered, SHOT).join(told.filter("gapless"), PAGE)
    out = {"base": nested(base, texts), "answers": answered, "detections": t["detections"], "page_errors": beyond, "description_gaps": told.filter("not gapless").select(*PAGE)}
    return out | ({"laser_errors": t["laser_errors"]} if "laser_errors" in t else {}) | {"samples": mcq.samples(ready.withColumn("key", F.col("screenshot_id").cast("bigint")), c.valid_courses)}


def evaluate(t: Tables, c: Config) -> Tables:
    """Answers of a model to the samples with a choice, and the reports on them; an answer is right if it is the expected text."""
    asked = t["samples"].filter(F.col("aoi_count") > 1).withColumn("sample_id", F.xxhash64("course", "video", F.to_json("conversations")))
    asked = asked.select("sample_id", "course", "aoi_count", F.col("conversations")[1]["value"].alias("answer"), models.messages(F.col("system"), F.col("conversations")[0]["value"]).alias("key"))
    if "template" in c.models:
        asked = models.apply_model(asked, c.models["template"], "key", "prompt", "string").drop("key", "error").withColumnRenamed("prompt", "key")
    said = models.apply_model(asked, c.models["answer"], "key", "output", "string", batch=c.text_batch)
    made = said.select("sample_id", "course", "aoi_count", "answer", "output", T.parse_answer(F.col("output")).alias("label"), F.coalesce(F.col("output") == F.col("answer"), F.lit(False)).alias("ok"))
    report = scoring.thresholds(made)
    return {"predictions": made, "report": report, "summary": scoring.summary(report)}


STAGES: dict[str, Callable[[Tables, Config], Tables]] = {"asr": asr, "det": det, "vlm": vlm, "dataset": dataset}
OTHERS: dict[str, Callable[[Tables, Config], Tables]] = {"translate": translate, "evaluate": evaluate}


def run(stage: str, tables: Tables, config: Config, into: str | None = None) -> Tables:
    """One stage or ``all``; results join the tables, written as Parquet into the folder ``into`` if it is given. An unknown stage or a
    missing table or model is an error at once, and no later stage runs."""
    if stage != "all" and stage not in STAGES | OTHERS:
        raise ValueError(f"stage {stage!r}: one of all, {', '.join(STAGES | OTHERS)}")
    for name, f in (STAGES if stage == "all" else {stage: (STAGES | OTHERS)[stage]}).items():
        made = f(tables, config)
        if into:
            made = {k: sinks.stored(v, f"{into}/{name}/{k}") for k, v in made.items()}
        tables = tables | made
    return tables


def report_csv(t: Tables, path: str) -> None:
    """The evaluation report: counts by course as a CSV file, and the accuracy of all of them appended."""
    sinks.write_csv(t["report"], path)
    sinks.write_csv(t["summary"], path, append=True)


def union(frames: list[DataFrame]) -> DataFrame:
    """Results of several courses as one."""
    return reduce(DataFrame.unionByName, frames)


def messages_of(question: Column) -> Column:
    """A question as the messages that a model gets."""
    return models.messages(F.lit(mcq.SYSTEM), question)

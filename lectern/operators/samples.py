"""Training samples of the page describer: a page image, its crops, prompt and answer as token ids and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import collate, models, pages

TOKENS = "array<bigint>"


def page_samples(index: DataFrame, crops: DataFrame, texts: DataFrame, keys: list[str], tokenize: models.Factory, eos: int, prompt: Callable | None = None, longest: int = collate.LONGEST) -> DataFrame:
    """keys, image, crops, input_ids, labels: one row for each page of ``index`` (keys, image).

    ``crops`` has aoi_idx and path, ``texts`` aoi_idx and text_1. The prompt is by default the tags of the regions and a request; another
    one is a function of the column of their number. Labels are masked but for the answer; both are cut to ``longest``.
    """
    tags = lambda n: F.concat(F.lit("<|image_1|>"), T.image_tags(n), F.lit("Please describe these "), n.cast("string"), F.lit(" images."))
    items = F.array_sort(F.collect_list(F.struct("aoi_idx", "text_1")))
    answers = texts.groupBy(*keys).agg(T.model_answer(F.transform(items, lambda x: x["text_1"])).alias("answer"))
    rows = pages.with_crops(index, crops, keys).join(answers, keys).withColumn("prompt", (prompt or tags)(F.size("crops")))
    for side in ("prompt", "answer"):
        rows = models.apply_model(rows, tokenize, side, f"{side}_ids", TOKENS).drop("error")
    labels = collate.labels(F.size("prompt_ids"), F.col("answer_ids"), F.lit(eos), longest)
    whole = F.slice(F.concat("prompt_ids", "answer_ids"), 1, longest)
    return rows.select(*keys, "image", "crops", whole.alias("input_ids"), labels.alias("labels"))

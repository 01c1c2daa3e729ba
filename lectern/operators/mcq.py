"""Multiple-choice samples from contexts, boxes and descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

# The prompt's head and tail around the subtitle, and the system message.
PROMPT_HEAD = (
    "### 字幕格式：\n            - 每段字幕的 `[number]` 表示說話順序：\n            - `[0]` 代表當前講話內容。\n"
    "            - `[1], [2], ...` 代表未來的內容，數值越大代表越晚說。\n            - `[-1], [-2], ...` 代表過去的內容，數值越小代表時間早說\n"
    '            ### 指令\n             請問以下字幕:"'
)
PROMPT_TAIL = '"最可能對應的是哪段敘述:?\n            ###敘述\n'
SYSTEM = (
    "You are a highly accurate natural language processing model specializing in semantic similarity tasks. Your task is to analyze a given subtitle and compare it with a list of "
    "narrative descriptions. Based on the semantic meaning of the subtitle and the narratives, identify which narrative is the closest match to the subtitle.Return the index of the "
    "closest narrative. Focus on the meaning and context of the text, rather than exact word matches."
)
VALID_COURSES = ("ML2022",)
# The translator's system message and what stands before a text.
TRANSLATE_SYSTEM = (
    "You are a professional translator specializing in English-to-Traditional Chinese (繁體中文) translation.         "
    "Ensure that your translations are accurate, fluent, and natural, preserving the original tone and intent of the text.         "
    "Do not include any explanations, labels, or formatting—only output the translated text."
)
TRANSLATE_USER = "Translate the following English text into Traditional Chinese (繁體中文):\n\n"


def prompt(subtitle: Column, options: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), subtitle, F.lit(PROMPT_TAIL), T.candidates(options))


def gathered(descriptions: DataFrame, page: list[str], body: str = "body") -> DataFrame:
    """options: texts in index order; ``gapless`` tells whether the indices are 0, 1, …, as they must be."""
    items = F.array_sort(F.collect_list(F.struct(F.col("aoi_idx").alias("k"), F.col(body).alias("t"))))
    made = descriptions.groupBy(*page).agg(items.alias("items"))
    gapless = F.forall(F.transform("items", lambda x, i: x["k"] == i), lambda ok: ok)
    return made.select(*page, F.transform("items", lambda x: x["t"]).alias("options"), gapless.alias("gapless"))


def reorder(options: Column, key: Column, shuffle: Column) -> Column:
    """Options in an order that depends on ``key`` (a number) and their place only; unchanged where ``shuffle`` is false."""
    keyed = F.transform(options, lambda t, i: F.struct(F.pmod(key * 7919 + i * 104729, F.lit(1000003)).alias("o"), i.alias("i"), t.alias("t")))
    return F.when(shuffle, F.transform(F.array_sort(keyed), lambda x: x["t"])).otherwise(options)


def relabel(before: Column, label: Column, after: Column) -> Column:
    """Where the labelled text stands afterwards: the first that equals it."""
    return F.array_position(after, F.try_element_at(before, label + 1)) - 1


def split_of(course: Column, valid=VALID_COURSES) -> Column:
    return F.when(course.isin(*valid), "valid").otherwise("train")


def subtitles(contexts: DataFrame, texts: str = "texts") -> Column:
    """The context's subtitle from its base document's texts, looked up by ordinal."""
    at = lambda k: F.element_at(F.col(texts), k + 1)
    return T.subtitle(F.transform("previous", lambda p: at(p["text_id"])), at(F.col("current")), F.transform("next", lambda n: at(n["text_id"])))


def samples(answered: DataFrame, valid=VALID_COURSES) -> DataFrame:
    """D16 rows from course, video, subtitle, options, ans, key: those answered and with a choice."""
    some = answered.filter((F.col("ans") != -1) & (F.size("options") > 1))
    some = some.withColumn("split", split_of(F.col("course"), valid)).withColumn("shown", reorder(F.col("options"), F.col("key"), F.col("split") == "train"))
    label = relabel(F.col("options"), F.col("ans"), F.col("shown"))
    said = F.array(
        F.struct(F.lit("human").alias("from"), prompt(F.col("subtitle"), F.col("shown")).alias("value")),
        F.struct(F.lit("gpt").alias("from"), T.answer(label).alias("value")),
    )
    return some.select(said.alias("conversations"), F.lit(SYSTEM).alias("system"), "course", "video", F.size("shown").alias("aoi_count"), "split")

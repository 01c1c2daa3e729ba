"""Batches of token arrays: padding, masks, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORE, LONGEST = -100, 8192


def pad(ids: Column, length: Column, value: int = 0, left: bool = False) -> Column:
    fill = F.array_repeat(F.lit(value).cast("bigint"), F.greatest(length - F.size(ids), F.lit(0)).cast("int"))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def attention(ids: Column) -> Column:
    return F.transform(ids, lambda x: (x != 0).cast("bigint"))


def labels(prompt_len: Column, answer: Column, eos: Column, longest: int = LONGEST) -> Column:
    """The prompt masked, cut to ``longest``; if nothing but mask is left, the last is the end token."""
    whole = F.slice(F.concat(F.array_repeat(F.lit(IGNORE).cast("bigint"), prompt_len), answer), 1, longest)
    masked = F.forall(whole, lambda x: x == IGNORE) & (F.size(whole) > 0)
    return F.when(masked, F.concat(F.slice(whole, F.lit(1), F.size(whole) - 1), F.array(eos.cast("bigint")))).otherwise(whole)


def collate(rows: DataFrame, batch: str, order: str, ids: str = "ids", left: bool = False) -> DataFrame:
    """One row a batch: ids padded to the batch's longest, and the attention mask. A batch is small by definition."""
    made = rows.groupBy(batch).agg(F.max(F.size(ids)).alias("longest"), F.array_sort(F.collect_list(F.struct(order, ids))).alias("rows"))
    padded = F.transform("rows", lambda r: pad(r[ids], F.col("longest"), left=left))
    return made.select(batch, "longest", padded.alias("input_ids")).withColumn("attention_mask", F.transform("input_ids", attention))


def stack(batches: DataFrame, group: str, order: str, ids: str = "input_ids", value: int = 0) -> DataFrame:
    """Padded batches (arrays of equally long arrays) laid on one another, all padded to the longest of the group."""
    made = batches.groupBy(group).agg(F.max(F.size(F.col(ids)[0])).alias("longest"), F.array_sort(F.collect_list(F.struct(order, ids))).alias("parts"))
    rows = F.flatten(F.transform("parts", lambda p: p[ids]))
    return made.select(group, "longest", F.transform(rows, lambda r: pad(r, F.col("longest"), value)).alias(ids))

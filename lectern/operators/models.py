"""Seams for models: speech recognition, detection, description, translation, answering.

A model is a factory of a batch callable. The factory runs once a task, the callable once an Arrow batch; rows keep their keys, so
no result is matched by position across partitions. Filters belong before these seams: the optimizer moves none through them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Batch = Callable[[list[Any]], list[Any]]
Factory = Callable[[], Batch]


def apply_model(rows: DataFrame, factory: Factory, column: str, into: str, kind: str, retries: int = 0, valid: Callable[[Any, pd.Series], bool] | None = None, batch: int = 30) -> DataFrame:
    """``rows`` with the model's answer and an error column; an answer that ``valid`` rejects is asked for again, ``retries``
    times at most. A failing row is reported in ``error``, not swallowed. ``batch`` rows go to the model at a time, the rest of an
    Arrow batch at its end."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in (into, "error")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in (whole.iloc[at : at + batch] for whole in batches for at in range(0, len(whole), batch)):
            out: list[Any] = [None] * len(pdf)
            error: list[str | None] = [None] * len(pdf)
            todo = list(range(len(pdf)))
            for _ in range(retries + 1):
                try:
                    answers = model([pdf[column].iloc[i] for i in todo])
                except Exception as broken:  # the whole batch failed: every row says why
                    for i in todo:
                        error[i] = f"{type(broken).__name__}: {broken}"
                    continue
                again = []
                for i, got in zip(todo, answers):
                    if valid is None or valid(got, pdf.iloc[i]):
                        out[i], error[i] = got, None
                    else:
                        error[i] = "invalid output"
                        again.append(i)
                todo = again
                if not todo:
                    break
            yield pdf.assign(**{into: out, "error": error})

    return rows.mapInPandas(each, ", ".join([*fields, f"`{into}` {kind}", "error string"]))


def messages(system: Column, question: Column) -> Column:
    """A system message and a question as the JSON list that chat models take."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.to_json(F.array(turn("system", system), turn("user", question)))


def fits_boxes(out: str | None, boxes: int) -> bool:
    """As ``text.valid_model_output``, for one answer."""
    return out is not None and out.count("Image ") == boxes and ": [END]" not in out


def fake(answer: Callable[[Any], Any]) -> Factory:
    """A deterministic stand-in for tests."""
    return lambda: lambda batch: [answer(x) for x in batch]

"""Language detectors: functions from the caption column to a language column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from poolsieve.functions.text import one_line


def column_detector(name: str = "lang") -> Callable[[Column], Column]:
    """Reads a column that is there already."""
    return lambda _: F.col(name)


def first_bytes(text: str, most: int) -> str:
    """The text's longest beginning of at most ``most`` bytes in UTF-8."""
    return text[:most].encode("utf-8", "replace")[:most].decode("utf-8", "ignore")


def model_detector(load: Callable[[], Callable[[list[str]], list[str]]], prefix: str = "__label__", least_bytes: int = 0, most_bytes: int | None = None) -> Callable[[Column], Column]:
    """Runs a model over Arrow batches.

    ``load`` is called once for each task's run of batches and returns a
    function from captions to labels; ``prefix`` is taken off the labels.
    Line ends are spaces to the model, and null captions have no language.  Models
    with bounds see the first ``most_bytes`` of a caption (in UTF-8, whole characters
    only); captions of fewer than ``least_bytes`` have no language.
    """

    @F.pandas_udf("string")
    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = load()
        for texts in batches:
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            there = texts.notna()
            if least_bytes:
                there &= texts.map(lambda t: t is not None and len(t.encode("utf-8", "replace")) >= least_bytes).astype(bool)
            if there.any():
                seen = texts[there] if most_bytes is None else texts[there].map(lambda t: first_bytes(t, most_bytes))
                out[there] = [label.removeprefix(prefix) for label in predict(seen.tolist())]
            yield out

    return lambda text: detect(one_line(text))

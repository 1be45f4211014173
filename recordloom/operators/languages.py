"""Language identification: a classifier of character trigrams, fitted on labelled texts.

Each letter has a trigram with what stands before and behind it, a space for all that is no letter; it goes to one of
SLOTS slots. A language's model has a smoothed log probability for each slot, so it has the same size whatever was read.
Texts are read as arrays of code points in Arrow batches: the same sums by higher-order functions took 4,500 CPU seconds
a GB of text.
"""

from __future__ import annotations

import functools
import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of trigrams; fixed, as the SQL of the query has it too.
SLOTS = 4096
#: Added to each slot's count; the least number of trigrams and the least margin a trigram of a decision.
SMOOTHING, LEAST, MARGIN = 0.5, 8, 0.05


class Languages(NamedTuple):
    """Languages in order, and for each slot their log probabilities."""

    names: list[str]
    table: list[list[float]]


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def slots(text: str | None) -> np.ndarray:
    """The slots of a text's trigrams, one for each letter of the lower-cased text."""
    codes = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[codes]
    codes[~letter] = 32
    at = np.flatnonzero(letter)
    return (codes[at - 1] * 961 + codes[at] * 31 + codes[at + 1]) % SLOTS


def _counts(batches):
    import pyarrow as pa

    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            totals[label] = totals.get(label, 0) + np.bincount(slots(text), minlength=SLOTS)
    for label, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["label", "slot", "n"])


def fit(texts: DataFrame, text: str = "text", label: str = "lang", smoothing: float = SMOOTHING) -> Languages:
    """A model of all rows with a label.

    A task gives a number for each slot and language that it has seen, and so does the driver get. Null labels and texts
    without letters add nothing; labels are few.
    """
    labelled = texts.where(F.col(label).isNotNull()).select(F.col(label).cast("string"), F.col(text).cast("string"))
    seen = labelled.mapInArrow(_counts, "label string, slot int, n long").groupBy("label", "slot").agg(F.sum("n").alias("n")).collect()
    names = sorted({r.label for r in seen})
    counts = np.zeros((SLOTS, len(names)))
    for r in seen:
        counts[r.slot, names.index(r.label)] = r.n
    totals = counts.sum(axis=0)
    return Languages(names, [[math.log((n + smoothing) / (total + smoothing * SLOTS)) for n, total in zip(row, totals, strict=True)] for row in counts])


def decide(text: str | None, names: list[str], table: np.ndarray, least: int, margin: float) -> tuple[str | None, float, int]:
    """Language, margin and number of trigrams of a text."""
    found = slots(text)
    if not names or not len(found):
        return None, 0.0, len(found)
    scores = table[found].sum(axis=0)
    order = np.argsort(-scores, kind="stable")
    lead = round(float(scores[order[0]] - scores[order[1]]) / len(found), 9) if len(names) > 1 else math.inf
    return (names[order[0]] if len(found) >= least and lead >= margin else None), lead, len(found)


def identify(text: Column, model: Languages, least: int = LEAST, margin: float = MARGIN) -> Column:
    """A struct of language, margin and n (trigrams). The language is null for fewer than `least` trigrams or a smaller margin.

    The margin is the best language's lead over the second in log probability a trigram; of equal ones the first in
    order leads by 0. A model of one language leads by infinity, one of none decides nothing. Null texts have no
    trigrams; texts are read whole.
    """
    names, table = model.names, np.array(model.table).reshape(-1, max(1, len(model.names)))

    @F.pandas_udf("language string, margin double, n long")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decide(x, names, table, least, margin) for x in texts], columns=["language", "margin", "n"])

    return run(text.cast("string"))


def accuracy(texts: DataFrame, model: Languages, text: str = "text", label: str = "lang") -> DataFrame:
    """label, records, decided and right of rows with a label; right ones are decided as their label."""
    judged = texts.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), identify(F.col(text), model)["language"].alias("found"))
    return judged.groupBy("label").agg(F.count(F.lit(1)).alias("records"), F.count("found").alias("decided"), F.count(F.when(F.col("found") == F.col("label"), 1)).alias("right"))

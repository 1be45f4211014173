"""Mixing sources to target weights by balanced sampling with the cube method.

Targets: the sources share `share` times all sizes by weight; a target ends at `most` times its source's size and the
excess goes to the others by weight. A document of a source with the ratio r = target / size is taken floor(r) times
and once more with the probability r - floor(r). Which documents those are is the cube method's choice: the flight
phase walks the vector of inclusion probabilities through the null space of two constraints (the source's tokens and
its documents), so both totals stay exact until fewer than three units of a block are fractional. Blocks of a bounded
number of units fly independently, as many blocks as a source needs; what they leave flies again in fewer blocks, level
by level, until a source's rest fits in one block, where the landing phase settles the last few units nearest to both
totals.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import ROW, folders, materialize, release, with_row

#: Weights of the sources by code point, repeating; null comes last.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Units that fly together in one block, on average.
BLOCK = 4096

_UNIT = f"{ROW} long, source string, size long, p double, h long"


def word_count(text: Column) -> Column:
    """Number of runs of characters outside U+0020 and U+0009 to U+000D; null: 0."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(plain, r"[\x20\x09-\x0D]+", "")).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n (rows) and target for each source of `sized` (source, size).

    Water-filling in closed form: in order of the level at which a source is full (its cap by its weight), the first
    source that isn't full at the level that the rest leaves sets the level for all that follow.
    """
    if share > most:
        raise ValueError("the share can't be more than each source may give")
    totals = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    full = totals.withColumn("w", weight).withColumn("cap", F.col("source_size") * most).withColumn("level", F.col("cap") / F.col("w"))
    before = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = full.withColumn("left", F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("ws", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    whole = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.first(F.when(F.col("left") / F.col("ws") <= F.col("level"), F.col("left") / F.col("ws")), ignorenulls=True).over(whole)
    return rest.withColumn("at", level).select("source", "source_size", "n", F.least(F.col("cap"), F.coalesce(F.col("at") * F.col("w"), F.col("cap"))).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Move probabilities `p` until fewer than three are fractional; sums of p and of p * size stay.

    Three fractional units at a time move along (s2 - s3, s3 - s1, s1 - s2), which the constraints' rows (1, 1, 1)
    and (s1, s2, s3) annul (units of equal size: along (1, -1, 0)), up or down until one is 0 or 1. `draw` has a
    number in [0, 1) for each unit, used when it is the first of the three; the direction's chance keeps expectations.
    """
    p, live = p.tolist(), []
    size, draw = size.tolist(), draw.tolist()
    for new in range(len(p)):
        if not 0.0 < p[new] < 1.0:
            continue
        live.append(new)
        if len(live) < 3:
            continue
        a, b, c = live
        move = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if not any(move):
            move = (1, -1, 0)
        up = down = math.inf
        for k, v in zip(live, move, strict=True):
            if v > 0:
                up, down = min(up, (1 - p[k]) / v), min(down, p[k] / v)
            elif v < 0:
                up, down = min(up, p[k] / -v), min(down, (1 - p[k]) / -v)
        step = up if draw[a] * (up + down) < down else -down
        for k, v in zip(live, move, strict=True):
            p[k] += step * v
            if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                p[k] = float(round(p[k]))
        live = [k for k in live if 0.0 < p[k] < 1.0]
        draw[live[0] if live else a] = (draw[a] * 7919 + draw[c]) % 1.0
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settle what is fractional after the last flight: of all ways the one nearest to the tokens, then the documents."""
    rest = np.flatnonzero((p > 0) & (p < 1))
    p = p.copy()
    if len(rest):
        tokens, units = float((p[rest] * size[rest]).sum()), float(p[rest].sum())
        ways = itertools.product((0.0, 1.0), repeat=len(rest))
        p[rest] = min(ways, key=lambda x: (round(abs(float(np.dot(x, size[rest])) - tokens), 6), abs(sum(x) - units), x))
    return p


def _fly(table):
    """One block's units after their flight; those of a source's only block have landed as well."""
    import pyarrow as pa

    columns = {name: table.column(name) for name in (ROW, "source", "size", "p", "h")}
    last = table.column("blocks")[0].as_py() == 1
    size, h = columns["size"].to_numpy(), columns["h"].to_numpy()
    # an order that rows have by themselves, whatever order they arrive in
    order = np.lexsort((columns[ROW].to_numpy(), size, h))
    if last:  # short documents last: what has to land is small
        order = order[np.argsort(-size[order], kind="stable")]
    draw = (h[order].view(np.uint64) >> np.uint64(11)).astype(np.float64) / 2.0**53
    p = flight(columns["p"].to_numpy()[order], size[order].astype(np.float64), draw)
    if last:
        p = landing(p, size[order].astype(np.float64))
    return pa.table({name: column.take(pa.array(order)) for name, column in columns.items()} | {"p": pa.array(p)})


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, most: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Each row with its source's figures and `whole`, how often it is taken for certain; the ROWs that are taken once more."""
    text = F.col(text_col).cast("string")
    rows = with_row(docs).select(ROW, F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("print"))
    sized = materialize(rows, "mix-sized")
    goal = materialize(targets(sized, weights, share, most), "mix-targets")
    dealt = sized.join(_shares(goal), sized.source.eqNullSafe(goal.source)).drop(goal.source)
    h = F.xxhash64("id", "size", "print", F.when(F.col("id").isNull(), F.col(ROW)))
    units = dealt.select(ROW, "source", "size", "p", h.alias("h"), F.ceil(F.col("n") / block).alias("blocks")).where("p > 0")
    extra: DataFrame | None = None
    while True:
        key = F.pmod(F.shiftrightunsigned("h", 20), F.col("blocks"))
        flown = materialize(units.withColumn("block", key).groupBy("source", "block").applyInArrow(_fly, _UNIT), "mix-flight")
        taken = flown.where("p = 1").select(ROW)
        extra = taken if extra is None else extra.unionByName(taken)
        left = flown.where("p > 0 AND p < 1")
        counts = materialize(left.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")), "mix-left")
        if counts.isEmpty():
            return dealt, extra
        units = left.withColumn("h", F.xxhash64("h")).join(counts, left.source.eqNullSafe(counts.source)).drop(counts.source)


def _shares(goal: DataFrame) -> DataFrame:
    """targets() with `whole`, the floor of target / size, and `p`, the rest."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return goal.withColumn("whole", F.floor(ratio + 1e-12).cast("long")).withColumn("p", F.greatest(ratio - F.col("whole"), F.lit(0.0)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """ROW, id, size, source_size, target, copies and taken (copies * size) for each row of `docs`.

    A null text has the size 0; null is a source of its own, the last. Rows are drawn by hashes of their ids and texts,
    those without an id also by their place in the files, so reruns on the same files agree; repeated rows are units
    of their own, ties in a block go by the place. An empty table gives no rows. A source of few or long documents can
    only come as near to its target as whole documents allow; a text of any length is one unit.
    """
    dealt, extra = _plan(docs, id_col, text_col, source_col, weights, share, most, block)
    copies = F.col("whole") + F.when(F.col("taken_row").isNotNull(), 1).otherwise(0)
    return dealt.join(extra.withColumnRenamed(ROW, "taken_row"), F.col(ROW) == F.col("taken_row"), "left").select(ROW, "id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of `docs` as often as mix() takes it, with all columns; rows that it takes 0 times go.

    Rules as in mix(). A source decides how often its rows are taken for certain, so only the ROWs of those that are
    taken once more are joined: where they are few they are sent along and no text moves.
    """
    docs = with_row(docs)
    mark = folders()
    dealt, extra = _plan(docs, id_col, text_col, source_col, WEIGHTS, SHARE, MOST, BLOCK)
    whole = materialize(dealt.select(F.col("source").alias(f"{ROW}_source"), F.col("whole").alias(f"{ROW}_whole")).distinct(), "mix-shares")
    extra = materialize(extra.withColumnRenamed(ROW, f"{ROW}_extra"), "mix-extra")
    release(docs.sparkSession, mark, whole, extra)
    rows = docs.join(whole, F.col(source_col).cast("string").eqNullSafe(F.col(f"{ROW}_source"))).join(extra, F.col(ROW) == F.col(f"{ROW}_extra"), "left")
    copies = F.col(f"{ROW}_whole") + F.when(F.col(f"{ROW}_extra").isNotNull(), 1).otherwise(0)
    return rows.withColumn(f"{ROW}_copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).drop(ROW, *(f"{ROW}_{x}" for x in ("source", "whole", "extra", "copy")))

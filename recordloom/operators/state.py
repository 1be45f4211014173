"""Keyed state: caches with expiry, work that is left, translation memories."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DAY = 86400
#: Seconds that entries of each kind live, by status; None is every other status.
EXPIRY = {
    "abstract": {"abstract_found": 365 * _DAY, "fetch_failed": _DAY, "parse_failed": _DAY, None: 7 * _DAY},
    "verification": {"unavailable": 3600, "unverified": 7 * _DAY, None: 30 * _DAY},
    "full_text": {"ok": 180 * _DAY, None: _DAY},
}


def key(*parts: Column) -> Column:
    """A digest of parts; blanks and nulls are told from each other's neighbours by their lengths."""
    return F.sha2(F.concat_ws("|", *(F.concat(F.length(F.coalesce(p.cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p.cast("string"), F.lit(""))) for p in parts)), 256)


def latest(entries: DataFrame, key_: str, *order: str) -> DataFrame:
    """The last entry of each key. An aggregate, so a hot key's entries meet after partial maxima."""
    rest = [c for c in entries.columns if c != key_]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return entries.groupBy(key_).agg(best.alias("__e")).select(key_, "__e.*")


def lifetime(kind: str, status: Column) -> Column:
    rules = EXPIRY[kind]
    out = F.lit(rules[None])
    for name, seconds in rules.items():
        if name is not None:
            out = F.when(status == name, seconds).otherwise(out)
    return out


def alive(entries: DataFrame, kind: str, saved_at: str, status: str, now: Column) -> DataFrame:
    """Entries that haven't expired; saved_at and now are seconds."""
    return entries.where(now - F.col(saved_at) <= lifetime(kind, F.col(status)))


def missing(work: DataFrame, entries: DataFrame, key_: str) -> DataFrame:
    """Work whose key has no entry."""
    return work.join(entries.select(key_).distinct(), key_, "left_anti")


def hits(work: DataFrame, entries: DataFrame, key_: str, *values: str) -> DataFrame:
    """Work with the values of its key's entry. Of repeated entries the least counts; latest() chooses by time before."""
    return work.join(entries.groupBy(key_).agg(F.min(F.struct(*values)).alias("__e")).select(key_, "__e.*"), key_)


def translated(texts: DataFrame, column: str, memory: DataFrame, translate: Callable[[list[str]], list[str]], batch: int = 25) -> DataFrame:
    """text, translated and error of the distinct texts that a memory (text) lacks, by a service's function.

    One partition asks, so that a service's limits hold; a text that fails has its error and no translation, and the
    others go on.
    """
    wanted = texts.select(F.trim(split_translation(F.col(column))[0]).alias("text")).where("text <> ''").distinct().join(memory.select("text").distinct(), "text", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            all_ = rows["text"].tolist()
            for at in range(0, len(all_), batch):
                some = all_[at : at + batch]
                try:
                    found, error = translate(some), None
                except Exception as refused:  # noqa: BLE001  (a service's error becomes a row's)
                    found, error = list(getattr(refused, "done", [])), str(refused)
                found += [None] * (len(some) - len(found))
                yield pd.DataFrame({"text": some, "translated": found, "error": [error if t is None else None for t in found]}, dtype=object)

    return wanted.coalesce(1).mapInPandas(run, "text string, translated string, error string")


def split_translation(cell: Column) -> tuple[Column, Column]:
    """The original and the bracketed translation at a cell's end; a bracketed number is a citation, not a translation."""
    text = F.coalesce(cell, F.lit(""))
    inner = F.regexp_extract(text, r"(?s)^(.*\S)\s*\[([^\[\]]+)\]\s*$", 2)
    has = (inner != "") & ~inner.rlike(r"^[\d\s,;–-]+$")
    return F.when(has, F.regexp_extract(text, r"(?s)^(.*\S)\s*\[([^\[\]]+)\]\s*$", 1)).otherwise(text), F.when(has, inner).otherwise("")


def translate_cells(df: DataFrame, column: str, memory: DataFrame, language: Column, target: str, overwrite: bool = False) -> DataFrame:
    """The column as `original [translation]` and <column>_status.

    Statuses: empty, already_target, already_translated, translated, missing. `memory` has text and translated; an
    echo of the original adds nothing.
    """
    original, old = split_translation(F.col(column))
    known = memory.select(F.col("text").alias("__text"), F.col("translated").alias("__new")).groupBy("__text").agg(F.min("__new").alias("__new"))
    rows = df.withColumn("__text", F.trim(original)).withColumn("__old", old).join(known, "__text", "left")
    status = (
        F.when(F.col("__text") == "", "empty")
        .when(F.coalesce(F.lower(F.substring_index(language, "-", 1)) == target.split("-")[0].lower(), F.lit(False)), "already_target")
        .when((F.col("__old") != "") & F.lit(not overwrite), "already_translated")
        .when(F.col("__new").isNotNull(), "translated")
        .otherwise("missing")
    )
    echo = F.lower(F.trim("__new")) == F.lower(F.col("__text"))
    value = F.when((F.col("__s") == "translated") & ~echo, F.concat("__text", F.lit(" ["), F.trim("__new"), F.lit("]"))).otherwise(F.col(column))
    return rows.withColumn("__s", status).withColumn(column, value).withColumnRenamed("__s", f"{column}_status").drop("__text", "__old", "__new")

"""Binding roles to columns, priority lookups, flattening and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.cells import blank_to_null, clean, first_filled

#: Names of a role's column, in order of preference.
ALIASES = {
    "title": ("title", "item title", "paper title", "标题", "题名"), "author": ("author", "authors", "creator", "作者"), "year": ("publication year", "year", "date", "年份", "出版年"), "doi": ("doi",), "url": ("url", "link", "链接"),
    "note": ("notes", "note", "备注"), "abstract": ("abstract note", "abstract", "summary", "摘要"), "keywords": ("manual tags", "keywords", "keyword", "tags", "tag", "关键词"), "item_type": ("item type", "type", "类型"),
}


def guess_column(columns: list[str], aliases: tuple[str, ...]) -> str | None:
    """The column named like the first alias that any is named like, else the first that contains an alias."""
    folded = [(c.strip().casefold(), c) for c in columns]
    for alias in aliases:
        for name, column in folded:
            if name == alias.casefold():
                return column
    return next((column for name, column in folded if any(a.casefold() in name for a in aliases)), None)


def bind(df: DataFrame, roles: tuple[str, ...] = tuple(ALIASES)) -> dict[str, str | None]:
    """The column of each role; names only, no data is read."""
    return {role: guess_column(df.columns, ALIASES[role]) for role in roles}


def value_of(df: DataFrame, *names: str) -> Column:
    """The first filled cell of the names: each as it is, then in any case."""
    cells = []
    for name in names:
        cells += [c for c in dict.fromkeys([*(c for c in df.columns if c == name), *(c for c in df.columns if c.casefold() == name.casefold())])]
    return first_filled(*(F.col(f"`{c}`") for c in cells))


def flatten(df: DataFrame, column: str, prefix: str = "", sign: str = "; ") -> DataFrame:
    """A struct's fields as columns, its lists joined."""
    fields = df.schema[column].dataType.fields
    cells = [(F.array_join(F.col(column)[f.name].cast("array<string>"), sign) if isinstance(f.dataType, T.ArrayType) else F.col(column)[f.name]).alias(prefix + f.name) for f in fields]
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c != column), *cells)


def drop_blank(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without those of the columns that no row fills."""
    filled = df.agg(*(F.max(clean(F.col(f"`{c}`")) != "").alias(str(i)) for i, c in enumerate(columns))).first()
    return df.drop(*(c for i, c in enumerate(columns) if not filled[str(i)]))


def common_columns(a: DataFrame, b: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Columns of both in A's order, of A alone, of B alone."""
    return [c for c in a.columns if c in b.columns], [c for c in a.columns if c not in b.columns], [c for c in b.columns if c not in a.columns]


def overlay_reviews(df: DataFrame, key: str, reviews: DataFrame, order: str | None = None) -> DataFrame:
    """Rows with status and decision by `reviews` (key, choice): accepted and not_accepted change the status, else it stays.

    Of a key's repeated reviews the last by `order` counts, without one the least choice, so no row is repeated.
    """
    choice = F.max_by("choice", order) if order else F.min("choice")
    marks = reviews.groupBy(key).agg(choice.alias("__choice"))
    joined = df.join(marks, key, "left")
    status = F.when(F.col("__choice") == "Accepted", "accepted").when(F.col("__choice") == "Not accepted", "not_accepted").otherwise(F.col("status"))
    decision = F.when(F.col("__choice") == "Accepted", "Approved").when(F.col("__choice") == "Not accepted", "Rejected")
    return joined.withColumn("status", status).withColumn("decision", decision).drop("__choice")


def first_undecided(df: DataFrame, row: str, decision: str) -> DataFrame:
    """One row: the least place without a decision."""
    return df.where(blank_to_null(F.col(decision)).isNull()).agg(F.min(row).alias(row))


def status_counts(df: DataFrame, status: str, total: tuple[str, ...] = ()) -> DataFrame:
    """status and n, and the number of rows in any of `total` as a row of its own."""
    counts = df.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    if not total:
        return counts
    return counts.unionByName(df.agg(F.count_if(F.col(status).isin(*total)).alias("n")).select(F.lit("total").alias("status"), "n"))


def differing(diff: DataFrame, status: str | None = None, field: str | None = None, title: str = "") -> DataFrame:
    """Rows of a pair diff by status, differing field and part of the title."""
    out = diff if status is None else diff.where(F.col("status") == status)
    out = out if field is None else out.where(F.array_contains("differences", field))
    return out.where(F.contains(F.lower("title"), F.lit(title.lower()))) if title else out


def duration(seconds: float) -> str:
    """h:mm:ss."""
    whole = int(seconds)
    return f"{whole // 3600}:{whole // 60 % 60:02d}:{whole % 60:02d}"

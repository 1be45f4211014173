"""Profiles of record tables: column kinds, counts, cross-tables, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.cells import clean, number, split_profile

#: Shares and bounds by which a column's kind is told.
TAG_SHARE, NUMBER_SHARE, YEARS, MOST_CATEGORIES, CATEGORY_RATIO = 0.1, 0.9, (1900, 2100), 50, 0.5
CHARTS = {"categorical": ("Bar chart", "Pie chart", "Table only"), "multi_tag": ("Bar chart", "Pie chart", "Table only"), "year": ("Bar chart", "Pie chart", "Table only"), "numeric": ("Histogram", "Table only")}


def charts_for(kind: str) -> tuple[str, ...]:
    return CHARTS.get(kind, ("Table only",))


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value for each filled cell of the columns, in one scan."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), clean(F.col(f"`{c}`")).alias("value")) for c in columns))
    return df.select(F.inline(pairs)).where("value <> ''")


def _kind() -> Column:
    return (
        F.when(F.col("n") == 0, "empty")
        .when(F.col("tagged") >= TAG_SHARE * F.col("n"), "multi_tag")
        .when((F.col("numbers") >= NUMBER_SHARE * F.col("n")) & (F.col("years") >= NUMBER_SHARE * F.col("numbers")) & (F.col("whole") >= NUMBER_SHARE * F.col("numbers")), "year")
        .when(F.col("numbers") >= NUMBER_SHARE * F.col("n"), "numeric")
        .when((F.col("values") <= MOST_CATEGORIES) & (F.col("values") <= CATEGORY_RATIO * F.col("n")), "categorical")
        .otherwise("text")
    )


def _kinds(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The columns' distinct values with their numbers of cells, and kind, n and values of each column with filled cells."""
    values = _cells(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("k"))
    x = number(F.col("value"))
    weigh = lambda test: F.coalesce(F.sum(F.when(test, F.col("k"))), F.lit(0))
    stats = values.groupBy("column").agg(
        F.sum("k").alias("n"),
        F.count(F.lit(1)).alias("values"),
        weigh(F.col("value").rlike("[;,]")).alias("tagged"),
        weigh(x.isNotNull()).alias("numbers"),
        weigh(x.between(*YEARS)).alias("years"),
        weigh(x % 1 == 0).alias("whole"),
    )
    return values, stats.withColumn("kind", _kind())


def kinds_of(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The kind of each column, all in one job."""
    found = {r.column: r.kind for r in _kinds(df, columns)[1].select("column", "kind").collect()}
    return {c: found.get(c, "empty") for c in columns}


def summarize(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, kind, non_empty, non_empty_pct, unique_values for each column.

    Equal cells of a column are counted first, so the rest works on distinct values; tags of multi-tag columns are
    counted from those.
    """
    columns = columns or df.columns
    total = df.count()
    values, kinds = _kinds(df, columns)
    tags = values.join(kinds.where("kind = 'multi_tag'").select("column"), "column").select("column", F.explode(split_profile(F.col("value"))).alias("tag")).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("tags"))
    named = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(columns)], "column string, place int")
    return (
        named.join(kinds, "column", "left")
        .join(tags, "column", "left")
        .select(
            "column",
            F.coalesce("kind", F.lit("empty")).alias("kind"),
            F.coalesce("n", F.lit(0)).cast("long").alias("non_empty"),
            (F.coalesce("n", F.lit(0)) / max(total, 1)).cast("double").alias("non_empty_pct"),
            F.when(F.col("kind") == "multi_tag", F.coalesce("tags", F.lit(0))).otherwise(F.coalesce("values", F.lit(0))).cast("long").alias("unique_values"),
        )
    )


def kind_of(df: DataFrame, column: str) -> str:
    return kinds_of(df, [column])[column]


def _exploded(df: DataFrame, column: str, kind: str, name: str, *keep: str) -> DataFrame:
    cell = F.col(f"`{column}`")
    parts = split_profile(cell) if kind == "multi_tag" else F.filter(F.array(clean(cell)), lambda x: x != "")
    return df.select(*keep, F.explode(parts).alias(name))


def value_counts(df: DataFrame, column: str, kind: str | None = None) -> DataFrame:
    """value and n; cells of multi-tag columns count each tag."""
    return _exploded(df, column, kind or kind_of(df, column), "value").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def by_key(counts: DataFrame) -> DataFrame:
    """Counts in the order of their values: numbers first, by size."""
    return counts.orderBy(number(F.col("value")).asc_nulls_last(), "value")


def with_share(counts: DataFrame) -> DataFrame:
    """Counts with their share of the sum of all counts."""
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).withColumn("share", (F.col("n") / F.col("total")).cast("double")).drop("total")


def top_and_other(counts: DataFrame, most: int = 8) -> DataFrame:
    """The `most` most frequent values, and `Other` for the rest."""
    ranked = counts.orderBy(F.desc("n"), "value").limit(most)
    rest = counts.join(ranked.select("value"), "value", "left_anti").agg(F.sum("n").alias("n")).where("n IS NOT NULL").select(F.lit("Other").alias("value"), "n")
    return ranked.unionByName(rest)


def cross_table(df: DataFrame, row: str, column: str, row_kind: str | None = None, column_kind: str | None = None) -> DataFrame:
    """row_value, col_value, n of all pairs of a record's values, rows without either left out."""
    first, second = F.col(f"`{row}`"), F.col(f"`{column}`")
    split = lambda cell, kind: split_profile(cell) if kind == "multi_tag" else F.filter(F.array(clean(cell)), lambda x: x != "")
    kinds = {row: row_kind, column: column_kind}
    kinds |= kinds_of(df, [c for c, kind in kinds.items() if not kind]) if None in kinds.values() else {}
    pairs = df.select(split(first, kinds[row]).alias("a"), split(second, kinds[column]).alias("b"))
    return pairs.select(F.explode("a").alias("row_value"), "b").select("row_value", F.explode("b").alias("col_value")).groupBy("row_value", "col_value").agg(F.count(F.lit(1)).alias("n"))


def sparse_rows(table: DataFrame) -> DataFrame:
    """A cross table's cells, the most frequent first, then by their labels."""
    return table.where("n > 0").orderBy(F.desc("n"), "row_value", "col_value")


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin, lower, upper, n of equal-width bins; the last bin has its upper edge, empty bins are there too.

    Cells that aren't numbers are left out; equal values make a range of half a unit to either side.
    """
    x = df.select(number(F.col(f"`{column}`")).alias("x")).where("x IS NOT NULL")
    low, high = x.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n long")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    counted = x.groupBy(F.least(F.width_bucket("x", F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", (F.lit(low) + (F.col("bin") - 1) * width).alias("lower"), (F.lit(low) + F.col("bin") * width).alias("upper"), F.coalesce("k", F.lit(0)).cast("long").alias("n"))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the last in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")

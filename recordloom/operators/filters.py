"""Typed conditions on record tables."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.cells import clean, fold, number
from recordloom.operators.schema import drop_blank

NUMERIC = {">": lambda x, v: x > v, ">=": lambda x, v: x >= v, "<": lambda x, v: x < v, "<=": lambda x, v: x <= v, "=": lambda x, v: x == v, "!=": lambda x, v: x != v}
TEXT = ("equals", "not equals", "contains", "does not contain", "is blank", "is not blank")


def condition(cell: Column, operator: str, value: str = "", upper: str = "") -> Column:
    """A predicate that is never null: a cell that isn't a number fails every numeric condition, `!=` too."""
    if operator in NUMERIC or operator == "between":
        x, v = number(cell), F.lit(float(value))
        found = x.between(v, F.lit(float(upper))) if operator == "between" else NUMERIC[operator](x, v)
        return F.coalesce(found, F.lit(False))
    if operator not in TEXT:
        raise ValueError(f"unknown operator: {operator}")
    text, target = fold(clean(cell)), fold(clean(F.lit(str(value))))
    return {
        "equals": text == target, "not equals": text != target, "contains": F.contains(text, target),
        "does not contain": ~F.contains(text, target), "is blank": text == "", "is not blank": text != "",
    }[operator]


def filter_records(df: DataFrame, conditions: list[tuple[str, str, str, str]], mode: str = "AND") -> DataFrame:
    """Rows that pass all (AND) or any (OR) of the conditions (column, operator, value, upper); none: all rows."""
    for name, *_ in conditions:
        if name not in df.columns:
            raise KeyError(f"column not found: {name}")
    if not conditions:
        return df
    return df.where(reduce(or_ if mode.upper() == "OR" else and_, [condition(F.col(f"`{c}`"), op, v, u) for c, op, v, u in conditions]))


def numeric_share(cell: Column) -> Column:
    """An aggregate: the share of numbers among the cells that aren't blank."""
    return F.avg(F.when(clean(cell) != "", number(cell).isNotNull().cast("int")))


def is_numeric(df: DataFrame, column: str, least: float = 0.8) -> bool:
    return (df.agg(numeric_share(F.col(f"`{column}`"))).first()[0] or 0) >= least


def project(df: DataFrame, columns: list[str], conditions=(), mode: str = "AND") -> DataFrame:
    """Filter, then the columns in order; no columns is an error."""
    if not columns:
        raise ValueError("no columns selected")
    return filter_records(df, list(conditions), mode).select(*(F.col(f"`{c}`") for c in columns))


def page(df: DataFrame, order: list[Column], number_: int, size: int = 100) -> DataFrame:
    """Rows of one page in the given order, the first page being 1."""
    return df.orderBy(*order).offset(max(number_ - 1, 0) * size).limit(size)


def operators_for(df: DataFrame, columns: list[str]) -> dict[str, tuple[str, ...]]:
    """The operators that each column's cells allow: numeric ones for a numeric column, else those of texts; one job for all."""
    shares = df.agg(*(numeric_share(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(columns))).first()
    return {c: (*NUMERIC, "between") if (shares[i] or 0) >= 0.8 else TEXT for i, c in enumerate(columns)}


def filter_by_kind(df: DataFrame, conditions: list[tuple[str, str, str, str]], mode: str = "AND") -> DataFrame:
    """filter_records() with the operators that the columns' kinds allow; another one is an error before any row is read for the result."""
    if unknown := [c for c, *_ in conditions if c not in df.columns]:
        raise KeyError(f"column not found: {unknown[0]}")
    allowed = operators_for(df, list(dict.fromkeys(c for c, *_ in conditions))) if conditions else {}
    for name, operator, *_ in conditions:
        if operator not in allowed[name]:
            raise ValueError(f"{name} doesn't take the operator {operator}")
    return filter_records(df, conditions, mode)


def export_frame(df: DataFrame, columns: list[str] | None = None, review: tuple[str, ...] = (), conditions=(), mode: str = "AND") -> DataFrame:
    """The filtered rows with the ticked columns (None: all), without those review columns that none of these rows fills."""
    frame = project(df, list(df.columns) if columns is None else columns, conditions, mode)
    return drop_blank(frame, [c for c in review if c in frame.columns])

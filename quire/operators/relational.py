"""A strict single-table SELECT on DataFrames.

The pieces refuse what they cannot answer exactly: names that are ambiguous, comparisons
across classes, sums of text, columns that are neither grouped nor aggregated. Nulls sort
last ascending and first descending, ties keep the input order, groups come in order of
first appearance where an input order is given.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.cells import ClassMismatch, comparable, comparison_class, sort_key


class UnknownName(ValueError):
    """No column, or more than one, answers to a name."""


class NotAggregated(ValueError):
    """A column is neither grouped nor aggregated, or an aggregate does not fit its column."""


def resolve(df: DataFrame, name: str, quoted: bool = False) -> str:
    """The column that a name means: exact if quoted; else exact in upper case or as written, else the only one but for case."""
    if name in df.columns or quoted:
        if name not in df.columns:
            raise UnknownName(f"no column {name!r}; there are {', '.join(df.columns)}")
        return name
    if name.upper() in df.columns:
        return name.upper()
    found = [c for c in df.columns if c.lower() == name.lower()]
    if len(found) != 1:
        raise UnknownName(f"{name!r} is {'ambiguous' if found else 'unknown'}; there are {', '.join(df.columns)}")
    return found[0]


def _class_of(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    return "numeric" if isinstance(value, (int, float)) else "text"


def _side(df: DataFrame, name: str, *values: Any) -> Column:
    """A column as it compares, after a check that the values are of its class."""
    column = resolve(df, name)
    kind = df.schema[column].dataType
    for value in values:
        if value is not None and _class_of(value) != comparison_class(kind):
            raise ClassMismatch(f"{column} is {comparison_class(kind)}, {value!r} is {_class_of(value)}")
    return comparable(F.col(column), kind)


def compare(df: DataFrame, name: str, op: str, value: Any) -> Column:
    """=, <>, <, >, <= or >= with a literal; unknown where either is null."""
    side, other = _side(df, name, value), F.lit(value)
    return {"=": side == other, "<>": side != other, "<": side < other, ">": side > other, "<=": side <= other, ">=": side >= other}[op]


def between(df: DataFrame, name: str, low: Any, high: Any, negate: bool = False) -> Column:
    """Inclusive range; dates are compared as ISO text."""
    found = _side(df, name, low, high).between(F.lit(low), F.lit(high))
    return ~found if negate else found


def in_list(df: DataFrame, name: str, values: Sequence[Any], negate: bool = False) -> Column:
    """Membership; a null in the list makes a miss unknown."""
    found = _side(df, name, *values).isin(*[F.lit(v) for v in values])
    return ~found if negate else found


def like(df: DataFrame, name: str, pattern: str, negate: bool = False) -> Column:
    """% and _ as wildcards, every other character as itself, backslash included; case counts."""
    found = _side(df, name, "").like(pattern.replace("\\", "\\\\"))
    return ~found if negate else found


def _aggregate(df: DataFrame, function: str, name: str) -> Column:
    if name == "*":
        if function != "COUNT":
            raise NotAggregated(f"{function}(*) has no meaning")
        return F.count(F.lit(1))
    column = resolve(df, name)
    kind = df.schema[column].dataType
    if function in ("SUM", "AVG"):
        if comparison_class(kind) != "numeric":
            raise NotAggregated(f"{function}({column}) needs numbers")
        return {"SUM": F.sum, "AVG": F.avg}[function](F.col(column).cast("double"))
    if function == "COUNT":
        return F.count(column)
    best = {"MIN": F.min_by, "MAX": F.max_by}[function]
    return best(F.col(column), sort_key(F.col(column), kind)) if comparison_class(kind) == "text" else {"MIN": F.min, "MAX": F.max}[function](column)


def select(
    df: DataFrame,
    columns: Sequence[str | tuple[str, str]] = ("*",),
    where: Column | None = None,
    group_by: Sequence[str] = (),
    order_by: Sequence[tuple[str, str]] = (),
    input_order: Sequence[str] = (),
) -> DataFrame:
    """SELECT columns FROM df WHERE where GROUP BY group_by ORDER BY order_by.

    columns are names, or (function, name) for COUNT, SUM, AVG, MIN and MAX, labelled as in
    COUNT(*). input_order names columns that give the input's order; it breaks ties and, for
    groups, gives the order of first appearance. A global aggregate has one row even without
    input.
    """
    rows = df if where is None else df.where(where)
    ties = [resolve(df, c) for c in input_order]
    aggregates = [c for c in columns if isinstance(c, tuple)]
    if not aggregates and not group_by:
        named = df.columns if list(columns) == ["*"] else [resolve(df, c) for c in columns]
        return _ordered(rows, order_by, [F.col(c) for c in ties]).select(*named)
    keys = [resolve(df, g) for g in group_by]
    plain = [c for c in columns if not isinstance(c, tuple)]
    if "*" in plain or any(resolve(df, c) not in keys for c in plain) or any(resolve(df, n) not in keys for n, _ in order_by):
        raise NotAggregated("a column is neither grouped nor aggregated")
    made = [_aggregate(df, f, n).alias(f"{f}({n})") for f, n in aggregates]
    first = [F.min(F.struct(*ties)).alias("_first")] if ties else []
    if not keys:
        return rows.agg(*made)
    grouped = rows.groupBy(*keys).agg(*made, *first)
    labels = [c if isinstance(c, str) else f"{c[0]}({c[1]})" for c in columns]
    out = _ordered(grouped, order_by, [F.col("_first")] if ties else [])
    return out.select(*(F.col(f"`{x}`" if "(" in x else resolve(df, x)) for x in labels))


def order_columns(df: DataFrame, order_by: Sequence[tuple[str, str]]) -> list[Column]:
    """Sort columns: nulls last ascending, first descending, text by UTF-16 code units."""
    out = []
    for name, direction in order_by:
        column = resolve(df, name)
        key = sort_key(F.col(column), df.schema[column].dataType)
        out.append(key.desc_nulls_first() if direction.upper() == "DESC" else key.asc_nulls_last())
    return out


def _ordered(df: DataFrame, order_by: Sequence[tuple[str, str]], ties: list[Column]) -> DataFrame:
    keys = order_columns(df, order_by)
    return df.orderBy(*keys, *ties) if keys or ties else df

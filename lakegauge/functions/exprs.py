"""Small column-expression helpers shared by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

KEYS = ["table_name", "column_name"]


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(column: Column, tokens) -> Column:
    """True if the column contains one of the tokens as a substring."""
    return any_of(column.contains(t) for t in tokens)


def first_rule(column: Column, rules, default: str) -> Column:
    """Label of the first ``(label, tokens)`` rule with a token inside the column."""
    label = F.lit(default)
    for name, tokens in reversed(list(rules)):
        label = F.when(contains_any(column, tokens), F.lit(name)).otherwise(label)
    return label


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100``; NULL when the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def fixed(value: Column, places: int = 1) -> Column:
    """Number as text with fixed decimals; exact halves go to the even digit."""
    return F.format_string(f"%.{places}f", F.bround(value.cast("double"), places))


def ordered_names(flag: Column, name: str = "column_name", order: str = "ordinal") -> Column:
    """Aggregate: the flagged names of a group as a comma list, in column order.

    Groups are the columns of one table, so the list is bounded by its schema.
    """
    picked = F.collect_list(F.when(flag, F.struct(F.col(order), F.col(name))))
    return F.array_join(F.transform(F.array_sort(picked), lambda s: s[name]), ", ")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.CharType, T.VarcharType))


def is_temporal(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def fields_of(df: DataFrame, columns=None, kind=None) -> list[T.StructField]:
    wanted = None if columns is None else set(columns)
    return [f for f in df.schema.fields
            if (wanted is None or f.name in wanted) and (kind is None or kind(f))]


def clean(field: T.StructField) -> Column:
    """The column with NaN as NULL and -0.0 as 0.0; other types unchanged."""
    c = quoted(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c + F.lit(0.0).cast(field.dataType))
    return c

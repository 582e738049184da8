"""Result sinks: nested JSON / Parquet, and flat CSV of recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def write_result(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Write a result table; every task writes its own part file."""
    if fmt == "csv":
        df = flat(df)
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def write_partitioned(df: DataFrame, path: str, columns: list[str], fmt: str = "parquet",
                      mode: str = "errorifexists") -> None:
    """Write a table with one folder per combination of values of the columns.

    Rows of a partition come together first, so that it gets few files; adaptive
    execution splits partitions that are larger than a task should be.
    """
    df.hint("rebalance", *columns).write.mode(mode).partitionBy(*columns).format(fmt).save(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that CSV can hold them."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[
        (F.to_json(f.name) if isinstance(f.dataType, nested) else F.col(f.name)).alias(f.name)
        for f in df.schema.fields])

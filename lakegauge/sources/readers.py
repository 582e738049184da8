"""Table scans, column subsets, samples and table selection."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, location: str, fmt: str = "parquet") -> DataFrame:
    """Lazy scan of one table; filters and columns are pushed to the reader."""
    return spark.read.format(fmt).load(location)


def read_lake(spark: SparkSession, directory: str, tables, fmt: str = "parquet") -> dict[str, DataFrame]:
    return {name: read_table(spark, f"{directory}/{name}.{fmt}", fmt) for name in tables}


def column_subset(df: DataFrame, columns) -> DataFrame:
    """Only the named columns, in table order; unknown names are ignored."""
    wanted = set(columns)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in wanted])


def head_sample(df: DataFrame, order_by, limit: int = 10_000) -> DataFrame:
    """Deterministic head sample (planned as a distributed top-n, not a full sort)."""
    return df.orderBy(*order_by).limit(limit)


def random_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Opt-in Bernoulli sample with a fixed seed."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def spread(df: DataFrame, partitions: int) -> DataFrame:
    """Spread a table that arrives in fewer splits than there are cores (for example
    one file with one row group) before heavy per-row work.  Costs a shuffle of the
    selected columns; large tables have splits enough and do not need it."""
    return df.repartition(partitions)


def table_selector(selection: str | None) -> str:
    """SQL regular expression for a comma list of names and ``*``/``?`` globs."""
    if not selection or selection.strip() in ("*", "all"):
        return ".*"
    parts = [p.strip() for p in selection.split(",") if p.strip()]
    return "|".join(re.escape(p).replace(r"\*", ".*").replace(r"\?", ".") for p in parts)


def select_tables(catalog: DataFrame, selection: str | None) -> DataFrame:
    """Catalog rows of the selected tables."""
    return catalog.where(F.col("table_name").rlike("^(?:" + table_selector(selection) + ")$"))


def quote(name: str) -> str:
    """A name as a quoted SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def session_tables(spark: SparkSession, database: str | None = None, selection: str | None = None) -> list[str]:
    """Names of the registered tables that match the selection (metadata only, no views)."""
    names = [t.name for t in spark.catalog.listTables(database) if t.tableType not in ("TEMPORARY", "VIEW")]
    if not selection or selection.strip() in ("*", "all"):
        return names
    globs = [p.strip() for p in selection.split(",")]
    return [n for n in names if any(fnmatch.fnmatchcase(n, g) for g in globs)]

"""Partition listings, formats, recency and row-count estimates.

Partition columns are ordinary columns for Spark: counts by a partition column of a
table written with ``partitionBy`` come from file footers, a filter on it skips the other
folders, and :func:`stored_partitions` lists the folders without opening a file.
Dates are parameters; nothing here reads the clock.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakegauge.functions import vocab
from lakegauge.functions.exprs import contains_any, quoted
from lakegauge.operators.catalog import file_listing

DAYS_IN_5_YEARS = 5 * 365
_PARSERS = {"YYYYMMDD": "yyyyMMdd", "YYYY-MM-DD": "yyyy-MM-dd", "YYYY-MM": "yyyy-MM"}


def partition_list(df: DataFrame, spec: str, first: int = 10) -> DataFrame:
    """Distinct partition specifications with row counts; ``listed`` marks the first ten."""
    parts = df.groupBy(quoted(spec).alias("partition")).agg(F.count(F.lit(1)).alias("row_count"))
    # the ten smallest names are picked by a top-n, not by ranking all partitions
    head = parts.select("partition").orderBy("partition").limit(first).withColumn("listed", F.lit(True))
    return (parts.join(F.broadcast(head), "partition", "left")
            .withColumn("listed", F.coalesce("listed", F.lit(False))))


def show_partitions(spark: SparkSession, table: str) -> DataFrame:
    """Partition specifications of a registered table (metadata only)."""
    return spark.sql(f"SHOW PARTITIONS {table}")


def stored_partitions(spark: SparkSession, location: str) -> DataFrame:
    """Partitions (``a=1/b=2``) below the folder of a table with files, bytes and time of the
    last change, from the file listing alone.

    Escaped characters of folder names are decoded; files outside any partition folder
    are left out, partitions without data files do not show.
    """
    folder = F.regexp_extract("path", "((?:/[^/=]+=[^/]*)+)/[^/]+$", 1)
    # folder names escape by percent signs only: a plus stays a plus
    name = F.url_decode(F.replace(F.substr(folder, F.lit(2)), F.lit("+"), F.lit("%2B")))
    return (file_listing(spark, {"": location}).where(folder != "").groupBy(name.alias("partition"))
            .agg(F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("size_bytes"),
                 F.max("modified_at").alias("last_modified")))


def partition_spec(columns: list[str]) -> Column:
    """The specification ``a=1/b=2`` of a row's partition; NULL as the writer names it."""
    null = F.lit("__HIVE_DEFAULT_PARTITION__")
    return F.concat_ws("/", *[F.concat(F.lit(c + "="), F.coalesce(quoted(c).cast("string"), null)) for c in columns])


def parse_partitions(parts: DataFrame, spec: str = "partition") -> DataFrame:
    """One row per partition and key of ``a=1/b=2`` texts, with date-key flag."""
    pieces = F.filter(F.split(F.col(spec), "/"), lambda p: p.contains("="))
    item = F.posexplode(pieces).alias("position", "piece")
    name = F.trim(F.split_part("piece", F.lit("="), F.lit(1)))
    return (parts.select(F.col(spec), *[c for c in parts.columns if c != spec], item)
            .withColumn("partition_column", name)
            .withColumn("value", F.trim(F.split_part("piece", F.lit("="), F.lit(2))))
            .withColumn("is_date", contains_any(F.lower("partition_column"), vocab.DATE_PARTITION_TOKENS))
            .drop("piece"))


def partition_format(value: Column) -> Column:
    """YYYYMMDD, YYYY-MM-DD or YYYY-MM by shape; anything else is unknown."""
    dashes = F.length(value) - F.length(F.replace(value, F.lit("-"), F.lit("")))
    return (F.when((F.length(value) == 8) & value.rlike(r"^\d+$"), "YYYYMMDD")
            .when((F.length(value) == 10) & (dashes == 2), "YYYY-MM-DD")
            .when(F.length(value) == 7, "YYYY-MM").otherwise("unknown"))


def partition_date(value: Column) -> Column:
    """Date of a partition value by its format; unreadable values are NULL."""
    shape = partition_format(value)
    out = F.lit(None).cast("date")
    for name, pattern in _PARSERS.items():
        text, full = (F.concat(value, F.lit("-01")), "yyyy-MM-dd") if name == "YYYY-MM" else (value, pattern)
        out = F.when(shape == name, F.try_to_timestamp(text, F.lit(full)).cast("date")).otherwise(out)
    return out


def recent_partitions(df: DataFrame, column: str, as_of: str, days: int = 30) -> DataFrame:
    """Partitions of the last ``days`` days before ``as_of`` with row counts and a
    five-year flag; unreadable dates are left out."""
    end = F.lit(as_of).cast("date")
    counts = df.groupBy(quoted(column).alias("date_value")).agg(F.count(F.lit(1)).alias("row_count"))
    return (counts.withColumn("partition_format", partition_format(F.col("date_value")))
            .withColumn("partition_date", partition_date(F.col("date_value")))
            .where(F.col("partition_date").isNotNull())
            .withColumn("is_recent", F.col("partition_date") >= F.date_sub(end, days))
            .withColumn("in_5_years", F.col("partition_date") >= F.date_sub(end, DAYS_IN_5_YEARS)))


def recent_values(as_of: str, shape: str, days: int = 7) -> list[str]:
    """Partition values of the last seven days, or the current month."""
    end = dt.date.fromisoformat(as_of)
    if shape == "YYYY-MM":
        return [end.strftime("%Y-%m")]
    pattern = "%Y%m%d" if shape == "YYYYMMDD" else "%Y-%m-%d"
    return [(end - dt.timedelta(days=i)).strftime(pattern) for i in range(days)]


def recent_sample(df: DataFrame, column: str, as_of: str, shape: str = "YYYYMMDD", days: int = 7) -> DataFrame:
    """Rows in the recent partitions; the literal list lets the scan skip the others."""
    values = recent_values(as_of, shape, days)
    period = f"last {len(values)} {'days' if len(values) > 1 else 'month'}"
    return df.where(quoted(column).isin(values)).agg(F.count(F.lit(1)).alias("recent_sample_count")).select(
        F.lit(column).alias("partition_column"), "recent_sample_count", F.lit(period).alias("sample_period"))


def row_count_estimate(df: DataFrame, column: str, as_of: str, shape: str = "YYYYMMDD", days: int = 7) -> DataFrame:
    """Estimated rows from recent partitions and the number of partitions in five years.

    Daily: mean of the sample days times partitions.  Monthly: current month times
    partitions / 60.  Other formats: latest partition times partitions.
    """
    parts = df.groupBy(quoted(column).alias("date_value")).agg(F.count(F.lit(1)).alias("row_count"))
    values = recent_values(as_of, shape, days)
    dated = parts.withColumn("d", partition_date(F.col("date_value")))
    start = F.date_sub(F.lit(as_of).cast("date"), DAYS_IN_5_YEARS)
    t = dated.agg(
        F.coalesce(F.sum(F.when(F.col("date_value").isin(values), F.col("row_count"))), F.lit(0)).alias("recent_sample_count"),
        F.count_if(F.coalesce(F.col("d") >= start, F.lit(False))).alias("partitions_in_5_years"),
        F.count(F.lit(1)).alias("partition_count"),
        F.max_by("row_count", "date_value").alias("latest_rows"))
    if shape in ("YYYYMMDD", "YYYY-MM-DD"):
        estimate = F.col("recent_sample_count") / F.lit(float(len(values))) * F.col("partitions_in_5_years")
    elif shape == "YYYY-MM":
        estimate = F.col("recent_sample_count") * (F.col("partitions_in_5_years") / 60)
    else:
        estimate = F.col("latest_rows") * F.col("partition_count")
    return t.select(F.lit(column).alias("partition_column"), F.lit(shape).alias("partition_format"), "recent_sample_count",
                    "partitions_in_5_years", "partition_count", F.floor(estimate).cast("bigint").alias("estimated_rows"))


def partition_like_columns(catalog: DataFrame) -> DataFrame:
    """Columns whose name looks like a partition key, for tables without a listing."""
    return catalog.where(contains_any(F.lower("column_name"), vocab.PARTITION_LIKE_TOKENS)).select(
        "table_name", "column_name", "row_count")

"""Date and timestamp column statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakegauge.functions.exprs import KEYS, fields_of, is_temporal, quoted


def instants(df: DataFrame, table: str, columns=None) -> DataFrame:
    """(table_name, column_name, ts): every present date or timestamp cell."""
    fields = fields_of(df, columns, is_temporal)
    if not fields:
        return (df.select(F.lit(table).alias("table_name"), F.lit("").alias("column_name"),
                          F.lit(None).cast("timestamp_ntz").alias("ts")).where(F.lit(False)))
    wide = df.select(*[quoted(f.name).cast("timestamp_ntz").alias(f.name) for f in fields])
    return (wide.unpivot([], [quoted(f.name) for f in fields], "column_name", "ts")
            .where(F.col("ts").isNotNull())
            .select(F.lit(table).alias("table_name"), "column_name", "ts"))


def range_label(days: Column) -> Column:
    """Day count in words: days, weeks (7), months (30) or years (365)."""
    def in_units(size, unit):
        return F.concat(F.floor(days / size).cast("string"), F.lit(f" {unit}"))
    return (F.when(days < 7, F.concat(days.cast("string"), F.lit(" days")))
            .when(days < 30, in_units(7, "weeks"))
            .when(days < 365, in_units(30, "months"))
            .when(days >= 365, in_units(365, "years")))


def date_range(instant_rows: DataFrame) -> DataFrame:
    """First and last instant, whole days between them, and the label."""
    days = F.timestamp_diff("DAY", F.col("start_date"), F.col("end_date"))
    return (instant_rows.groupBy(*KEYS)
            .agg(F.min("ts").alias("start_date"), F.max("ts").alias("end_date"))
            .withColumn("range_days", days)
            .withColumn("range_description", range_label(F.col("range_days"))))


PARTS = {
    # kind: (part of the timestamp, variation above which it is a pattern, description)
    "day_of_week": (lambda ts: F.weekday(ts), 0.5, "Significant variation by day of week"),
    "hour_of_day": (lambda ts: F.hour(ts), 0.5, "Significant variation by hour of day"),
    "monthly": (lambda ts: F.month(ts), 0.3, "Seasonal patterns detected"),
}


def part_counts(instant_rows: DataFrame, kinds=tuple(PARTS)) -> DataFrame:
    """(table_name, column_name, kind, bucket, n) for all calendar parts in one scan."""
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), PARTS[k][0](F.col("ts")).alias("bucket"))
                      for k in kinds])
    return (instant_rows.select(*KEYS, F.explode(parts).alias("part"))
            .groupBy(*KEYS, F.col("part.kind").alias("kind"), F.col("part.bucket").alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n")))


def temporal_variation(instant_rows: DataFrame, kinds=tuple(PARTS)) -> DataFrame:
    """Coefficient of variation of the bucket counts, and whether it is a pattern.

    Only buckets that occur count; a single bucket has no spread and is never a
    pattern.  The bucket map has at most 24 entries.
    """
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(PARTS[k][1])) for k in kinds])
    text = F.coalesce(*[F.when(F.col("kind") == k, F.lit(PARTS[k][2])) for k in kinds])
    entry = F.struct("bucket", "n")
    return (part_counts(instant_rows, kinds).groupBy(*KEYS, "kind")
            .agg(F.count(F.lit(1)).alias("buckets"),
                 F.try_divide(F.stddev_samp("n"), F.avg("n")).alias("variation"),
                 F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("data"))
            .withColumn("is_pattern", F.coalesce((F.col("variation") > limit) & (F.col("buckets") > 1), F.lit(False)))
            .withColumn("description", F.when(F.col("is_pattern"), text)))


def daily_distribution(df: DataFrame, date_column: str, start: str, end: str, days: int = 30) -> DataFrame:
    """Rows per day in an inclusive range, newest first, at most ``days`` days.

    The bounds are compared with the raw column so that the reader can use them.
    """
    c = quoted(date_column)
    after = F.date_add(F.lit(end).cast("date"), 1)
    return (df.where((c >= F.lit(start).cast("date")) & (c < after))
            .groupBy(F.to_date(c).alias("analysis_date"))
            .agg(F.count(F.lit(1)).alias("record_count"))
            .orderBy(F.desc("analysis_date")).limit(days))

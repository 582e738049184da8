"""Outliers by z-score, interquartile range and text length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lakegauge.functions.exprs import KEYS, percent
from lakegauge.operators.numeric import QUARTILES, moments, quantiles
from lakegauge.operators.values import length_summary


def _fold(flagged: DataFrame, kind: str, text: str, examples: int) -> DataFrame:
    """Count the flagged rows per column and keep a few extreme examples (none, if 0 are wanted).

    ``flagged`` holds distinct outlying values with counts; the rank filter is
    planned as a group limit before the shuffle, so no column is gathered.
    """
    if not examples:
        totals = flagged.groupBy(*KEYS).agg(F.sum("n").alias("count"), F.max("size").alias("size"))
        return totals.select(*KEYS, F.lit(kind).alias("type"), "count", percent(F.col("count"), F.col("size")).alias("percentage"),
                             F.lit(text).alias("description"), F.lit(None).cast("array<double>").alias("examples"))
    counted = flagged.groupBy(*KEYS, "v", "size", "distance").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*KEYS).orderBy(F.desc("distance"), F.asc("v"))
    best = (counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= examples)
            .groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "v"))),
                                            lambda s: s["v"]).alias("examples")))
    totals = counted.groupBy(*KEYS).agg(F.sum("n").alias("count"), F.max("size").alias("size"))
    return (totals.join(F.broadcast(best), KEYS)  # proven bound: one row per column
            .select(*KEYS, F.lit(kind).alias("type"), "count",
                    percent(F.col("count"), F.col("size")).alias("percentage"),
                    F.lit(text).alias("description"), "examples"))


def zscore_outliers(number_rows: DataFrame, stats: DataFrame | None = None,
                    threshold: float = 3.0, examples: int = 5) -> DataFrame:
    """Values more than ``threshold`` population standard deviations from the mean."""
    stats = moments(number_rows) if stats is None else stats
    bounds = stats.where(F.col("std_pop") > 0).select(
        *KEYS, "mean", "std_pop", F.col("non_null_count").alias("size"))
    z = F.abs(F.col("v") - F.col("mean")) / F.col("std_pop")
    flagged = (number_rows.join(F.broadcast(bounds), KEYS)  # proven bound: one row per column
               .where(z > threshold)
               .select(*KEYS, "v", "size", z.alias("distance"), F.lit(1).alias("n")))
    return _fold(flagged, "statistical_outliers", f"Values with Z-score > {threshold:g}", examples)


def iqr_outliers(number_rows: DataFrame, quartiles: DataFrame | None = None,
                 factor: float = 1.5, examples: int = 5) -> DataFrame:
    """Values below Q1 - 1.5 IQR or above Q3 + 1.5 IQR."""
    if quartiles is None:
        quartiles = quantiles(number_rows, QUARTILES, with_size=True)
    reach = (F.col("q3") - F.col("q1")) * factor
    bounds = quartiles.select(*KEYS, (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"),
                              F.col("non_null_count").alias("size"))
    v = F.col("v")
    flagged = (number_rows.join(F.broadcast(bounds), KEYS)  # proven bound: one row per column
               .where((v < F.col("low")) | (v > F.col("high")))
               .select(*KEYS, "v", "size", F.greatest(F.col("low") - v, v - F.col("high")).alias("distance"),
                       F.lit(1).alias("n")))
    return _fold(flagged, "iqr_outliers", f"Values outside {factor:g}*IQR from quartiles", examples)


def length_outliers(lengths: DataFrame, threshold: float = 2.0, examples: int = 5) -> DataFrame:
    """Text values whose length is more than ``threshold`` deviations from the mean.

    ``lengths`` are rows per length (``length_counts``), so neither texts nor rows
    are scanned again; the examples are the outlying lengths.
    """
    bounds = length_summary(lengths).where(F.col("std_pop_length") > 0).select(
        *KEYS, "avg_length", "std_pop_length", F.col("non_null").alias("size"))
    z = F.abs(F.col("length") - F.col("avg_length")) / F.col("std_pop_length")
    flagged = (lengths.join(F.broadcast(bounds), KEYS).where(z > threshold)
               .select(*KEYS, F.col("length").cast("double").alias("v"), "size", z.alias("distance"), "n"))
    return _fold(flagged, "length_outliers", "Values with unusual string length", examples)


def numeric_outliers(number_rows: DataFrame, profile: DataFrame, threshold: float = 3.0, factor: float = 1.5,
                     examples: int = 5) -> DataFrame:
    """Z-score and interquartile outliers of profiled columns in one scan.

    ``profile`` comes from ``numeric_profile``.  Without examples (0) outliers are only counted: no value is shuffled.
    """
    reach = (F.col("q3") - F.col("q1")) * factor
    bounds = profile.select(*KEYS, "mean", "std_pop", F.col("non_null_count").alias("size"),
                            (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    v = F.col("v")
    z = F.when(F.col("std_pop") > 0, F.abs(v - F.col("mean")) / F.col("std_pop"))
    beyond = F.greatest(F.col("low") - v, v - F.col("high"))
    hits = F.array_compact(F.array(
        F.when(z > threshold, F.struct(F.lit("z").alias("kind"), z.alias("distance"))),
        F.when(beyond > 0, F.struct(F.lit("i").alias("kind"), beyond.alias("distance")))))
    flagged = (number_rows.join(F.broadcast(bounds), KEYS)  # proven bound: one row per column
               .where((z > threshold) | (beyond > 0)).select(*KEYS, "v", "size", F.inline(hits)))
    group = [*KEYS, "kind"]
    if not examples:
        return _described(flagged.groupBy(*group).agg(F.count(F.lit(1)).alias("count"), F.max("size").alias("size"))
                          .withColumn("examples", F.lit(None).cast("array<double>")), threshold, factor)
    counted = flagged.groupBy(*KEYS, "kind", "v", "size", "distance").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*group).orderBy(F.desc("distance"), F.asc("v"))
    best = (counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= examples)
            .groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "v"))), lambda s: s["v"]).alias("examples")))
    totals = counted.groupBy(*group).agg(F.sum("n").alias("count"), F.max("size").alias("size"))
    return _described(totals.join(F.broadcast(best), group), threshold, factor)  # proven bound: two rows per column


def _described(found: DataFrame, threshold: float, factor: float) -> DataFrame:
    by_z = F.col("kind") == "z"
    return found.select(
        *KEYS, F.when(by_z, "statistical_outliers").otherwise("iqr_outliers").alias("type"), "count",
        percent(F.col("count"), F.col("size")).alias("percentage"),
        F.when(by_z, f"Values with Z-score > {threshold:g}")
        .otherwise(f"Values outside {factor:g}*IQR from quartiles").alias("description"), "examples")


def all_anomalies(number_rows: DataFrame, profile: DataFrame, lengths: DataFrame, examples: int = 5) -> DataFrame:
    """All three kinds, one row per column and kind that occurs."""
    return numeric_outliers(number_rows, profile, examples=examples).unionByName(length_outliers(lengths, examples=examples))

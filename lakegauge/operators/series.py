"""Per-period metrics, spikes, trends and the sentences told about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lakegauge.functions.exprs import clean, fields_of, fixed, is_numeric, quoted


def period_metrics(df: DataFrame, period: str, metrics=None, start=None, end=None,
                   table: str = "", first: int | None = None) -> DataFrame:
    """(table_name, metric, period, record_count, avg, total, min, max) per period value.

    The range is inclusive and compares the raw period column, so partitions and
    row groups outside it are skipped.  The default metrics are all numeric columns,
    or the ``first`` of them.  All metrics share one scan and one shuffle of per-task partial sums.
    """
    names = metrics or [f.name for f in fields_of(df, kind=is_numeric) if f.name != period][:first]
    p = quoted(period)
    rows = df.where(p.isNotNull())
    if start is not None:
        rows = rows.where(p >= F.lit(start))
    if end is not None:
        rows = rows.where(p <= F.lit(end))
    fields = {f.name: f for f in df.schema.fields}
    wide = rows.select(p.alias("period"), *[clean(fields[n]).cast("double").alias(n) for n in names])
    return (wide.unpivot(["period"], [quoted(n) for n in names], "metric", "v").where(F.col("v").isNotNull())
            .groupBy(F.lit(table).alias("table_name"), "metric", "period")
            .agg(F.count(F.lit(1)).alias("record_count"), F.avg("v").alias("avg_value"), F.sum("v").alias("total_value"),
                 F.min("v").alias("min_value"), F.max("v").alias("max_value")))


SERIES = ["table_name", "metric"]


def series_summary(periods: DataFrame, min_points: int = 5) -> DataFrame:
    """Points, mean, spread, first and last period of every series long enough."""
    return (periods.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("data_points"), F.avg("total_value").alias("mean_value"),
        F.stddev_samp("total_value").alias("std_value"),
        F.min("period").alias("min_period"), F.max("period").alias("max_period"))
        .where(F.col("data_points") >= min_points))


def spikes(periods: DataFrame, deviations: float = 2.0, min_points: int = 5) -> DataFrame:
    """Periods whose total is above mean + 2 sample deviations of the series."""
    base = series_summary(periods, min_points).select(
        *SERIES, F.col("mean_value").alias("baseline_mean"),
        (F.col("mean_value") + deviations * F.col("std_value")).alias("threshold"))
    return (periods.join(F.broadcast(base), SERIES)  # proven bound: one row per metric column
            .where(F.col("total_value") > F.col("threshold"))
            .select(*SERIES, "period", "total_value", "threshold", "baseline_mean"))


def spike_summary(spike_rows: DataFrame) -> DataFrame:
    """Spike count, dates and the largest spike per series."""
    return spike_rows.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("spike_count"),
        F.max("threshold").alias("threshold"), F.max("baseline_mean").alias("baseline_mean"),
        F.max_by("period", F.struct(F.col("total_value"), -F.unix_date(F.col("period").cast("date")))).alias("largest_period"),
        F.max("total_value").alias("largest_value"))


def trends(periods: DataFrame, points: int = 7, up: float = 1.2, down: float = 0.8) -> DataFrame:
    """Mean of the last seven against the first seven periods of each series.

    The ranks are cut at seven before the shuffle, so a long series is not gathered.
    """
    def edge(order, name):
        rank = F.row_number().over(Window.partitionBy(*SERIES).orderBy(order))
        return (periods.withColumn("rank", rank).where(F.col("rank") <= points)
                .groupBy(*SERIES).agg(F.avg("total_value").alias(name), F.count(F.lit(1)).alias("n_" + name)))

    first, last = edge(F.asc("period"), "first_avg"), edge(F.desc("period"), "last_avg")
    a, b = F.col("first_avg"), F.col("last_avg")
    return (first.join(F.broadcast(last), SERIES)  # proven bound: one row per metric column
            .where(F.col("n_first_avg") >= points)
            .select(*SERIES, a, b,
                    F.when(b > a * up, "up").when(b < a * down, "down").otherwise("steady").alias("trend"),
                    ((F.try_divide(b, a) - 1) * 100).alias("change_percentage")))


def stories(spike_rows: DataFrame, trend_rows: DataFrame) -> DataFrame:
    """Sentences for the largest spike of a series and for clear trends; one line
    says so when there is nothing to tell."""
    name = F.concat("table_name", F.lit("."), "metric")
    top = spike_summary(spike_rows).select(*SERIES, F.lit("spike").alias("kind"), F.concat(
        F.lit("Spike alert: "), name, F.lit(" showed unusual activity on "), F.col("largest_period").cast("string"),
        F.lit(", reaching "), F.format_number("largest_value", 0), F.lit(" (baseline average "),
        F.format_number("baseline_mean", 0), F.lit(")")).alias("story"))
    word = F.when(F.col("trend") == "up", "increase").otherwise("decrease")
    moved = trend_rows.where("trend <> 'steady'").select(*SERIES, F.lit("trend").alias("kind"), F.concat(
        F.initcap("trend"), F.lit("ward trend: "), name, F.lit(" shows a "),
        fixed(F.abs(F.col("change_percentage"))), F.lit("% "), word,
        F.lit(" over the analyzed period")).alias("story"))
    told = top.unionByName(moved)
    calm = (told.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit("").alias("table_name"), F.lit("").alias("metric"), F.lit("steady").alias("kind"),
        F.lit("Steady pattern: consistent values across the analyzed periods, no significant anomalies").alias("story")))
    return told.unionByName(calm)


def spike_insight(spike_rows: DataFrame) -> DataFrame:
    """How many series have a spike."""
    return (spike_rows.select(*SERIES).distinct().agg(F.count(F.lit(1)).alias("series_with_spikes"))
            .withColumn("insight", F.when(F.col("series_with_spikes") > 0, F.format_string(
                "Detected %d unusual spikes across analyzed partitions", "series_with_spikes"))))

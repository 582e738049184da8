"""Dimension and measure discovery, status, churn and channel metrics, period rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakegauge.functions import vocab
from lakegauge.functions.exprs import contains_any, percent, quoted


def _is_text() -> Column:
    return F.lower("data_type").rlike(r"^(string|text|char.*|varchar.*)$")


def _descriptive() -> Column:
    return contains_any(F.lower("column_name"), vocab.DIMENSION_WORDS)


def dimension_columns(catalog: DataFrame, stats: DataFrame, ratio: float = 0.1) -> DataFrame:
    """Descriptive columns by name, other text columns by low distinct share.

    ``stats`` has total_count and unique_count per column.
    """
    share = F.coalesce(F.try_divide(F.col("unique_count").cast("double"), F.col("total_count")), F.lit(0.0))
    kind = (F.when(_descriptive(), "descriptive_dimension")
            .when(_is_text() & (share < ratio), "categorical_dimension"))
    return (catalog.join(stats.select("table_name", "column_name", "total_count", "unique_count"), ["table_name", "column_name"])
            .withColumn("type", kind).where("type is not null")
            .select("table_name", "column_name", "ordinal", "data_type", "type",
                    F.col("unique_count").alias("cardinality"), share.alias("cardinality_ratio")))


def measure_columns(catalog: DataFrame) -> DataFrame:
    """Measures by name, other numeric columns that are no *_id as potential measures.

    A column that was tested as a dimension (by name or as text) is never a measure.
    """
    name = F.lower("column_name")
    numeric = F.lower("data_type").rlike(r"^(tinyint|smallint|int|bigint|float|double|decimal.*)$")
    kind = (F.when(_descriptive() | _is_text(), None)
            .when(contains_any(name, vocab.FACT_WORDS), "measure")
            .when(numeric & ~name.endswith("_id"), "potential_measure"))
    return (catalog.withColumn("type", kind).where("type is not null")
            .select("table_name", "column_name", "data_type", "type", "row_count"))


def dimension_pairs(df: DataFrame, dimensions: list[str], first: int | None = None) -> DataFrame:
    """Row counts of all (or the ``first``) pairs of dimension columns, all pairs in one pass.

    Grouping sets expand each row once per pair; counts are combined per task.
    """
    pairs = [(a, b) for i, a in enumerate(dimensions) for b in dimensions[i + 1:]][:first]
    used = list(dict.fromkeys(c for p in pairs for c in p))
    rows = F.array(*[F.struct(F.lit(a).alias("dimension1"), F.lit(b).alias("dimension2"),
                              quoted(a).cast("string").alias("value1"), quoted(b).cast("string").alias("value2"))
                     for a, b in pairs])
    return (df.select(*[quoted(c) for c in used]).select(F.inline(rows))
            .groupBy("dimension1", "dimension2", "value1", "value2").agg(F.count(F.lit(1)).alias("record_count")))


def _on_days(df: DataFrame, date_column: str, start: str, end: str) -> DataFrame:
    """Rows of an inclusive day range; the raw column is compared, so scans can skip."""
    c = quoted(date_column)
    return df.where((c >= F.lit(start).cast("date")) & (c < F.date_add(F.lit(end).cast("date"), 1)))


def status_on_day(df: DataFrame, status: str, date_column: str, day: str,
                  active=("active",), cancelled=("cancelled",)) -> DataFrame:
    """Total, active and cancelled rows of one day (case-folded states)."""
    s = F.lower(quoted(status))
    return _on_days(df, date_column, day, day).agg(
        F.count(F.lit(1)).alias("total_subscriptions"),
        F.count_if(s.isin(list(active))).alias("active_subscriptions"),
        F.count_if(s.isin(list(cancelled))).alias("cancelled_subscriptions"))


def last_days(df: DataFrame, date_column: str, as_of: str, days: int = 7) -> DataFrame:
    """Rows with ``as_of - 7 <= date <= as_of``."""
    c, end = quoted(date_column), F.lit(as_of).cast("date")
    return df.where((c >= F.date_sub(end, days)) & (c < F.date_add(end, 1))).agg(
        F.count(F.lit(1)).alias(f"subscriptions_last_{days}_days"))


def status_distribution(df: DataFrame, status: str, top: int = 10) -> DataFrame:
    return (df.groupBy(quoted(status).alias("status")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("status")).limit(top))


def churn(df: DataFrame, status: str, churned=tuple(vocab.CHURNED_STATES)) -> DataFrame:
    """Churned rows with churn and retention percentage (two decimals); no row for no data."""
    t = df.agg(F.count(F.lit(1)).alias("total_subscriptions"),
               F.count_if(F.lower(quoted(status)).isin(list(churned))).alias("churned_subscriptions"))
    rate = percent(F.col("churned_subscriptions"), F.col("total_subscriptions"))
    return (t.where("total_subscriptions > 0").withColumn("churn_rate_percent", F.bround(rate, 2))
            .withColumn("retention_rate_percent", F.bround(100 - rate, 2)))


def channels(df: DataFrame, channel: str, top: int = 10) -> DataFrame:
    """Ten largest channels with their share of the ten's total (one decimal)."""
    best = (df.groupBy(quoted(channel).cast("string").alias("raw")).agg(F.count(F.lit(1)).alias("subscriber_count"))
            .orderBy(F.desc("subscriber_count"), F.asc("raw")).limit(top))
    whole = F.sum("subscriber_count").over(Window.partitionBy(F.lit(1)))  # at most ten rows
    return best.select(F.when(F.coalesce("raw", F.lit("")) == "", "Unknown").otherwise(F.col("raw")).alias("channel"),
                       "subscriber_count", F.bround(F.col("subscriber_count") / whole * 100, 1).alias("percentage"))


def pick_columns(catalog: DataFrame) -> DataFrame:
    """Status, date and channel columns of each table, chosen by name.

    A status name wins over a date name, that over a channel name; the last status
    and metric channel and the first report channel are taken, dates in order.
    """
    name, at = F.lower("column_name"), F.struct("ordinal", "column_name")
    status = name.contains("status")
    start = ~status & contains_any(name, vocab.START_DATE_TOKENS)
    end = ~status & contains_any(name, vocab.END_DATE_TOKENS)
    metric = ~status & ~start & contains_any(name, vocab.METRIC_CHANNEL_TOKENS)
    report = contains_any(name, vocab.CHANNEL_TOKENS)

    def names(flag):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(flag, at))), lambda s: s["column_name"]), ", ")

    return catalog.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"),
        F.max(F.when(status, at))["column_name"].alias("status_column"), names(start).alias("date_columns"),
        names(end).alias("end_date_columns"), F.max(F.when(metric, at))["column_name"].alias("metric_channel_column"),
        F.min(F.when(report, at))["column_name"].alias("channel_column"))


def period_rollup(df: DataFrame, date_column: str, metric: str) -> DataFrame:
    """Monthly, quarterly, yearly and overall aggregates of a metric in one pass.

    Days of a month are combined per task; NULL year, quarter or month marks a subtotal.
    """
    c = quoted(date_column)
    return (df.where(c.isNotNull())
            .rollup(F.year(c).alias("year"), F.quarter(c).alias("quarter"), F.month(c).alias("month"))
            .agg(F.count(F.lit(1)).alias("record_count"), F.sum(quoted(metric)).alias("total_value"),
                 F.avg(quoted(metric)).alias("avg_value")))

"""Data-quality checks and scores for columns, tables and the whole lake."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakegauge.functions import vocab
from lakegauge.functions.exprs import KEYS, contains_any, fields_of, fixed, is_text, ordered_names, percent, quoted
from lakegauge.operators.values import cells


# --- text quality ------------------------------------------------------------

def text_quality(df: DataFrame, table: str, columns=None, placeholders=tuple(vocab.PLACEHOLDERS)) -> DataFrame:
    """Total, present, blank and placeholder values of every string column.

    All columns in one aggregate: each task sends one row to the shuffle.
    """
    names = [f.name for f in fields_of(df, columns, is_text)]
    trimmed = F.trim("value")
    return cells(df, table, names).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("total_count"), F.count("value").alias("non_null_count"),
        F.count_if(trimmed == "").alias("empty_count"),
        F.count_if(F.lower(trimmed).isin(list(placeholders))).alias("meaningless_count"))


def text_quality_issues(quality: DataFrame, null_limit: float = 50, empty_limit: float = 20,
                        placeholder_limit: float = 10) -> DataFrame:
    """One row per column and issue with its share of all rows."""
    def share(part):
        return F.coalesce(percent(part, F.col("total_count")), F.lit(0.0))

    def issue(name, part, limit, words):
        value = share(part)
        return F.when(value > limit, F.struct(
            F.lit(name).alias("issue"), value.alias("percentage"), part.alias("affected"),
            F.concat(F.col("column_name"), F.lit(" has "), fixed(value), F.lit("% " + words))
            .alias("description")))

    found = F.array_compact(F.array(
        issue("high_null_percentage", F.col("total_count") - F.col("non_null_count"), null_limit, "NULL values"),
        issue("empty_data", F.col("empty_count"), empty_limit, "empty strings"),
        issue("meaningless_data", F.col("meaningless_count"), placeholder_limit, "meaningless values")))
    return quality.select(*KEYS, F.inline(found))


def text_quality_summary(issues: DataFrame) -> DataFrame:
    """Summary lines over all issues."""
    counts = issues.agg(F.count_if(F.col("issue") == "empty_data").alias("e"),
                        F.count_if(F.col("issue") == "meaningless_data").alias("m"))
    lines = F.array_compact(F.array(
        F.when(F.col("e") > 0, F.format_string("Found %d columns with significant empty data", "e")),
        F.when(F.col("m") > 0, F.format_string("Found %d columns with meaningless placeholder values", "m")),
        F.when((F.col("e") == 0) & (F.col("m") == 0),
               F.lit("Data quality appears good - no significant empty or meaningless data detected"))))
    return counts.select(F.explode(lines).alias("insight"))


# --- column issues and scores --------------------------------------------------

def non_integers(df: DataFrame, table: str, columns) -> DataFrame:
    """Present values that cannot be read as an integer, per string column."""
    wide = df.agg(*[F.count_if(quoted(c).try_cast("bigint").isNull() & quoted(c).isNotNull()).alias(c)
                    for c in columns])
    return (wide.unpivot([], [quoted(c) for c in columns], "column_name", "non_integer_count")
            .select(F.lit(table).alias("table_name"), "column_name", "non_integer_count"))


def column_issues(stats: DataFrame, lengths: DataFrame, non_integer: DataFrame | None = None,
                  null_limit: float = 50, duplicate_limit: float = 10, spread: float = 0.5) -> DataFrame:
    """Issue flags, issue texts and the 0-1 schema score of every column.

    ``stats`` comes from ``uniqueness``, ``lengths`` from ``length_summary`` and
    ``non_integer`` from ``non_integers``; all have one row per column.
    """
    out = stats.join(F.broadcast(lengths.select(*KEYS, "avg_length", "std_length")), KEYS, "left")
    if non_integer is None:
        out = out.withColumn("non_integer_count", F.lit(0).cast("bigint"))
    else:
        out = out.join(F.broadcast(non_integer), KEYS, "left").withColumn(
            "non_integer_count", F.coalesce("non_integer_count", F.lit(0)))
    keyed = contains_any(F.lower("column_name"), vocab.KEY_NAME_TOKENS)
    out = (out.withColumn("duplicate_percentage", F.when(keyed, percent(
        F.col("total_count") - F.col("unique_count"), F.col("total_count"))))
        .withColumn("high_null", F.col("null_percentage") > null_limit)
        .withColumn("key_duplicates", F.coalesce(F.col("duplicate_percentage") > duplicate_limit, F.lit(False)))
        .withColumn("non_integer", F.col("non_integer_count") > 0)
        .withColumn("inconsistent_length",
                    F.coalesce(F.col("std_length") > F.col("avg_length") * spread, F.lit(False))))
    flags = ["high_null", "key_duplicates", "non_integer", "inconsistent_length"]
    texts = F.array_compact(F.array(
        F.when(F.col("high_null"), F.concat(F.lit("High null percentage: "), fixed(F.col("null_percentage")), F.lit("%"))),
        F.when(F.col("key_duplicates"),
               F.concat(F.lit("High duplicate percentage in key column: "), fixed(F.col("duplicate_percentage")), F.lit("%"))),
        F.when(F.col("non_integer"), F.format_string("Non-numeric values in integer column: %d", "non_integer_count")),
        F.when(F.col("inconsistent_length"), F.lit("Inconsistent string length formatting"))))
    penalty = F.least(F.col("null_percentage") / 100 * 0.5, F.lit(0.3))
    issues = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    return (out.withColumn("quality_issues", texts).withColumn("issue_count", issues)
            .withColumn("data_quality_score", F.greatest(F.lit(0.0), 1 - penalty - F.col("issue_count") * 0.1)))


def table_score(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Schema score per table: mean column score (0 or missing counts as 0.5), plus
    0.1 for rows, plus 0.05 for partitions, minus 0.1 without a primary key."""
    mean = columns.groupBy("table_name").agg(
        F.avg(F.coalesce(F.nullif("data_quality_score", F.lit(0.0)), F.lit(0.5))).alias("mean_score"),
        F.coalesce(F.bool_or("is_primary_key"), F.lit(False)).alias("has_primary_key"))
    raw = (F.col("mean_score") + F.when(F.col("row_count") > 0, 0.1).otherwise(0.0)
           + F.when(F.col("is_partitioned"), 0.05).otherwise(0.0)
           - F.when(F.col("has_primary_key"), 0.0).otherwise(0.1))
    return (tables.join(mean, "table_name", "left")
            .withColumn("table_quality_score", F.coalesce(
                F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), F.lit(0.0))))


def profile_score(profile: DataFrame) -> DataFrame:
    """0-1 profile score per column from NULLs, key uniqueness, format and anomalies."""
    share = percent(F.coalesce(F.col("anomaly_count"), F.lit(0)), F.col("total_count"))
    score = (F.lit(1.0)
             - F.when(F.col("null_percentage") > 50, 0.3).when(F.col("null_percentage") > 20, 0.1).otherwise(0.0)
             - F.when(F.col("potential_key") & (F.col("unique_percentage") < 95), 0.2).otherwise(0.0)
             - F.when(F.col("format_consistency") < 0.8, 0.1).otherwise(0.0)
             - F.when(share > 10, 0.2).when(share > 5, 0.1).otherwise(0.0))
    return profile.withColumn("quality_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


# --- roll-ups --------------------------------------------------------------------

def quality_rollup(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Mean quality and completeness over tables, mean NULL share over columns."""
    left = tables.agg(F.coalesce(F.avg("overall_quality_score"), F.lit(0.0)).alias("avg_quality_score"),
                      F.coalesce(F.avg("completeness_score"), F.lit(0.0)).alias("avg_completeness_score"),
                      F.count(F.lit(1)).alias("tables_analyzed"))
    nulls = columns.agg(F.coalesce(F.avg("null_percentage"), F.lit(0.0)))
    return left.withColumn("avg_null_percentage", nulls.scalar())


def table_digest(profile: DataFrame, null_limit: float = 30, trend_limit: float = 25) -> DataFrame:
    """Short digest per table: high-NULL columns, personal-data columns, first three numeric."""
    numeric = F.array_sort(F.collect_list(F.when(F.col("mean").isNotNull(), F.struct(
        "ordinal", "column_name", "mean", "std_dev"))))
    text = F.transform(F.slice(numeric, 1, 3), lambda s: F.concat(
        s["column_name"], F.lit(" (mean="), fixed(s["mean"], 2),
        F.lit(", std="), fixed(F.coalesce(s["std_dev"], F.lit(0.0)), 2), F.lit(")")))
    high = F.array_sort(F.collect_list(F.when(F.col("null_percentage") > null_limit, F.struct(
        "ordinal", "column_name", "null_percentage"))))
    high_text = F.transform(F.slice(high, 1, 5), lambda s: F.concat(
        s["column_name"], F.lit(" ("), fixed(s["null_percentage"]), F.lit("%)")))
    return profile.groupBy("table_name").agg(
        F.max("total_count").alias("total_rows"), F.count(F.lit(1)).alias("total_columns"),
        F.avg(1 - F.col("null_percentage") / 100).alias("completeness_score"),
        F.avg("quality_score").alias("overall_quality_score"),
        F.array_join(high_text, ", ").alias("high_null_columns"),
        ordered_names(F.col("potential_pii")).alias("pii_columns"),
        F.array_join(text, "; ").alias("numeric_columns"),
        F.count_if(F.col("null_percentage") > trend_limit).alias("trend_null_columns"))


def database_quality(scores: DataFrame, limit: float = 0.7) -> DataFrame:
    """Mean table score and the tables that need attention (a 0 score is not listed)."""
    low = (F.col("table_quality_score") < limit) & (F.col("table_quality_score") != 0)
    return scores.agg(
        F.coalesce(F.avg("table_quality_score"), F.lit(0.0)).alias("average_score"),
        F.count(F.lit(1)).alias("tables"), F.count_if(low).alias("tables_needing_attention"),
        F.array_join(F.array_sort(F.collect_list(F.when(low, F.col("table_name")))), ", ").alias("attention_list"))


def date_validity(df: DataFrame, table: str, column: str, formats=("yyyy-MM-dd",)) -> DataFrame:
    """Present values of a column that can be read as a date, over the whole column."""
    c = quoted(column)
    readable = F.coalesce(*[F.try_to_timestamp(c.cast("string"), F.lit(f)) for f in formats])
    return df.agg(F.count(c).alias("total"), F.count(readable).alias("valid")).select(
        F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "total", "valid",
        F.when(F.col("total") > 0, F.format_string("%d/%d samples valid", "valid", "total"))
        .otherwise("no data").alias("date_validity"))


def catalog_checks(catalog: DataFrame, wide: int = 100) -> DataFrame:
    """Catalog checks per table: no columns, too many columns, no rows, no identifier."""
    per_table = catalog.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"), F.count("column_name").alias("column_count"),
        F.count_if(F.lower("column_name").contains("id")).alias("id_columns"))
    name = F.col("table_name")

    def check(kind, cond, *text):
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), F.concat(F.lit("Table "), name, *text).alias("message")))

    found = F.array_compact(F.array(
        check("anomaly", F.col("column_count") == 0, F.lit(" has no column information")),
        check("insight", F.col("column_count") > wide, F.lit(" has many columns ("),
              F.col("column_count").cast("string"), F.lit(") - consider normalization")),
        check("anomaly", F.col("row_count") == 0, F.lit(" appears to be empty")),
        check("insight", F.col("id_columns") == 0, F.lit(" may lack proper identifier columns"))))
    return per_table.select("table_name", "row_count", "column_count", F.inline(found))

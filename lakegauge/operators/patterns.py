"""Value patterns, personal-data flags, key flags and data classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakegauge.functions import vocab
from lakegauge.functions.exprs import KEYS, contains_any, percent
from lakegauge.operators.values import PATTERN_BITS, pattern_bits, present


def pattern_sums(counts: DataFrame) -> DataFrame:
    """Rows per pattern and column; each pattern runs once per distinct value."""
    bits = F.coalesce("long_bits", pattern_bits(F.col("value")))
    flagged = present(counts).select(*KEYS, "n", bits.alias("bits"))
    # collapse to (column, bit combination) first: a handful of rows per column
    combos = flagged.groupBy(*KEYS, "bits").agg(F.sum("n").alias("n"))
    return combos.groupBy(*KEYS).agg(
        F.sum("n").alias("non_null_count"),
        *[F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("n"))), F.lit(0)).alias(name)
          for name, bit in PATTERN_BITS.items()])


def common_patterns(sums: DataFrame) -> DataFrame:
    """Reported patterns: any of the seven with a match, a numeric string on more
    than 80 % of the values, and the first date format on more than 50 %."""
    size = F.col("non_null_count")

    def row(name, matches, detail, keep):
        return F.when(keep, F.struct(F.lit(name).alias("pattern"), matches.alias("matches"),
                                     detail.alias("description")))

    found = [row(name, F.col(name), F.lit(None).cast("string"), F.col(name) > 0)
             for name in vocab.VALUE_PATTERNS]
    digits = F.col("numeric_string")
    found.append(row("numeric_string", digits, F.lit("Numeric values stored as strings"), digits > size * 0.8))
    formats = [F.when(F.col(f"`{f}`") > size * 0.5, F.struct(F.col(f"`{f}`").alias("matches"), F.lit(f).alias("format")))
               for f in vocab.DATE_PATTERNS]
    best = F.coalesce(*formats)
    found.append(F.when(best.isNotNull(), F.struct(
        F.lit("date_format").alias("pattern"), best["matches"].alias("matches"),
        F.concat(F.lit("Date format: "), best["format"]).alias("description"))))
    return (sums.select(*KEYS, "non_null_count", F.inline(F.array_compact(F.array(*found))))
            .withColumn("percentage", percent(F.col("matches"), F.col("non_null_count")))
            .drop("non_null_count"))


def business_flags(profile: DataFrame, patterns: DataFrame) -> DataFrame:
    """PII flag, key flag and data class; ``profile`` has the uniqueness columns."""
    hits = (patterns.where(F.col("pattern").isin(vocab.PII_PATTERNS))
            .groupBy(*KEYS).agg(F.lit(True).alias("pii_pattern")))
    joined = profile.join(F.broadcast(hits), KEYS, "left")  # proven bound: one row per column
    return classified(joined, F.coalesce("pii_pattern", F.lit(False))).drop("pii_pattern")


def classified(profile: DataFrame, pii_pattern: Column) -> DataFrame:
    """Add the flags and the class, given whether a personal-data pattern was found."""
    name = F.lower("column_name")
    any_value = F.col("non_null_count") > 0  # a column without a value is not classified at all
    pii = any_value & (contains_any(name, vocab.PII_TOKENS) | pii_pattern)
    key = any_value & (contains_any(name, vocab.KEY_TOKENS) | (F.col("unique_percentage") > 95))
    label = (F.when(pii, "sensitive").when(key, "identifier")
             .when(contains_any(name, vocab.FINANCIAL_TOKENS), "financial")
             .when(contains_any(name, vocab.TEMPORAL_TOKENS), "temporal").otherwise("general"))
    return profile.withColumns({"potential_pii": pii, "potential_key": key, "data_classification": F.when(any_value, label)})


def pattern_rollup(patterns: DataFrame) -> DataFrame:
    """Columns per pattern kind with its rank (top five are the most common)."""
    totals = patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("columns"))
    return totals.orderBy(F.desc("columns"), "pattern")


def pattern_metrics(patterns: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row: pattern kinds, total patterns, total anomaly kinds, five most common."""
    kinds = patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("columns"))
    entry = F.struct((-F.col("columns")).alias("order"), "pattern", "columns")
    # `kinds` has at most nine rows: the pattern vocabulary is fixed
    top = F.slice(F.array_sort(F.collect_list(entry)), 1, 5)
    left = kinds.agg(
        F.count(F.lit(1)).alias("pattern_types_detected"),
        F.coalesce(F.sum("columns"), F.lit(0)).alias("total_patterns"),
        F.array_join(F.transform(top, lambda s: F.concat_ws("=", s["pattern"], s["columns"])), ", ")
        .alias("most_common_patterns"))
    return left.withColumn("total_anomalies", anomalies.agg(F.count(F.lit(1))).scalar())

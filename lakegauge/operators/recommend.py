"""Recommendations: every rule is a filter over metric tables that emits rows of one
shape; rule sets are unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lakegauge.functions.exprs import fixed, ordered_names


def _rows(df: DataFrame, title: Column, category: str, priority: str, description: Column, effort: str, benefit: str,
          confidence: float, details: dict[str, Column], column: bool = False) -> DataFrame:
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        title.alias("title"), F.lit(category).alias("category"), F.lit(priority).alias("priority"),
        description.alias("description"), F.lit(effort).alias("implementation_effort"),
        F.lit(benefit).alias("expected_benefit"), F.lit(confidence).alias("confidence"), F.col("table_name"),
        (F.col("column_name") if column else F.lit(None).cast("string")).alias("column_name"),
        F.create_map(*pairs).alias("technical_details"))


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def missing_primary_key(keys: DataFrame) -> DataFrame:
    """Tables without a primary key by name."""
    t = keys.groupBy("table_name").agg(F.bool_or("is_primary_key").alias("pk")).where("not pk")
    name = F.col("table_name")
    return _rows(t, _text("Add Primary Key to ", name), "schema_design", "high",
                 _text("Table ", name, " appears to lack a primary key, which is essential for data integrity and performance."),
                 "low", "Improved data integrity and query performance", 0.8,
                 {"suggestion": F.lit("Add an auto-incrementing ID column or identify existing unique columns")})


def wide_tables(catalog: DataFrame, limit: int = 50) -> DataFrame:
    """Tables with more than ``limit`` columns."""
    t = catalog.groupBy("table_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    name = F.col("table_name")
    return _rows(t, _text("Consider Normalizing Wide Table ", name), "normalization", "medium",
                 _text("Table ", name, " has ", F.col("n").cast("string"), " columns, which may indicate denormalization opportunities."),
                 "high", "Improved maintainability and reduced storage", 0.6,
                 {"column_count": F.col("n"), "suggestion": F.lit("Consider breaking into multiple related tables")})


def high_nulls(stats: DataFrame, limit: float = 50) -> DataFrame:
    """Columns with more than ``limit`` percent NULLs."""
    t, c = F.col("table_name"), F.col("column_name")
    return _rows(stats.where(F.col("null_percentage") > limit), _text("High Null Values in ", t, ".", c), "data_quality",
                 "medium", _text("Column ", c, " in ", t, " has ", fixed(F.col("null_percentage")), "% null values."),
                 "medium", "Improved data completeness and query reliability", 0.9,
                 {"null_percentage": fixed(F.col("null_percentage"), 4),
                  "suggestion": F.lit("Investigate data collection process or consider default values")}, column=True)


def enum_candidates(stats: DataFrame, ratio: float = 0.1, limit: int = 20) -> DataFrame:
    """String columns with few distinct values; ``stats`` has data_type, unique_count, total_count."""
    kind = F.lower("data_type")
    share = F.try_divide(F.col("unique_count").cast("double"), F.col("total_count"))
    few = stats.where((kind.contains("string") | kind.contains("varchar")) & (share < ratio) & (F.col("unique_count") < limit))
    t, c, u = F.col("table_name"), F.col("column_name"), F.col("unique_count").cast("string")
    return _rows(few, _text("Consider Enum/Category for ", t, ".", c), "data_type_optimization", "low",
                 _text("Column ", c, " has only ", u, " unique values, consider using enum or category type."),
                 "low", "Reduced storage and improved performance", 0.7,
                 {"unique_count": F.col("unique_count"), "total_count": F.col("total_count"),
                  "suggestion": F.lit("Convert to enum or create lookup table")}, column=True)


def partition_large_tables(tables: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Tables with more than ``limit`` rows."""
    name = F.col("table_name")
    return _rows(tables.where(F.col("row_count") > limit), _text("Consider Partitioning Large Table ", name), "partitioning", "high",
                 _text("Table ", name, " has ", F.format_number("row_count", 0), " rows. Partitioning could improve query performance."),
                 "medium", "Significantly improved query performance for date/time-based queries", 0.8,
                 {"row_count": F.col("row_count"),
                  "suggestion": F.lit("Partition by date, region, or other frequently filtered columns")})


def columnar_format(tables: DataFrame, limit: int = 100 * 1024 * 1024) -> DataFrame:
    """Tables of more than ``limit`` bytes."""
    name = F.col("table_name")
    return _rows(tables.where(F.col("size_bytes") > limit), _text("Optimize File Format for ", name), "file_format", "medium",
                 _text("Large table ", name, " could benefit from columnar storage format."), "medium",
                 "30-70% reduction in storage and improved query performance", 0.7,
                 {"size_bytes": F.col("size_bytes"),
                  "suggestion": F.lit("Consider Parquet or ORC format with appropriate compression")})


def connections(relationships: DataFrame) -> DataFrame:
    """Outgoing and incoming relationships per table (both ends always count)."""
    ends = relationships.select(F.inline(F.array(
        F.struct(F.col("from_table").alias("table_name"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("to_table").alias("table_name"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return ends.groupBy("table_name").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def star_roles(relationships: DataFrame, fact_limit: int = 3, dimension_limit: int = 2) -> DataFrame:
    """Fact tables (more than 3 outgoing) and dimension tables (more than 2 incoming, none outgoing)."""
    t, name = connections(relationships), F.col("table_name")
    facts = _rows(t.where(F.col("outgoing") > fact_limit), _text("Consider ", name, " as Fact Table in Star Schema"),
                  "dimensional_modeling", "medium",
                  _text("Table ", name, " has multiple foreign key relationships, suggesting it could be a fact table."), "high",
                  "Improved analytics performance with star schema design", 0.6,
                  {"outgoing_relationships": F.col("outgoing"), "suggestion": F.lit("Design star schema with this as central fact table")})
    dims = _rows(t.where((F.col("outgoing") <= fact_limit) & (F.col("incoming") > dimension_limit) & (F.col("outgoing") == 0)),
                 _text("Optimize ", name, " as Dimension Table"), "dimensional_modeling", "low",
                 _text("Table ", name, " is referenced by multiple tables, suggesting it's a dimension table."), "medium",
                 "Better organized dimensional model", 0.7,
                 {"incoming_relationships": F.col("incoming"),
                  "suggestion": F.lit("Add surrogate keys and slowly changing dimension handling if needed")})
    return facts.unionByName(dims)


def together(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sets)


def filter_recommendations(recs: DataFrame, category=None, priority=None, table=None) -> DataFrame:
    """Rows that meet all given conditions."""
    for column, value in [("category", category), ("priority", priority), ("table_name", table)]:
        if value:
            recs = recs.where(F.col(column) == value)
    return recs


def sort_recommendations(recs: DataFrame, by: str = "priority") -> DataFrame:
    """By priority (high, medium, low, others), confidence (highest first) or category; ties by title."""
    p = F.col("priority")
    rank = F.when(p == "high", 0).when(p == "medium", 1).when(p == "low", 2).otherwise(3)
    keys = {"priority": [rank], "confidence": [F.desc("confidence")], "category": [F.asc("category")]}.get(by)
    return recs if keys is None else recs.orderBy(*keys, "title")


# --- rule lines ---------------------------------------------------------------------

def schema_rules(columns: DataFrame, tables: DataFrame, row_limit: int = 1_000_000, null_limit: float = 50) -> DataFrame:
    """(table_name, rule, recommendation): primary key, partitioning by the first date
    column, high-NULL columns, indexes for foreign keys of facts.

    ``columns`` has key flags, data_type, null_percentage; ``tables`` has row_count,
    is_partitioned and table_type.
    """
    kind = F.lower("data_type")
    dated = kind.contains("date") | kind.contains("timestamp")
    t = columns.groupBy("table_name").agg(
        F.bool_or("is_primary_key").alias("pk"),
        F.min(F.when(dated, F.struct("ordinal", "column_name")))["column_name"].alias("date_column"),
        ordered_names(F.col("null_percentage") > null_limit).alias("nulls"),
        ordered_names(F.col("is_foreign_key")).alias("fks")).join(tables, "table_name")

    def line(rule, cond, *text):
        return F.when(cond, F.struct(F.lit(rule).alias("rule"), _text(*text).alias("recommendation")))

    found = F.array_compact(F.array(
        line("primary_key", ~F.col("pk"), "Consider adding a primary key for better data integrity"),
        line("partitioning", ~F.col("is_partitioned") & (F.col("row_count") > row_limit) & F.col("date_column").isNotNull(),
             "Consider partitioning by date column: ", F.coalesce("date_column", F.lit(""))),
        line("nulls", F.col("nulls") != "", "Review columns with high null percentages: ", F.col("nulls")),
        line("indexing", (F.col("table_type") == "fact") & (F.col("fks") != ""),
             "Consider indexing foreign key columns: ", F.col("fks"))))
    return t.select("table_name", F.inline(found))


def database_insights(tables: DataFrame, row_limit: int = 1_000_000) -> DataFrame:
    """(kind, entry, tables): tables per type, and large tables without partitions."""
    types = tables.groupBy(F.coalesce("table_type", F.lit("unknown")).alias("entry")).agg(
        F.count(F.lit(1)).alias("tables")).select(F.lit("table_type").alias("kind"), "entry", "tables")
    large = tables.where((F.col("row_count") > row_limit) & ~F.col("is_partitioned")).select(
        F.lit("large_unpartitioned").alias("kind"), F.col("table_name").alias("entry"), F.col("row_count").alias("tables"))
    return types.unionByName(large)


def profile_rules(profile: DataFrame, row_limit: int = 1_000_000) -> DataFrame:
    """(table_name, rule, column_name, detail): keys, foreign keys, partitioning, indexes
    read from a column profile."""
    key = F.col("potential_key") & (F.col("unique_percentage") > 95)
    fk = F.lower("column_name").endswith("_id") & (F.col("unique_percentage") <= 95)

    def line(rule, cond, detail):
        return F.when(cond, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))

    none = F.lit("")
    found = F.array_compact(F.array(
        line("potential_key", key, none),
        line("potential_foreign_key", fk, F.substring("column_name", F.lit(1), F.length("column_name") - 3)),
        line("partitioning", (F.col("data_classification") == "temporal") & (F.col("total_count") > row_limit), none),
        line("indexing", key | fk, none)))
    return profile.select("table_name", "column_name", F.inline(found)).withColumn(
        "confidence", F.when(F.col("rule") == "potential_foreign_key", F.lit(0.7)))


def metadata_rules(catalog: DataFrame, references: DataFrame, partitioned: DataFrame, wide: int = 50,
                   row_limit: int = 1_000_000) -> DataFrame:
    """Lake-wide lines: empty, wide, large unpartitioned and dated tables, references;
    one default line when nothing was found.  ``partitioned`` lists table names."""
    t = (catalog.groupBy("table_name").agg(
        F.max("row_count").alias("rows"), F.count(F.lit(1)).alias("n"),
        F.bool_or(F.col("type_bucket") == "date").alias("dated"))
        .join(partitioned.select("table_name", F.lit(True).alias("is_partitioned")), "table_name", "left"))
    totals = t.agg(
        F.count_if(F.col("rows") == 0).alias("empty"), F.count_if(F.col("n") > wide).alias("wide"),
        F.count_if((F.col("rows") > row_limit) & F.col("is_partitioned").isNull()).alias("large"),
        F.count_if("dated").alias("dated")).withColumn("refs", references.agg(F.count(F.lit(1))).scalar())

    def line(column, text):
        return F.when(F.col(column) > 0, F.format_string(text, column))

    found = F.array_compact(F.array(
        line("empty", "Found %d empty tables - consider archiving or populating them"),
        line("wide", f"Found %d wide tables (>{wide} columns) - consider normalization"),
        line("large", "Found %d large unpartitioned tables - consider partitioning for performance"),
        line("dated", "Found %d tables with date columns - validate date formats and consider time-based partitioning"),
        line("refs", "Identified %d potential foreign key relationships - consider adding formal constraints")))
    default = F.array(F.lit("Data structure analysis completed - no major issues identified"))
    return totals.select(F.explode(F.when(F.size(found) > 0, found).otherwise(default)).alias("recommendation"))

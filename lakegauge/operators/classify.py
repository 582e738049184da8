"""Rules over the column catalog: keys, table types, domains, roles, documentation.

Inputs have one row per column of the lake (plus row counts and data-derived
metrics); lists built here are bounded by the columns of one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakegauge.functions import vocab
from lakegauge.functions.exprs import contains_any, first_rule, fixed, ordered_names

NUMERIC_TYPES = r"^(tinyint|smallint|int|bigint|float|double|decimal.*)$"


def singular(table: Column) -> Column:
    """Lower-case table name without trailing s characters (all of them)."""
    return F.rtrim(F.lower(table), F.lit("s"))


def key_columns(catalog: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Primary and foreign keys by name.

    ``id`` and ``<table>_id`` are primary keys, every other ``*_id`` refers to the
    table it names.  ``strict_reference=True`` takes every ``*_id`` as a primary key.
    """
    name = F.lower("column_name")
    ends = name.endswith("_id")
    own = ends if strict_reference else (name == F.concat(singular(F.col("table_name")), F.lit("_id")))
    pk = own | (name == "id")
    fk = ends & ~pk
    return (catalog.withColumn("is_primary_key", pk).withColumn("is_foreign_key", fk)
            .withColumn("referenced_table", F.when(fk, F.replace(name, F.lit("_id"), F.lit(""))))
            .withColumn("referenced_column", F.when(fk, F.lit("id"))))


def _is_numeric() -> Column:
    return F.lower("data_type").rlike(NUMERIC_TYPES)


def table_types(keys: DataFrame) -> DataFrame:
    """dimension, fact, bridge, lookup or unknown from key and measure counts."""
    t = keys.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("column_count"),
        F.count_if("is_foreign_key").alias("foreign_keys"), F.count_if(_is_numeric()).alias("measures"),
        F.bool_or(F.lower("column_name").isin(vocab.DESCRIPTIVE_NAMES)).alias("named"))
    fk, n = F.col("foreign_keys"), F.col("column_count")
    kind = (F.when((fk <= 2) & (n > 5) & F.col("named"), "dimension")
            .when((fk >= 2) & (F.col("measures") >= 2), "fact")
            .when((fk >= 2) & (n <= fk + 2), "bridge")
            .when((F.col("row_count") > 0) & (F.col("row_count") < 1000), "lookup")
            .otherwise("unknown"))
    return t.withColumn("table_type", kind).drop("named")


def table_types_by_name(catalog: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """dimension, fact, aggregate or operational from names, comment, columns and rows."""
    c = F.lower("column_name")
    t = catalog.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("column_count"),
        F.bool_or(contains_any(c, vocab.MEASURE_NAME_TOKENS)).alias("measures"),
        F.count_if(c.endswith("_id") | c.endswith("_key")).alias("key_columns"),
        F.bool_or(contains_any(c, vocab.DATE_KEY_TOKENS)).alias("date_keys"),
        F.bool_or(contains_any(c, vocab.DESCRIPTIVE_TOKENS)).alias("descriptive"))
    if comments is None:
        t = t.withColumn("table_comment", F.lit(""))
    else:
        t = t.join(comments.select("table_name", "table_comment"), "table_name", "left")
    name, note = F.lower("table_name"), F.lower(F.coalesce("table_comment", F.lit("")))
    kind = (F.when(contains_any(name, vocab.TYPE_DIMENSION_TOKENS) | note.contains("dimension"), "dimension")
            .when(contains_any(name, vocab.TYPE_FACT_TOKENS) | note.contains("fact"), "fact")
            .when(contains_any(name, vocab.TYPE_AGGREGATE_TOKENS) | contains_any(note, vocab.COMMENT_AGGREGATE_WORDS),
                  "aggregate")
            .when(F.col("measures") & (F.col("key_columns") > 2) & F.col("date_keys"), "fact")
            .when(~F.col("measures") & (F.col("column_count") > 5) & F.col("descriptive"), "dimension")
            .when(F.col("measures") & contains_any(name, vocab.PERIOD_NAME_TOKENS), "aggregate")
            .when(F.col("row_count") > 1_000_000_000, "fact")
            .when(F.col("row_count") < 10_000, "dimension")
            .otherwise("operational"))
    return t.select("table_name", "row_count", kind.alias("table_type"))


def table_classes(catalog: DataFrame) -> DataFrame:
    """dimension or fact by name, else likely_* by size and type buckets."""
    t = catalog.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"),
        F.count_if(F.col("type_bucket") == "text").alias("text_columns"),
        F.count_if(F.col("type_bucket") == "numeric").alias("numeric_columns"))
    name, rows = F.lower("table_name"), F.col("row_count")
    kind = (F.when(contains_any(name, vocab.CLASS_DIMENSION_TOKENS), "dimension")
            .when(contains_any(name, vocab.CLASS_FACT_TOKENS), "fact")
            .when((rows > 0) & (rows < 10_000) & (F.col("text_columns") > F.col("numeric_columns")), "likely_dimension")
            .when((rows > 100_000) & (F.col("numeric_columns") > 0), "likely_fact")
            .otherwise("unknown"))
    return t.withColumn("table_classification", kind)


def quick_split(catalog: DataFrame) -> DataFrame:
    """Fast fact/dimension split with a size label."""
    t = catalog.groupBy("table_name").agg(F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("columns"))
    name = F.lower("table_name")
    kind = (F.when(contains_any(name, ["dim_", "dimension"]), "dimension")
            .when(name.contains("fact_") | (F.col("columns") > 10), "fact").otherwise("dimension_candidate"))
    large = (F.col("row_count") > 1_000_000) & (kind != "dimension_candidate")
    return t.withColumn("type", kind).withColumn("estimated_size", F.when(large, "large").otherwise("medium"))


def domains(catalog: DataFrame) -> DataFrame:
    """Business domain: keywords in the table name first, then in any column name."""
    names = list(vocab.TABLE_DOMAINS)
    numbered = [(str(i), words) for i, words in enumerate(vocab.TABLE_DOMAINS.values())]
    index = F.nullif(first_rule(F.lower("column_name"), numbered, ""), F.lit("")).cast("int")
    by_table = F.nullif(first_rule(F.lower("table_name"), vocab.TABLE_DOMAINS.items(), ""), F.lit(""))
    return (catalog.groupBy("table_name").agg(F.max("row_count").alias("row_count"), F.min(index).alias("i"))
            .select("table_name", "row_count", F.coalesce(
                by_table, F.get(F.array(*[F.lit(n) for n in names]), F.col("i")), F.lit("general")).alias("domain")))


def column_roles(catalog: DataFrame) -> DataFrame:
    """identifier, status or temporal role of a column; other columns are left out."""
    name, kind = F.lower("column_name"), F.lower("data_type")
    role = (F.when(name.endswith("_id") & kind.contains("bigint"), "identifier_column")
            .when(name.contains("status") & (kind.contains("varchar") | kind.contains("string")), "status_dimension")
            .when(contains_any(name, ["date", "created", "updated"]), "temporal_column"))
    text = F.concat(F.col("column_name"), F.when(role == "identifier_column", " appears to be an identifier column")
                    .when(role == "status_dimension", " is a status dimension for business logic")
                    .otherwise(" is a temporal column for time-based analysis"))
    return catalog.withColumn("pattern", role).where("pattern is not null").withColumn("description", text)


def role_counts(catalog: DataFrame) -> DataFrame:
    """Identifier, temporal and status columns per table."""
    name = F.lower("column_name")
    return catalog.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"),
        F.count_if(name.contains("id") | name.endswith("_key")).alias("identifier_columns"),
        F.count_if(contains_any(name, ["date", "time", "created", "updated"])).alias("temporal_columns"),
        F.count_if(name.contains("status") | name.contains("state")).alias("status_columns"))


def storage_hints(keys: DataFrame, stats: DataFrame, low: float = 0.01, high: float = 0.9) -> DataFrame:
    """Cardinality label, NULL share and partition or clustering hint per column."""
    share = F.try_divide(F.col("unique_count").cast("double"), F.col("total_count"))
    named = contains_any(F.lower("column_name"), ["date", "time", "created", "updated"])
    return (keys.join(stats, ["table_name", "column_name"])
            .withColumn("cardinality", F.when(F.col("unique_count") > 0, F.when(share < low, "low cardinality")
                                              .when(share > high, "high cardinality")))
            .withColumn("hint", F.when(named, "potential partition key")
                        .when(F.col("is_foreign_key"), "potential clustering key"))
            .select("table_name", "column_name", "data_type", "cardinality", "null_percentage", "hint"))


def role_groups(keys: DataFrame) -> DataFrame:
    """Keys, measures and dimensions of each table as comma lists in column order."""
    key = F.col("is_primary_key") | F.col("is_foreign_key")
    return keys.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"), ordered_names(key).alias("keys"),
        ordered_names(~key & _is_numeric()).alias("measures"),
        ordered_names(~key & ~_is_numeric()).alias("dimensions"))


def _commented() -> Column:
    return F.length(F.trim(F.coalesce("comment", F.lit("")))) > 0


def comment_coverage(catalog: DataFrame) -> DataFrame:
    """Columns with and without comment, share (one decimal) and documentation level."""
    t = catalog.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("columns"), F.count_if(_commented()).alias("columns_with_comments"))
    exact = F.col("columns_with_comments") / F.col("columns") * 100
    return (t.withColumn("columns_without_comments", F.col("columns") - F.col("columns_with_comments"))
            .withColumn("comment_coverage_percentage", F.bround(exact, 1))
            .withColumn("level", F.when(exact > 70, "well").when(exact > 30, "partial").otherwise("poor")))


def documentation_tables(catalog: DataFrame, comments: DataFrame) -> DataFrame:
    """Documentation facts, pattern and anomaly lines per table."""
    t = (catalog.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("columns"),
        F.count_if(_commented()).alias("documented_columns"))
        .join(comments.select("table_name", "table_comment"), "table_name", "left"))
    note, name = F.lower(F.coalesce("table_comment", F.lit(""))), F.lower("table_name")
    documented = F.length(F.trim(note)) > 0
    pattern = F.when(documented, F.when(note.contains("dimension") | name.contains("dim_"), "dimension table")
                     .when(note.contains("fact") | name.contains("fact_"), "fact table")
                     .when(contains_any(note, ["audit", "log", "history"]), "audit/logging table"))
    anomalies = F.array_compact(F.array(
        F.when(F.col("columns") > 100, F.format_string("Very wide table (%d columns)", "columns")),
        F.when(F.col("row_count") > 100_000_000, F.format_string("Very large table (%,d rows)", "row_count")),
        F.when((F.col("documented_columns") == 0) & (F.col("columns") > 10),
               F.lit("Large table with no column documentation"))))
    return t.select("table_name", "row_count", "columns", "documented_columns", documented.alias("documented"),
                    pattern.alias("pattern"), F.array_join(anomalies, "; ").alias("anomalies"))


def documentation_summary(doc: DataFrame) -> DataFrame:
    """Documentation coverage of tables, columns and rows with low-coverage flags; a row is
    documented if its table is."""
    t = doc.agg(F.count(F.lit(1)).alias("total_tables"), F.count_if("documented").alias("documented_tables"),
                F.sum("columns").alias("total_columns"), F.sum("documented_columns").alias("documented_columns"),
                F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
                F.coalesce(F.sum(F.when(F.col("documented"), F.col("row_count"))), F.lit(0)).alias("documented_rows"))

    def share(part, whole):
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)) * 100, F.lit(0.0))

    return (t.withColumn("table_documentation_pct", share("documented_tables", "total_tables"))
            .withColumn("column_documentation_pct", share("documented_columns", "total_columns"))
            .withColumn("row_documentation_pct", share("documented_rows", "total_rows"))
            .withColumn("low_table_coverage", F.col("table_documentation_pct") < 50)
            .withColumn("low_column_coverage", F.col("column_documentation_pct") < 30))


def descriptions(catalog: DataFrame, first: int = 10) -> DataFrame:
    """A sentence per table: size, commented columns, key columns, kind of table."""
    name = F.lower("column_name")
    t = catalog.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("n"), F.count_if(_commented()).alias("c"),
        ordered_names((F.col("ordinal") <= first) & contains_any(name, ["id", "key", "code"])).alias("keys"))
    table = F.lower("table_name")
    kind = (F.when(table.contains("dim_"), ". This appears to be a dimension table for data warehousing")
            .when(table.contains("fact_"), ". This appears to be a fact table containing measurable events")
            .when(contains_any(table, ["log", "event", "activity"]), ". This appears to be an event/activity tracking table")
            .when(contains_any(table, ["user", "customer", "account"]), ". This appears to be a user/customer data table")
            .otherwise(""))
    return t.select("table_name", "row_count", F.concat(
        F.format_string("Table %s contains %d columns", "table_name", "n"),
        F.when(F.col("c") > 0, F.format_string(" (%d with descriptions)", "c")).otherwise(""),
        F.when(F.col("keys") != "", F.concat(F.lit(". Key columns: "), F.col("keys"))).otherwise(""), kind)
        .alias("description"))


def business_context(catalog: DataFrame, comments: DataFrame, references: DataFrame) -> DataFrame:
    """Domains, purposes, key entities and data flows of the lake as (kind, entry) rows, each
    with the number of tables behind it and their rows (a table counts once an entry)."""
    name = F.lower("column_name")
    entity = F.replace(F.replace(F.replace(name, F.lit("_id"), F.lit("")), F.lit("_key"), F.lit("")),
                       F.lit("_code"), F.lit(""))

    def rows(df, kind, entry):
        return df.select(F.lit(kind).alias("kind"), entry.alias("entry"), "table_name", "row_count")

    noted = (comments.where(F.length("table_comment") > 0)
             .join(catalog.groupBy("table_name").agg(F.max("row_count").alias("row_count")), "table_name", "left"))
    behind = (rows(domains(catalog), "domain", F.col("domain"))
            .unionByName(rows(noted, "purpose", F.concat("table_name", F.lit(": "), "table_comment")))
            .unionByName(rows(catalog.where(contains_any(name, ["id", "key", "code"])), "entity", entity))
            .unionByName(rows(references, "flow", F.concat("table_name", F.lit("."), "column_name",
                                                           F.lit(" -> "), "likely_references"))))
    return (behind.groupBy("kind", "entry", "table_name").agg(F.max("row_count").alias("row_count"))
            .groupBy("kind", "entry").agg(F.count(F.lit(1)).alias("tables"),
                                          F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count")))


def size_label(size: Column) -> Column:
    """Byte count as B, KB, MB, GB, TB or PB with one decimal; 0 and NULL are unknown."""
    def text(power):
        return F.concat(fixed(size / F.lit(1024.0 ** power)), F.lit(" " + vocab.SIZE_UNITS[power]))

    label = text(5)
    for power in range(4, -1, -1):
        label = F.when(size < 1024 ** (power + 1), text(power)).otherwise(label)
    return F.when(size.isNull() | (size == 0), "unknown").otherwise(label)

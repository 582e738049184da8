"""Column and table catalogs, table and column statistics, DDL properties."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakegauge.functions import vocab
from lakegauge.functions.exprs import KEYS, clean, contains_any, quoted
from lakegauge.operators.values import table_counts, uniqueness
from lakegauge.sources.readers import quote, session_tables


def type_bucket(data_type: Column) -> Column:
    """date, numeric or text by substrings of the type name, tried in that order."""
    name = F.lower(data_type)
    return (F.when(contains_any(name, vocab.DATE_TYPE_TOKENS), "date")
            .when(contains_any(name, vocab.NUMERIC_TYPE_TOKENS), "numeric")
            .otherwise("text"))


def _together(frames) -> DataFrame:
    out = None
    for one in frames:
        out = one if out is None else out.unionByName(one)
    return out


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of all non-empty tables: one scan each, one shuffle of
    one row per task and table (for Parquet the scan reads file footers only)."""
    marks = _together(df.select(F.lit(name).alias("table_name")) for name, df in tables.items())
    return marks.groupBy("table_name").agg(F.count(F.lit(1)).alias("row_count"))


def schema_rows(tables: dict[str, DataFrame], database: str = "default") -> DataFrame:
    """One row per column of every table, from the schemas alone."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(database, name, f.name, i + 1, f.dataType.simpleString(), f.nullable, (f.metadata or {}).get("comment"))
            for name, df in tables.items() for i, f in enumerate(df.schema.fields)]
    schema = ("database string, table_name string, column_name string, ordinal int, data_type string, "
              "nullable boolean, comment string")
    return spark.createDataFrame(rows, schema).withColumn("type_bucket", type_bucket(F.col("data_type")))


def lake_catalog(tables: dict[str, DataFrame], database: str = "default") -> DataFrame:
    """One row per column of every table, with type, bucket, comment and row count."""
    # proven bound: one row per table
    return (schema_rows(tables, database).join(F.broadcast(row_counts(tables)), "table_name", "left")
            .withColumn("row_count", F.coalesce("row_count", F.lit(0))))


def column_catalog(df: DataFrame, table: str, database: str = "default") -> DataFrame:
    return lake_catalog({table: df}, database)


def lake_stats(tables: dict[str, DataFrame], database: str = "default") -> DataFrame:
    """Row count, column count and uncompressed size of the stored values per table."""
    spark = next(iter(tables.values())).sparkSession
    widths = spark.createDataFrame([(database, n, len(df.columns)) for n, df in tables.items()],
                                   "database string, table_name string, column_count bigint")
    sized = _together(df.select(F.lit(name).alias("table_name"), _row_bytes(df).alias("bytes"))
                      for name, df in tables.items())
    totals = sized.groupBy("table_name").agg(F.count(F.lit(1)).alias("row_count"), F.sum("bytes").alias("size_bytes"))
    return (widths.join(F.broadcast(totals), "table_name", "left")  # proven bound: one row per table
            .select("database", "table_name", "column_count", F.coalesce("row_count", F.lit(0)).alias("row_count"),
                    F.coalesce("size_bytes", F.lit(0)).alias("size_bytes")))


def table_stats(df: DataFrame, table: str, database: str = "default") -> DataFrame:
    return lake_stats({table: df}, database)


def _row_bytes(df: DataFrame) -> Column:
    total = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        total = total + _value_bytes(f)
    return total


def _value_bytes(field) -> Column:
    """Bytes of one value: text by its encoding, other types by their fixed width."""
    c, kind = quoted(field.name), field.dataType.simpleString()
    width = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}.get(kind, 8)
    if kind == "string":
        size = F.octet_length(c)
    elif kind.startswith("array"):
        size = F.size(c) * (4 if kind in ("array<float>", "array<int>") else 8)
    elif kind.startswith(("map", "struct")):
        size = F.octet_length(F.to_json(c))
    else:
        size = F.lit(width)
    return F.when(c.isNotNull(), size).otherwise(0).cast("bigint")


def file_listing(spark: SparkSession, locations: dict[str, str]) -> DataFrame:
    """One row per data file below each table's location: path, size, time of last change.

    The listing asks the file system for each file's status and opens none; files whose
    name starts with a dot or an underscore are left out, files without rows are not.
    """
    def one(name, location):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(location)
        return files.select(F.lit(name).alias("table_name"), "path", F.col("length").alias("size_bytes"),
                            F.col("modificationTime").alias("modified_at"))
    return _together(one(name, location) for name, location in locations.items())


def file_stats(spark: SparkSession, locations: dict[str, str], fmt: str = "parquet",
               database: str = "default") -> DataFrame:
    """Rows, columns, files, stored bytes, time of last change and location of tables given
    by their folders or files.

    No value is read: sizes and times come from the listing, row counts from a scan without
    columns (Parquet and ORC answer it from file footers).  A folder without data files has
    no size, time or rows, if its schema can be read at all.
    """
    tables = {name: spark.read.format(fmt).load(location) for name, location in locations.items()}
    known = spark.createDataFrame([(database, n, len(tables[n].columns), locations[n]) for n in tables],
                                  "database string, table_name string, column_count bigint, location string")
    files = file_listing(spark, locations).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("size_bytes"),
        F.max("modified_at").alias("last_modified"))
    # proven bounds: one row per table
    return (known.join(F.broadcast(files), "table_name", "left")
            .join(F.broadcast(row_counts(tables)), "table_name", "left")
            .select("database", "table_name", "column_count", F.coalesce("row_count", F.lit(0)).alias("row_count"),
                    F.coalesce("file_count", F.lit(0)).alias("file_count"),
                    F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), "last_modified", "location"))


def registered_stats(spark: SparkSession, database: str = "default", selection: str | None = None) -> DataFrame:
    """Statistics of the registered tables of a database, from the catalog.

    Row count and size are the catalog's where a table has been analysed
    (``counted`` is false).  Other tables are counted by a scan without columns and
    have the size that the catalog knows, NULL if none.  Views are left out.
    """
    known, unknown = [], {}
    for name in session_tables(spark, database, selection):
        table = f"{quote(database)}.{quote(name)}"
        info = json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {table} AS JSON").first()[0])
        stats = info.get("statistics") or {}
        rows = stats.get("num_rows")
        if rows is None:
            unknown[name] = spark.table(table)
        known.append((database, name, len(info["columns"]), rows, stats.get("size_in_bytes"), info.get("provider"),
                      info.get("location"), rows is None))
    schema = ("database string, table_name string, column_count bigint, stored_rows bigint, size_bytes bigint, "
              "provider string, location string, counted boolean")
    out = spark.createDataFrame(known, schema)
    if unknown:  # proven bound: one row per table
        out = out.join(F.broadcast(row_counts(unknown)), "table_name", "left")
    else:
        out = out.withColumn("row_count", F.lit(None).cast("bigint"))
    return out.select("database", "table_name", "column_count",
                      F.coalesce("stored_rows", "row_count", F.lit(0)).alias("row_count"),
                      "size_bytes", "provider", "location", "counted")


def column_stats(df: DataFrame, table: str, columns=None) -> DataFrame:
    """Total, non-NULL, distinct and NULL count with NULL share per column."""
    return uniqueness(table_counts({table: df}, {table: columns})).select(
        *KEYS, "total_count", "non_null_count", F.col("unique_count").alias("distinct_count"),
        "null_count", "null_percentage")


def show_stats(df: DataFrame, table: str, columns=None) -> DataFrame:
    """Data size of text columns, distinct values and NULL fraction per column."""
    fields = [f for f in df.schema.fields if columns is None or f.name in set(columns)]
    sizes = df.agg(*[F.coalesce(F.sum(_value_bytes(f)), F.lit(0)).alias(f.name) for f in fields])
    sizes = sizes.unpivot([], [quoted(f.name) for f in fields], "column_name", "data_size")
    stats = column_stats(df, table, columns)
    return (stats.join(F.broadcast(sizes), "column_name")  # proven bound: one row per column
            .select(*KEYS, "data_size", F.col("distinct_count").alias("distinct_values_count"),
                    F.coalesce(F.try_divide(F.col("null_count").cast("double"), F.col("total_count")), F.lit(0.0))
                    .alias("nulls_fraction")))


def range_stats(df: DataFrame, table: str, columns=None, rsd: float = 0.02) -> DataFrame:
    """Approximate distinct count, minimum and maximum (as text) of each column.

    One aggregate over the table: a sketch per column, no value is shuffled.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in set(columns)]
    fields = [f for f in fields if not f.dataType.simpleString().startswith(("map", "struct", "array"))]
    wide = df.agg(*[F.struct(
        F.approx_count_distinct(clean(f), rsd).alias("approx_distinct_count"),
        F.min(clean(f)).cast("string").alias("min_value"),
        F.max(clean(f)).cast("string").alias("max_value")).alias(f.name) for f in fields])
    return (wide.unpivot([], [quoted(f.name) for f in fields], "column_name", "s")
            .select(F.lit(table).alias("table_name"), "column_name", "s.*"))


def database_summary(stats: DataFrame) -> DataFrame:
    """Tables, columns, rows and bytes per database."""
    return stats.groupBy("database").agg(
        F.count(F.lit(1)).alias("total_tables"), F.sum("column_count").alias("total_columns"),
        F.sum("row_count").alias("total_rows"), F.sum("size_bytes").alias("total_size_bytes"))


def ddl_properties(ddl: DataFrame, text: str = "ddl") -> DataFrame:
    """Properties read from CREATE TABLE texts, one text per row."""
    t = F.col(text)
    upper = F.upper(t)

    def first_word(words):
        return F.coalesce(*[F.when(upper.contains(w), F.lit(w)) for w in words])

    partitioned = upper.contains("PARTITIONED BY")
    after = F.element_at(F.split(upper, "PARTITIONED BY"), 2)
    inner = F.split_part(F.split_part(after, F.lit("("), F.lit(2)), F.lit(")"), F.lit(1))
    names = F.transform(F.split(inner, ","), lambda c: F.split_part(F.trim(c), F.lit(" "), F.lit(1)))
    comment = F.coalesce(
        F.nullif(F.regexp_extract(t, r"(?i)COMMENT\s+'([^']+)'", 1), F.lit("")),
        F.nullif(F.regexp_extract(t, r'(?i)COMMENT\s+"([^"]+)"', 1), F.lit("")))
    # the text after the first quote whose preceding stretch names LOCATION
    pieces = F.split(t, "'")
    location = F.get(F.filter(pieces, lambda x, i: F.upper(F.get(pieces, i - 1)).contains("LOCATION")), F.lit(0))
    return ddl.select(
        *[c for c in ddl.columns if c != text],
        partitioned.alias("partitioned"), upper.contains("CLUSTERED BY").alias("bucketed"),
        contains_any(upper, vocab.DDL_COMPRESSED_WORDS).alias("compressed"),
        first_word(vocab.DDL_FORMATS).alias("file_format"),
        first_word(vocab.DDL_COMPRESSIONS).alias("compression"),
        location.alias("location"),
        F.when(partitioned & after.contains("("), F.array_join(names, ",")).otherwise("").alias("partition_columns"),
        comment.alias("comment"))

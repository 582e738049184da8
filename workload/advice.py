"""J: recommendations from rules over catalogs, statistics and relationships."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakegauge.functions.exprs import fields_of, is_text
from lakegauge.operators import catalog as ca, classify as cl, recommend as rc, relate as re, values as va
from lakegauge.plans import lake as lk
from workload.common import CUSTOMER_COLUMNS, CUSTOMER_SQL, TABLES, lake, planted_customer, table, union_all
from workload.quality import PROFILE_SQL, profiles
from workload.relations import F2_SQL, G1_SQL, KEYS_SQL, PARTITIONED, STAR, SUFFIX_SQL, WITH, catalog, star
from workload.sources import STATS_SQL, stored

QUERIES, ORACLES = {}, {}
SHOWN = ["title", "category", "priority", "description", "implementation_effort", "expected_benefit", "confidence",
         "table_name", "column_name"]


def _rec_sql(title, category, priority, description, effort, benefit, confidence, source, column="cast(null as varchar)"):
    return f"""select {title} as title, '{category}' as category, '{priority}' as priority, {description} as description, '{effort}' as implementation_effort,
 '{benefit}' as expected_benefit, cast({confidence} as double) as confidence, table_name, {column} as column_name from {source}"""


def _keys(s, d):
    return cl.key_columns(catalog(s, d))


J1_SQL = _rec_sql("'Add Primary Key to ' || table_name", "schema_design", "high",
                  "'Table ' || table_name || ' appears to lack a primary key, which is essential for data integrity and performance.'", "low",
                  "Improved data integrity and query performance", 0.8,
                  "(select table_name from keys group by 1 having not bool_or(is_primary_key))")


def _with_rows(recs, cat):
    """Recommendations beside the row count of their table."""
    rows = cat.groupBy("table_name").agg(F.max("row_count").alias("row_count"))
    return recs.select(*SHOWN).join(rows, "table_name")


QUERIES["j1_no_pk"] = lambda s, d: _with_rows(rc.missing_primary_key(_keys(s, d)), catalog(s, d))
ORACLES["j1_no_pk"] = WITH + f", {KEYS_SQL}, r as ({J1_SQL}) select r.*, (select max(row_count) from cat where cat.table_name = r.table_name) as row_count from r"


def _wide(s, d):
    """A 55-column feature table: one flag per partition-like remainder of the order key."""
    o = table(s, d, "orders")
    return {"orders": o, "order_flags": o.select("o_orderkey", "o_custkey", *[
        (F.col("o_orderkey") % (i + 2)).alias(f"f{i}") for i in range(53)])}


QUERIES["j2_wide"] = lambda s, d: _with_rows(rc.wide_tables(ca.lake_catalog(_wide(s, d))), ca.lake_catalog(_wide(s, d)))
ORACLES["j2_wide"] = "select r.*, (select count(*) from orders) as row_count from (" + _rec_sql(
    "'Consider Normalizing Wide Table order_flags'", "normalization", "medium",
    "'Table order_flags has 55 columns, which may indicate denormalization opportunities.'", "high",
    "Improved maintainability and reduced storage", 0.6, "(select 'order_flags' as table_name)") + ") r"

STAT_SRC = {"customer": ("p", CUSTOMER_COLUMNS), "orders": ("orders", TABLES["orders"]), "documents": ("documents", TABLES["documents"]),
            "lineitem": ("lineitem", TABLES["lineitem"])}


def _stat_tables(s, d):
    return {"customer": planted_customer(s, d), **lake(s, d, ["orders", "documents", "lineitem"])}


def _null_stats(s, d):
    return lk.union_tables(va.presence, _stat_tables(s, d))


def _text_stats(s, d):
    """Distinct values of the text columns, the only ones that enumerations are proposed for."""
    tables = _stat_tables(s, d)
    stats = va.uniqueness(va.table_counts(tables, {t: [f.name for f in fields_of(df, None, is_text)] for t, df in tables.items()}))
    return stats.join(ca.lake_catalog(tables).select("table_name", "column_name", "data_type", "ordinal"), ["table_name", "column_name"])


STAT_SQL = f"with p as ({CUSTOMER_SQL}), st as (" + union_all(
    f"select '{t}' as table_name, '{c}' as column_name, '{k}' as kind, count(*) as n, count({c}) as m, count(distinct {c}) as u from {f}"
    for t, (f, cs) in STAT_SRC.items() for c, k in cs.items()) + ")"
J3_SQL = _rec_sql("'High Null Values in ' || table_name || '.' || column_name", "data_quality", "medium",
                  "'Column ' || column_name || ' in ' || table_name || ' has ' || format('{:.1f}', (n - m) / n * 100) || '% null values.'", "medium",
                  "Improved data completeness and query reliability", 0.9, "st where (n - m) / n * 100 > 50", "column_name")
QUERIES["j3_high_null"] = lambda s, d: rc.high_nulls(_null_stats(s, d)).select(*SHOWN)
ORACLES["j3_high_null"] = STAT_SQL + " " + J3_SQL
J4_SQL = _rec_sql("'Consider Enum/Category for ' || table_name || '.' || column_name", "data_type_optimization", "low",
                  "'Column ' || column_name || ' has only ' || u || ' unique values, consider using enum or category type.'", "low",
                  "Reduced storage and improved performance", 0.7, "st where kind = 'string' and u / n < 0.1 and u < 20", "column_name")
QUERIES["j4_enum"] = lambda s, d: rc.enum_candidates(_text_stats(s, d)).select(*SHOWN)
ORACLES["j4_enum"] = STAT_SQL + " " + J4_SQL

ROWS_LIMIT = 10_000
J5_SQL = _rec_sql("'Consider Partitioning Large Table ' || table_name", "partitioning", "high",
                  "'Table ' || table_name || ' has ' || format('{:,}', row_count) || ' rows. Partitioning could improve query performance.'", "medium",
                  "Significantly improved query performance for date/time-based queries", 0.8, f"sizes where row_count > {ROWS_LIMIT}")
QUERIES["j5_partition"] = lambda s, d: rc.partition_large_tables(ca.lake_stats(lake(s, d)), ROWS_LIMIT).select(*SHOWN)
ORACLES["j5_partition"] = f"with sizes as ({STATS_SQL}) " + J5_SQL
J6_SQL = _rec_sql("'Optimize File Format for ' || table_name", "file_format", "medium",
                  "'Large table ' || table_name || ' could benefit from columnar storage format.'", "medium",
                  "30-70% reduction in storage and improved query performance", 0.7, "sizes where size_bytes > 1000000")
QUERIES["j6_stored_size"] = lambda s, d: rc.columnar_format(stored(s, d), 1_000_000).select(*SHOWN)
QUERIES["j6_file_format"] = lambda s, d: rc.columnar_format(ca.lake_stats(lake(s, d)), 1_000_000).select(*SHOWN)
ORACLES["j6_file_format"] = f"with sizes as ({STATS_SQL}) " + J6_SQL


def _relations(s, d):
    """Relationships from the star schema plus the planted references into one dimension."""
    return re.foreign_key_candidates(catalog(s, d))


CONN_SQL = G1_SQL + """, conn as (select table_name, sum(o) as outgoing, sum(i) as incoming from (select from_table as table_name, 1 as o, 0 as i from fk
 union all select to_table, 0, 1 from fk) group by 1)"""
J7_SQL = _rec_sql("'Consider ' || table_name || ' as Fact Table in Star Schema'", "dimensional_modeling", "medium",
                  "'Table ' || table_name || ' has multiple foreign key relationships, suggesting it could be a fact table.'", "high",
                  "Improved analytics performance with star schema design", 0.6, "conn where outgoing > 3")
J8_SQL = _rec_sql("'Optimize ' || table_name || ' as Dimension Table'", "dimensional_modeling", "low",
                  "'Table ' || table_name || ' is referenced by multiple tables, suggesting it''s a dimension table.'", "medium",
                  "Better organized dimensional model", 0.7, "conn where outgoing = 0 and incoming > 2")
QUERIES["j7_fact"] = lambda s, d: _with_rows(rc.star_roles(_relations(s, d)).where("title like '%Fact Table%'"), catalog(s, d))
ORACLES["j7_fact"] = WITH + CONN_SQL + f", r as ({J7_SQL}) select r.*, (select max(row_count) from cat where cat.table_name = r.table_name) as row_count from r"
QUERIES["j8_dimension"] = lambda s, d: _with_rows(rc.star_roles(_relations(s, d)).where("title like '%Dimension Table%'"), catalog(s, d))
ORACLES["j8_dimension"] = WITH + CONN_SQL + f", r as ({J8_SQL}) select r.*, (select max(row_count) from cat where cat.table_name = r.table_name) as row_count from r"


def _all(s, d):
    return rc.together(rc.high_nulls(_null_stats(s, d)), rc.enum_candidates(_text_stats(s, d)),
                       rc.partition_large_tables(ca.lake_stats(lake(s, d)), ROWS_LIMIT),
                       rc.columnar_format(ca.lake_stats(lake(s, d)), 1_000_000))


ALL_SQL = STAT_SQL + f", sizes as ({STATS_SQL}), recs as ({J3_SQL} union all {J4_SQL} union all {J5_SQL} union all {J6_SQL})"
QUERIES["j9_filter"] = lambda s, d: rc.filter_recommendations(_all(s, d), "data_type_optimization", "low", "customer").select(*SHOWN)
ORACLES["j9_filter"] = ALL_SQL + " select * from recs where category = 'data_type_optimization' and priority = 'low' and table_name = 'customer'"
QUERIES["j10_sort"] = lambda s, d: rc.sort_recommendations(_all(s, d), "priority").select(*SHOWN)
ORACLES["j10_sort"] = ALL_SQL + " select * from recs order by case priority when 'high' then 0 when 'medium' then 1 when 'low' then 2 else 3 end, title"


def _tables(s, d):
    return cl.table_types(_keys(s, d)).select("table_name", "row_count", "table_type").withColumn(
        "is_partitioned", F.col("table_name").isin(["orders"]))


NULLED = {"customers": ("customer", "c_mktsegment", "market_code")}


def _star_nulls(s, d):
    """Star columns with NULL shares from the data; market_code is planted to be mostly NULL."""
    tables = star(s, d)
    tables["customers"] = tables["customers"].withColumn("market_code", F.expr("case when id % 10 < 6 then null else market_code end"))
    counts = lk.union_tables(lambda df, n: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
                             .unpivot([], df.columns, "column_name", "v").select(F.lit(n).alias("table_name"), "column_name", "v"), tables)
    return counts.groupBy("table_name", "column_name").agg(
        (F.count_if(F.col("v").isNull()) / F.count(F.lit(1)) * 100).alias("null_percentage"))


NULLS_SQL = "nulls as (" + union_all(
    f"select '{t}' as table_name, '{n}' as column_name, " + (
        "count(*) filter (c_custkey % 10 < 6) / count(*) * 100" if (t, n) == ("customers", "market_code") else f"(count(*) - count({o})) / count(*) * 100")
    + f" as null_percentage from {src}" for t, (src, cols) in STAR.items() for n, (o, _) in cols.items()) + ")"
QUERIES["j11_schema_rules"] = lambda s, d: rc.schema_rules(
    _keys(s, d).join(_star_nulls(s, d), ["table_name", "column_name"]).drop("row_count"), _tables(s, d), row_limit=5000)
ORACLES["j11_schema_rules"] = WITH + f", {KEYS_SQL}" + F2_SQL + f", {NULLS_SQL}" + """, x as (select keys.*, null_percentage, table_type, table_name = 'orders' as is_partitioned
  from keys join nulls using (table_name, column_name) join types using (table_name)),
 y as (select table_name, bool_or(is_primary_key) as pk, max(row_count) as row_count, any_value(table_type) as table_type, any_value(is_partitioned) as is_partitioned,
  arg_min(column_name, ordinal) filter (regexp_matches(data_type, 'date|timestamp')) as dc, string_agg(column_name, ', ' order by ordinal) filter (null_percentage > 50) as nulls,
  string_agg(column_name, ', ' order by ordinal) filter (is_foreign_key) as fks from x group by 1)
 select table_name, 'primary_key' as rule, 'Consider adding a primary key for better data integrity' as recommendation from y where not pk
 union all select table_name, 'partitioning', 'Consider partitioning by date column: ' || dc from y where not is_partitioned and row_count > 5000 and dc is not null
 union all select table_name, 'nulls', 'Review columns with high null percentages: ' || nulls from y where nulls is not null
 union all select table_name, 'indexing', 'Consider indexing foreign key columns: ' || fks from y where table_type = 'fact' and fks is not null"""
QUERIES["j12_db_insights"] = lambda s, d: rc.database_insights(_tables(s, d), 5000)
ORACLES["j12_db_insights"] = WITH + f", {KEYS_SQL}" + F2_SQL + """ select 'table_type' as kind, table_type as entry, count(*) as tables from types group by 2
 union all select 'large_unpartitioned', table_name, row_count from types where row_count > 5000 and table_name <> 'orders'"""
QUERIES["j13_profile_rules"] = lambda s, d: rc.profile_rules(profiles(s, d), 5000)
ORACLES["j13_profile_rules"] = PROFILE_SQL + """, k as (select *, potential_key and unique_percentage > 95 as is_key, lower(column_name) like '%\\_id' escape '\\' and unique_percentage <= 95 as is_fk from c)
 select table_name, column_name, 'potential_key' as rule, '' as detail, cast(null as double) as confidence from k where is_key
 union all select table_name, column_name, 'potential_foreign_key', substr(column_name, 1, length(column_name) - 3), 0.7e0 from k where is_fk
 union all select table_name, column_name, 'partitioning', '', null from k where data_classification = 'temporal' and total_count > 5000
 union all select table_name, column_name, 'indexing', '', null from k where is_key or is_fk"""


def _j14(s, d):
    tables = {**star(s, d), **_wide(s, d), "no_rows": table(s, d, "region").where("r_regionkey < 0")}
    cat = ca.lake_catalog(tables)
    parted = cat.where(F.col("table_name").isin(PARTITIONED)).select("table_name").distinct()
    return rc.metadata_rules(cat, re.suffix_references(cat), parted, row_limit=5000)


# the wide set brings its own orders table, which replaces the renamed one
QUERIES["j14_metadata_rules"] = _j14
ORACLES["j14_metadata_rules"] = WITH + SUFFIX_SQL + """, t as (select table_name, max(row_count) as row_count, bool_or(type_bucket = 'date') as dated from cat where table_name <> 'orders' group by 1
  union all select 'orders', count(*), true from orders union all select 'order_flags', count(*), false from orders union all select 'no_rows', 0, false)
 select 'Found 1 empty tables - consider archiving or populating them' as recommendation
 union all select 'Found 1 wide tables (>50 columns) - consider normalization'
 union all select 'Found ' || count(*) || ' large unpartitioned tables - consider partitioning for performance' from t where row_count > 5000 and table_name not in ('orders', 'fact_lineitem') having count(*) > 0
 union all select 'Found ' || count(*) || ' tables with date columns - validate date formats and consider time-based partitioning' from t where dated
 union all select 'Identified ' || count(*) || ' potential foreign key relationships - consider adding formal constraints' from refs2 where table_name <> 'orders'"""

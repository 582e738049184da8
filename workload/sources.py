"""A: scans, samples, catalogs, statistics, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakegauge.operators import catalog as ca, numeric as nu
from lakegauge.plans import lake as lk
from lakegauge.sources import readers as rd, sinks as sk
from lakegauge.sources.work import fresh_path
from workload.common import (TABLES, columns, lake, per_column, planted_orders, ORDERS_SQL, rounded, table, union_all)

ALL = list(TABLES)
QUERIES, ORACLES = {}, {}

# Spark type names for the catalog's SQL twin
TYPE_SQL = """case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'VARCHAR' then 'string'
 when 'DOUBLE' then 'double' when 'TIMESTAMP' then 'timestamp_ntz' when 'FLOAT[]' then 'array<float>' end"""
NAMES_SQL = "(" + ", ".join(f"'{t}'" for t in ALL) + ")"
COUNTS_SQL = union_all(f"select '{t}' as table_name, count(*) as row_count from {t}" for t in ALL)
CATALOG_SQL = f"""(select distinct c.table_name, c.column_name, cast(c.ordinal_position as integer) as ordinal,
 {TYPE_SQL} as data_type, n.row_count,
 case when regexp_matches(lower({TYPE_SQL}), 'date|time') then 'date'
      when regexp_matches(lower({TYPE_SQL}), 'int|double|float|decimal|numeric') then 'numeric' else 'text' end as type_bucket
 from information_schema.columns c join ({COUNTS_SQL}) n using (table_name) where c.table_name in {NAMES_SQL})"""


QUERIES["a1_scan"] = lambda s, d: rounded(table(s, d, "lineitem").agg(
    F.count(F.lit(1)).alias("row_count"), F.sum("l_orderkey").alias("sum_orderkey"),
    F.sum("l_quantity").alias("sum_quantity"), F.sum("l_extendedprice").alias("sum_price")), 2)
ORACLES["a1_scan"] = """select count(*) as row_count, cast(sum(l_orderkey) as bigint) as sum_orderkey,
 round(sum(l_quantity), 2) as sum_quantity, round(sum(l_extendedprice), 2) as sum_price from lineitem"""

QUERIES["a2_sample"] = lambda s, d: rd.head_sample(table(s, d, "orders"), ["o_orderkey"], 1000).select(
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
ORACLES["a2_sample"] = "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders order by o_orderkey limit 1000"

QUERIES["a3_subset_profile"] = lambda s, d: rounded(nu.moments(nu.numbers(
    rd.column_subset(table(s, d, "lineitem"), ["l_quantity", "l_discount"]), "lineitem"))
    .select("table_name", "column_name", "non_null_count", "min_value", "max_value", "mean", "std_dev"))
ORACLES["a3_subset_profile"] = per_column(
    """select '{t}' as table_name, '{c}' as column_name, count({c}) as non_null_count, round(min({c}), 4) as min_value,
 round(max({c}), 4) as max_value, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std_dev from {t}""",
    {"lineitem": ["l_quantity", "l_discount"]})

QUERIES["a4_table_select"] = lambda s, d: rd.select_tables(
    ca.lake_catalog(lake(s, d)), "p*, orders, *item").groupBy("table_name").agg(
    F.count(F.lit(1)).alias("column_count"), F.max("row_count").alias("row_count"))
ORACLES["a4_table_select"] = f"""select table_name, count(*) as column_count, max(row_count) as row_count from {CATALOG_SQL}
 where table_name like 'p%' or table_name = 'orders' or table_name like '%item' group by table_name"""

QUERIES["a5_column_catalog"] = lambda s, d: ca.lake_catalog(lake(s, d)).select(
    "table_name", "column_name", "ordinal", "data_type", "type_bucket", "row_count")
ORACLES["a5_column_catalog"] = f"select table_name, column_name, ordinal, data_type, type_bucket, row_count from {CATALOG_SQL}"


def _bytes_sql(t):
    size = {"int": "4", "bigint": "8", "double": "8", "timestamp": "8", "string": "strlen({c})", "array": "4 * len({c})"}
    parts = [f"coalesce(sum(case when {c} is null then 0 else {size[k].format(c=c)} end), 0)" for c, k in TABLES[t].items()]
    return (f"select 'default' as database, '{t}' as table_name, cast({len(TABLES[t])} as bigint) as column_count, "
            f"count(*) as row_count, cast({' + '.join(parts)} as bigint) as size_bytes from {t}")


STATS_SQL = union_all(_bytes_sql(t) for t in ALL)
QUERIES["a6_table_stats"] = lambda s, d: ca.lake_stats(lake(s, d))
ORACLES["a6_table_stats"] = STATS_SQL


# file sizes and times have no SQL twin: tested against the file system
def stored(s, d):
    return ca.file_stats(s, {t: f"{d}/{t}.parquet" for t in ALL})


QUERIES["a6_file_stats"] = stored


def _a7(s, d):
    """Write status shares as nested JSON and flat CSV, read both back and compare."""
    folder = fresh_path(s, "sink")
    shares = (table(s, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
              .select(F.col("o_orderstatus").alias("status"), F.struct("o_orderpriority", "n").alias("detail")))
    sk.write_result(shares, folder + "/json", "json")
    sk.write_result(shares, folder + "/csv", "csv")
    sk.write_result(shares, folder + "/parquet", "parquet")
    j = s.read.schema(shares.schema).json(folder + "/json").select("status", "detail.o_orderpriority", "detail.n")
    c = (s.read.schema("status string, detail string").option("header", True).option("escape", '"').csv(folder + "/csv")
         .select("status", F.get_json_object("detail", "$.o_orderpriority").alias("o_orderpriority"),
                 F.get_json_object("detail", "$.n").cast("bigint").alias("n")))
    p = s.read.parquet(folder + "/parquet").select("status", "detail.o_orderpriority", "detail.n")
    both = j.withColumn("src", F.lit("json")).unionByName(c.withColumn("src", F.lit("csv"))).unionByName(
        p.withColumn("src", F.lit("parquet")))
    return both.groupBy("status", "o_orderpriority").agg(
        F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.count_distinct("n").alias("versions"))


QUERIES["a7_sinks"] = _a7
ORACLES["a7_sinks"] = """select o_orderstatus as status, o_orderpriority, count(*) as n, cast(3 as bigint) as copies,
 cast(1 as bigint) as versions from orders group by all"""

SCALAR = {t: columns(t, {"int", "bigint", "double", "timestamp", "string"}) for t in ["orders", "events", "documents"]}
QUERIES["a8_show_stats"] = lambda s, d: rounded(lk.union_tables(ca.show_stats, lake(s, d, SCALAR)))
ORACLES["a8_show_stats"] = union_all(
    f"""select '{t}' as table_name, '{c}' as column_name, cast(coalesce(sum(case when {c} is null then 0 else
 {'strlen(' + c + ')' if TABLES[t][c] == 'string' else ('4' if TABLES[t][c] == 'int' else '8')} end), 0) as bigint) as data_size,
 count(distinct {c}) as distinct_values_count, round(1 - count({c}) * 1.0 / count(*), 4) as nulls_fraction from {t}"""
    for t in SCALAR for c in SCALAR[t])

QUERIES["a9_column_stats"] = lambda s, d: rounded(lk.union_tables(ca.column_stats, {
    "orders": planted_orders(s, d), "lineitem": table(s, d, "lineitem")}))
ORACLES["a9_column_stats"] = "with planted as (" + ORDERS_SQL + ") " + union_all(
    f"""select '{t}' as table_name, '{c}' as column_name, count(*) as total_count, count({c}) as non_null_count,
 count(distinct {c}) as distinct_count, count(*) - count({c}) as null_count,
 round((count(*) - count({c})) * 100.0 / count(*), 4) as null_percentage from {f}"""
    for t, f, cs in [("orders", "planted", columns("orders") + ["order_day", "date_key", "part_spec"]),
                     ("lineitem", "lineitem", columns("lineitem"))] for c in cs)

QUERIES["a10_min_max"] = lambda s, d: lk.union_tables(ca.range_stats, lake(s, d, ["orders", "lineitem", "customer"])).select(
    "table_name", "column_name", "min_value", "max_value")
ORACLES["a10_min_max"] = union_all(
    f"select '{t}' as table_name, '{c}' as column_name, cast(min({c}{z}) as varchar) as min_value, cast(max({c}{z}) as varchar) as max_value from {t}"
    for t in ["orders", "lineitem", "customer"] for c, z in [(c, " + 0.0" if TABLES[t][c] == "double" else "") for c in columns(t)])


def _a10_approx(s, d):
    """Approximate against exact distinct counts: every column within 5 %."""
    tables = lake(s, d, ["orders", "lineitem"])
    approx = lk.union_tables(ca.range_stats, tables).select("table_name", "column_name", "approx_distinct_count")
    exact = lk.union_tables(ca.column_stats, tables).select("table_name", "column_name", "distinct_count")
    return approx.join(exact, ["table_name", "column_name"]).select(
        "table_name", "column_name", "distinct_count",
        (F.abs(F.col("approx_distinct_count") - F.col("distinct_count")) <= F.greatest(
            F.lit(1.0), 0.05 * F.col("distinct_count"))).alias("within_5_percent"))


QUERIES["a10_approx_distinct"] = _a10_approx
ORACLES["a10_approx_distinct"] = per_column(
    "select '{t}' as table_name, '{c}' as column_name, count(distinct {c}) as distinct_count, true as within_5_percent from {t}",
    {t: columns(t) for t in ["orders", "lineitem"]})

# one DDL text per order, derived from its attributes
DDL = """concat('CREATE TABLE lake.t_', cast(o_orderkey as string), ' (id bigint COMMENT ''key of ', o_orderstatus,
 ''', price double', ') ',
 case when o_orderkey % 3 = 0 then 'PARTITIONED BY (dt string, region string) ' when o_orderkey % 3 = 1 then 'partitioned by (o_day date) ' else '' end,
 case when o_orderkey % 5 = 0 then 'CLUSTERED BY (id) INTO 8 BUCKETS ' else '' end,
 case when o_orderkey % 4 = 0 then 'STORED AS PARQUET ' when o_orderkey % 4 = 1 then 'stored as orc ' when o_orderkey % 4 = 2 then 'STORED AS TEXTFILE ' else '' end,
 case when o_orderkey % 2 = 0 then concat('LOCATION ''/lake/', o_orderpriority, '/', cast(o_orderkey as string), ''' ') else '' end,
 case when o_orderkey % 7 = 0 then 'TBLPROPERTIES (''compression''=''SNAPPY'')' else '' end)"""
QUERIES["a11_ddl_properties"] = lambda s, d: ca.ddl_properties(
    table(s, d, "orders").selectExpr("o_orderkey", f"{DDL} as ddl"))
ORACLES["a11_ddl_properties"] = f"""with t as (select o_orderkey, o_orderstatus, o_orderpriority, {DDL} as ddl from orders)
select o_orderkey, o_orderkey % 3 < 2 as partitioned, o_orderkey % 5 = 0 as bucketed,
 regexp_matches(ddl, '(?i)parquet|orc|gzip|snappy') as compressed,
 case o_orderkey % 4 when 0 then 'PARQUET' when 1 then 'ORC' when 2 then 'TEXTFILE' end as file_format,
 case when o_orderkey % 7 = 0 then 'SNAPPY' end as compression,
 case when o_orderkey % 2 = 0 then '/lake/' || o_orderpriority || '/' || cast(o_orderkey as varchar) end as location,
 case o_orderkey % 3 when 0 then 'DT,REGION' when 1 then 'O_DAY' else '' end as partition_columns,
 'key of ' || o_orderstatus as comment from t"""


QUERIES["a12_profile_all"] = lambda s, d: rounded(lk.profile_all(
    {t: (lambda t=t: table(s, d, t)) for t in [*ALL, "no_such_table"]})
    .select("table_name", "column_name", "total_count", "null_count", "unique_count", "mean", "failed"))
ORACLES["a12_profile_all"] = union_all(
    f"""select '{t}' as table_name, '{c}' as column_name, count(*) as total_count, count(*) - count({c}) as null_count,
 count(distinct {c}) as unique_count, {f'round(avg({c}), 4)' if k in ('int', 'bigint', 'double') else 'cast(null as double)'} as mean,
 false as failed from {t}""" for t in ALL for c, k in TABLES[t].items()) + """
union all select 'no_such_table', null, null, null, null, null, true"""

# one more table, whose last row cannot be computed
BROKEN = "case when r_name = 'EUROPE' then cast(raise_error('unreadable row') as string) else r_name end as r_name"
QUERIES["a12_profile_each"] = lambda s, d: rounded(lk.profile_each(
    s, {**{t: (lambda t=t: table(s, d, t)) for t in [*ALL, "no_such_table"]},
        "broken": lambda: table(s, d, "region").selectExpr("r_regionkey", BROKEN)})
    .select("table_name", "column_name", "total_count", "null_count", "unique_count", "mean", "failed"))
ORACLES["a12_profile_each"] = ORACLES["a12_profile_all"] + """
union all select 'broken', null, null, null, null, null, true"""

QUERIES["a13_stored_summary"] = lambda s, d: ca.database_summary(stored(s, d))
QUERIES["a13_db_summary"] = lambda s, d: ca.database_summary(ca.lake_stats(lake(s, d)))
ORACLES["a13_db_summary"] = f"""select database, count(*) as total_tables, cast(sum(column_count) as bigint) as total_columns,
 cast(sum(row_count) as bigint) as total_rows, cast(sum(size_bytes) as bigint) as total_size_bytes from ({STATS_SQL}) group by database"""

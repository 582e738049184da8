"""H: partition analytics over orders partitioned by order day."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakegauge.operators import catalog as ca, partitions as pt
from lakegauge.sources import sinks as sk
from lakegauge.sources.work import fresh_path
from workload.common import ORDERS_SQL, lake, planted_orders, table, union_all
from workload.relations import star, WITH
from workload.sources import CATALOG_SQL

QUERIES, ORACLES = {}, {}
AS_OF = "2001-06-15"
P = f"with p as ({ORDERS_SQL}) "

QUERIES["h1_partitions"] = lambda s, d: pt.partition_list(planted_orders(s, d), "part_spec")
ORACLES["h1_partitions"] = P + """select part_spec as partition, count(*) as row_count, row_number() over (order by part_spec) <= 10 as listed from p group by 1"""

QUERIES["h2_partition_parse"] = lambda s, d: pt.parse_partitions(pt.partition_list(planted_orders(s, d), "part_spec").drop("listed"))
ORACLES["h2_partition_parse"] = P + """, g as (select part_spec as partition, count(*) as row_count from p group by 1)
 select partition, row_count, 0 as position, 'date_key' as partition_column, split_part(split_part(partition, '/', 1), '=', 2) as value, true as is_date from g
 union all select partition, row_count, 1, 'status', split_part(split_part(partition, '/', 2), '=', 2), false from g"""

# one value column that mixes the formats
MIXED = """case when o_orderkey % 4 = 0 then replace(substr(cast(o_orderdate as string),1,10),'-','')
 when o_orderkey % 4 = 1 then substr(cast(o_orderdate as string),1,10) when o_orderkey % 4 = 2 then substr(cast(o_orderdate as string),1,7)
 else concat('v', substr(cast(o_orderdate as string),1,7)) end"""
QUERIES["h3_partition_format"] = lambda s, d: (table(s, d, "orders").selectExpr(f"{MIXED} as value")
    .groupBy("value").agg(F.count(F.lit(1)).alias("row_count"))
    .withColumn("partition_format", pt.partition_format(F.col("value")))
    .withColumn("partition_date", pt.partition_date(F.col("value")).cast("string")))
ORACLES["h3_partition_format"] = f"""with v as (select {MIXED} as value, count(*) as row_count from orders group by 1)
 select value, row_count, case when regexp_matches(value, '^[0-9]{{8}}$') then 'YYYYMMDD' when regexp_matches(value, '^.{{4}}-.{{2}}-.{{2}}$') then 'YYYY-MM-DD'
 when length(value) = 7 then 'YYYY-MM' else 'unknown' end as partition_format,
 cast(cast(coalesce(try_strptime(value, '%Y%m%d'), try_strptime(value, '%Y-%m-%d'), try_strptime(value || '-01', '%Y-%m-%d')) as date) as varchar) as partition_date from v"""

QUERIES["h4_recent_partitions"] = lambda s, d: pt.recent_partitions(planted_orders(s, d), "date_key", AS_OF).withColumn(
    "partition_date", F.col("partition_date").cast("string"))
ORACLES["h4_recent_partitions"] = P + f"""select date_key as date_value, count(*) as row_count, 'YYYYMMDD' as partition_format, cast(cast(strptime(date_key, '%Y%m%d') as date) as varchar) as partition_date,
 cast(strptime(date_key, '%Y%m%d') as date) >= date '{AS_OF}' - 30 as is_recent, cast(strptime(date_key, '%Y%m%d') as date) >= date '{AS_OF}' - 1825 as in_5_years from p group by date_key"""

CASES = [("date_key", "YYYYMMDD"), ("order_day", "YYYY-MM-DD"), ("order_month", "YYYY-MM")]


def _monthly(s, d):
    return planted_orders(s, d).withColumn("order_month", F.substr("order_day", F.lit(1), F.lit(7)))


def _each(metric):
    def run(s, d):
        out = None
        for column, shape in CASES:
            one = metric(_monthly(s, d), column, AS_OF, shape)
            out = one if out is None else out.unionByName(one)
        return out
    return run


PM = f"with q as ({ORDERS_SQL}), p as (select *, substr(order_day, 1, 7) as order_month, cast(o_orderdate as date) as day from q) "
RECENT = {"date_key": f"day between date '{AS_OF}' - 6 and date '{AS_OF}'", "order_day": f"day between date '{AS_OF}' - 6 and date '{AS_OF}'",
          "order_month": f"order_month = '{AS_OF[:7]}'"}
QUERIES["h5_recent_sample"] = _each(pt.recent_sample)
ORACLES["h5_recent_sample"] = PM + union_all(
    f"select '{c}' as partition_column, count(*) as recent_sample_count, 'last {'1 month' if c == 'order_month' else '7 days'}' as sample_period from p where {RECENT[c]}"
    for c, _ in CASES)
QUERIES["h6_rowcount_estimate"] = _each(pt.row_count_estimate)


def _estimate_sql(c, shape):
    start = f"date '{AS_OF}' - 1825"
    date = "cast(strptime(order_month || '-01', '%Y-%m-%d') as date)" if c == "order_month" else "day"
    estimate = "r * (n5 / 60)" if c == "order_month" else "r / 7 * n5"
    return f"""select '{c}' as partition_column, '{shape}' as partition_format, r as recent_sample_count, n5 as partitions_in_5_years, n as partition_count,
 cast(floor({estimate}) as bigint) as estimated_rows from (select count(*) filter ({RECENT[c]}) as r, count(distinct {c}) as n,
 count(distinct {c}) filter ({date} >= {start}) as n5 from p)"""


ORACLES["h6_rowcount_estimate"] = PM + union_all(_estimate_sql(c, f) for c, f in CASES)

# orders stored by month: folders listed without opening files, rows counted from footers, other months skipped
MONTH = ("order_month", "YYYY-MM")


def _stored(s, d):
    path = fresh_path(s, "orders-by-month")
    sk.write_partitioned(_monthly(s, d), path, ["order_month"])
    return path


def _months(s, path):
    # months stay texts
    return s.read.schema("o_orderkey bigint, order_month string").parquet(path)


def _h1_stored(s, d):
    path = _stored(s, d)
    counted = pt.partition_list(_months(s, path).select(pt.partition_spec(["order_month"]).alias("spec")), "spec")
    return pt.stored_partitions(s, path).where("file_count > 0 and size_bytes > 0").select("partition").join(counted, "partition")


QUERIES["h1_stored_partitions"] = _h1_stored
ORACLES["h1_stored_partitions"] = PM + """select 'order_month=' || order_month as partition, count(*) as row_count,
 row_number() over (order by order_month) <= 10 as listed from p group by order_month"""
QUERIES["h4_stored_recent"] = lambda s, d: pt.recent_partitions(_months(s, _stored(s, d)), "order_month", AS_OF).withColumn(
    "partition_date", F.col("partition_date").cast("string"))
ORACLES["h4_stored_recent"] = PM + f""", m as (select order_month as date_value, count(*) as row_count, cast(strptime(order_month || '-01', '%Y-%m-%d') as date) as first from p group by 1)
 select date_value, row_count, 'YYYY-MM' as partition_format, cast(first as varchar) as partition_date, first >= date '{AS_OF}' - 30 as is_recent, first >= date '{AS_OF}' - 1825 as in_5_years from m"""
QUERIES["h5_stored_sample"] = lambda s, d: pt.recent_sample(_months(s, _stored(s, d)), "order_month", AS_OF, "YYYY-MM")
ORACLES["h5_stored_sample"] = PM + f"""select 'order_month' as partition_column, count(*) as recent_sample_count, 'last 1 month' as sample_period from p where {RECENT['order_month']}"""
QUERIES["h6_stored_estimate"] = lambda s, d: pt.row_count_estimate(_months(s, _stored(s, d)), "order_month", AS_OF, "YYYY-MM")
ORACLES["h6_stored_estimate"] = PM + _estimate_sql(*MONTH)

QUERIES["h7_partition_like"] = lambda s, d: pt.partition_like_columns(ca.lake_catalog(
    {**lake(s, d), **star(s, d), "orders_keyed": planted_orders(s, d)}))
ORACLES["h7_partition_like"] = WITH + f""", k as (select table_name, c, column_name, row_count from cat union all select table_name, lower(column_name), column_name, row_count from {CATALOG_SQL} where table_name <> 'orders'
 union all select 'orders_keyed', c, c, (select count(*) from orders) from (select unnest(['order_day', 'date_key', 'part_spec', 'o_orderdate', 'o_orderkey']) as c))
 select table_name, column_name, row_count from k where regexp_matches(c, 'date_key|partition|dt|year|month|day')"""

"""I: dimensions, measures, status, churn, channels, history tables, rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakegauge.functions import vocab
from lakegauge.operators import business as bu, catalog as ca, history as hi, values as va
from lakegauge.plans import lake as lk
from workload.common import rounded, table, union_all
from workload.profiling import tokens_sql
from workload.relations import NUMERIC_SQL, STAR, WITH, catalog, star

QUERIES, ORACLES = {}, {}

DIM_TABLES = ["customers", "parts", "fact_lineitem", "orders", "user_events"]


def _dimensions(s, d):
    tables = {t: df for t, df in star(s, d).items() if t in DIM_TABLES}
    stats = va.uniqueness(va.table_counts(tables))
    return bu.dimension_columns(ca.lake_catalog(tables), stats)


QUERIES["i1_dimensions"] = lambda s, d: rounded(_dimensions(s, d).drop("ordinal"), 6)
ORACLES["i1_dimensions"] = WITH + ", u as (" + union_all(
    f"select '{t}' as table_name, '{n}' as column_name, count(*) as n, count(distinct {o}) as u from {STAR[t][0]}"
    for t in DIM_TABLES for n, (o, _) in STAR[t][1].items()) + f"""), k as (select *, case when {tokens_sql('c', vocab.DIMENSION_WORDS)} then 'descriptive_dimension'
 when data_type = 'string' and u / n < 0.1 then 'categorical_dimension' end as type from cat join u using (table_name, column_name))
 select table_name, column_name, data_type, type, u as cardinality, round(u / n, 6) as cardinality_ratio from k where type is not null"""
QUERIES["i2_measures"] = lambda s, d: bu.measure_columns(catalog(s, d))
ORACLES["i2_measures"] = WITH + f""", k as (select *, case when {tokens_sql('c', vocab.DIMENSION_WORDS)} or data_type = 'string' then null
 when {tokens_sql('c', vocab.FACT_WORDS)} then 'measure' when {NUMERIC_SQL} and not c like '%\\_id' escape '\\' then 'potential_measure' end as type from cat)
 select table_name, column_name, data_type, type, row_count from k where type is not null"""

DIMS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount"]
QUERIES["i3_dimension_pairs"] = lambda s, d: bu.dimension_pairs(table(s, d, "lineitem").withColumn(
    "l_discount", F.round(F.col("l_discount") * 100).cast("int")), DIMS)
ORACLES["i3_dimension_pairs"] = "with l as (select * replace (cast(round(l_discount * 100) as integer) as l_discount) from lineitem) " + union_all(
    f"select '{a}' as dimension1, '{b}' as dimension2, cast({a} as varchar) as value1, cast({b} as varchar) as value2, count(*) as record_count from l group by {a}, {b}"
    for a, b in [(a, b) for i, a in enumerate(DIMS) for b in DIMS[i + 1:]])

DAY = "1998-08-25"
QUERIES["i4_status_today"] = lambda s, d: bu.status_on_day(table(s, d, "orders"), "o_orderstatus", "o_orderdate", DAY, ("o", "p"), ("f",))
ORACLES["i4_status_today"] = f"""select count(*) as total_subscriptions, count(*) filter (lower(o_orderstatus) in ('o', 'p')) as active_subscriptions,
 count(*) filter (lower(o_orderstatus) = 'f') as cancelled_subscriptions from orders where cast(o_orderdate as date) = date '{DAY}'"""
QUERIES["i5_last_7_days"] = lambda s, d: bu.last_days(table(s, d, "orders"), "o_orderdate", DAY)
ORACLES["i5_last_7_days"] = f"select count(*) as subscriptions_last_7_days from orders where cast(o_orderdate as date) between date '{DAY}' - 7 and date '{DAY}'"
QUERIES["i6_status_distribution"] = lambda s, d: bu.status_distribution(table(s, d, "part"), "p_type")
ORACLES["i6_status_distribution"] = "select p_type as status, count(*) as count from part group by 1 order by 2 desc, 1 limit 10"
# event types as subscription states
STATE = "case event_type when 'error' then 'Churned' when 'logout' then 'EXPIRED' else event_type end"
QUERIES["i7_churn"] = lambda s, d: bu.churn(table(s, d, "events").withColumn("state", F.expr(STATE)), "state")
ORACLES["i7_churn"] = f"""with e as (select lower({STATE}) in ('cancelled', 'churned', 'expired', 'inactive') as gone from events)
 select count(*) as total_subscriptions, count(*) filter (gone) as churned_subscriptions, round_even(count(*) filter (gone) / count(*) * 100, 2) as churn_rate_percent,
 round_even(100 - count(*) filter (gone) / count(*) * 100, 2) as retention_rate_percent from e"""
CHANNEL = "case when doc_id % 11 = 0 then null when doc_id % 13 = 0 then '' else concat(source, '-', lang) end"
QUERIES["i8_channels"] = lambda s, d: bu.channels(table(s, d, "documents").withColumn("channel", F.expr(CHANNEL)), "channel")
ORACLES["i8_channels"] = f"""with g as (select {CHANNEL} as c, count(*) as n from documents group by 1 order by n desc, c asc nulls first limit 10)
 select case when coalesce(c, '') = '' then 'Unknown' else c end as channel, n as subscriber_count, round_even(n / sum(n) over () * 100, 1) as percentage from g"""

PICK = {"subscriptions": ("orders", {"o_orderkey": "subscription_id", "o_orderstatus": "status", "o_orderdate": "start_date",
                                     "o_orderpriority": "channel", "o_custkey": "customer_id", "o_totalprice": "end_price"}),
        "campaigns": ("documents", {"doc_id": "id", "source": "source_platform", "lang": "medium", "text": "status_text",
                                    "n_chars": "churn_status"}),
        "plain": ("region", {"r_regionkey": "key", "r_name": "label"})}


def _picked(s, d):
    return bu.pick_columns(ca.lake_catalog({t: table(s, d, src).select(*[F.col(o).alias(n) for o, n in m.items()])
                                            for t, (src, m) in PICK.items()}))


QUERIES["i9_column_pick"] = _picked
ORACLES["i9_column_pick"] = "with cat as (" + union_all(
    f"select '{t}' as table_name, '{n}' as column_name, {i} as ordinal, (select count(*) from {src}) as row_count"
    for t, (src, m) in PICK.items() for i, n in enumerate(m.values())) + f"""), f as (select *, contains(column_name, 'status') as st,
 {tokens_sql('column_name', vocab.START_DATE_TOKENS)} as sd, {tokens_sql('column_name', vocab.END_DATE_TOKENS)} as ed,
 {tokens_sql('column_name', vocab.METRIC_CHANNEL_TOKENS)} as mc, {tokens_sql('column_name', vocab.CHANNEL_TOKENS)} as ch from cat)
 select table_name, max(row_count) as row_count, arg_max(column_name, ordinal) filter (st) as status_column,
 coalesce(string_agg(column_name, ', ' order by ordinal) filter (not st and sd), '') as date_columns,
 coalesce(string_agg(column_name, ', ' order by ordinal) filter (not st and ed), '') as end_date_columns,
 arg_max(column_name, ordinal) filter (not st and not sd and mc) as metric_channel_column, arg_min(column_name, ordinal) filter (ch) as channel_column from f group by 1"""

ORDER = ["ts", "event_id"]
CHANGE_SQL = """with c as (select *, lag(event_type) over (partition by user_id order by ts, event_id) as previous_state,
 row_number() over (partition by user_id order by ts, event_id) as rn from events), k as (select * from c where rn = 1 or previous_state is distinct from event_type)"""
QUERIES["i10_scd2"] = lambda s, d: hi.type2_dimension(table(s, d, "events"), "user_id", ORDER, "event_type").withColumn(
    "effective_at", F.col("effective_at").cast("string")).withColumn("expires_at", F.col("expires_at").cast("string"))
ORACLES["i10_scd2"] = CHANGE_SQL + """ select user_id, event_type as state, cast(ts as varchar) as effective_at,
 cast(lead(ts) over w as varchar) as expires_at, row_number() over w as version, lead(ts) over w is null as is_current from k window w as (partition by user_id order by ts, event_id)"""
QUERIES["i11_dimension_extract"] = lambda s, d: hi.extract_dimension(table(s, d, "events"), "user_id", ORDER, ["event_type", "value"]).withColumn(
    "first_seen", F.col("first_seen").cast("string")).withColumn("last_seen", F.col("last_seen").cast("string")).drop("surrogate_key")
ORACLES["i11_dimension_extract"] = """select user_id, count(*) as source_rows, cast(min(ts) as varchar) as first_seen, cast(max(ts) as varchar) as last_seen,
 arg_max(event_type, (ts, event_id)) as latest_event_type, arg_max(value, (ts, event_id)) as latest_value,
 arg_min(event_type, (ts, event_id)) as first_event_type, arg_min(value, (ts, event_id)) as first_value from events group by 1"""
QUERIES["i12_state_changes"] = lambda s, d: hi.state_changes(table(s, d, "events"), "user_id", ORDER, "event_type").withColumn(
    "changed_at", F.col("changed_at").cast("string"))
ORACLES["i12_state_changes"] = CHANGE_SQL + """, x as (select *, lag(ts) over (partition by user_id order by ts, event_id) as since from k)
 select user_id, previous_state, event_type as state, cast(ts as varchar) as changed_at, date_sub('day', since, ts) as duration_days from x where since is not null"""
QUERIES["i13_period_rollup"] = lambda s, d: rounded(bu.period_rollup(table(s, d, "orders"), "o_orderdate", "o_totalprice"), 2)
ORACLES["i13_period_rollup"] = """select cast(y as integer) as year, cast(q as integer) as quarter, cast(m as integer) as month, count(*) as record_count, round(sum(o_totalprice), 2) as total_value,
 round(avg(o_totalprice), 2) as avg_value from (select *, year(o_orderdate) as y, quarter(o_orderdate) as q, month(o_orderdate) as m from orders) group by rollup (y, q, m)"""

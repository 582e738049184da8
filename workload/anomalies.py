"""D: outliers, time patterns, series."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakegauge.operators import anomalies as an, numeric as nu, series as se, temporal as te, values as va
from lakegauge.plans import lake as lk
from workload.common import NUMERIC, as_money, columns, lake, rounded, table, union_all

QUERIES, ORACLES = {}, {}
NUM = {t: columns(t, NUMERIC) for t in ["events", "documents", "orders", "lineitem", "part"]}


def _numbers(s, d):
    return lk.union_tables(nu.numbers, lake(s, d, NUM))


def _shown(found):
    return rounded(found.withColumn("examples", as_money("examples")))


def _outlier_sql(bounds, distance, condition, kind):
    def one(t, c):
        b = bounds.format(t=t, c=c)
        return f"""select '{t}' as table_name, '{c}' as column_name, '{kind}' as type, cast(sum(n) as bigint) as count,
 round(sum(n) * 100.0 / max(size), 4) as percentage,
 string_agg(cast(cast(round(v, 2) as decimal(18,2)) as varchar), ',' order by dist desc, v) filter (rank <= 5) as examples
 from (select *, row_number() over (order by dist desc, v) as rank from (
  select cast({c} as double) + 0.0 as v, count(*) as n, any_value(size) as size, any_value({distance.format(c=c)}) as dist
  from {t}, ({b}) where {condition.format(c=c)} group by 1)) having count(*) > 0"""
    return union_all(one(t, c) for t, cs in NUM.items() for c in cs)


QUERIES["d1_zscore"] = lambda s, d: _shown(an.zscore_outliers(_numbers(s, d))).drop("description")
ORACLES["d1_zscore"] = _outlier_sql("select avg({c}) as m, stddev_pop({c}) as sd, count({c}) as size from {t}",
                                    "abs({c} - m) / sd", "sd > 0 and abs({c} - m) / sd > 3", "statistical_outliers")
QUERIES["d2_iqr"] = lambda s, d: _shown(an.iqr_outliers(_numbers(s, d))).drop("description")
ORACLES["d2_iqr"] = _outlier_sql(
    """select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi, size from (select quantile_cont(cast({c} as double), 0.25) as q1,
 quantile_cont(cast({c} as double), 0.75) as q3, count({c}) as size from {t})""",
    "greatest(lo - {c}, {c} - hi)", "{c} < lo or {c} > hi", "iqr_outliers")

TEXT = {t: columns(t, {"string"}) for t in ["documents", "pages", "orders", "conversations", "customer"]}


def _length_sql(t, c):
    return f"""select '{t}' as table_name, '{c}' as column_name, cast(sum(n) as bigint) as count, round(sum(n) * 100.0 / max(size), 4) as percentage,
 string_agg(cast(cast(v as decimal(18,2)) as varchar), ',' order by dist desc, v) filter (rank <= 5) as examples
 from (select *, row_number() over (order by dist desc, v) as rank from (
  select length({c}) as v, count(*) as n, any_value(size) as size, any_value(abs(length({c}) - m) / sd) as dist
  from {t}, (select avg(length({c})) as m, stddev_pop(length({c})) as sd, count({c}) as size from {t})
  where sd > 1e-9 and abs(length({c}) - m) / sd > 2 group by 1)) having count(*) > 0"""


QUERIES["d3_length_outliers"] = lambda s, d: _shown(an.length_outliers(va.length_counts(
    va.table_counts(lake(s, d, TEXT), TEXT)))).drop("type", "description")
ORACLES["d3_length_outliers"] = union_all(_length_sql(t, c) for t, cs in TEXT.items() for c in cs)

# a copy of the events that keeps mostly Mondays, mornings and January, so that
# every kind of time pattern also fires
SKEWED = """select event_id, user_id, value, ts, case when event_id % 20 = 0 then ts
 when event_id % 2 = 0 then timestamp '2024-01-01 09:00:00' else ts end as skewed_ts,
 case when event_id % 8 = 0 then timestamp '2024-05-06 10:00:00' else ts end as season_ts from events"""
TIMES = ["ts", "skewed_ts", "season_ts"]


def skewed_events(s, d):
    e = table(s, d, "events")
    return e.selectExpr(
        "event_id", "user_id", "value", "ts",
        "case when event_id % 20 = 0 then ts when event_id % 2 = 0 then timestamp_ntz '2024-01-01 09:00:00' else ts end as skewed_ts",
        "case when event_id % 8 = 0 then timestamp_ntz '2024-05-06 10:00:00' else ts end as season_ts")


def _instants(s, d):
    return (te.instants(skewed_events(s, d), "events").unionByName(te.instants(table(s, d, "orders"), "orders"))
            .unionByName(te.instants(table(s, d, "lineitem"), "lineitem")))


def _variation(kind):
    def run(s, d):
        data = F.array_join(F.transform(F.array_sort(F.map_entries("data")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
        return rounded(te.temporal_variation(_instants(s, d), (kind,)).select(
            "table_name", "column_name", F.col("buckets"), "variation", "is_pattern", data.alias("data")), 6)
    return run


def _variation_sql(part, limit):
    return f"with ev as ({SKEWED}) " + union_all(
        f"""select '{t}' as table_name, '{c}' as column_name, count(*) as buckets, round(stddev_samp(n) / avg(n), 6) as variation,
 coalesce(stddev_samp(n) / avg(n) > {limit}, false) as is_pattern, string_agg(b || ':' || n, ',' order by b) as data
 from (select {part.format(c=c)} as b, count(*) as n from {f} group by 1)"""
        for t, f, cs in [("events", "ev", TIMES), ("orders", "orders", ["o_orderdate"]), ("lineitem", "lineitem", ["l_shipdate"])]
        for c in cs)


QUERIES["d4_dow_pattern"] = _variation("day_of_week")
ORACLES["d4_dow_pattern"] = _variation_sql("isodow({c}) - 1", 0.5)
QUERIES["d5_hour_pattern"] = _variation("hour_of_day")
ORACLES["d5_hour_pattern"] = _variation_sql("hour({c})", 0.5)
QUERIES["d6_month_pattern"] = _variation("monthly")
ORACLES["d6_month_pattern"] = _variation_sql("month({c})", 0.3)

# events per day with one planted spike and a rising metric
DAILY = """select event_id, cast(ts as date) as day, value, user_id,
 value * case when cast(ts as date) = date '2024-01-15' then 10 else 1 end as value_spiked,
 value * day(ts) as value_rising, value * (40 - day(ts)) as value_falling from events"""
METRICS = ["value", "user_id", "value_spiked", "value_rising", "value_falling"]
START, END = "2024-01-01", "2024-01-30"


def _periods(s, d):
    e = table(s, d, "events").selectExpr(
        "event_id", "cast(ts as date) as day", "value", "user_id",
        "value * case when cast(ts as date) = date '2024-01-15' then 10 else 1 end as value_spiked",
        "value * day(ts) as value_rising", "value * (40 - day(ts)) as value_falling")
    return se.period_metrics(e, "day", METRICS, F.to_date(F.lit(START)), F.to_date(F.lit(END)), "events")


PERIOD_SQL = f"with ev as ({DAILY}), p as (" + union_all(
    f"""select 'events' as table_name, '{m}' as metric, day as period, count(*) as record_count, avg({m}) as avg_value,
 cast(sum({m}) as double) as total_value, min({m}) as min_value, max({m}) as max_value
 from ev where {m} is not null and day between date '{START}' and date '{END}' group by day""" for m in METRICS) + ")"

QUERIES["d7_period_metrics"] = lambda s, d: rounded(_periods(s, d).withColumn("period", F.col("period").cast("string")), 3)
ORACLES["d7_period_metrics"] = PERIOD_SQL + """ select table_name, metric, cast(period as varchar) as period, record_count,
 round(avg_value, 3) as avg_value, round(total_value, 3) as total_value, round(cast(min_value as double), 3) as min_value,
 round(cast(max_value as double), 3) as max_value from p"""

SUMMARY_SQL = """s as (select table_name, metric, count(*) as data_points, avg(total_value) as mean_value, stddev_samp(total_value) as std_value,
 min(period) as min_period, max(period) as max_period from p group by all having count(*) >= 5)"""
SPIKE_SQL = """k as (select p.*, mean_value as baseline_mean, mean_value + 2 * std_value as threshold from p join s using (table_name, metric)
 where total_value > mean_value + 2 * std_value)"""
QUERIES["d8_spikes"] = lambda s, d: rounded(se.spikes(_periods(s, d)).withColumn("period", F.col("period").cast("string")), 3)
ORACLES["d8_spikes"] = PERIOD_SQL + f", {SUMMARY_SQL}, {SPIKE_SQL}" + """ select table_name, metric, cast(period as varchar) as period,
 round(total_value, 3) as total_value, round(threshold, 3) as threshold, round(baseline_mean, 3) as baseline_mean from k"""
QUERIES["d8_spike_summary"] = lambda s, d: rounded(se.spike_summary(se.spikes(_periods(s, d))).withColumn(
    "largest_period", F.col("largest_period").cast("string")), 3)
ORACLES["d8_spike_summary"] = PERIOD_SQL + f", {SUMMARY_SQL}, {SPIKE_SQL}" + """ select table_name, metric, count(*) as spike_count,
 round(max(threshold), 3) as threshold, round(max(baseline_mean), 3) as baseline_mean,
 cast(arg_max(period, total_value) as varchar) as largest_period, round(max(total_value), 3) as largest_value from k group by all"""

TREND_SQL = """r as (select *, row_number() over (partition by table_name, metric order by period) as a,
 row_number() over (partition by table_name, metric order by period desc) as b from p),
 t as (select table_name, metric, avg(total_value) filter (a <= 7) as first_avg, avg(total_value) filter (b <= 7) as last_avg
 from r group by all having count(*) >= 7)"""
QUERIES["d9_trend"] = lambda s, d: rounded(se.trends(_periods(s, d)), 3)
ORACLES["d9_trend"] = PERIOD_SQL + f", {TREND_SQL}" + """ select table_name, metric, round(first_avg, 3) as first_avg, round(last_avg, 3) as last_avg,
 case when last_avg > first_avg * 1.2 then 'up' when last_avg < first_avg * 0.8 then 'down' else 'steady' end as trend,
 round((last_avg / first_avg - 1) * 100, 3) as change_percentage from t"""
QUERIES["d10_series_summary"] = lambda s, d: rounded(se.series_summary(_periods(s, d)).withColumn(
    "min_period", F.col("min_period").cast("string")).withColumn("max_period", F.col("max_period").cast("string")), 3)
ORACLES["d10_series_summary"] = PERIOD_SQL + f", {SUMMARY_SQL}" + """ select table_name, metric, data_points, round(mean_value, 3) as mean_value,
 round(std_value, 3) as std_value, cast(min_period as varchar) as min_period, cast(max_period as varchar) as max_period from s"""
QUERIES["d11_stories"] = lambda s, d: se.stories(se.spikes(_periods(s, d)), se.trends(_periods(s, d)))
ORACLES["d11_stories"] = PERIOD_SQL + f", {SUMMARY_SQL}, {SPIKE_SQL}, {TREND_SQL}" + """
 select table_name, metric, 'spike' as kind, 'Spike alert: ' || table_name || '.' || metric || ' showed unusual activity on ' ||
  cast(arg_max(period, total_value) as varchar) || ', reaching ' || format('{:,}', cast(round(max(total_value)) as bigint)) ||
  ' (baseline average ' || format('{:,}', cast(round(max(baseline_mean)) as bigint)) || ')' as story from k group by table_name, metric
 union all select table_name, metric, 'trend', case when last_avg > first_avg then 'Upward' else 'Downward' end || ' trend: ' || table_name || '.' ||
  metric || ' shows a ' || format('{:.1f}', abs((last_avg / first_avg - 1) * 100)) || '% ' ||
  case when last_avg > first_avg then 'increase' else 'decrease' end || ' over the analyzed period'
 from t where last_avg > first_avg * 1.2 or last_avg < first_avg * 0.8"""
QUERIES["d11_spike_insight"] = lambda s, d: se.spike_insight(se.spikes(_periods(s, d)))
ORACLES["d11_spike_insight"] = PERIOD_SQL + f", {SUMMARY_SQL}, {SPIKE_SQL}" + """ select count(distinct metric) as series_with_spikes,
 'Detected ' || count(distinct metric) || ' unusual spikes across analyzed partitions' as insight from k"""

QUERIES["d12_daily_distribution"] = lambda s, d: te.daily_distribution(
    table(s, d, "lineitem"), "l_shipdate", "1997-03-01", "1997-08-31").select(
    F.col("analysis_date").cast("string").alias("analysis_date"), "record_count")
ORACLES["d12_daily_distribution"] = """select cast(cast(l_shipdate as date) as varchar) as analysis_date, count(*) as record_count from lineitem
 where cast(l_shipdate as date) between date '1997-03-01' and date '1997-08-31' group by 1 order by 1 desc limit 30"""

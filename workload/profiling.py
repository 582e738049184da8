"""B and C: column profiles, value patterns and personal-data flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakegauge.functions import vocab
from lakegauge.operators import anomalies as an, numeric as nu, patterns as pa, temporal as te, values as va
from lakegauge.plans import lake as lk
from workload.common import (
    CUSTOMER_COLUMNS, CUSTOMER_SQL, NUMERIC, ORDERS_SQL, PLANTED_ORDERS, TABLES, columns, lake, per_column, planted_customer, planted_orders, rounded, table, union_all)

QUERIES, ORACLES = {}, {}

NUM = {t: columns(t, NUMERIC) for t in ["orders", "lineitem", "events", "part"]}


def _numbers(s, d, names=tuple(NUM)):
    return lk.union_tables(nu.numbers, lake(s, d, names))


def _counts(s, d, names):
    return va.table_counts(lake(s, d, names))


def _num_sql(fields, cols=NUM):
    return per_column("select '{t}' as table_name, '{c}' as column_name, " + fields + " from {t}", cols)


QUERIES["b1_nulls"] = lambda s, d: rounded(va.presence(planted_customer(s, d), "customer").select("table_name", "column_name", "total_count", "null_count", "null_percentage"))
ORACLES["b1_nulls"] = f"with p as ({CUSTOMER_SQL}) " + union_all(
    f"""select 'customer' as table_name, '{c}' as column_name, count(*) as total_count, count(*) - count({c}) as null_count,
 round((count(*) - count({c})) / count(*) * 100, 4) as null_percentage from p""" for c in CUSTOMER_COLUMNS)

UNIQ_TABLES = ["orders", "lineitem", "documents", "events"]
QUERIES["b2_uniqueness"] = lambda s, d: rounded(va.uniqueness(_counts(s, d, UNIQ_TABLES)).select(
    "table_name", "column_name", "unique_count", "unique_percentage", "duplicate_count"))
ORACLES["b2_uniqueness"] = per_column(
    """select '{t}' as table_name, '{c}' as column_name, count(distinct {c}) as unique_count,
 round(count(distinct {c}) / count({c}) * 100, 4) as unique_percentage, count({c}) - count(distinct {c}) as duplicate_count from {t}""",
    {t: columns(t) for t in UNIQ_TABLES})

QUERIES["b3_numeric_basic"] = lambda s, d: rounded(nu.moments(_numbers(s, d)).join(
    nu.quantiles(_numbers(s, d), {"median": 0.5}), ["table_name", "column_name"]).select(
    "table_name", "column_name", "min_value", "max_value", "mean", "median"))
ORACLES["b3_numeric_basic"] = _num_sql("""round(cast(min({c}) as double), 4) as min_value, round(cast(max({c}) as double), 4) as max_value,
 round(avg({c}), 4) as mean, round(quantile_cont(cast({c} as double), 0.5), 4) as median""")

QUERIES["b4_spread"] = lambda s, d: rounded(nu.moments(_numbers(s, d)).select(
    "table_name", "column_name", F.round("std_dev", 4).alias("std_dev"), F.round("variance", 2).alias("variance")))
ORACLES["b4_spread"] = _num_sql("round(stddev_samp({c}), 4) as std_dev, round(var_samp({c}), 2) as variance")

Z = "(cast({c} as double) - (select avg({c}) from {t})) / (select nullif(stddev_pop({c}), 0) from {t})"
QUERIES["b5_skewness"] = lambda s, d: rounded(nu.moments(_numbers(s, d)).select("table_name", "column_name", "skewness"))
ORACLES["b5_skewness"] = _num_sql(f"round(avg(power({Z}, 3)), 4) + 0.0 as skewness")

QUERIES["b6_kurtosis"] = lambda s, d: rounded(nu.moments(_numbers(s, d)).select("table_name", "column_name", "kurtosis"))
ORACLES["b6_kurtosis"] = _num_sql(f"round(avg(power({Z}, 4)) - 3, 4) as kurtosis")


def _quant(fields):
    return ", ".join(f"round(quantile_cont(cast({{c}} as double), {p}), 4) as {n}" for n, p in fields.items())


QUERIES["b7_quartiles"] = lambda s, d: rounded(nu.quantiles(_numbers(s, d), nu.QUARTILES))
ORACLES["b7_quartiles"] = _num_sql(_quant(nu.QUARTILES))
QUERIES["b8_percentiles"] = lambda s, d: rounded(nu.quantiles(_numbers(s, d), nu.PERCENTILES))
ORACLES["b8_percentiles"] = _num_sql(_quant(nu.PERCENTILES))

TEXT = {t: columns(t, {"string"}) for t in ["orders", "documents", "pages", "conversations", "part"]}


def _lengths(s, d):
    return lk.union_tables(va.text_lengths, lake(s, d, TEXT))


QUERIES["b9_text_lengths"] = lambda s, d: rounded(_lengths(s, d).select(
    "table_name", "column_name", F.col("min_length").cast("bigint").alias("min_length"),
    F.col("max_length").cast("bigint").alias("max_length"), "avg_length"))
ORACLES["b9_text_lengths"] = _num_sql(
    "min(length({c})) as min_length, max(length({c})) as max_length, round(avg(length({c})), 4) as avg_length", TEXT)
QUERIES["b10_format_consistency"] = lambda s, d: rounded(_lengths(s, d).select("table_name", "column_name", "format_consistency"), 6)
ORACLES["b10_format_consistency"] = _num_sql(
    "round(1 - count(distinct length({c})) / count({c}), 6) as format_consistency", TEXT)

DATES = {t: columns(t, {"timestamp"}) for t in ["orders", "lineitem", "events"]}


def _dates(s, d):
    return te.date_range(lk.union_tables(te.instants, lake(s, d, DATES)))


QUERIES["b11_date_range"] = lambda s, d: _dates(s, d).select(
    "table_name", "column_name", F.col("start_date").cast("string").alias("start_date"),
    F.col("end_date").cast("string").alias("end_date"), F.col("range_days").cast("bigint").alias("range_days"))
ORACLES["b11_date_range"] = _num_sql(
    """cast(min({c}) as varchar) as start_date, cast(max({c}) as varchar) as end_date,
 date_sub('day', min({c}), max({c})) as range_days""", DATES)

# spans of every customer's orders: all four kinds of label occur
QUERIES["b12_range_label"] = lambda s, d: (table(s, d, "orders").groupBy("o_custkey")
    .agg(F.timestamp_diff("DAY", F.min("o_orderdate"), F.max("o_orderdate")).alias("range_days"))
    .select("o_custkey", "range_days", te.range_label(F.col("range_days")).alias("label"))
    .unionByName(te.date_range(te.instants(table(s, d, "events"), "events")).select(
        F.lit(-1).cast("bigint").alias("o_custkey"), "range_days", F.col("range_description").alias("label"))))
ORACLES["b12_range_label"] = """with r as (select o_custkey, date_sub('day', min(o_orderdate), max(o_orderdate)) as n from orders group by 1
 union all select -1, date_sub('day', min(ts), max(ts)) from events)
select o_custkey, n as range_days, case when n < 7 then n || ' days' when n < 30 then n // 7 || ' weeks'
 when n < 365 then n // 30 || ' months' else n // 365 || ' years' end as label from r"""

FREQ = {t: columns(t) for t in ["orders", "documents", "lineitem", "pages"]}


def _freq(s, d, which):
    cells = lk.union_tables(lambda df, n: va.cells(df, n, columns(n, {"string"})), lake(s, d, FREQ))  # only texts may be long
    counts = va.table_counts(lake(s, d, FREQ), FREQ)
    return which(counts, va.uniqueness(counts), cells)


def _freq_sql(order, keep):
    def one(t, c):
        v = f"cast({c} as varchar)"
        return f"""select '{t}' as table_name, '{c}' as column_name, rank, v as value, n, round(n / total * 100, 4) as percentage
 from (select v, n, sum(n) over () as total, count(*) over () as u,
  row_number() over (order by {order}) as rank
  from (select {v} as v, count(*) as n from {t} where {c} is not null group by 1)) where rank <= {keep}"""
    return union_all(one(t, c) for t, cs in FREQ.items() for c in cs)


QUERIES["b13_top_values"] = lambda s, d: rounded(_freq(s, d, va.top_values)).withColumn("rank", F.col("rank").cast("bigint"))
ORACLES["b13_top_values"] = _freq_sql("n desc, v asc", "10")
QUERIES["b14_least_values"] = lambda s, d: rounded(_freq(s, d, va.least_values)).withColumn("rank", F.col("rank").cast("bigint"))
ORACLES["b14_least_values"] = _freq_sql("n asc, v desc", "case when u > 20 then 10 else least(5, u) end")

# ---- C ------------------------------------------------------------------------
PATTERN_COLS = {"customer": list(CUSTOMER_COLUMNS), "orders": [*TABLES["orders"], *PLANTED_ORDERS], "pages": columns("pages"),
                "events": columns("events")}


def _pattern_frames(s, d):
    return {"customer": planted_customer(s, d), "orders": planted_orders(s, d), "pages": table(s, d, "pages"),
            "events": table(s, d, "events")}


def _pattern_counts(s, d):
    return va.table_counts(_pattern_frames(s, d), PATTERN_COLS)


def _patterns(s, d):
    return pa.common_patterns(pa.pattern_sums(_pattern_counts(s, d)))


PATTERN_WITH = f"with customer_p as ({CUSTOMER_SQL}), orders_p as ({ORDERS_SQL}) "
SOURCE = {"customer": "customer_p", "orders": "orders_p"}


def _hit(c, pattern):
    return f"cast(count_if(regexp_matches(cast({c} as varchar), '{pattern}')) as bigint)"


SEVEN_SQL = union_all(
    f"""select '{t}' as table_name, '{c}' as column_name, '{name}' as pattern, {_hit(c, rx)} as matches, count({c}) as size from {SOURCE.get(t, t)}"""
    for t, cs in PATTERN_COLS.items() for c in cs for name, rx in vocab.VALUE_PATTERNS.items())
QUERIES["c1_patterns"] = lambda s, d: rounded(_patterns(s, d).where(F.col("pattern").isin(list(vocab.VALUE_PATTERNS))).select(
    "table_name", "column_name", "pattern", "matches", "percentage"))
ORACLES["c1_patterns"] = PATTERN_WITH + f"""select table_name, column_name, pattern, matches, round(matches / size * 100, 4) as percentage
 from ({SEVEN_SQL}) where matches > 0"""

DIGITS_SQL = union_all(
    f"""select '{t}' as table_name, '{c}' as column_name, {_hit(c, vocab.NUMERIC_STRING_PATTERN)} as matches, count({c}) as size from {SOURCE.get(t, t)}"""
    for t, cs in PATTERN_COLS.items() for c in cs)
QUERIES["c2_numeric_string"] = lambda s, d: rounded(_patterns(s, d).where("pattern = 'numeric_string'").select(
    "table_name", "column_name", "matches", "percentage"))
ORACLES["c2_numeric_string"] = PATTERN_WITH + f"""select table_name, column_name, matches, round(matches / size * 100, 4) as percentage
 from ({DIGITS_SQL}) where matches > size * 0.8"""

DATE_SQL = union_all(
    f"""select '{t}' as table_name, '{c}' as column_name, count({c}) as size, """
    + ", ".join(f"{_hit(c, rx)} as m{i}" for i, rx in enumerate(vocab.DATE_PATTERNS.values())) + f" from {SOURCE.get(t, t)}"
    for t, cs in PATTERN_COLS.items() for c in cs)
QUERIES["c3_date_format"] = lambda s, d: rounded(_patterns(s, d).where("pattern = 'date_format'").select(
    "table_name", "column_name", "matches", "percentage", "description"))
ORACLES["c3_date_format"] = PATTERN_WITH + f"""select table_name, column_name, matches, round(matches / size * 100, 4) as percentage, 'Date format: ' || f as description from (
 select *, case when m0 > size * 0.5 then m0 when m1 > size * 0.5 then m1 when m2 > size * 0.5 then m2 end as matches,
 case when m0 > size * 0.5 then 'YYYY-MM-DD' when m1 > size * 0.5 then 'MM/DD/YYYY' when m2 > size * 0.5 then 'MM-DD-YYYY' end as f
 from ({DATE_SQL})) where f is not null"""


def _flags(s, d):
    counts = _pattern_counts(s, d)
    return pa.business_flags(va.uniqueness(counts), pa.common_patterns(pa.pattern_sums(counts)))


def tokens_sql(column, tokens):
    return "(" + " or ".join(f"contains({column}, '{t}')" for t in tokens) + ")"


FLAG_SQL = PATTERN_WITH + f""", hits as ({SEVEN_SQL}), pii as (select distinct table_name, column_name from hits
  where matches > 0 and pattern in ('email', 'phone', 'ssn', 'credit_card')),
 u as ({union_all(f"select '{t}' as table_name, '{c}' as column_name, count({c}) as n, count(distinct {c}) as u from {SOURCE.get(t, t)}"
                  for t, cs in PATTERN_COLS.items() for c in cs)}),
 f as (select table_name, column_name, n, u, lower(column_name) as l,
  n > 0 and ({tokens_sql('lower(column_name)', vocab.PII_TOKENS)} or (table_name, column_name) in (select table_name, column_name from pii)) as potential_pii,
  n > 0 and ({tokens_sql('lower(column_name)', vocab.KEY_TOKENS)} or coalesce(u / nullif(n, 0), 0) * 100 > 95) as potential_key from u) """
QUERIES["c4_pii"] = lambda s, d: _flags(s, d).select("table_name", "column_name", "potential_pii")
ORACLES["c4_pii"] = FLAG_SQL + "select table_name, column_name, potential_pii from f"
QUERIES["c5_key_flag"] = lambda s, d: _flags(s, d).select("table_name", "column_name", "unique_count", "potential_key")
ORACLES["c5_key_flag"] = FLAG_SQL + "select table_name, column_name, u as unique_count, potential_key from f"
QUERIES["c6_classification"] = lambda s, d: _flags(s, d).select("table_name", "column_name", "data_classification")
ORACLES["c6_classification"] = FLAG_SQL + f"""select table_name, column_name, case when n = 0 then null when potential_pii then 'sensitive'
 when potential_key then 'identifier' when {tokens_sql('l', vocab.FINANCIAL_TOKENS)} then 'financial'
 when {tokens_sql('l', vocab.TEMPORAL_TOKENS)} then 'temporal' else 'general' end as data_classification from f"""


def _c7(s, d):
    numbers = nu.numbers(table(s, d, "events"), "events").unionByName(nu.numbers(table(s, d, "documents"), "documents"))
    found = an.zscore_outliers(numbers).unionByName(an.iqr_outliers(numbers))
    return pa.pattern_metrics(_patterns(s, d), found)


def iqr_sql(t, c):
    return f"""(select count(*) from {t}, (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {t})
 where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1))"""


def z_sql(t, c, limit=3):
    return f"(select count(*) from {t}, (select avg({c}) as m, stddev_pop({c}) as sd from {t}) where sd > 0 and abs({c} - m) / sd > {limit})"


ODD_SQL = " + ".join(f"case when {f('events', c)} > 0 then 1 else 0 end" for c in NUM["events"] for f in (z_sql, iqr_sql)) + " + " + \
    " + ".join(f"case when {f('documents', c)} > 0 then 1 else 0 end" for c in columns("documents", NUMERIC) for f in (z_sql, iqr_sql))
QUERIES["c7_pattern_rollup"] = _c7
ORACLES["c7_pattern_rollup"] = PATTERN_WITH + f""", k as (select pattern, count(*) as columns from (
  select table_name, column_name, pattern from ({SEVEN_SQL}) where matches > 0
  union all select table_name, column_name, 'numeric_string' from ({DIGITS_SQL}) where matches > size * 0.8
  union all select table_name, column_name, 'date_format' from ({DATE_SQL}) where m0 > size * 0.5 or m1 > size * 0.5 or m2 > size * 0.5) group by 1)
select count(*) as pattern_types_detected, cast(sum(columns) as bigint) as total_patterns,
 (select string_agg(pattern || '=' || columns, ', ' order by columns desc, pattern) from (select * from k order by columns desc, pattern limit 5)) as most_common_patterns,
 cast({ODD_SQL} as bigint) as total_anomalies from k"""

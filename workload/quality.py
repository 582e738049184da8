"""E: data-quality checks and scores; full profiles (B15-B17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakegauge.functions import vocab
from lakegauge.operators import catalog as ca, classify as cl, quality as qu, values as va
from lakegauge.plans import lake as lk, profile as pr
from lakegauge.sources.work import written
from workload.common import (
    CUSTOMER_COLUMNS, CUSTOMER_SQL, NUMERIC, TABLES, columns, lake, planted_customer, rounded, table, union_all)
from workload.profiling import _hit, tokens_sql
from workload.sources import CATALOG_SQL

QUERIES, ORACLES = {}, {}

# ---- text quality ---------------------------------------------------------------
TEXT_SRC = {"customer": ("p", [c for c, k in CUSTOMER_COLUMNS.items() if k == "string"]),
            "documents": ("documents", columns("documents", {"string"})),
            "conversations": ("conversations", columns("conversations", {"string"}))}
PLACE_SQL = "(" + ", ".join(f"'{w}'" for w in vocab.PLACEHOLDERS) + ")"
E1_SQL = f"with p as ({CUSTOMER_SQL}), q as (" + union_all(
    f"""select '{t}' as table_name, '{c}' as column_name, count(*) as total_count, count({c}) as non_null_count,
 count(*) filter (trim({c}) = '') as empty_count, count(*) filter (lower(trim({c})) in {PLACE_SQL}) as meaningless_count from {f}"""
    for t, (f, cs) in TEXT_SRC.items() for c in cs) + ")"


def _text_quality(s, d):
    return lk.union_tables(qu.text_quality, {"customer": planted_customer(s, d), "documents": table(s, d, "documents"),
                                             "conversations": table(s, d, "conversations")})


E2_SQL = E1_SQL + """, i as (select table_name, column_name, 'high_null_percentage' as issue, (total_count - non_null_count) * 100.0 / total_count as percentage,
  total_count - non_null_count as affected, 'NULL values' as words from q where (total_count - non_null_count) * 100.0 / total_count > 50
 union all select table_name, column_name, 'empty_data', empty_count * 100.0 / total_count, empty_count, 'empty strings' from q where empty_count * 100.0 / total_count > 20
 union all select table_name, column_name, 'meaningless_data', meaningless_count * 100.0 / total_count, meaningless_count, 'meaningless values' from q where meaningless_count * 100.0 / total_count > 10)"""
QUERIES["e1_text_quality"] = lambda s, d: _text_quality(s, d)
ORACLES["e1_text_quality"] = E1_SQL + " select * from q"
QUERIES["e2_quality_issues"] = lambda s, d: rounded(qu.text_quality_issues(_text_quality(s, d)))
ORACLES["e2_quality_issues"] = E2_SQL + """ select table_name, column_name, issue, round(percentage, 4) as percentage, affected,
 column_name || ' has ' || format('{:.1f}', percentage) || '% ' || words as description from i"""
QUERIES["e2_quality_summary"] = lambda s, d: qu.text_quality_summary(qu.text_quality_issues(_text_quality(s, d)))
ORACLES["e2_quality_summary"] = E2_SQL + """ select 'Found ' || count(*) || ' columns with significant empty data' as insight from i where issue = 'empty_data' having count(*) > 0
 union all select 'Found ' || count(*) || ' columns with meaningless placeholder values' from i where issue = 'meaningless_data' having count(*) > 0
 union all select 'Data quality appears good - no significant empty or meaningless data detected' where not exists (select * from i where issue <> 'high_null_percentage')"""

# ---- column issues ------------------------------------------------------------------
ISSUE_SRC = {"customer": ("p", CUSTOMER_COLUMNS), "documents": ("documents", TABLES["documents"]),
             "orders": ("orders", TABLES["orders"])}
CHECKED_AS_INTEGER = ["num_text", "note"]


def _issues(s, d):
    tables = {"customer": planted_customer(s, d), "documents": table(s, d, "documents"), "orders": table(s, d, "orders")}
    counts = va.table_counts(tables)
    texts = [c for _, (f, cs) in ISSUE_SRC.items() for c, k in cs.items() if k == "string"]
    lengths = va.length_summary(va.length_counts(counts.where(F.col("column_name").isin(texts))))
    bad = qu.non_integers(tables["customer"], "customer", CHECKED_AS_INTEGER)
    return qu.column_issues(va.uniqueness(counts), lengths, bad)


ISSUE_SQL = f"with p as ({CUSTOMER_SQL}), q as (" + union_all(
    f"""select '{t}' as table_name, '{c}' as column_name, count(*) as n, coalesce((count(*) - count({c})) / count(*) * 100, 0) as null_percentage,
 {'(count(*) - count(distinct ' + c + ')) / count(*) * 100' if any(x in c for x in vocab.KEY_NAME_TOKENS) else 'cast(null as double)'} as duplicate_percentage,
 {'cast(count_if(try_cast(' + c + ' as bigint) is null and ' + c + ' is not null) as bigint)' if t == 'customer' and c in CHECKED_AS_INTEGER else 'cast(0 as bigint)'} as non_integer_count,
 {'coalesce(stddev_samp(length(' + c + ')) > avg(length(' + c + ')) * 0.5, false)' if k == 'string' else 'false'} as inconsistent_length from {f}"""
    for t, (f, cs) in ISSUE_SRC.items() for c, k in cs.items()) + """), r as (select *, null_percentage > 50 as high_null,
 coalesce(duplicate_percentage > 10, false) as key_duplicates, non_integer_count > 0 as non_integer from q),
 x as (select *, high_null::int + key_duplicates::int + non_integer::int + inconsistent_length::int as issue_count from r),
 y as (select *, greatest(0.0, 1 - least(null_percentage / 100 * 0.5, 0.3) - issue_count * 0.1) as score from x)"""


def _issue_query(key, spark_cols, sql_cols):
    QUERIES[key] = lambda s, d: rounded(_issues(s, d).select("table_name", "column_name", *spark_cols))
    ORACLES[key] = ISSUE_SQL + f" select table_name, column_name, {sql_cols} from y"


_issue_query("e3_high_null", ["null_percentage", "high_null"], "round(null_percentage, 4) as null_percentage, high_null")
_issue_query("e4_key_duplicates", ["duplicate_percentage", "key_duplicates"],
             "round(duplicate_percentage, 4) as duplicate_percentage, key_duplicates")
_issue_query("e5_non_integer", ["non_integer_count", "non_integer"], "non_integer_count, non_integer")
_issue_query("e6_length_inconsistency", ["inconsistent_length"], "inconsistent_length")
_issue_query("e7_schema_column_score", ["issue_count", "data_quality_score"],
             "issue_count, round(score, 4) as data_quality_score")

PARTITIONED = ["orders"]  # planted: orders counts as partitioned


def _table_scores(s, d):
    issues = _issues(s, d)
    keys = cl.key_columns(issues.select("table_name", "column_name", "data_quality_score"))
    tables = (ca.row_counts({"customer": planted_customer(s, d), "documents": table(s, d, "documents"),
                             "orders": table(s, d, "orders")})
              .withColumn("is_partitioned", F.col("table_name").isin(PARTITIONED)))
    return qu.table_score(keys, tables)


E8_SQL = ISSUE_SQL + f""", z as (select table_name, max(n) as row_count, avg(coalesce(nullif(score, 0), 0.5)) as mean_score,
 bool_or(lower(column_name) = 'id' or lower(column_name) = rtrim(table_name, 's') || '_id') as has_primary_key from y group by 1),
 w as (select *, least(1.0, greatest(0.0, mean_score + case when row_count > 0 then 0.1 else 0 end + case when table_name = 'orders' then 0.05 else 0 end
 - case when has_primary_key then 0 else 0.1 end)) as table_quality_score from z)"""
QUERIES["e8_schema_table_score"] = lambda s, d: rounded(_table_scores(s, d).select(
    "table_name", "row_count", "has_primary_key", "mean_score", "table_quality_score"))
ORACLES["e8_schema_table_score"] = E8_SQL + """ select table_name, row_count, has_primary_key, round(mean_score, 4) as mean_score,
 round(table_quality_score, 4) as table_quality_score from w"""
QUERIES["e15_db_quality"] = lambda s, d: rounded(qu.database_quality(_table_scores(s, d), 0.95))
ORACLES["e15_db_quality"] = E8_SQL + """ select round(avg(table_quality_score), 4) as average_score, count(*) as tables,
 count(*) filter (table_quality_score < 0.95 and table_quality_score <> 0) as tables_needing_attention,
 coalesce(string_agg(table_name, ', ' order by table_name) filter (table_quality_score < 0.95 and table_quality_score <> 0), '') as attention_list from w"""

# ---- full profiles --------------------------------------------------------------------
PROFILE_SRC = {"customer": ("p", CUSTOMER_COLUMNS), "documents": ("documents", TABLES["documents"]),
               "events": ("events", TABLES["events"]), "orders": ("orders", TABLES["orders"])}


def parts(s, d):
    tables = {"customer": planted_customer(s, d), **lake(s, d, ["documents", "events", "orders"])}
    return pr.union_parts([pr.parts_of(df, t) for t, df in tables.items()])


def profiles(s, d, lists=False):
    return pr.profile_parts(parts(s, d), lists=lists)


def _profile_sql(t, f, c, k):
    num, txt = k in NUMERIC, k == "string"
    size = f"(select count({c}) from {f})"
    odd = "0"
    if num:
        odd = f"""(select count(*) from {f}, (select avg({c}) as m, stddev_pop({c}) as sd from {f}) where sd > 0 and abs({c} - m) / sd > 3) +
 (select count(*) from {f}, (select quantile_cont(cast({c} as double), 0.25) as q1, quantile_cont(cast({c} as double), 0.75) as q3 from {f})
  where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1))"""
    elif txt:
        odd = f"""(select count(*) from {f}, (select avg(length({c})) as m, stddev_pop(length({c})) as sd from {f}) where sd > 1e-9 and abs(length({c}) - m) / sd > 2)"""
    pii = " or ".join(f"{_hit(c, vocab.VALUE_PATTERNS[p])} > 0" for p in vocab.PII_PATTERNS)
    d = f"cast({c} as double)"
    return f"""select '{t}' as table_name, '{c}' as column_name, {list(PROFILE_SRC[t][1]).index(c) + 1} as ordinal, count(*) as total_count, count(*) - count({c}) as null_count,
 (count(*) - count({c})) / count(*) * 100 as null_percentage, count(distinct {c}) as unique_count,
 coalesce(count(distinct {c}) / nullif(count({c}), 0), 0) * 100 as unique_percentage, count({c}) as non_null_count,
 {f'avg({d})' if num else 'cast(null as double)'} as mean, {f'stddev_samp({d})' if num else 'cast(null as double)'} as std_dev,
 {f'quantile_cont({d}, 0.25)' if num else 'cast(null as double)'} as q1, {f'quantile_cont({d}, 0.5)' if num else 'cast(null as double)'} as q2,
 {f'quantile_cont({d}, 0.75)' if num else 'cast(null as double)'} as q3,
 {f'avg(length({c}))' if txt else 'cast(null as double)'} as avg_length,
 {f'1 - count(distinct length({c})) / nullif(count({c}), 0)' if txt else 'cast(null as double)'} as format_consistency,
 cast({odd} as bigint) as anomaly_count, {pii} as pii_hit from {f}"""


PROFILE_SQL = f"with p as ({CUSTOMER_SQL}), a as (" + union_all(
    _profile_sql(t, f, c, k) for t, (f, cs) in PROFILE_SRC.items() for c, k in cs.items()) + f"""),
 b as (select *, non_null_count > 0 and (pii_hit or {tokens_sql('lower(column_name)', vocab.PII_TOKENS)}) as potential_pii,
  non_null_count > 0 and (unique_percentage > 95 or {tokens_sql('lower(column_name)', vocab.KEY_TOKENS)}) as potential_key from a),
 c as (select *, case when non_null_count = 0 then null when potential_pii then 'sensitive' when potential_key then 'identifier'
  when {tokens_sql('lower(column_name)', vocab.FINANCIAL_TOKENS)} then 'financial' when {tokens_sql('lower(column_name)', vocab.TEMPORAL_TOKENS)} then 'temporal' else 'general' end as data_classification,
  greatest(0e0, least(1e0, 1e0 - case when null_percentage > 50 then 0.3e0 when null_percentage > 20 then 0.1e0 else 0e0 end
  - case when potential_key and unique_percentage < 95 then 0.2e0 else 0e0 end - case when format_consistency < 0.8 then 0.1e0 else 0e0 end
  - case when anomaly_count * 1e2 / total_count > 10 then 0.2e0 when anomaly_count * 1e2 / total_count > 5 then 0.1e0 else 0e0 end)) as quality_score from b)"""
FLAT = ["mean", "std_dev", "q1", "q2", "q3", "avg_length", "format_consistency", "null_percentage", "unique_percentage", "quality_score"]
EXACT = ["table_name", "column_name", "total_count", "null_count", "unique_count", "potential_pii", "potential_key", "data_classification"]

QUERIES["b15_column_profile"] = lambda s, d: rounded(profiles(s, d, lists=True).select(
    *EXACT, F.coalesce("anomaly_count", F.lit(0)).alias("anomaly_count"), *FLAT))
ORACLES["b15_column_profile"] = PROFILE_SQL + f" select {', '.join(EXACT)}, anomaly_count, {', '.join(f'round({c}, 4) as {c}' for c in FLAT)} from c"

TABLE_SQL = PROFILE_SQL + """, t as (select table_name, max(total_count) as total_rows, count(*) as total_columns,
 avg(1 - null_percentage / 100) as completeness_score, coalesce(avg(format_consistency), 0.8) as consistency_score, avg(quality_score) as overall_quality_score,
 coalesce(string_agg(column_name, ', ' order by ordinal) filter (potential_key and unique_percentage > 95), '') as potential_keys,
 coalesce(string_agg(column_name, ', ' order by ordinal) filter (column_name like '%\\_id' escape '\\' and unique_percentage <= 95), '') as potential_foreign_keys,
 string_agg(column_name, ', ' order by ordinal) filter (quality_score < 0.7) as low_quality from c group by 1)"""
QUERIES["b16_table_profile"] = lambda s, d: rounded(pr.table_metrics(parts(s, d), [
    f for f in pr.TABLE_NEEDS if f not in ("recommended_partitioning", "table_level_issues")]))
ORACLES["b16_table_profile"] = TABLE_SQL + """ select table_name, total_rows, total_columns, round(completeness_score, 4) as completeness_score,
 round(consistency_score, 4) as consistency_score, round(overall_quality_score, 4) as overall_quality_score, potential_keys, potential_foreign_keys,
 concat_ws(', ', nullif(potential_keys, ''), nullif(potential_foreign_keys, '')) as recommended_indexing from t"""
QUERIES["b17_profile_record"] = lambda s, d: pr.profile_record(pr.column_profile(table(s, d, "events"), "events"))

QUERIES["e9_profile_column_score"] = lambda s, d: rounded(pr.profile_parts(parts(s, d), lists=False, fields=["quality_score"]))
ORACLES["e9_profile_column_score"] = PROFILE_SQL + " select table_name, column_name, round(quality_score, 4) as quality_score from c"
QUERIES["e10_completeness"] = lambda s, d: rounded(pr.table_metrics(parts(s, d), ["completeness_score"]))
ORACLES["e10_completeness"] = TABLE_SQL + " select table_name, round(completeness_score, 4) as completeness_score from t"
QUERIES["e11_consistency"] = lambda s, d: rounded(pr.table_metrics(parts(s, d), ["consistency_score"]))
ORACLES["e11_consistency"] = TABLE_SQL + " select table_name, round(consistency_score, 4) as consistency_score from t"
QUERIES["e12_overall_quality"] = lambda s, d: rounded(pr.table_metrics(
    parts(s, d), ["overall_quality_score", "table_level_issues"]))
ORACLES["e12_overall_quality"] = TABLE_SQL + """ select table_name, round(overall_quality_score, 4) as overall_quality_score,
 'Low quality columns requiring attention: ' || low_quality as table_level_issues from t"""


def _rollup(s, d):
    fields = ["completeness_score", "overall_quality_score"]
    # read twice, one row per column: written, so that it is profiled once
    p = written(pr.profile_parts(parts(s, d), lists=False, fields=pr.column_fields(fields)), "profile")
    return qu.quality_rollup(pr.table_fields(p, fields), p)


QUERIES["e13_quality_rollup"] = lambda s, d: rounded(_rollup(s, d))
ORACLES["e13_quality_rollup"] = TABLE_SQL + """ select round(avg(overall_quality_score), 4) as avg_quality_score, round(avg(completeness_score), 4) as avg_completeness_score,
 count(*) as tables_analyzed, (select round(avg(null_percentage), 4) from c) as avg_null_percentage from t"""
QUERIES["e14_table_digest"] = lambda s, d: rounded(qu.table_digest(profiles(s, d)))
ORACLES["e14_table_digest"] = PROFILE_SQL + """, n as (select *, row_number() over (partition by table_name, mean is not null order by ordinal) as rn,
 row_number() over (partition by table_name, null_percentage > 30 order by ordinal) as rh from c)
 select table_name, max(total_count) as total_rows, count(*) as total_columns, round(avg(1 - null_percentage / 100), 4) as completeness_score,
 round(avg(quality_score), 4) as overall_quality_score,
 coalesce(string_agg(column_name || ' (' || format('{:.1f}', null_percentage) || '%)', ', ' order by ordinal) filter (null_percentage > 30 and rh <= 5), '') as high_null_columns,
 coalesce(string_agg(column_name, ', ' order by ordinal) filter (potential_pii), '') as pii_columns,
 coalesce(string_agg(column_name || ' (mean=' || format('{:.2f}', mean) || ', std=' || format('{:.2f}', coalesce(std_dev, 0)) || ')', '; ' order by ordinal)
  filter (mean is not null and rn <= 3), '') as numeric_columns, count(*) filter (null_percentage > 25) as trend_null_columns from n group by 1"""

DAY_BROKEN = "case when o_orderkey % 10 = 0 then concat('x', substr(cast(o_orderdate as string),1,10)) else substr(cast(o_orderdate as string),1,10) end"


def _e16(s, d):
    o = table(s, d, "orders").selectExpr("*", f"{DAY_BROKEN} as order_day")
    return qu.date_validity(o, "orders", "order_day").unionByName(
        qu.date_validity(table(s, d, "events"), "events", "ts", ("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]",)))


QUERIES["e16_date_validity"] = _e16
ORACLES["e16_date_validity"] = f"""with o as (select {DAY_BROKEN} as order_day from orders), x as (
 select 'orders' as table_name, 'order_day' as column_name, count(order_day) as total, count(try_strptime(order_day, '%Y-%m-%d')) as valid from o
 union all select 'events', 'ts', count(ts), count(ts) from events)
 select *, valid || '/' || total || ' samples valid' as date_validity from x"""

QUERIES["e17_metadata_checks"] = lambda s, d: qu.catalog_checks(ca.lake_catalog(
    {**lake(s, d), "no_rows": table(s, d, "region").where("r_regionkey < 0")}))
ORACLES["e17_metadata_checks"] = f"""with t as (select table_name, max(row_count) as row_count, count(*) as column_count,
 count(*) filter (contains(lower(column_name), 'id')) as ids from {CATALOG_SQL} group by 1 union all select 'no_rows', 0, 2, 0)
 select table_name, row_count, column_count, 'insight' as kind, 'Table ' || table_name || ' has many columns (' || column_count || ') - consider normalization' as message from t where column_count > 100
 union all select table_name, row_count, column_count, 'anomaly', 'Table ' || table_name || ' appears to be empty' from t where row_count = 0
 union all select table_name, row_count, column_count, 'insight', 'Table ' || table_name || ' may lack proper identifier columns' from t where ids = 0"""

"""F and G: catalog rules and relationships, over a renamed star schema.

The star schema is the given tables with column names that follow naming
conventions, so that every naming rule fires; every query also reads the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lakegauge.functions import vocab
from lakegauge.operators import catalog as ca, classify as cl, relate as re, values as va
from lakegauge.plans import lake as lk
from workload.common import TABLES, lake, rounded, table, union_all
from workload.profiling import tokens_sql
from workload.sources import ALL, CATALOG_SQL, STATS_SQL

QUERIES, ORACLES = {}, {}

STAR = {  # table: (source, {column: (source column, comment)})
    "customers": ("customer", {"id": ("c_custkey", "key of the customer"), "name": ("c_name", "full name"),
                               "nation_id": ("c_nationkey", None), "account_balance": ("c_acctbal", "money owed"),
                               "market_code": ("c_mktsegment", None), "description": ("c_mktsegment", None)}),
    "nations": ("nation", {"id": ("n_nationkey", "key"), "name": ("n_name", "name"), "region_id": ("n_regionkey", "region")}),
    "regions": ("region", {"id": ("r_regionkey", None), "name": ("r_name", "  ")}),
    "suppliers": ("supplier", {"id": ("s_suppkey", None), "name": ("s_name", None), "nationid": ("s_nationkey", None),
                               "account_balance": ("s_acctbal", None)}),
    "parts": ("part", {"id": ("p_partkey", None), "name": ("p_name", None), "brand_code": ("p_brand", None),
                       "type": ("p_type", None), "size": ("p_size", None), "price": ("p_retailprice", None),
                       "title": ("p_name", "title")}),
    "orders": ("orders", {"order_id": ("o_orderkey", "order key"), "customer_id": ("o_custkey", None),
                          "order_status": ("o_orderstatus", "state"), "total_amount": ("o_totalprice", None),
                          "created_at": ("o_orderdate", None), "priority_ref": ("o_orderpriority", None)}),
    "fact_lineitem": ("lineitem", {"order_id": ("l_orderkey", None), "part_id": ("l_partkey", None),
                                   "supplier_id": ("l_suppkey", None), "line_number": ("l_linenumber", None),
                                   "quantity": ("l_quantity", None), "price": ("l_extendedprice", None),
                                   "discount": ("l_discount", None), "tax": ("l_tax", None),
                                   "return_status": ("l_returnflag", None), "line_status": ("l_linestatus", None),
                                   "ship_date": ("l_shipdate", None)}),
    "dim_part": ("part", {"part_id": ("p_partkey", "part"), "name": ("p_name", "name"), "type": ("p_type", "type")}),
    "orders_archive": ("orders", {"order_id": ("o_orderkey", None), "customer_id": ("o_custkey", None),
                                  "order_status": ("o_orderstatus", None), "total_amount": ("o_totalprice", None),
                                  "created_at": ("o_orderdate", None)}),
    "orders_by_day": ("orders", {"customer_id": ("o_custkey", None), "order_status": ("o_orderstatus", None),
                                 "total_amount": ("o_totalprice", None), "created_at": ("o_orderdate", None),
                                 "priority_ref": ("o_orderpriority", None), "order_count": ("o_orderkey", None)}),
    "part_suppliers": ("lineitem", {"part_id": ("l_partkey", None), "supplier_id": ("l_suppkey", None)}),
    "user_events": ("events", {"id": ("event_id", None), "user_id": ("user_id", None), "event_type": ("event_type", None),
                               "value": ("value", None), "updated_date": ("ts", None)}),
}
TABLE_COMMENTS = {"customers": "Customer dimension", "fact_lineitem": "Order lines", "user_events": "Audit log of clicks",
                  "orders": "", "orders_by_day": "fact rollup per day", "parts": "Catalog of parts"}
PARTITIONED = ["orders", "fact_lineitem"]


def star(s, d):
    out = {}
    for name, (src, cols) in STAR.items():
        df = table(s, d, src)
        out[name] = df.select(*[F.col(old).alias(new, metadata={"comment": note} if note is not None else {})
                                for new, (old, note) in cols.items()])
    return out


def catalog(s, d):
    return ca.lake_catalog(star(s, d))


def comments(s):
    return s.createDataFrame(list(TABLE_COMMENTS.items()), "table_name string, table_comment string")


_TYPE = {"timestamp": "timestamp_ntz"}


def _q(text):
    return "null" if text is None else "'" + text.replace("'", "''") + "'"


STAR_SQL = "(select *, case when regexp_matches(data_type, 'date|time') then 'date' when regexp_matches(data_type, 'int|double') then 'numeric' else 'text' end as type_bucket, lower(column_name) as c from (" + union_all(
    f"select '{t}' as table_name, '{new}' as column_name, {i + 1} as ordinal, '{_TYPE.get(TABLES[src][old], TABLES[src][old])}' as data_type, {_q(note)} as comment, (select count(*) from {src}) as row_count"
    for t, (src, cols) in STAR.items() for i, (new, (old, note)) in enumerate(cols.items())) + "))"
COMMENT_SQL = "(" + union_all(f"select '{t}' as table_name, '{n}' as table_comment" for t, n in TABLE_COMMENTS.items()) + ")"
WITH = f"with cat as {STAR_SQL}, notes as {COMMENT_SQL} "
NUMERIC_SQL = "data_type in ('int', 'bigint', 'double')"
KEYS_SQL = """keys as (select *, c = 'id' or c = rtrim(table_name, 's') || '_id' as is_primary_key,
 c like '%\\_id' escape '\\' and not (c = 'id' or c = rtrim(table_name, 's') || '_id') as is_foreign_key from cat)"""

# ---- F -----------------------------------------------------------------------------
STAR_KEYS = {t: [c for c in cols if "id" in c] for t, (_, cols) in STAR.items()}
STAR_KEYS = {t: cs for t, cs in STAR_KEYS.items() if cs}


def _f1(s, d):
    """Keys by name, beside the distinct share of the column in the data."""
    tables = star(s, d)
    unique = va.uniqueness(va.table_counts({t: tables[t] for t in STAR_KEYS}, STAR_KEYS)).select(
        "table_name", "column_name", "unique_percentage")
    return cl.key_columns(ca.lake_catalog(tables)).join(unique, ["table_name", "column_name"], "left").select(
        "table_name", "column_name", "is_primary_key", "is_foreign_key", "referenced_table", "referenced_column", "unique_percentage")


QUERIES["f1_pk_fk"] = lambda s, d: rounded(_f1(s, d))
ORACLES["f1_pk_fk"] = WITH + f", {KEYS_SQL}, u as (" + union_all(
    f"select '{t}' as table_name, '{c}' as column_name, count(distinct {STAR[t][1][c][0]}) / count(*) * 100 as u from {STAR[t][0]}"
    for t, cs in STAR_KEYS.items() for c in cs) + """) select table_name, column_name, is_primary_key, is_foreign_key,
 case when is_foreign_key then replace(c, '_id', '') end as referenced_table, case when is_foreign_key then 'id' end as referenced_column,
 round(u, 4) as unique_percentage from keys left join u using (table_name, column_name)"""

F2_SQL = f""", g as (select table_name, max(row_count) as row_count, count(*) as column_count, count(*) filter (is_foreign_key) as foreign_keys,
 count(*) filter ({NUMERIC_SQL}) as measures, bool_or(c in ('name', 'description', 'title')) as named from keys group by 1),
 types as (select *, case when foreign_keys <= 2 and column_count > 5 and named then 'dimension' when foreign_keys >= 2 and measures >= 2 then 'fact'
 when foreign_keys >= 2 and column_count <= foreign_keys + 2 then 'bridge' when row_count > 0 and row_count < 1000 then 'lookup' else 'unknown' end as table_type from g)"""
QUERIES["f2_table_type"] = lambda s, d: cl.table_types(cl.key_columns(catalog(s, d)))
ORACLES["f2_table_type"] = WITH + f", {KEYS_SQL}" + F2_SQL + " select * exclude (named) from types"

QUERIES["f3_table_type_named"] = lambda s, d: cl.table_types_by_name(catalog(s, d), comments(s))
ORACLES["f3_table_type_named"] = WITH + f""", g as (select table_name, max(row_count) as row_count, count(*) as n,
 bool_or({tokens_sql('c', vocab.MEASURE_NAME_TOKENS)}) as m, count(*) filter (c like '%\\_id' escape '\\' or c like '%\\_key' escape '\\') > 2 as k,
 bool_or({tokens_sql('c', vocab.DATE_KEY_TOKENS)}) as dk, bool_or({tokens_sql('c', vocab.DESCRIPTIVE_TOKENS)}) as de from cat group by 1),
 h as (select g.*, lower(coalesce(table_comment, '')) as note from g left join notes using (table_name))
 select table_name, row_count, case when {tokens_sql('table_name', vocab.TYPE_DIMENSION_TOKENS)} or contains(note, 'dimension') then 'dimension'
 when {tokens_sql('table_name', vocab.TYPE_FACT_TOKENS)} or contains(note, 'fact') then 'fact'
 when {tokens_sql('table_name', vocab.TYPE_AGGREGATE_TOKENS)} or {tokens_sql('note', vocab.COMMENT_AGGREGATE_WORDS)} then 'aggregate'
 when m and k and dk then 'fact' when not m and n > 5 and de then 'dimension'
 when m and {tokens_sql('table_name', vocab.PERIOD_NAME_TOKENS)} then 'aggregate'
 when row_count > 1000000000 then 'fact' when row_count < 10000 then 'dimension' else 'operational' end as table_type from h"""

CLASS_SQL = f""", classes as (select table_name, max(row_count) as row_count, count(*) filter (type_bucket = 'text') as text_columns,
 count(*) filter (type_bucket = 'numeric') as numeric_columns, case when {tokens_sql('table_name', vocab.CLASS_DIMENSION_TOKENS)} then 'dimension'
 when {tokens_sql('table_name', vocab.CLASS_FACT_TOKENS)} then 'fact'
 when max(row_count) between 1 and 9999 and count(*) filter (type_bucket = 'text') > count(*) filter (type_bucket = 'numeric') then 'likely_dimension'
 when max(row_count) > 100000 and count(*) filter (type_bucket = 'numeric') > 0 then 'likely_fact' else 'unknown' end as table_classification from cat group by 1)"""
QUERIES["f4_table_class"] = lambda s, d: cl.table_classes(catalog(s, d))
ORACLES["f4_table_class"] = WITH + CLASS_SQL + " select * from classes"

QUERIES["f5_quick_split"] = lambda s, d: cl.quick_split(catalog(s, d))
ORACLES["f5_quick_split"] = WITH + """, g as (select table_name, max(row_count) as row_count, count(*) as columns from cat group by 1),
 h as (select *, case when contains(table_name, 'dim_') or contains(table_name, 'dimension') then 'dimension' when contains(table_name, 'fact_') or columns > 10 then 'fact' else 'dimension_candidate' end as type from g)
 select *, case when row_count > 1000000 and type <> 'dimension_candidate' then 'large' else 'medium' end as estimated_size from h"""

def _domain_case(x, labels):
    return "case " + " ".join(f"when {tokens_sql(x, w)} then {l}" for l, w in zip(labels, vocab.TABLE_DOMAINS.values())) + " end"


DOMAINS = list(vocab.TABLE_DOMAINS)
F6_SQL = f""", dom as (select table_name, max(row_count) as row_count, coalesce({_domain_case('table_name', [f"'{x}'" for x in DOMAINS])},
 ([{', '.join(f"'{x}'" for x in DOMAINS)}])[min({_domain_case('c', range(1, 9))})], 'general') as domain from allcat group by table_name)"""
ALLCAT = ", allcat as (select table_name, c, row_count from cat union all select table_name, lower(column_name), row_count from " + CATALOG_SQL + " where table_name <> 'orders')"


def _both(s, d):
    return ca.lake_catalog({**lake(s, d), **star(s, d)})


QUERIES["f6_domain"] = lambda s, d: cl.domains(_both(s, d))
ORACLES["f6_domain"] = WITH + ALLCAT + F6_SQL + " select * from dom"

QUERIES["f7_column_roles"] = lambda s, d: cl.column_roles(catalog(s, d)).select(
    "table_name", "column_name", "pattern", "description", "row_count")
ORACLES["f7_column_roles"] = WITH + """, r as (select *, case when c like '%\\_id' escape '\\' and contains(data_type, 'bigint') then 'identifier_column'
 when contains(c, 'status') and data_type = 'string' then 'status_dimension' when regexp_matches(c, 'date|created|updated') then 'temporal_column' end as pattern from cat)
 select table_name, column_name, pattern, column_name || case pattern when 'identifier_column' then ' appears to be an identifier column'
 when 'status_dimension' then ' is a status dimension for business logic' else ' is a temporal column for time-based analysis' end as description, row_count
 from r where pattern is not null"""
QUERIES["f8_role_counts"] = lambda s, d: cl.role_counts(catalog(s, d))
ORACLES["f8_role_counts"] = WITH + """ select table_name, max(row_count) as row_count, count(*) filter (contains(c, 'id') or c like '%\\_key' escape '\\') as identifier_columns,
 count(*) filter (regexp_matches(c, 'date|time|created|updated')) as temporal_columns, count(*) filter (regexp_matches(c, 'status|state')) as status_columns from cat group by 1"""

HINT_TABLES = ["customers", "nations", "fact_lineitem", "orders", "user_events"]


def _f9(s, d):
    tables = {t: df for t, df in star(s, d).items() if t in HINT_TABLES}
    stats = va.uniqueness(va.table_counts(tables)).select(
        "table_name", "column_name", "total_count", "unique_count", "null_percentage")
    return cl.storage_hints(cl.key_columns(ca.lake_catalog(tables)), stats)


QUERIES["f9_storage_hints"] = lambda s, d: rounded(_f9(s, d))
ORACLES["f9_storage_hints"] = WITH + f", {KEYS_SQL}, u as (" + union_all(
    f"select '{t}' as table_name, '{n}' as column_name, count(*) as n, count(distinct {o}) as u, (count(*) - count({o})) / count(*) * 100 as null_percentage from {STAR[t][0]}"
    for t in HINT_TABLES for n, (o, _) in STAR[t][1].items()) + """) select table_name, column_name, data_type,
 case when u > 0 and u / n < 0.01 then 'low cardinality' when u > 0 and u / n > 0.9 then 'high cardinality' end as cardinality, round(null_percentage, 4) as null_percentage,
 case when regexp_matches(c, 'date|time|created|updated') then 'potential partition key' when is_foreign_key then 'potential clustering key' end as hint
 from keys join u using (table_name, column_name)"""

QUERIES["f10_role_groups"] = lambda s, d: cl.role_groups(cl.key_columns(catalog(s, d)))
ORACLES["f10_role_groups"] = WITH + f", {KEYS_SQL}" + "".join(f"""{' select table_name, max(row_count) as row_count' if i == 0 else ''},
 coalesce(string_agg(column_name, ', ' order by ordinal) filter ({cond}), '') as {n}""" for i, (n, cond) in enumerate([
    ("keys", "is_primary_key or is_foreign_key"), ("measures", f"not (is_primary_key or is_foreign_key) and {NUMERIC_SQL}"),
    ("dimensions", f"not (is_primary_key or is_foreign_key) and not {NUMERIC_SQL}")])) + " from keys group by 1"

DOCUMENTED = "trim(coalesce(comment, '')) <> ''"


def _covered(s, d):
    """Comment coverage beside the rows the documented tables hold."""
    cat = catalog(s, d)
    return cl.comment_coverage(cat).join(cat.groupBy("table_name").agg(F.max("row_count").alias("row_count")), "table_name")


QUERIES["f11_comment_coverage"] = lambda s, d: _covered(s, d)
ORACLES["f11_comment_coverage"] = WITH + f""", g as (select table_name, count(*) as columns, count(*) filter ({DOCUMENTED}) as columns_with_comments, max(row_count) as row_count from cat group by 1)
 select *, columns - columns_with_comments as columns_without_comments, round_even(columns_with_comments / columns * 100, 1) as comment_coverage_percentage,
 case when columns_with_comments / columns * 100 > 70 then 'well' when columns_with_comments / columns * 100 > 30 then 'partial' else 'poor' end as level from g"""
F12_SQL = f""", g as (select table_name, max(row_count) as row_count, count(*) as columns, count(*) filter ({DOCUMENTED}) as documented_columns from cat group by 1),
 h as (select g.*, lower(coalesce(table_comment, '')) as note from g left join notes using (table_name)),
 doc as (select table_name, row_count, columns, documented_columns, trim(note) <> '' as documented, case when trim(note) = '' then null
  when contains(note, 'dimension') or contains(table_name, 'dim_') then 'dimension table' when contains(note, 'fact') or contains(table_name, 'fact_') then 'fact table'
  when regexp_matches(note, 'audit|log|history') then 'audit/logging table' end as pattern,
  case when documented_columns = 0 and columns > 10 then 'Large table with no column documentation' else '' end as anomalies from h)"""
QUERIES["f12_documentation"] = lambda s, d: cl.documentation_tables(catalog(s, d), comments(s))
ORACLES["f12_documentation"] = WITH + F12_SQL + " select * from doc"
QUERIES["f12_documentation_summary"] = lambda s, d: rounded(cl.documentation_summary(cl.documentation_tables(catalog(s, d), comments(s))))
ORACLES["f12_documentation_summary"] = WITH + F12_SQL + """, t as (select count(*) as total_tables, count(*) filter (documented) as documented_tables,
 cast(sum(columns) as bigint) as total_columns, cast(sum(documented_columns) as bigint) as documented_columns,
 cast(sum(row_count) as bigint) as total_rows, cast(coalesce(sum(row_count) filter (documented), 0) as bigint) as documented_rows from doc)
 select *, round(documented_tables / total_tables * 100, 4) as table_documentation_pct, round(documented_columns / total_columns * 100, 4) as column_documentation_pct,
 case when total_rows = 0 then 0.0 else round(documented_rows / total_rows * 100, 4) end as row_documentation_pct,
 documented_tables / total_tables * 100 < 50 as low_table_coverage, documented_columns / total_columns * 100 < 30 as low_column_coverage from t"""
QUERIES["f13_description"] = lambda s, d: cl.descriptions(catalog(s, d))
ORACLES["f13_description"] = WITH + f""", g as (select table_name, max(row_count) as row_count, count(*) as n, count(*) filter ({DOCUMENTED}) as k,
 string_agg(column_name, ', ' order by ordinal) filter (ordinal <= 10 and regexp_matches(c, 'id|key|code')) as keys from cat group by 1)
 select table_name, row_count, 'Table ' || table_name || ' contains ' || n || ' columns' || case when k > 0 then ' (' || k || ' with descriptions)' else '' end ||
 coalesce('. Key columns: ' || keys, '') || case when contains(table_name, 'dim_') then '. This appears to be a dimension table for data warehousing'
 when contains(table_name, 'fact_') then '. This appears to be a fact table containing measurable events'
 when regexp_matches(table_name, 'log|event|activity') then '. This appears to be an event/activity tracking table'
 when regexp_matches(table_name, 'user|customer|account') then '. This appears to be a user/customer data table' else '' end as description from g"""

SUFFIX_SQL = """, refs as (select distinct table_name, c as column_name, row_count, regexp_extract(c, '_(id|key|code|ref)$', 1) as suffix,
 regexp_replace(c, '_(id|key|code|ref)$', '') as stem from cat where regexp_matches(c, '_(id|key|code|ref)$')
 and not (c = rtrim(table_name, 's') || '_id') and length(regexp_replace(c, '_(id|key|code|ref)$', '')) > 2),
 refs2 as (select table_name, column_name, row_count, stem || case when suffix = 'code' then ' lookup table' else ' table' end as likely_references,
 case when suffix = 'id' then 'high' else 'medium' end as confidence from refs)"""


def _f14(s, d):
    cat = catalog(s, d)
    return cl.business_context(cat, comments(s), re.suffix_references(cat))


QUERIES["f14_business_context"] = _f14
ORACLES["f14_business_context"] = WITH + SUFFIX_SQL + ", allcat as (select table_name, c, row_count from cat)" + F6_SQL + """, size as (select table_name, max(row_count) as row_count from cat group by 1),
 behind as (select 'domain' as kind, domain as entry, table_name from dom union select 'purpose', table_name || ': ' || table_comment, table_name from notes where table_comment <> ''
 union select 'entity', replace(replace(replace(c, '_id', ''), '_key', ''), '_code', ''), table_name from cat where regexp_matches(c, 'id|key|code')
 union select 'flow', table_name || '.' || column_name || ' -> ' || likely_references, table_name from refs2)
 select kind, entry, count(*) as tables, cast(coalesce(sum(row_count), 0) as bigint) as row_count from behind left join size using (table_name) group by 1, 2"""

# products beyond a bigint (from about 80,000 orders on) keep their exact label; their size has no bigint and is NULL
_PLANTED_SIZE = "cast(o_orderkey as decimal(38,0)) * o_orderkey * o_orderkey * o_custkey"
QUERIES["f15_size_label"] = lambda s, d: (ca.lake_stats(lake(s, d)).select("table_name", "size_bytes")
    .unionByName(table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("table_name"),
                                              F.expr(_PLANTED_SIZE).cast("decimal(38,0)").alias("size_bytes")))
    .withColumn("label", cl.size_label(F.col("size_bytes")))
    .withColumn("size_bytes", F.col("size_bytes").try_cast("bigint")))
SIZE_CASE = "case when coalesce(b, 0) = 0 then 'unknown' " + " ".join(
    f"when b < {1024 ** (i + 1)} then format('{{:.1f}} {u}', b / {1024 ** i}.0)" for i, u in enumerate(vocab.SIZE_UNITS[:5])) + \
    f" else format('{{:.1f}} PB', b / {1024 ** 5}.0) end"
ORACLES["f15_size_label"] = f"""with x as (select table_name, size_bytes as b from ({STATS_SQL}) union all
 select cast(o_orderkey as varchar), cast(o_orderkey * o_orderkey * o_orderkey * o_custkey as bigint) from orders)
 select table_name, b as size_bytes, {SIZE_CASE} as label from x"""

# ---- G -------------------------------------------------------------------------------
FAMILY_SQL = "case when contains(data_type, 'int') then 'integer' when data_type = 'string' then 'string' else data_type end"
G1_SQL = f""", fam as (select *, {FAMILY_SQL} as family, rtrim(table_name, 's') as one from cat),
 fk as (select 'foreign_key' as type, a.table_name as from_table, a.column_name as from_column, b.table_name as to_table, b.column_name as to_column,
 a.row_count as from_rows, b.row_count as to_rows,
 least(1.0, 0.5 + case when a.c = b.c then 0.3 else 0 end + case when a.c = b.one || '_id' and b.c = 'id' then 0.4 else 0 end
  + case when contains(a.c, 'id') or contains(b.c, 'id') then 0.1 else 0 end) as confidence,
 'Column names suggest relationship: ' || a.c || ' -> ' || b.c as reasoning
 from fam a join fam b on a.table_name < b.table_name and a.family = b.family and (a.c = b.c
  or (b.c = 'id' and a.c in (b.one || '_id', b.one || 'id', b.table_name || '_id')) or (a.c = 'id' and b.c in (a.one || '_id', a.table_name || '_id'))))"""
QUERIES["g1_fk_candidates"] = lambda s, d: rounded(re.foreign_key_candidates(catalog(s, d)).drop("confidence"))
ORACLES["g1_fk_candidates"] = WITH + G1_SQL + " select * exclude (confidence) from fk"
QUERIES["g2_type_compat"] = lambda s, d: re.type_compatibility(_both(s, d)).select("table_name", "column_name", "family", "row_count")
ORACLES["g2_type_compat"] = WITH + f"""select table_name, column_name, {FAMILY_SQL} as family, row_count from
 (select table_name, column_name, data_type, row_count from cat union all select table_name, column_name, data_type, row_count from {CATALOG_SQL} where table_name <> 'orders')"""
QUERIES["g3_confidence"] = lambda s, d: rounded(re.foreign_key_candidates(catalog(s, d)).select(
    "from_table", "from_column", "to_table", "to_column", "confidence", "from_rows"))
ORACLES["g3_confidence"] = WITH + G1_SQL + " select from_table, from_column, to_table, to_column, round(cast(confidence as double), 4) as confidence, from_rows from fk"


def _g4(s, d):
    cat = catalog(s, d)
    return re.degrees(re.foreign_key_candidates(cat)).join(
        cat.groupBy("table_name").agg(F.max("row_count").alias("row_count")), "table_name")


QUERIES["g4_hub_lookup"] = _g4
ORACLES["g4_hub_lookup"] = WITH + G1_SQL + """, e as (select to_table as table_name, 1 as i, 0 as o from fk union all select from_table, 0, 1 from fk),
 g as (select table_name, cast(sum(i) as bigint) as incoming, cast(sum(o) as bigint) as outgoing from e group by 1)
 select g.*, incoming + outgoing as total_relationships, incoming + outgoing > 3 as is_hub, incoming > outgoing and incoming > 1 as is_lookup,
 (select max(row_count) from cat where cat.table_name = g.table_name) as row_count from g"""


def _with_rows(df, cat, side):
    rows = cat.groupBy(F.col("table_name").alias(side)).agg(F.max("row_count").alias("row_count"))
    return df.join(rows, side)


def _g5(s, d):
    # conventions name the referenced table in the singular: register the tables under it
    cat = ca.lake_catalog({t.rstrip("s"): df for t, df in star(s, d).items()})
    return _with_rows(re.named_foreign_keys(cl.key_columns(cat)), cat, "from_table")


QUERIES["g5_named_fk"] = _g5
ORACLES["g5_named_fk"] = WITH + """, k as (select rtrim(table_name, 's') as table_name, column_name, c, row_count from cat)
 select 'foreign_key' as type, table_name as from_table, column_name as from_column, replace(c, '_id', '') as to_table, 'id' as to_column,
 cast(0.8 as double) as confidence, row_count from k where c like '%\\_id' escape '\\' and c <> rtrim(table_name, 's') || '_id'
 and replace(c, '_id', '') in (select table_name from k)"""
QUERIES["g6_common_name"] = lambda s, d: _with_rows(re.potential_joins(catalog(s, d)), catalog(s, d), "table1")
ORACLES["g6_common_name"] = WITH + """ select 'potential_join' as type, a.table_name as table1, a.column_name as column1, b.table_name as table2, b.column_name as column2,
 cast(0.6 as double) as confidence, 'common_column_name' as detected_by, a.row_count from cat a join cat b on a.column_name = b.column_name and a.table_name < b.table_name
 where a.c not in ('id', 'created_at', 'updated_at')"""
QUERIES["g7_suffix_fk"] = lambda s, d: re.suffix_references(catalog(s, d))
ORACLES["g7_suffix_fk"] = WITH + SUFFIX_SQL + " select * from refs2"

G8_SQL = CLASS_SQL + """, sh as (select a.table_name as table1, b.table_name as table2, a.column_name, case when regexp_matches(a.c, '_id|_key|id_|key_') then 'foreign_key'
 when a.c in ('date', 'created_at', 'updated_at', 'timestamp') then 'temporal' else 'common_attribute' end as relationship_type
 from cat a join cat b on a.column_name = b.column_name and a.table_name < b.table_name),
 shared as (select sh.*, case relationship_type when 'foreign_key' then 'high' when 'temporal' then 'medium' else 'low' end as strength,
 x.table_classification as table1_type, y.table_classification as table2_type from sh join classes x on x.table_name = table1 join classes y on y.table_name = table2)"""


def _shared(s, d):
    cat = catalog(s, d)
    return re.shared_columns(cat, cl.table_classes(cat))


QUERIES["g8_pair_strength"] = lambda s, d: _shared(s, d)
ORACLES["g8_pair_strength"] = WITH + G8_SQL + " select * from shared"
QUERIES["g8_pair_totals"] = lambda s, d: re.shared_totals(_shared(s, d), catalog(s, d))
ORACLES["g8_pair_totals"] = WITH + G8_SQL + """ select table1, table2, count(*) as total_relationships, count(*) filter (strength = 'high') as strong_relationships,
 string_agg(column_name, ', ' order by column_name) as common_columns, any_value(x.row_count) as row_count1, any_value(y.row_count) as row_count2
 from shared join (select distinct table_name, row_count from cat) x on x.table_name = table1 join (select distinct table_name, row_count from cat) y on y.table_name = table2 group by 1, 2"""
QUERIES["g9_fact_dim_links"] = lambda s, d: re.fact_dimension_links(catalog(s, d), cl.table_classes(catalog(s, d)))
ORACLES["g9_fact_dim_links"] = WITH + CLASS_SQL + """, t as (select cat.*, table_classification as k from cat join classes using (table_name))
 select a.table_name as fact_table, b.table_name as dimension_table, string_agg(distinct a.column_name, ', ' order by a.column_name) as linking_columns,
 case when bool_or(contains(a.column_name, '_id') or contains(a.column_name, '_key')) then 'high' else 'medium' end as relationship_strength
 from t a join t b on a.column_name = b.column_name and a.table_name <> b.table_name where (a.k like 'fact%' or contains(a.table_name, 'fact'))
 and (b.k like 'dim%' or contains(b.table_name, 'dim')) group by 1, 2"""
QUERIES["g10_column_frequency"] = lambda s, d: re.column_frequency(catalog(s, d))
ORACLES["g10_column_frequency"] = WITH + """ select c as column_name, string_agg(table_name, ', ' order by table_name) as tables, count(*) as frequency,
 c like '%\\_id' escape '\\' or c like '%\\_key' escape '\\' as likely_join_key, regexp_matches(c, 'date|time') or c like '%\\_key' escape '\\' as is_dimension_key,
 cast(sum(row_count) as bigint) as rows_covered from cat group by c having count(*) >= 2"""
QUERIES["g10_join_key_pairs"] = lambda s, d: _with_rows(re.join_key_pairs(catalog(s, d)), catalog(s, d), "table1")
ORACLES["g10_join_key_pairs"] = WITH + """ select a.table_name as table1, b.table_name as table2, a.c as join_column, case when a.c like '%\\_id' escape '\\' then 'high' else 'medium' end as confidence, a.row_count
 from cat a join cat b on a.c = b.c and a.table_name < b.table_name where a.c like '%\\_id' escape '\\' or a.c like '%\\_key' escape '\\'"""
QUERIES["g11_name_tokens"] = lambda s, d: re.name_tokens(_both(s, d))
ORACLES["g11_name_tokens"] = WITH + ALLCAT + """, k as (select distinct table_name, row_count, unnest(string_split(c, '_')) as pattern from allcat where contains(c, '_'))
 select pattern, string_agg(table_name, ', ' order by table_name) as tables, count(*) as frequency, cast(sum(row_count) as bigint) as rows_covered
 from k where length(pattern) > 2 group by 1 having count(*) >= 2"""


def _similar(s, d):
    cat = catalog(s, d)
    info = cl.table_classes(cat).select("table_name", "row_count", "table_classification").withColumn(
        "is_partitioned", F.col("table_name").isin(PARTITIONED))
    return re.schema_similarity(cat, info)


G12_SQL = CLASS_SQL + """, info as (select *, table_name in ('orders', 'fact_lineitem') as is_partitioned from classes),
 cols as (select table_name, count(*) as n from cat group by 1),
 pr as (select a.table_name as table1, b.table_name as table2, count(*) as common_columns_count, string_agg(a.column_name, ', ' order by a.column_name) as common_columns
  from cat a join cat b on a.column_name = b.column_name and a.table_name < b.table_name group by 1, 2),
 sim as (select pr.*, common_columns_count / (x.n + y.n - common_columns_count) * 100 as commonality, x.n - common_columns_count as u1, y.n - common_columns_count as u2,
  p.row_count / q.row_count as row_count_ratio, p.is_partitioned <> q.is_partitioned as partitioning_differs, p.table_classification <> q.table_classification as class_differs
  from pr join cols x on x.table_name = table1 join cols y on y.table_name = table2 join info p on p.table_name = table1 join info q on q.table_name = table2),
 lab as (select *, case when u1 = 0 and u2 > 0 then table1 || ' appears to be a subset of ' || table2 when u2 = 0 and u1 > 0 then table2 || ' appears to be a subset of ' || table1
  when commonality > 80 then 'Very similar tables with minor differences' else 'Related tables with significant overlap' end as relationship_type from sim where commonality > 50)"""
QUERIES["g12_schema_similarity"] = lambda s, d: rounded(_similar(s, d).drop("commonality"))
ORACLES["g12_schema_similarity"] = WITH + G12_SQL + """ select table1, table2, round_even(commonality, 1) as commonality_percentage, common_columns_count, common_columns,
 coalesce((select string_agg(a.column_name || ' ' || a.data_type, ', ' order by a.column_name) from cat a where a.table_name = table1 and a.column_name not in (select column_name from cat b where b.table_name = table2)), '') as table1_unique_columns,
 coalesce((select string_agg(a.column_name || ' ' || a.data_type, ', ' order by a.column_name) from cat a where a.table_name = table2 and a.column_name not in (select column_name from cat b where b.table_name = table1)), '') as table2_unique_columns,
 round(row_count_ratio, 4) as row_count_ratio, case when row_count_ratio > 2 then table1 || format(' has {:.1f}x more records than ', row_count_ratio) || table2
 when row_count_ratio < 0.5 then table2 || format(' has {:.1f}x more records than ', 1 / row_count_ratio) || table1 end as row_count_insight,
 partitioning_differs, class_differs, relationship_type from lab"""
QUERIES["g13_similarity_advice"] = lambda s, d: re.similarity_advice(_similar(s, d))
ORACLES["g13_similarity_advice"] = WITH + G12_SQL + """, adv as (select *, case when commonality > 90 then ['Consider consolidating ' || table1 || ' and ' || table2 || ' as they are nearly identical', 'Investigate if one table is a duplicate or backup of the other']
 when commonality > 80 then ['Evaluate if ' || table1 || ' and ' || table2 || ' can be merged with additional columns', 'Consider creating a unified schema with optional columns']
 when commonality > 70 then ['Analyze if ' || table1 || ' and ' || table2 || ' represent different versions or time periods', 'Consider implementing a versioning strategy or temporal tables']
 else ['Tables ' || table1 || ' and ' || table2 || ' are related but serve different purposes', 'Maintain as separate entities but ensure consistent naming and relationships'] end
 || case when contains(relationship_type, 'subset') then ['Consider using views or derived tables for subset relationships'] else [] end
 || case when partitioning_differs then ['Standardize partitioning strategy across related tables'] else [] end
 || case when class_differs then ['Ensure proper fact-dimension relationships are maintained'] else [] end as lines from lab)
 select table1, table2, cast(unnest(range(len(lines))) as integer) as line, unnest(lines) as recommendation from adv"""

PLAIN = {t: [c for c, k in TABLES[t].items() if k != "array"] for t in ALL}
QUERIES["g14_value_containment"] = lambda s, d: rounded(re.inclusion_dependencies(
    lake(s, d), re.inclusion_candidates(ca.schema_rows(lake(s, d)))))
CELLS_SQL = union_all(
    f"""select '{t}' as t, '{c}' as c, '{'integer' if TABLES[t][c] in ('int', 'bigint') else TABLES[t][c]}' as family, cast({c} as varchar) as v, count(*) as n
 from {t} where {c} is not null group by all""" for t, cs in PLAIN.items() for c in cs)
ORACLES["g14_value_containment"] = f"""with cells as materialized ({CELLS_SQL}),
 st as (select t, c, family, regexp_replace(c, '^[a-z]+_', '') as k, max(n) as most, min(try_cast(v as double)) as lo, max(try_cast(v as double)) as hi from cells group by all),
 p as (select a.t as from_table, a.c as from_column, b.t as to_table, b.c as to_column from st a join st b on a.k = b.k and a.t <> b.t and a.family = b.family
  where b.most = 1 and (a.family <> 'integer' or (a.lo >= b.lo and a.hi <= b.hi)))
 select from_table, from_column, to_table, to_column, case when from_column = to_column then 'equal_name' else 'prefix_stripped' end as matched_by,
  count(*) as source_values, count(w.v) as contained_values, cast(coalesce(sum(case when w.v is null then x.n end), 0) as bigint) as orphan_rows,
  round(count(w.v) / count(*), 4) as containment
 from p join cells x on x.t = from_table and x.c = from_column left join cells w on w.t = to_table and w.c = to_column and w.v = x.v group by 1, 2, 3, 4, 5"""


def _g15(s, d):
    cat = catalog(s, d)
    return re.relationship_counts(re.foreign_key_candidates(cat), re.potential_joins(cat))


QUERIES["g15_relationship_counts"] = _g15
ORACLES["g15_relationship_counts"] = WITH + G1_SQL + """, j as (select 1 from cat a join cat b on a.column_name = b.column_name and a.table_name < b.table_name where a.c not in ('id', 'created_at', 'updated_at'))
 select (select count(*) from fk) + (select count(*) from j) as total_detected, (select count(*) from fk) as foreign_keys, (select count(*) from j) as potential_joins"""

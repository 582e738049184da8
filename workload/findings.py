"""K: findings texts.  Every document carries a planted report in front of its own text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakegauge.functions import vocab
from lakegauge.operators import findings as fi
from workload.common import TABLES, lake, rounded, table, union_all

QUERIES, ORACLES = {}, {}

REPORT = """concat('## Data Quality Findings', chr(10), '- Critical null issue in orders', chr(10),
         'compliance risk, simple fix', chr(10), '- ok', chr(10), '**Partitioning**', chr(10),
         '1. Partition lineitem by date ', cast(doc_id % 7 as string), chr(10),
         'high priority, complex', chr(10), chr(10), '## Usage of ', lang, chr(10), 'category: ', source, ' quick',
         chr(10), 'Priority: High', chr(10), '- item ', cast(doc_id % 5 as string), ' of ', source, ' is an important customer key with moderate gain', chr(10), chr(10), text)"""
STAGE = "case doc_id % 4 when 0 then 'discovery' when 1 then 'analysis' when 2 then 'modeling' else 'optimization' end"
ORDER = ["doc_id", "section", "item"]


def docs(s, d):
    return table(s, d, "documents").selectExpr("doc_id", f"{STAGE} as stage", f"{REPORT} as text")


WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(32)||chr(133)||chr(160)||chr(5760)||" + \
    "||".join(f"chr({c})" for c in [*range(8192, 8203), 8232, 8233, 8239, 8287, 12288])


def words_sql(x):
    return f"list_filter(string_split(translate({x}, (select ws from w), repeat(' ', (select cast(length(ws) as integer) from w))), ' '), lambda q: q <> '')"


LINES = f"""with w as (select {WS} as ws), docs as (select doc_id, {STAGE} as stage, {REPORT} as text from documents),
 raw as (select doc_id, stage, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from docs),
 ln as (select doc_id, stage, i, trim(x, (select ws from w)) as l from raw)"""
SECTIONS = LINES + f""", hd as (select *, starts_with(l, '##') or starts_with(l, '**') or (ends_with(l, ':') and len({words_sql('l')}) <= 4) as h from ln),
 sc as (select *, sum(case when h then 1 else 0 end) over (partition by doc_id order by i) as s from hd),
 se as (select doc_id, stage, s, trim(replace(replace(replace(max(l) filter (h), '##', ''), '**', ''), ':', ''), (select ws from w)) as title,
  coalesce(string_agg(l, chr(10) order by i) filter (not h), '') as content from sc where s > 0 group by doc_id, stage, s),
 sections as (select doc_id, stage, cast(min(s) as integer) as section, title, arg_max(content, s) as content from se where title <> '' group by doc_id, stage, title)"""
ITEMS = SECTIONS + """, il as (select doc_id, stage, section, title, unnest(string_split(content, chr(10))) as x, generate_subscripts(string_split(content, chr(10)), 1) as i from sections),
 im as (select doc_id, stage, section, title, i, trim(x, (select ws from w)) as l from il where trim(x, (select ws from w)) <> ''),
 ib as (select *, sum(case when first or regexp_matches(l, '^(-|•|\\*|\\p{Nd})') then 1 else 0 end) over (partition by doc_id, section order by i) as item
  from (select *, row_number() over (partition by doc_id, section order by i) = 1 as first from im)),
 it as (select doc_id, stage, section, title, cast(item as integer) as item, string_agg(l, chr(10) order by i) as body, min(l) filter (k = 1) as head,
  string_agg(l, chr(10) order by i) filter (k > 1) as rest from (select *, row_number() over (partition by doc_id, section, item order by i) as k from ib) group by all),
 items as (select * from it where length(body) > case when stage = 'analysis' then 15 else 10 end)"""
TITLED = ITEMS + """, titled as (select doc_id, stage, section, item, title as section_title, ltrim(head, '-•*0123456789. ') as title,
 coalesce(rest, ltrim(head, '-•*0123456789. ')) as description from items)"""


def rule_sql(x, rules, default):
    return "case " + " ".join("when " + " or ".join(f"contains({x}, '{w}')" for w in ws) + f" then '{l}'" for l, ws in rules) + f" else '{default}' end"


TAG_SQL = ", ".join(f"{rule_sql('bt' if src == 'both' else 'd', rules, default)} as {n}" for n, (src, rules, default) in fi.TAGS.items())
CATEGORY_SQL = "case stage " + " ".join(f"when '{st}' then {rule_sql('lower(title)' if st == 'optimization' else 'lower(section_title)', r, df)}" for st, (r, df) in fi.CATEGORIES.items()) + " end"
SCORE = lambda col, m: f"case {col} " + " ".join(f"when '{k}' then {v}" for k, v in m.items()) + " end"
FOUND = TITLED + f""", tg as (select *, {TAG_SQL}, {CATEGORY_SQL} as category from (select *, lower(description) as d, lower(title || ' ' || description) as bt from titled)),
 found as (select * exclude (priority), priority as text_priority, case stage when 'analysis' then case when {SCORE('severity', vocab.SEVERITY_SCORES)} + {SCORE('business_impact', vocab.IMPACT_SCORES)} >= 6 then 'critical'
  when {SCORE('severity', vocab.SEVERITY_SCORES)} + {SCORE('business_impact', vocab.IMPACT_SCORES)} >= 4 then 'high'
  when {SCORE('severity', vocab.SEVERITY_SCORES)} + {SCORE('business_impact', vocab.IMPACT_SCORES)} >= 3 then 'medium' else 'low' end
  when 'modeling' then priority else 'medium' end as priority from tg)"""

QUERIES["k1_sections"] = lambda s, d: fi.sections(docs(s, d))
ORACLES["k1_sections"] = SECTIONS + " select * from sections"
QUERIES["k2_items"] = lambda s, d: fi.items(fi.sections(docs(s, d)))
ORACLES["k2_items"] = ITEMS + " select doc_id, stage, section, title, item, body from items"


def titled(s, d):
    return fi.titled(fi.items(fi.sections(docs(s, d))))


QUERIES["k3_title"] = titled
ORACLES["k3_title"] = TITLED + " select * from titled"

PAIR = "not starts_with(l, '-') and not starts_with(l, '•') and contains(l, ':') and replace(lower(trim(split_part(l, ':', 1), (select ws from w))), ' ', '_') in ('priority', 'category', 'implementation_effort')"
QUERIES["k4_markdown_recs"] = lambda s, d: fi.markdown_recommendations(docs(s, d))
ORACLES["k4_markdown_recs"] = LINES + f""", b as (select *, starts_with(l, '##') or starts_with(l, '**') as head, l = '' as blank from ln),
 g as (select *, sum(case when head or blank then 1 else 0 end) over (partition by doc_id order by i) as rec from b),
 m as (select doc_id, stage, rec from g where head),
 p as (select g.*, not head and {PAIR} as pair, replace(lower(trim(split_part(l, ':', 1), (select ws from w))), ' ', '_') as k,
  lower(trim(substr(l, strpos(l, ':') + 1), (select ws from w))) as v from g semi join m on g.doc_id = m.doc_id and g.rec = m.rec)
 select doc_id, stage, cast(rec as integer) as rec, trim(replace(replace(max(l) filter (head), '**', ''), '##', ''), (select ws from w)) as title,
 coalesce(arg_max(v, i) filter (pair and k = 'priority'), 'medium') as priority, coalesce(arg_max(v, i) filter (pair and k = 'category'), 'general') as category,
 coalesce(arg_max(v, i) filter (pair and k = 'implementation_effort'), 'medium') as implementation_effort,
 coalesce(trim(string_agg(l, chr(10) order by i) filter (not head and not pair), (select ws from w)), '') as description from p group by doc_id, stage, rec"""

TAGS = list(fi.TAGS)
# tags of whole documents, and of the planted findings
QUERIES["k5_tags"] = lambda s, d: fi.tag(titled(s, d)).select("doc_id", "stage", "section", "item", *TAGS)
ORACLES["k5_tags"] = TITLED + f" select doc_id, stage, section, item, {TAG_SQL} from (select *, lower(description) as d, lower(title || ' ' || description) as bt from titled)"
QUERIES["k6_categories"] = lambda s, d: fi.categorize(titled(s, d)).select("doc_id", "stage", "section", "item", "category")
ORACLES["k6_categories"] = TITLED + f" select doc_id, stage, section, item, {CATEGORY_SQL} as category from titled"
QUERIES["k7_priority"] = lambda s, d: fi.findings(docs(s, d)).select("doc_id", "stage", "section", "item", "severity", "business_impact", "priority")
ORACLES["k7_priority"] = FOUND + " select doc_id, stage, section, item, severity, business_impact, priority from found"

NAMES = sorted(TABLES)


def _mentions(s, d):
    from lakegauge.operators import catalog as ca
    sizes = ca.lake_catalog(lake(s, d)).groupBy("table_name").agg(F.max("row_count").alias("row_count"), F.count("column_name").alias("column_count"))
    return fi.mentions(titled(s, d), sizes).select(
        "doc_id", "section", "item", "associated_tables", "table_name", "row_count", "column_count")


QUERIES["k8_mentions"] = _mentions
ORACLES["k8_mentions"] = TITLED + f""", sizes as ({union_all(f"select '{t}' as table_name, {i} as o, count(*) as row_count, (select count(*) from information_schema.columns where table_name = '{t}') as column_count from {t}" for i, t in enumerate(NAMES))}),
 hit as (select doc_id, section, item, table_name, o from titled, sizes where contains(lower(title), table_name) or (stage = 'analysis' and contains(lower(description), table_name))),
 g as (select doc_id, section, item, string_agg(table_name, ', ' order by o) as associated_tables, arg_min(table_name, o) as table_name from hit group by 1, 2, 3)
 select g.*, row_count, column_count from g join sizes using (table_name)"""


def _lake_row(s, d):
    """Quality of the documents table as the lake's one-row summary."""
    t = table(s, d, "documents")
    return t.agg(F.lit(12).alias("tables"), F.count_distinct("source").alias("relationships"),
                 (F.count_if(F.col("n_chars") > 200) / F.count(F.lit(1))).alias("data_quality_score"),
                 (F.count("text") / F.count(F.lit(1))).alias("completeness_score"))


def _confidences(s, d, by=("stage",)):
    return fi.confidences(fi.findings(docs(s, d)), _lake_row(s, d), by)


CONF = """, q as (select 12 as tables, count(distinct source) as relationships, count(*) filter (n_chars > 200) / count(*) as q, count(text) / count(*) as cq from documents),
 {g} as (select {by}, count(*) as recommendations, count(distinct category) as categories from found group by {by}),
 {c} as (select {g}.*, greatest(0e0, least(1e0, case stage when 'discovery' then 0.8e0 + 0.1e0 + case when relationships > 0 then 0.1e0 else 0e0 end + case when recommendations > 5 then 0.05e0 else 0e0 end
  when 'analysis' then 0.75e0 + case when q > 0.8 then 0.1e0 when q < 0.5 then -0.1e0 else 0e0 end + case when recommendations > 10 then 0.05e0 when recommendations < 3 then -0.1e0 else 0e0 end + case when categories > 3 then 0.05e0 else 0e0 end
  else 0.7e0 + case when q > 0.8 then 0.1e0 when q < 0.5 then -0.1e0 else 0e0 end + case when cq > 0.9 then 0.1e0 when cq < 0.7 then -0.1e0 else 0e0 end
   + case when recommendations > 10 then -0.1e0 when recommendations < 3 then 0.05e0 else 0e0 end end)) as confidence from {g}, q)"""
STAGE_CONF = CONF.format(g="sg", c="conf", by="stage")
QUERIES["k9_confidence"] = lambda s, d: rounded(_confidences(s, d))
ORACLES["k9_confidence"] = FOUND + STAGE_CONF + " select stage, recommendations, categories, round(confidence, 4) as confidence from conf"
QUERIES["k9_confidence_per_report"] = lambda s, d: rounded(_confidences(s, d, ("doc_id", "stage")))
ORACLES["k9_confidence_per_report"] = FOUND + CONF.format(g="sg", c="conf", by="doc_id, stage") + \
    " select doc_id, stage, recommendations, categories, round(confidence, 4) as confidence from conf"


def consolidated(s, d):
    found = fi.findings(docs(s, d))
    return fi.consolidate(found, fi.confidences(found, _lake_row(s, d)))


CONSOLIDATED = FOUND + STAGE_CONF + f""", co as (select found.*, confidence_1 as stage_confidence, {SCORE('priority', vocab.PRIORITY_SCORES)} * {SCORE('stage', vocab.STAGE_WEIGHTS)} * confidence_1 as score
  from found join (select stage, confidence as confidence_1 from conf) using (stage)),
 cons as (select *, case when score >= 4.5 then 'critical' when score >= 3.5 then 'high' when score >= 2.5 then 'medium' else 'low' end as consolidated_priority from co)"""
SHOWN = ["doc_id", "stage", "section", "item", "title", "priority", "consolidated_priority"]
QUERIES["k10_consolidated"] = lambda s, d: rounded(consolidated(s, d).select(*SHOWN, "stage_confidence"))
ORACLES["k10_consolidated"] = CONSOLIDATED + f" select {', '.join(SHOWN)}, round(stage_confidence, 4) as stage_confidence from cons"


def title_rows(s, d):
    """Item titles of all reports; the planted ones come in seven and five wordings per source."""
    return titled(s, d).select("doc_id", "section", "item", "title")


QUERIES["k11_dedup"] = lambda s, d: fi.deduplicate(title_rows(s, d), ORDER)
# greedy rule: keep the first title, drop all that are similar to it, go on with the rest
ORACLES["k11_dedup"] = f"with recursive {TITLED[5:]}" + f""", sets as (select doc_id, section, item, title, list_sort(list_distinct({words_sql('lower(title)')})) as ts from titled),
 firsts as (select ts, min((doc_id, section, item)) as pos from sets where len(ts) > 0 group by ts),
 num as (select ts, pos, row_number() over (order by pos) as k from firsts),
 tok as (select k, len(ts) as n, ts, unnest(ts) as t from num), fr as (select t, count(*) as f from tok group by 1),
 ra as (select tok.*, row_number() over (partition by k order by f, t) as r from tok join fr using (t)),
 hd2 as (select * from ra where r <= n - floor(n * 0.8 + 1e-9)),
 pr as (select distinct a.k as a, b.k as b from hd2 a join hd2 b on a.t = b.t and a.k < b.k
  where len(list_intersect(a.ts, b.ts)) / (a.n + b.n - len(list_intersect(a.ts, b.ts))) > 0.8),
 nb as (select b, list(a) as earlier from pr group by b), ord as (select b, earlier, row_number() over (order by b) as step from nb),
 loop as (select cast(0 as bigint) as step, cast([] as bigint[]) as dropped
  union all select loop.step + 1, case when len(list_filter(ord.earlier, lambda x: not list_contains(loop.dropped, x))) > 0 then list_append(loop.dropped, ord.b) else loop.dropped end
  from loop join ord on ord.step = loop.step + 1),
 gone as (select unnest(dropped) as k from (select dropped from loop order by step desc limit 1))
 select doc_id, section, item, title from sets where len(ts) = 0 or (doc_id, section, item) in (select pos from num where k not in (select k from gone))"""

# whole document texts as titles: near copies of any length (the recursive SQL takes
# minutes here; tests compare the operator with a brute-force loop instead)
QUERIES["k11_dedup_documents"] = lambda s, d: fi.deduplicate(
    table(s, d, "documents").select("doc_id", "text"), ["doc_id"], "text").select("doc_id")

def ranked(s, d):
    """Titles are settled before the confidences join, so the texts are parsed for them once."""
    found = fi.findings(docs(s, d))
    return fi.rank(fi.consolidate(fi.deduplicate(found, ORDER), fi.confidences(found, _lake_row(s, d))), ORDER)


QUERIES["k12_ranked"] = lambda s, d: ranked(s, d).select(*SHOWN)
ORACLES["k12_ranked"] = f"with recursive {CONSOLIDATED[5:]}" + ORACLES["k11_dedup"][len(f"with recursive {TITLED[5:]}"):].split("\n select doc_id, section, item, title from sets")[0] + f""",
 kept as (select doc_id, section, item from sets where len(ts) = 0 or (doc_id, section, item) in (select pos from num where k not in (select k from gone)))
 select {', '.join(SHOWN)} from cons join kept using (doc_id, section, item)
 order by {SCORE('consolidated_priority', vocab.PRIORITY_RANKS)} desc, doc_id, section, item"""

QUERIES["k13_overlap"] = lambda s, d: rounded(fi.stage_overlap(fi.findings(docs(s, d)), 0.01), 6)
STOP = "[" + ", ".join(f"'{w}'" for w in vocab.KEYWORD_STOPLIST) + "]"
ORACLES["k13_overlap"] = FOUND + f""", kw as (select distinct stage, unnest(list_slice(list_filter({words_sql('bt')}, lambda x: length(x) > 3 and not list_contains({STOP}, x)), 1, 10)) as m from found),
 ct as (select distinct stage, category as m from found), st as (select distinct stage from found),
 pr as (select a.stage as stage1, b.stage as stage2,
  (select count(*) from ct x join ct y using (m) where x.stage = a.stage and y.stage = b.stage) as cc, (select count(distinct m) from ct where stage in (a.stage, b.stage)) as cu,
  (select count(*) from kw x join kw y using (m) where x.stage = a.stage and y.stage = b.stage) as kk, (select count(distinct m) from kw where stage in (a.stage, b.stage)) as ku,
  coalesce((select string_agg(m, ', ' order by m) from ct where stage = a.stage and m in (select m from ct where stage = b.stage)), '') as common_themes,
  coalesce((select string_agg(m, ', ' order by m) from ct where stage = a.stage and m not in (select m from ct where stage = b.stage)), '') as unique_to_first,
  coalesce((select string_agg(m, ', ' order by m) from ct where stage = b.stage and m not in (select m from ct where stage = a.stage)), '') as unique_to_second
  from st a join st b on a.stage <> b.stage)
 select stage1, stage2, round((cc / cu + kk / ku) / 2, 6) as overlap_score, common_themes, unique_to_first, unique_to_second from pr where (cc / cu + kk / ku) / 2 > 0.01"""


def _stage_results(s, d):
    """Stage results, with the stages below a confidence of 0.75 counted as failed."""
    return _confidences(s, d).withColumn("success", F.col("confidence") >= 0.75)


QUERIES["k14_insights"] = lambda s, d: rounded(fi.run_insights(_stage_results(s, d)))
ORACLES["k14_insights"] = FOUND + STAGE_CONF + """, r as (select *, confidence >= 0.75 as success, case stage when 'discovery' then 0 when 'analysis' then 1 when 'modeling' then 2 else 3 end as o from conf)
 select count(*) as total_stages, count(*) filter (success) as successful_stages, count(*) filter (not success) as failed_stages,
 round(count(*) filter (success) / count(*) * 100, 4) as success_rate, round(avg(confidence) filter (success), 4) as average_confidence,
 arg_max(stage, (confidence, -o)) filter (success) as highest_confidence_stage, arg_min(stage, (confidence, o)) filter (success) as lowest_confidence_stage,
 cast(sum(recommendations) filter (success) as bigint) as total_recommendations, round(avg(recommendations) filter (success), 4) as average_per_stage from r"""
QUERIES["k15_distribution"] = lambda s, d: rounded(fi.distribution(consolidated(s, d)))
ORACLES["k15_distribution"] = CONSOLIDATED + " " + union_all(
    f"""select '{dim}' as dimension, {col} as value, count(*) as findings, count(*) filter (consolidated_priority in ('critical', 'high')) as high_priority,
 round(avg(stage_confidence), 4) as avg_confidence from cons group by {col}"""
    for dim, col in [("category", "category"), ("source", "stage"), ("priority", "consolidated_priority")])
QUERIES["k16_filter_sort"] = lambda s, d: fi.filter_sort(consolidated(s, d), "data_quality", None, "analysis", "title").select(*SHOWN)
ORACLES["k16_filter_sort"] = CONSOLIDATED + f" select {', '.join(SHOWN)} from cons where category = 'data_quality' and stage = 'analysis'"
QUERIES["k16_top_findings"] = lambda s, d: fi.top_findings(consolidated(s, d), ORDER).select(*SHOWN)
ORACLES["k16_top_findings"] = CONSOLIDATED + f" select {', '.join(SHOWN)} from cons where consolidated_priority in ('critical', 'high') order by doc_id, section, item limit 5"
QUERIES["k17_quick_wins"] = lambda s, d: fi.quick_wins(titled(s, d)).select("doc_id", "section", "item", "is_priority_action", "is_quick_win")
ORACLES["k17_quick_wins"] = TITLED + """ select doc_id, section, item, regexp_matches(b, 'critical|important') as is_priority_action, regexp_matches(b, 'quick|easy') as is_quick_win
 from (select *, lower(title || ' ' || description) as b from titled)"""
QUERIES["k17_quick_win_counts"] = lambda s, d: fi.quick_win_counts(fi.quick_wins(titled(s, d)))
ORACLES["k17_quick_win_counts"] = TITLED + """ select count(*) as total_recommendations, count(*) filter (regexp_matches(b, 'critical|important')) as priority_actions,
 count(*) filter (regexp_matches(b, 'quick|easy')) as quick_wins from (select lower(title || ' ' || description) as b from titled)"""

"""Whole-table profiles: every column statistic joined per column, then per table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lakegauge.functions import vocab
from lakegauge.functions.exprs import KEYS, is_numeric, is_temporal, ordered_names, percent
from lakegauge.operators import anomalies as an, numeric as nu, patterns as pa, quality as qu
from lakegauge.operators import temporal as te, values as va
from lakegauge.operators.catalog import schema_rows


@dataclass
class Parts:
    """Lazy building blocks of a profile, shared by all statistics of a table."""

    catalog: DataFrame
    text_cells: DataFrame
    counts: DataFrame
    numbers: DataFrame
    instants: DataFrame
    presence: DataFrame


def parts_of(df: DataFrame, table: str, columns=None) -> Parts:
    fields = [f for f in df.schema.fields if columns is None or f.name in set(columns)]
    catalog = schema_rows({table: df})
    if columns is not None:
        catalog = catalog.where(F.col("column_name").isin([f.name for f in fields]))
    texts = [f.name for f in fields if not (is_numeric(f) or is_temporal(f))]  # may be long as text
    return Parts(catalog, va.cells(df, table, texts), va.table_counts({table: df}, {table: columns}),
                 nu.numbers(df, table, columns), te.instants(df, table, columns), va.presence(df, table, columns))


def union_parts(parts: list[Parts]) -> Parts:
    """One set of building blocks for many tables (each stays keyed by table)."""
    def together(name):
        frames = [getattr(p, name) for p in parts]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out
    return Parts(*[together(n) for n in Parts.__dataclass_fields__])


def column_profile(df: DataFrame, table: str, columns=None, exact: bool = True) -> DataFrame:
    """One row per column with all statistics, patterns, anomalies, flags and the score."""
    return profile_parts(parts_of(df, table, columns), exact)


ONE, MANY = ["catalog", "presence", "stats", "numeric", "lengths", "dates"], ["temporal", "pattern", "anomaly", "top", "least"]


def _gathered(frames: dict[str, DataFrame]) -> DataFrame:
    """Metric frames side by side: one row per column, by a union and one grouping.

    A frame becomes a struct column; frames with several rows per column (at most
    some dozens, all bounded) become arrays.  This replaces a chain of joins.
    """
    names = [n for n in ONE + MANY if n in frames]
    parts = []
    for own, df in frames.items():
        rest = [c for c in df.columns if c not in KEYS]
        parts.append(df.select(*KEYS, *[(F.struct(*rest) if n == own else F.lit(None)).alias(n) for n in names]))
    together = reduce(DataFrame.union, parts)
    return together.groupBy(*KEYS).agg(*[
        (F.any_value(n, True) if n in ONE else F.array_sort(F.collect_list(n))).alias(n) for n in names])


PRESENCE = {"total_count", "null_count", "null_percentage", "non_null_count"}
#: frames behind derived fields; every other field names its frame in `FRAME_OF`
NEEDS = {"potential_key": {"stats"}, "potential_pii": {"stats", "pattern"}, "data_classification": {"stats", "pattern"},
         "anomaly_count": {"anomaly"}, "anomalies": {"anomaly"}, "quality_score": {"stats", "lengths", "anomaly"},
         "common_patterns": {"pattern"}, "temporal_patterns": {"temporal"}, "most_frequent_values": {"stats", "top"},
         "least_frequent_values": {"stats", "least"}}
FRAME_OF = {**dict.fromkeys(["ordinal", "data_type"], "catalog"), **dict.fromkeys(["unique_count", "unique_percentage", "duplicate_count"], "stats"),
            **dict.fromkeys(["min_length", "max_length", "avg_length", "format_consistency"], "lengths"),
            **dict.fromkeys(["start_date", "end_date", "range_days", "range_description"], "dates")}


#: numeric statistics that outliers are judged by
OUTLIER_FIELDS = ["mean", "std_pop", "q1", "q3"]


def frames_for(fields) -> set[str]:
    """The metric frames that the wanted profile fields need; presence alone is counted without a shuffle of values."""
    need = {"catalog"}
    for f in fields:
        need |= NEEDS[f] if f in NEEDS else set() if f in PRESENCE else {FRAME_OF.get(f, "numeric")}
    return need if "stats" in need or not PRESENCE & set(fields) else need | {"presence"}


def profile_parts(p: Parts, exact: bool = True, lists: bool = True, fields=None) -> DataFrame:
    """Profile rows from building blocks; with ``fields`` only those, and only the work behind them.

    Distinct values, lengths, patterns and frequent values all read the one shuffle
    of the value counts.  Lengths are taken of every column and dropped for others
    than text at the end: a filter here would be pushed below the shuffle and
    split it in two.
    """
    need = set(ONE + MANY) - {"presence"} - (set() if lists else {"top", "least"}) if fields is None else frames_for(fields)
    # outliers need these; the examples among them only the field that shows them
    parts = None if fields is None else {*fields, *(OUTLIER_FIELDS if "anomaly" in need else ())}
    numeric = nu.numeric_profile(p.numbers, exact, fields=parts) if need & {"numeric", "anomaly"} else None
    examples = 5 if fields is None or "anomalies" in fields else 0
    summed = va.by_length(p.counts)
    length_rows = va.lengths_of(summed)
    build = {
        "catalog": lambda: p.catalog.select(*KEYS, "ordinal", "data_type"),
        "presence": lambda: p.presence,
        "stats": lambda: va.uniqueness_of(summed) if need & {"lengths", "anomaly"} else va.uniqueness(p.counts),
        "numeric": lambda: numeric.drop("non_null_count", "std_pop"),
        "lengths": lambda: va.length_summary(length_rows).select(*KEYS, "min_length", "max_length", "avg_length", "format_consistency"),
        "dates": lambda: te.date_range(p.instants),
        "temporal": lambda: te.temporal_variation(p.instants).where("is_pattern").select(*KEYS, F.col("kind").alias("type"), "description"),
        "pattern": lambda: pa.common_patterns(pa.pattern_sums(p.counts)).select(*KEYS, "pattern", "matches", "percentage", "description"),
        "anomaly": lambda: an.all_anomalies(p.numbers, numeric, length_rows, examples),
        "top": lambda: va.most_frequent(p.counts, p.text_cells),
        "least": lambda: va.least_frequent(p.counts, p.text_cells)}
    frames = {n: make() for n, make in build.items() if n in need}
    got = _gathered(frames)
    is_text = F.col("catalog.data_type") == "string"
    columns = {n: [c for c in frames[n].columns if c not in KEYS] for n in ONE if n in frames}
    out = [F.col(f"{n}.{c}").alias(c) for n in ["catalog", "presence", "stats", "numeric", "dates"] for c in columns.get(n, [])]
    out += [F.when(is_text, F.col(f"lengths.{c}")).alias(c) for c in columns.get("lengths", [])]
    if "temporal" in need:
        out.append(F.col("temporal").alias("temporal_patterns"))
    if "pattern" in need:
        out.append(F.col("pattern").alias("common_patterns"))
    if "anomaly" in need:
        anomalies = F.filter("anomaly", lambda a: is_text | (a["type"] != "length_outliers"))
        out.append(F.when(F.size(anomalies) > 0, anomalies).alias("anomalies"))

    def shared(values):
        return F.transform(values, lambda v: F.struct(
            v["rank"].alias("rank"), v["value"].alias("value"), v["n"].alias("count"),
            percent(v["n"], F.col("stats.non_null_count")).alias("percentage")))
    if "top" in need:
        out.append(shared(F.col("top")).alias("most_frequent_values"))
    if "least" in need:
        out.append(F.slice(shared(F.col("least")), 1, va.least_kept(F.col("stats.unique_count"))).alias("least_frequent_values"))
    rows = got.select(*KEYS, *out)
    # an empty table has no value counts: its columns get zero counts
    zero = {"total_count": F.lit(0), "null_count": F.lit(0), "null_percentage": F.lit(0.0), "non_null_count": F.lit(0),
            "unique_count": F.lit(0), "unique_percentage": F.lit(0.0), "duplicate_count": F.lit(0)}
    rows = rows.withColumns({c: F.coalesce(F.col(c), v) for c, v in zero.items() if c in rows.columns})
    if "anomaly" in need:
        rows = rows.withColumn("anomaly_count", F.aggregate(
            F.transform("anomalies", lambda a: a["count"]), F.lit(0).cast("bigint"), lambda x, y: x + y))
    if "stats" in need:
        pii = F.exists("common_patterns", lambda x: x["pattern"].isin(vocab.PII_PATTERNS)) if "pattern" in need else F.lit(False)
        rows = pa.classified(rows, pii)
    if {"stats", "lengths", "anomaly"} <= need:
        rows = qu.profile_score(rows)
    return rows if fields is None else rows.select(*KEYS, *fields)


#: profile fields behind each table field
TABLE_NEEDS = {
    "total_rows": ["total_count"], "total_columns": [], "completeness_score": ["null_percentage"],
    "consistency_score": ["format_consistency"], "overall_quality_score": ["quality_score"],
    "potential_keys": ["ordinal", "potential_key", "unique_percentage"], "potential_foreign_keys": ["ordinal", "unique_percentage"],
    "recommended_partitioning": ["ordinal", "total_count", "data_classification"],
    "recommended_indexing": ["ordinal", "potential_key", "unique_percentage"], "table_level_issues": ["ordinal", "quality_score"]}


def table_metrics(p: Parts, fields: list[str], exact: bool = True) -> DataFrame:
    """Chosen fields of :func:`table_profile`, with only the column statistics that they need."""
    return table_fields(profile_parts(p, exact, False, column_fields(fields)), fields)


def column_fields(fields: list[str]) -> list[str]:
    """The profile fields behind table fields."""
    return sorted({c for f in fields for c in TABLE_NEEDS[f]})


def table_fields(profile: DataFrame, fields: list[str]) -> DataFrame:
    """Chosen fields of :func:`table_profile` from a profile that has the :func:`column_fields` behind them."""
    every = {c for needs in TABLE_NEEDS.values() for c in needs}
    kinds = {"total_count": "bigint", "ordinal": "int", "potential_key": "boolean", "data_classification": "string"}
    # fields that nobody asked for are NULL and leave the plan with the columns built on them
    padded = profile.select("*", *[F.lit(None).cast(kinds.get(c, "double")).alias(c) for c in sorted(every - set(profile.columns))])
    return table_profile(padded).select("table_name", *fields)


def table_profile(profile: DataFrame) -> DataFrame:
    """One row per table from its column profiles."""
    p = profile
    is_key = F.col("potential_key") & (F.col("unique_percentage") > 95)
    is_fk = F.lower("column_name").endswith("_id") & (F.col("unique_percentage") <= 95)
    temporal = F.col("data_classification") == "temporal"
    return (p.groupBy("table_name").agg(
        F.max("total_count").alias("total_rows"),
        F.count(F.lit(1)).alias("total_columns"),
        F.avg(1 - F.col("null_percentage") / 100).alias("completeness_score"),
        F.coalesce(F.avg("format_consistency"), F.lit(0.8)).alias("consistency_score"),
        F.avg("quality_score").alias("overall_quality_score"),
        ordered_names(is_key).alias("potential_keys"),
        ordered_names(is_fk).alias("potential_foreign_keys"),
        ordered_names(temporal).alias("temporal_columns"),
        ordered_names(F.col("quality_score") < 0.7).alias("low_quality_columns"))
        .withColumn("recommended_partitioning",
                    F.when(F.col("total_rows") > 1_000_000, F.col("temporal_columns")).otherwise(""))
        .withColumn("recommended_indexing",
                    F.concat_ws(", ", F.nullif("potential_keys", F.lit("")), F.nullif("potential_foreign_keys", F.lit(""))))
        .withColumn("table_level_issues", F.when(
            F.col("low_quality_columns") != "",
            F.concat(F.lit("Low quality columns requiring attention: "), F.col("low_quality_columns"))))
        .drop("temporal_columns", "low_quality_columns"))


def profile_record(profile: DataFrame) -> DataFrame:
    """Profile rows as nested records: numeric fields only where a mean exists, text
    fields only where a mean length exists; NULL fields are left out of the JSON."""
    numeric = F.when(F.col("mean").isNotNull(), F.struct("min_value", "max_value", "mean", "median", "std_dev"))
    text = F.when(F.col("avg_length").isNotNull(), F.struct("min_length", "max_length", "avg_length"))
    base = ["column_name", "data_type", "total_count", "null_count", "null_percentage", "unique_count",
            "unique_percentage", "quality_score", "potential_pii", "potential_key", "data_classification",
            "most_frequent_values", "common_patterns", "anomalies"]
    return profile.withColumn("median", F.col("q2")).select(
        *KEYS, F.to_json(F.struct(*base, numeric.alias("numeric"), text.alias("text"))).alias("record"))

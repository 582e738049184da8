"""History tables: type-2 dimensions, state changes, extracted dimensions.

A window per key would let one task sort the whole history of a hot key.  Here all
rows are range-partitioned by key and time and written once, with the number of
their range as slice: a history that is longer than a range spreads over several,
however short the time it covers.  Windows run per (key, slice), and only one edge
row per key and slice meets per key.

Rows with a NULL key form one history of their own.  A NULL time comes before every
known time of its key.  Rows equal in key and all order columns follow each other
by state, NULL first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakegauge.functions.exprs import quoted
from lakegauge.sources.work import written


def _sliced(df: DataFrame, key: str, order: list[str], attribute: str, slices: int | None) -> DataFrame:
    """(_key, _at0.., _state, _slice) of every row, read back from the scratch folder, since
    a range partitioning planned twice need not cut twice at the same rows."""
    spark = df.sparkSession
    narrow = df.select(quoted(key).alias("_key"), *[quoted(o).alias(f"_at{i}") for i, o in enumerate(order)],
                       quoted(attribute).alias("_state"))
    parts = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = narrow.repartitionByRange(parts, *narrow.columns).withColumn("_slice", F.spark_partition_id())
    return written(ranged, "history")


def _order(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c.startswith("_at")] + ["_state"]


def _by_slice(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Every row with the edge row of its key and slice (NULL keys meet each other)."""
    e = edges.withColumnsRenamed({"_key": "_edge_key", "_slice": "_edge_slice"})
    return (rows.join(e, rows["_key"].eqNullSafe(e["_edge_key"]) & (rows["_slice"] == e["_edge_slice"]))
            .drop("_edge_key", "_edge_slice"))


def _neighbour(rows: DataFrame, value: Column, name: str, ahead: bool = False) -> DataFrame:
    """Add ``name``: a struct with the value of the previous (or next) row of the key,
    NULL at the end of the history."""
    boxed, order = F.struct(value.alias("v")), _order(rows)
    inside = Window.partitionBy("_key", "_slice").orderBy(*order)
    across = Window.partitionBy("_key").orderBy("_slice")
    shift = F.lead if ahead else F.lag
    pick = F.min_by if ahead else F.max_by
    edges = (rows.groupBy("_key", "_slice").agg(pick(boxed, F.struct(*order)).alias("_edge"))
             .select("_key", "_slice", shift("_edge").over(across).alias("_across")))
    return (_by_slice(rows.withColumn("_near", shift(boxed).over(inside)), edges)
            .withColumn(name, F.coalesce("_near", "_across")).drop("_near", "_across"))


def _changed(df: DataFrame, key: str, order: list[str], attribute: str, slices: int | None) -> DataFrame:
    """Rows whose state differs from the previous one of their key (the first row of a key
    counts as a change), with ``_previous`` boxed."""
    near = _neighbour(_sliced(df, key, order, attribute, slices), F.col("_state"), "_previous")
    return near.where(F.col("_previous").isNull() | ~F.col("_previous.v").eqNullSafe(F.col("_state")))


def type2_dimension(df: DataFrame, key: str, order: list[str], attribute: str,
                    slices: int | None = None) -> DataFrame:
    """One row per key and run of equal states: effective and expiry time, version
    and current flag.  ``slices`` is the number of ranges, by default that of shuffles."""
    kept = _neighbour(_changed(df, key, order, attribute, slices), F.col("_at0"), "_next", ahead=True)
    earlier = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = (kept.groupBy("_key", "_slice").agg(F.count(F.lit(1)).alias("_n"))
              .select("_key", "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    inside = F.row_number().over(Window.partitionBy("_key", "_slice").orderBy(*_order(kept)))
    return _by_slice(kept.withColumn("_i", inside), before).select(
        F.col("_key").alias(key), F.col("_state").alias("state"), F.col("_at0").alias("effective_at"),
        F.col("_next.v").alias("expires_at"), (F.col("_before") + F.col("_i")).alias("version"),
        F.col("_next").isNull().alias("is_current"))


def state_changes(df: DataFrame, key: str, order: list[str], attribute: str,
                  slices: int | None = None) -> DataFrame:
    """One row per state change: from, to, when, and whole days in the earlier state
    (NULL where either time is)."""
    return (_neighbour(_changed(df, key, order, attribute, slices), F.col("_at0"), "_since")
            .where(F.col("_since").isNotNull())
            .select(F.col("_key").alias(key), F.col("_previous.v").alias("previous_state"),
                    F.col("_state").alias("state"), F.col("_at0").alias("changed_at"),
                    F.timestamp_diff("DAY", F.col("_since.v"), F.col("_at0")).alias("duration_days")))


def extract_dimension(df: DataFrame, key: str, order: list[str], attributes: list[str]) -> DataFrame:
    """One row per natural key: first and latest values of the attributes, row count,
    and a surrogate key hashed from the natural key (no global numbering needed)."""
    at = F.struct(*[quoted(o) for o in order])
    return df.groupBy(quoted(key).alias(key)).agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.min(quoted(order[0])).alias("first_seen"), F.max(quoted(order[0])).alias("last_seen"),
        *[F.max_by(quoted(a), at).alias(f"latest_{a}") for a in attributes],
        *[F.min_by(quoted(a), at).alias(f"first_{a}") for a in attributes]
    ).withColumn("surrogate_key", F.xxhash64(key))

"""Numeric column statistics and exact quantiles at any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row, Window, functions as F, types as T

from lakegauge.functions.exprs import KEYS, clean, fields_of, is_numeric, quoted

QUARTILES = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
PERCENTILES = {"p1": 0.01, "p5": 0.05, "p95": 0.95, "p99": 0.99}

BINS = 128  # equal parts of a span of values
SMALL = 10_000  # rows of a span whose values are ranked one by one
CUTS = 1_000  # accuracy of the sketch that makes the first cuts


def numbers(df: DataFrame, table: str, columns=None) -> DataFrame:
    """(table_name, column_name, v): every present numeric cell as a double."""
    fields = fields_of(df, columns, is_numeric)
    if not fields:
        return (df.select(F.lit(table).alias("table_name"), F.lit("").alias("column_name"),
                          F.lit(None).cast("double").alias("v")).where(F.lit(False)))
    wide = df.select(*[clean(f).cast("double").alias(f.name) for f in fields])
    return (wide.unpivot([], [quoted(f.name) for f in fields], "column_name", "v")
            .where(F.col("v").isNotNull())
            .select(F.lit(table).alias("table_name"), "column_name", "v"))


_MOMENTS = {
    "non_null_count": F.count, "min_value": F.min, "max_value": F.max, "mean": F.avg, "std_dev": F.stddev_samp,
    "variance": F.var_samp, "std_pop": F.stddev_pop, "skewness": F.skewness, "kurtosis": F.kurtosis}


def moments(number_rows: DataFrame) -> DataFrame:
    """Count, range, mean, spread, skewness and excess kurtosis per column.

    One grouped aggregate with as many groups as numeric columns: every task
    sends one row per column to the shuffle.
    """
    return number_rows.groupBy(*KEYS).agg(*[f("v").alias(name) for name, f in _MOMENTS.items()])


def _edges(ps: list[float], accuracy: int) -> list[float]:
    margin = 8.0 / accuracy  # the sketch's own rank error is 1 / accuracy
    return [e for p in ps for e in (max(0.0, p - margin), min(1.0, p + margin))]


def quantiles(number_rows: DataFrame, probs: dict[str, float], exact: bool = True,
              accuracy: int = 10_000, with_size: bool = False) -> DataFrame:
    """Linear-interpolation quantiles per column, one output column per entry of ``probs``.

    The exact way counts, it never sorts or gathers a column:

    1. A sketch cuts the range of a column into spans, narrow ones around the wanted ranks.
    2. Every row is counted in one of ``BINS`` equal parts of its span.  Running totals over these bins, whose number is
       fixed, say which bin holds each wanted rank, and between which values.
    3. Bins with more than ``SMALL`` rows and more than one value are the spans of the next round, which counts only their
       rows; the values of the others are ranked one by one.

    A round is one scan and one aggregation; only the bins that hold a wanted rank come to the driver, at most two a
    quantile and column.  The cuts decide how narrow the first bins are: a poor sketch costs a round, never the result.
    ``exact=False`` returns the sketch's answer; ``with_size`` adds ``non_null_count`` to the exact one.
    """
    if not exact:
        names, ps = list(probs), list(probs.values())
        got = number_rows.groupBy(*KEYS).agg(F.percentile_approx("v", ps, accuracy).alias("q"))
        return got.select(*KEYS, *[F.col("q")[i].alias(n) for i, n in enumerate(names)])
    return _with_quantiles(number_rows, ["non_null_count"], probs, accuracy).select(*KEYS, *probs, *(["non_null_count"] if with_size else []))


_SPANS = "table_name string, column_name string, id int, lows array<double>, highs array<double>, befores array<bigint>, ranks array<array<bigint>>"


def _counted(number_rows: DataFrame, spans: dict[tuple, list[tuple]], bins: int | None, whole: bool) -> list:
    """Bins (or single values, without ``bins``) of the spans that hold a wanted rank, with their value range and rows.

    ``spans``: (low, high, rows before, wanted ranks) per column.  With ``whole`` they follow each other over the whole
    column, and the rows before a span are those of the earlier ones.
    """
    keys = list(spans)
    rows = [(*k, i, *map(list, zip(*sorted(spans[k], key=lambda x: x[:2])))) for i, k in enumerate(keys)]
    known = number_rows.sparkSession.createDataFrame(rows, _SPANS)  # one row per column
    v, inf, parts = F.col("v"), float("inf"), bins or 1
    one = number_rows.join(F.broadcast(known.select(*KEYS, "id", "lows", "highs")), KEYS).select("id", "v", "lows", "highs", F.lit(0).alias("span"))
    # the last span that begins at or below the value, by halving
    for i in reversed(range(max(map(len, spans.values())).bit_length())):
        ahead = F.col("span") + (1 << i)
        one = one.select("id", "v", "lows", "highs", F.when(v >= F.get("lows", ahead), ahead).otherwise(F.col("span")).alias("span"))
    two = one.select("id", "v", "span", F.get("lows", "span").alias("low"), F.get("highs", "span").alias("high"))
    low, high = F.col("low"), F.col("high")
    # halves, so that no difference of finite numbers overflows; infinities have bins of their own
    even = (high > low) & (F.abs(low) < inf) & (F.abs(high) < inf)
    place = F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * parts)
    code = F.when(v == -inf, -1).when(v == inf, parts).when(even, F.least(place, F.lit(parts - 1))).otherwise(0)
    # rows outside the spans share groups without a code, which count 0; a filter here would be pushed below the
    # grouping and the join, and repeat the search for the span in every condition
    three = two.select("id", "v", "span", F.when(v.between(low, high), code.cast("int") if bins else v).alias("code"))
    counted = three.groupBy("id", "span", "code").agg(
        F.count("code").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    # bounded: a fixed number of bins a span, or the values of a small one
    order = Window.partitionBy("id", *([] if whole else ["span"])).orderBy("span", "code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("upto") - F.col("n") + (0 if whole else F.get("befores", "span"))
    hits = F.filter(F.flatten("ranks") if whole else F.get("ranks", "span"),
                    lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
    found = (counted.withColumn("upto", F.sum("n").over(order)).join(F.broadcast(known.select("id", "befores", "ranks")), "id")
             .withColumn("before", before).select("id", "low", "high", "n", "before", hits.alias("ranks")).where(F.size("ranks") > 0))
    return [(keys[r["id"]], r) for r in found.collect()]


def _ranked_values(number_rows: DataFrame, columns: dict[tuple, tuple]) -> dict[tuple, dict[int, float]]:
    """The values at the wanted ranks (from 0) of every column, in rounds.  ``columns``: (ascending cuts, ranks) per column."""
    found: dict[tuple, dict[int, float]] = {k: {} for k in columns}
    spans = {k: [(a, b, 0, ranks if i == 0 else []) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))] for k, (cuts, ranks) in columns.items()}
    whole = True
    while spans:
        large, small = {}, {}
        for key, r in _counted(number_rows, spans, BINS, whole):
            span = (r["low"], r["high"], r["before"], list(r["ranks"]))
            if r["low"] == r["high"]:
                found[key].update(dict.fromkeys(r["ranks"], r["low"]))
            else:
                (small if r["n"] <= SMALL else large).setdefault(key, []).append(span)
        if small:
            for key, r in _counted(number_rows, small, None, False):
                found[key].update(dict.fromkeys(r["ranks"], r["low"]))
        spans, whole = large, False
    return found


def _with_quantiles(number_rows: DataFrame, stats: DataFrame | list[str], probs: dict[str, float], accuracy: int) -> DataFrame:
    """``stats`` and exact quantiles, as a frame of known rows.  ``stats`` has one row per column, or names the moments, with
    ``non_null_count``, that are taken in the scan for the cuts."""
    ps, sharp = list(probs.values()), min(accuracy, CUTS)
    taken = stats if isinstance(stats, list) else []
    first = number_rows.groupBy(*KEYS).agg(
        *[_MOMENTS[m]("v").alias(m) for m in taken], F.percentile_approx("v", _edges(ps, sharp), sharp).alias("edge"),
        F.min("v").alias("low"), F.max("v").alias("high"))
    got = first.collect()  # one row per column
    cuts = {(r["table_name"], r["column_name"]): sorted([r["low"], *r["edge"], r["high"]]) for r in got}
    if taken:
        stats = first.select(*KEYS, *taken)
        rows = [Row(**{c: r[c] for c in [*KEYS, *taken]}) for r in got]
    else:
        rows = stats.collect()
    at = lambda r: [p * (r["non_null_count"] - 1) for p in ps]
    wanted = {k: (cuts[k], sorted({f(p) for p in at(r) for f in (math.floor, math.ceil)}))
              for r in rows if (k := (r["table_name"], r["column_name"])) in cuts}
    found, out = _ranked_values(number_rows, wanted), []
    for r in rows:
        values, answers = found[(r["table_name"], r["column_name"])], []
        for p in at(r):
            a, b = values[math.floor(p)], values[math.ceil(p)]
            answers.append(a if a == b else a + (b - a) * (p - math.floor(p)))
        out.append((*r, *answers))
    schema = T.StructType([*stats.schema.fields, *[T.StructField(n, T.DoubleType()) for n in probs]])
    return number_rows.sparkSession.createDataFrame(out, schema)


def numeric_profile(number_rows: DataFrame, exact: bool = True, accuracy: int = 10_000, fields=None) -> DataFrame:
    """Moments and all seven quantiles per column; when exact, moments are one scan of compiled code, cuts another one,
    and the rounds of :func:`quantiles` follow.

    With ``fields`` only ``non_null_count``, those moments and those quantiles, the moments in the scan for the cuts."""
    probs = {n: p for n, p in {**QUARTILES, **PERCENTILES}.items() if fields is None or n in fields}
    names = [m for m in _MOMENTS if fields is None or m in fields or m == "non_null_count"]
    if exact and probs:
        return _with_quantiles(number_rows, moments(number_rows) if fields is None else names, probs, accuracy)
    first = number_rows.groupBy(*KEYS).agg(
        *[_MOMENTS[m]("v").alias(m) for m in names],
        *([F.percentile_approx("v", list(probs.values()), accuracy).alias("edge")] if probs else []))
    return first.select("*", *[F.col("edge")[i].alias(n) for i, n in enumerate(probs)]).drop("edge")

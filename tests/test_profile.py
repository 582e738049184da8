import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakegauge.operators import anomalies as an, catalog as ca, numeric as nu, patterns as pa, quality as qu, temporal as te, values as va
from lakegauge.plans import lake as lk, profile as pr


def one(df, column="column_name"):
    return {r[column]: r.asDict() for r in df.collect()}


def numbers(spark, values, name="x"):
    return spark.createDataFrame([("t", name, float(v)) for v in values], "table_name string, column_name string, v double")


@pytest.mark.parametrize("values", [
    list(range(1, 1001)), [1.5] * 500, [0.0] * 400 + [random.Random(1).gauss(0, 1) for _ in range(700)],
    [random.Random(2).lognormvariate(0, 3) for _ in range(3000)], [-1e9] + [i / 100 for i in range(2000)], [7.0], [1.0, 2.0]])
def test_quantiles_are_exact_with_narrow_enclosures(spark, values):
    probs = {**nu.QUARTILES, **nu.PERCENTILES}
    got = nu.quantiles(numbers(spark, values), probs, accuracy=200).collect()[0]
    for name, p in probs.items():
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


def test_quantiles_need_no_good_cuts(spark, monkeypatch):
    """Values over many magnitudes, repeated and infinite ones, with few rows ranked one by one: several rounds."""
    monkeypatch.setattr(nu, "SMALL", 20)
    rng, inf = random.Random(9), float("inf")
    values = [0.0] * 300 + [rng.lognormvariate(0, 30) for _ in range(1500)] + [-1e308, 1e308, -inf, inf, inf]
    got = nu.quantiles(numbers(spark, values), {**nu.QUARTILES, **nu.PERCENTILES, "p0": 0.0, "p100": 1.0}, accuracy=10).first()
    want = sorted(values)
    for name, p in {**nu.QUARTILES, **nu.PERCENTILES}.items():
        at = p * (len(want) - 1)
        a, b = want[int(at)], want[min(int(at) + 1, len(want) - 1)]
        assert got[name] == pytest.approx(a + (b - a) * (at - int(at)), rel=1e-12)
    assert (got["p0"], got["p100"]) == (-inf, inf)


def test_quantiles_do_not_depend_on_partitioning(spark):
    rng = random.Random(5)
    rows = numbers(spark, [rng.choice([1.0, 1.0, rng.random()]) for _ in range(5000)])
    a = nu.quantiles(rows.repartition(1), nu.QUARTILES, accuracy=300).collect()
    b = nu.quantiles(rows.repartition(16), nu.QUARTILES, accuracy=300).collect()
    assert a == b


def test_nulls_nan_and_negative_zero(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b"), (-0.0, "a"), (0.0, None)], "x double, s string")
    got = one(va.uniqueness(va.value_counts(va.cells(df, "t"))))
    assert (got["x"]["null_count"], got["x"]["unique_count"], got["x"]["duplicate_count"]) == (2, 2, 1)
    assert (got["s"]["null_percentage"], got["s"]["unique_count"]) == (40.0, 2)
    assert nu.moments(nu.numbers(df, "t")).collect()[0]["non_null_count"] == 3


def test_empty_table_and_all_null_column(spark):
    empty = spark.createDataFrame([], "id bigint, s string, ts timestamp_ntz")
    assert pr.column_profile(empty, "t").count() == 3
    nulls = spark.createDataFrame([(None, 1)], "x double, y int")
    got = one(pr.column_profile(nulls, "t"))
    assert got["x"]["null_percentage"] == 100 and got["x"]["mean"] is None and got["x"]["data_classification"] is None
    assert got["y"]["std_dev"] is None and got["y"]["mean"] == 1.0


def test_long_texts_are_identified_by_their_whole_content(spark):
    base = "x" * 5000
    df = spark.createDataFrame([(base + "a",), (base + "b",), (base + "a",), ("short",)], "s string")
    cells = va.cells(df, "t")
    counts = va.value_counts(cells)
    stats = va.uniqueness(counts)
    assert stats.collect()[0]["unique_count"] == 3
    top = va.top_values(counts, stats, cells).orderBy("rank").collect()
    assert top[0]["value"] == base + "a" and top[0]["n"] == 2
    assert {r["value"] for r in top} == {base + "a", base + "b", "short"}
    length = va.length_summary(va.length_counts(counts)).collect()[0]
    assert (length["max_length"], length["min_length"], length["distinct_lengths"]) == (5001, 5, 2)


def test_long_texts_are_ranked_by_their_whole_text(spark):
    """Ties with equal first characters, repeated long texts and short ones between them, against a plain sort."""
    rng = random.Random(4)
    base = "p" * 64
    texts = [base + f"{rng.random()}" for _ in range(60)] + [base, base + "0" * 200, "q" * 70, "a"] + [base + "twice"] * 2 + ["b" * 90] * 2
    df = spark.createDataFrame([(t,) for t in texts], "s string").repartition(5)
    cells = va.cells(df, "t")
    counts, n = va.value_counts(cells), {t: texts.count(t) for t in set(texts)}
    down = sorted(n, key=lambda t: (-n[t], t))
    assert [r["value"] for r in va.most_frequent(counts, cells).orderBy("rank").collect()] == down[:10]
    assert [r["value"] for r in va.least_frequent(counts, cells).orderBy("rank").collect()] == down[::-1][:10]


def test_least_values_take_five_or_ten(spark):
    few = spark.createDataFrame([(v,) for v in "aaabbcdefg"], "s string")
    many = spark.createDataFrame([(f"v{i:02d}",) for i in range(25)], "s string")
    for df, n in [(few, 5), (many, 10)]:
        counts = va.value_counts(va.cells(df, "t"))
        assert va.least_values(counts, va.uniqueness(counts)).count() == n


def test_metrics_on_demand_equal_the_whole_profile(spark):
    rows = [(i, None if i % 3 else "x" * (i % 7), float(i % 11) if i % 5 else None, f"u{i}@b.co") for i in range(60)] + [(61, "y" * 40, 1e6, None)]
    df = spark.createDataFrame(rows, "a_id bigint, s string, x double, contact string")
    parts = pr.parts_of(df, "t")
    whole = one(pr.profile_parts(parts))
    for fields in (["null_percentage"], ["format_consistency", "null_count"], ["quality_score"], ["q2", "mean"], ["potential_pii"],
                   ["most_frequent_values", "unique_count"], ["common_patterns", "anomaly_count", "ordinal"]):
        got = one(pr.profile_parts(parts, fields=fields))
        assert {c: {f: r[f] for f in fields} for c, r in got.items()} == {c: {f: whole[c][f] for f in fields} for c in got} and len(got) == 4
    table = pr.table_profile(pr.profile_parts(parts)).first().asDict()
    for f in pr.TABLE_NEEDS:
        assert pr.table_metrics(parts, [f]).first()[f] == table[f], f
    assert pr.frames_for(["null_percentage"]) == {"catalog", "presence"}
    plan = pr.table_metrics(parts, ["completeness_score"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "md5" not in plan  # one aggregate a table, no cells and no quantiles
    assert pr.profile_parts(pr.parts_of(df.limit(0), "t"), fields=["null_percentage"]).count() == 4


def test_table_queries_profile_once_and_only_what_they_show(spark, monkeypatch):
    from workload import quality
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 2))], "s string, day timestamp_ntz")
    monkeypatch.setattr(quality, "parts", lambda s, d: pr.parts_of(df, "t"))
    plan = lambda q: quality.QUERIES[q](spark, "")._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan("e13_quality_rollup")  # reads the profile of its columns, written once
    for q in ("b16_table_profile", "e9_profile_column_score"):
        assert "hour(" not in plan(q) and "md5" in plan(q)  # values are counted, calendar patterns are not asked for


def test_outliers_without_examples_are_only_counted(spark):
    values = numbers(spark, [1.0] * 50 + [2.0] * 50 + [99.0, -99.0, 99.0])
    lengths = spark.createDataFrame([("t", "x", n, 30) for n in (3, 4)] + [("t", "x", 90, 1)], "table_name string, column_name string, length int, n bigint")
    profile = nu.numeric_profile(values, fields=pr.OUTLIER_FIELDS)
    assert profile.columns == ["table_name", "column_name", "non_null_count", "mean", "std_pop", "q1", "q3"]
    whole = nu.numeric_profile(values).select(profile.columns)
    assert profile.collect() == whole.collect()
    shown, counted = an.all_anomalies(values, whole, lengths), an.all_anomalies(values, profile, lengths, examples=0)
    same = lambda df: sorted(df.drop("examples").collect())
    assert same(shown) == same(counted) and len(same(counted)) == 3
    assert "Window" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_lengths_and_distinct_values_share_one_sum(spark):
    df = spark.createDataFrame([(1, "a"), (1, "bb"), (2, None), (None, "bb"), (3, "z" * 70), (3, "z" * 70)], "k int, s string")
    counts = va.table_counts({"t": df})
    summed = va.by_length(counts)
    assert {(r["column_name"], r["length"]): (r["n"], r["distinct"]) for r in summed.collect()} == {
        ("k", 1): (5, 3), ("k", -1): (1, 0), ("s", 1): (1, 1), ("s", 2): (2, 1), ("s", 70): (2, 1), ("s", -1): (1, 0)}
    both = [va.uniqueness_of(summed).select("column_name", (F.col("null_count") + F.col("unique_count")).alias("x")), va.lengths_of(summed).select("column_name", F.col("n").alias("x"))]
    together = both[0].union(both[1])
    together.collect()
    plan = together._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("Initial Plan")[0]
    assert sorted(va.uniqueness(counts).collect()) == sorted(va.uniqueness_of(summed).collect())


def test_patterns_and_flags(spark):
    rows = [("a@b.co", "555-123-4567", "2024-01-02", "12", "https://x.y/z", i) for i in range(6)] + [("x", "y", "n", "z", "w", 9)] * 4
    df = spark.createDataFrame(rows, "contact string, p string, d string, n string, u string, v int")
    counts = va.value_counts(va.cells(df, "t"))
    found = pa.common_patterns(pa.pattern_sums(counts))
    got = {(r["column_name"], r["pattern"]): r["matches"] for r in found.collect()}
    assert got[("contact", "email")] == 6 and got[("p", "phone")] == 6 and got[("u", "url")] == 6
    assert got[("d", "date_format")] == 6  # 60 % is more than half
    assert ("n", "numeric_string") not in got and got[("v", "numeric_string")] == 10  # 60 % is not more than 80 %
    flags = one(pa.business_flags(va.uniqueness(counts), found))
    assert flags["contact"]["potential_pii"] and flags["contact"]["data_classification"] == "sensitive"
    assert flags["d"]["data_classification"] == "general"


def test_exactly_half_is_not_a_date_format(spark):
    df = spark.createDataFrame([("2024-01-02",), ("x",)], "d string")
    assert pa.common_patterns(pa.pattern_sums(va.value_counts(va.cells(df, "t")))).count() == 0


def test_zscore_of_exactly_three_is_no_outlier(spark):
    values = [0.0] * 9 + [10.0]  # mean 1, population deviation 3, z of 10 is exactly 3
    assert an.zscore_outliers(numbers(spark, values)).count() == 0
    row = an.zscore_outliers(numbers(spark, values + [0.0])).collect()[0]
    assert row["count"] == 1 and row["examples"] == [10.0]
    assert an.zscore_outliers(numbers(spark, [1.5] * 10)).count() == 0


def test_iqr_outliers_against_numpy(spark):
    rng = random.Random(3)
    values = [rng.gauss(0, 1) for _ in range(500)] + [9, -9, 12]
    q1, q3 = np.quantile(values, [0.25, 0.75])
    want = sum(v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1) for v in values)
    got = an.iqr_outliers(numbers(spark, values)).collect()[0]
    assert got["count"] == want and got["examples"][0] == 12


def test_temporal_variation(spark):
    df = spark.sql("""select timestamp_ntz '2024-01-01 09:00:00' as ts from range(10) union all
                      select timestamp_ntz '2024-01-02 10:00:00' from range(1)""")
    got = {r["kind"]: r for r in te.temporal_variation(te.instants(df, "t")).collect()}
    assert got["day_of_week"]["is_pattern"] and got["day_of_week"]["data"] == {0: 10, 1: 1}
    assert got["hour_of_day"]["is_pattern"] and not got["monthly"]["is_pattern"]


@pytest.mark.parametrize("days,label", [(0, "0 days"), (6, "6 days"), (7, "1 weeks"), (29, "4 weeks"), (30, "1 months"),
                                        (364, "12 months"), (365, "1 years"), (800, "2 years")])
def test_range_labels(spark, days, label):
    assert spark.range(1).select(te.range_label(F.lit(days))).first()[0] == label


def test_text_quality_thresholds(spark):
    def issues(values):
        df = spark.createDataFrame([(v,) for v in values], "s string")
        return {r["issue"] for r in qu.text_quality_issues(qu.text_quality(df, "t")).collect()}
    assert issues([None, "x"]) == set()  # exactly 50 %
    assert issues([None, None, "x"]) == {"high_null_percentage"}
    assert issues(["  ", "a", "b", "c", "d"]) == set()  # exactly 20 %
    assert issues(["  ", "a", "b", "c"]) == {"empty_data"}
    assert issues(["N/A "] + ["a"] * 9) == set()  # exactly 10 %
    assert issues(["N/A "] + ["a"] * 8) == {"meaningless_data"}


def test_profile_score_boundaries(spark):
    cases = [(50.0, False, 100.0, None, 0, 0.9), (50.1, False, 100.0, None, 0, 0.7), (20.0, False, 1.0, None, 0, 1.0),
             (0.0, True, 95.0, None, 0, 1.0), (0.0, True, 94.9, None, 0, 0.8), (0.0, False, 1.0, 0.8, 10, 0.9),
             (0.0, False, 1.0, 0.79, 11, 0.7), (0.0, False, 1.0, None, 5, 1.0)]
    df = spark.createDataFrame(
        [(i, *c[:4], c[4], 100) for i, c in enumerate(cases)],
        "i int, null_percentage double, potential_key boolean, unique_percentage double, format_consistency double, anomaly_count long, total_count long")
    got = {r["i"]: r["quality_score"] for r in qu.profile_score(df).collect()}
    for i, c in enumerate(cases):
        assert got[i] == pytest.approx(c[5]), c


def test_profile_is_the_same_for_shuffled_rows_and_doubles_with_a_doubled_table(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("abc"), rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, s string, x double")
    shuffled = spark.createDataFrame(rng.sample(rows, len(rows)), df.schema).repartition(7)
    cols = ["column_name", "unique_count", "null_percentage", "q2", "anomaly_count", "quality_score"]
    base = sorted(pr.column_profile(df, "t").select(*cols).collect())
    assert base == sorted(pr.column_profile(shuffled, "t").select(*cols).collect())
    double = one(pr.column_profile(df.unionAll(df), "t"))
    assert double["s"]["total_count"] == 600 and double["x"]["null_percentage"] == 0
    assert double["x"]["duplicate_count"] == 300


def test_failing_table_becomes_an_error_row(spark, tmp_path):
    got = lk.profile_all({"good": lambda: spark.range(3).toDF("id"), "bad": lambda: spark.read.parquet(str(tmp_path / "none"))})
    assert {(r["table_name"], r["failed"]) for r in got.collect()} == {("good", False), ("bad", True)}


def test_a_table_that_fails_while_running_leaves_the_others(spark, tmp_path):
    good, corrupt = str(tmp_path / "good"), tmp_path / "corrupt"
    spark.range(50).write.parquet(good)
    corrupt.mkdir()
    for part in os.listdir(good):
        if part.endswith(".parquet"):
            data = open(os.path.join(good, part), "rb").read()
            (corrupt / part).write_bytes(data[:4] + b"\0" * (len(data) - 12) + data[-8:])
    schema = spark.read.parquet(good).schema
    got = lk.profile_each(spark, {
        "good": lambda: spark.read.parquet(good), "empty": lambda: spark.read.parquet(good).limit(0),
        "corrupt": lambda: spark.read.schema(schema).parquet(str(corrupt)),
        "missing": lambda: spark.read.parquet(str(tmp_path / "none")),
        "raises": lambda: spark.range(9).selectExpr("if(id = 8, raise_error('x'), id) as id")}, workers=2)
    rows = {r["table_name"]: r for r in got.collect()}
    assert {n for n, r in rows.items() if r["failed"]} == {"corrupt", "missing", "raises"}
    assert all(rows[n]["error"] for n in ("corrupt", "missing", "raises"))
    assert rows["good"]["total_count"] == 50 and rows["good"]["mean"] == 24.5
    only = lk.profile_each(spark, {"missing": lambda: spark.read.parquet(str(tmp_path / "none"))})
    assert [r["failed"] for r in only.collect()] == [True]


def test_file_statistics_equal_the_file_system(spark, tmp_path):
    flat, parts, empty = str(tmp_path / "flat"), str(tmp_path / "parts"), str(tmp_path / "empty")
    spark.range(1000).repartition(3).write.parquet(flat)
    spark.range(1000).selectExpr("id", "id % 7 as d").write.partitionBy("d").parquet(parts)
    spark.range(0).write.parquet(empty)
    got = {r["table_name"]: r for r in ca.file_stats(spark, {"flat": flat, "parts": parts, "empty": empty}).collect()}
    for name, rows, columns in (("flat", 1000, 1), ("parts", 1000, 2), ("empty", 0, 1)):
        files = [os.path.join(top, f) for top, _, fs in os.walk(tmp_path / name) for f in fs if f.endswith(".parquet")]
        row = got[name]
        assert (row["row_count"], row["column_count"], row["file_count"]) == (rows, columns, len(files))
        assert row["size_bytes"] == sum(os.path.getsize(f) for f in files)
        newest = dt.datetime.fromtimestamp(max(os.path.getmtime(f) for f in files))
        assert abs((row["last_modified"] - newest).total_seconds()) < 1
        assert row["location"] == str(tmp_path / name)
    plan = ca.file_stats(spark, {"flat": flat})._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and plan.count("ReadSchema: struct<>") == 1
    assert ca.database_summary(ca.file_stats(spark, {"flat": flat, "empty": empty})).first()["total_rows"] == 1000


def test_catalog_statistics_are_used_where_a_table_has_them(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS stats_db LOCATION '" + str(tmp_path / "db") + "'")
    try:
        for name in ("analysed", "plain", "other"):
            spark.range(30).write.option("path", str(tmp_path / name)).saveAsTable(f"stats_db.{name}")
        spark.sql("CREATE VIEW stats_db.seen AS SELECT 1 AS one")
        spark.sql("ANALYZE TABLE stats_db.analysed COMPUTE STATISTICS")
        got = {r["table_name"]: r for r in ca.registered_stats(spark, "stats_db", "analysed,p*,seen").collect()}
        assert set(got) == {"analysed", "plain"}
        assert [(got[n]["row_count"], got[n]["counted"]) for n in ("analysed", "plain")] == [(30, False), (30, True)]
        assert got["analysed"]["size_bytes"] > 0 and got["analysed"]["location"].endswith("/analysed")
    finally:
        spark.sql("DROP DATABASE stats_db CASCADE")


def test_typed_counts_equal_text_counts(spark):
    df = spark.sql("""select * from values (1, 1.5D, float(0.1), date'2024-01-01', timestamp'2024-01-01 00:00:00.25', 1.50BD, 'a', true),
        (1, double('nan'), float('-0.0'), date'2024-01-01', timestamp'2024-01-01 00:00:00.25', 1.50BD, 'a', true),
        (-7, -0.0D, float('0.0'), null, null, 2.00BD, repeat('x', 70), null), (null, 0.0D, null, null, null, null, null, false)
        as t(i, d, f, day, ts, m, s, b)""")
    names = ["table_name", "column_name", "value", "digest", "head", "long_length", "long_bits", "n", "held"]
    got, want = va.table_counts({"t": df}), va.value_counts(va.cells(df, "t"))
    assert sorted(map(str, got.select(names).collect())) == sorted(map(str, want.select(names).collect()))
    assert {k: t for k, t in got.dtypes} == {k: t for k, t in want.dtypes}
    some = va.table_counts({"t": df, "u": df}, {"t": ["i"], "u": ["s"]})
    assert {(r[0], r[1]) for r in some.select("table_name", "column_name").distinct().collect()} == {("t", "i"), ("u", "s")}
    assert va.table_counts({"t": df.limit(0)}).count() == 0


def test_statistics_share_one_shuffle_of_native_values(spark):
    counts = va.table_counts({"t": spark.range(100).select("id", (F.col("id") / 3).alias("d"))})
    both = va.uniqueness(counts).select("column_name", "unique_count").unionByName(
        va.length_summary(va.length_counts(counts)).select("column_name", F.col("distinct_lengths").alias("unique_count")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    made = [line for line in plan.splitlines() if "- Exchange hashpartitioning(" in line and "table_name" not in line]
    assert len(made) == 2 and all(", v#" in line for line in made)  # one for the whole numbers, one for the doubles

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from lakegauge.operators import (business as bu, catalog as ca, classify as cl, history as hi, partitions as pt, recommend as rc,
                                 relate as re, series as se)
from lakegauge.sources import readers as rd, sinks as sk


def catalog(spark, tables):
    rows = [("db", t, c, i + 1, k, True, None, n) for t, (n, cols) in tables.items() for i, (c, k) in enumerate(cols)]
    schema = "database string, table_name string, column_name string, ordinal int, data_type string, nullable boolean, comment string, row_count bigint"
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("type_bucket", ca.type_bucket(F.col("data_type")))


SHOP = {"customers": (100_000, [("customer_id", "bigint"), ("customer_name", "string"), ("email", "string"), ("created_date", "date")]),
        "orders": (1_000_000, [("order_id", "bigint"), ("customer_id", "bigint"), ("order_amount", "decimal(10,2)"), ("order_date", "date")])}


def test_keys_and_strict_reference(spark):
    cat = catalog(spark, SHOP)
    got = {(r["table_name"], r["column_name"]): r for r in cl.key_columns(cat).collect()}
    assert got[("orders", "order_id")]["is_primary_key"] and got[("orders", "customer_id")]["is_foreign_key"]
    assert got[("orders", "customer_id")]["referenced_table"] == "customer"
    strict = cl.key_columns(cat, strict_reference=True)
    assert strict.where("is_foreign_key").count() == 0 and strict.where("is_primary_key").count() == 3


def test_decimal_counts_as_measure(spark):
    assert bu.measure_columns(catalog(spark, SHOP)).where("column_name = 'order_amount'").count() == 1


def test_table_types(spark):
    many = [("a_id", "bigint"), ("b_id", "bigint")]
    cat = catalog(spark, {"f": (10**6, many + [("x", "double"), ("y", "double")]), "link": (10**6, many),
                          "d": (10**6, [("name", "string")] + [(f"c{i}", "string") for i in range(5)]),
                          "small": (999, [("c", "string")]), "none": (0, [("c", "string")]), "big": (1000, [("c", "string")])})
    got = {r["table_name"]: r["table_type"] for r in cl.table_types(cl.key_columns(cat)).collect()}
    # two key columns are numeric, so a link table of bigint keys meets the fact rule first
    assert got == {"f": "fact", "link": "fact", "d": "dimension", "small": "lookup", "none": "unknown", "big": "unknown"}
    text_link = catalog(spark, {"link": (5000, [("a_id", "string"), ("b_id", "string")])})
    assert cl.table_types(cl.key_columns(text_link)).first()["table_type"] == "bridge"


def test_foreign_key_candidates_against_nested_loops(spark):
    rng = random.Random(4)
    names = ["users", "class", "orders", "item", "boxes"]
    pool = ["id", "user_id", "userid", "users_id", "cla_id", "class_id", "order_id", "item_id", "itemid", "box_id", "boxe_id", "note"]
    tables = {t: (1, [(c, rng.choice(["int", "bigint", "string"])) for c in rng.sample(pool, 8)]) for t in names}

    def related(a, b, t1, t2):
        s1, s2 = t1.rstrip("s"), t2.rstrip("s")
        return (a == b or (b == "id" and a in (s2 + "_id", s2 + "id", t2 + "_id"))
                or (a == "id" and b in (s1 + "_id", t1 + "_id")))

    def family(k):
        return "i" if "int" in k else k
    order = sorted(names)
    want = {(t1, a, t2, b) for i, t1 in enumerate(order) for t2 in order[i + 1:] for a, ka in tables[t1][1] for b, kb in tables[t2][1]
            if related(a, b, t1, t2) and family(ka) == family(kb)}
    got = {(r["from_table"], r["from_column"], r["to_table"], r["to_column"])
           for r in re.foreign_key_candidates(catalog(spark, tables)).collect()}
    assert got == want and len(want) > 5


@pytest.mark.parametrize("shared,extra,found", [(1, (1, 0), False), (3, (1, 1), True), (3, (1, 0), True), (19, (1, 0), True), (1, (1, 1), False)])
def test_similarity_limits(spark, shared, extra, found):
    cols = [(f"c{i}", "int") for i in range(shared)]
    cat = catalog(spark, {"a": (10, cols + [(f"a{i}", "int") for i in range(extra[0])]), "b": (10, cols + [(f"b{i}", "int") for i in range(extra[1])])})
    info = cat.groupBy("table_name").agg(F.max("row_count").alias("row_count")).withColumn("is_partitioned", F.lit(False)).withColumn("table_classification", F.lit("unknown"))
    rows = re.schema_similarity(cat, info).collect()
    assert bool(rows) == found
    if found and extra[1] == 0:
        assert rows[0]["relationship_type"] == "b appears to be a subset of a"
        advice = [r["recommendation"] for r in re.similarity_advice(re.schema_similarity(cat, info)).collect()]
        assert "Consider using views or derived tables for subset relationships" in advice


def test_inclusion_dependencies_equal_sets(spark):
    """Integers, strings, long texts, NULLs and a pair of a name rule, against sets; each table is scanned once."""
    long = "x" * 500
    tables = {
        "parent": spark.createDataFrame([(i, f"n{i}", long + str(i)) for i in range(10)], "id bigint, name string, text string"),
        "child": spark.createDataFrame([(i % 12, f"n{i % 9}" if i % 5 else None, long + str(i % 4)) for i in range(24)], "owner bigint, c_name string, text string"),
        "other": spark.createDataFrame([(i % 10, 1.0) for i in range(30)], "id int, x double"),
        "empty": spark.createDataFrame([], "id bigint, name string")}
    named = spark.createDataFrame([("parent", "id", "child", "owner")], ", ".join(f"{c} string" for c in re.PAIR))
    candidates = re.inclusion_candidates(ca.schema_rows(tables), named)
    got = re.inclusion_dependencies(tables, candidates)
    got = {tuple(r[:4]): (r["matched_by"], r["source_values"], r["contained_values"], r["orphan_rows"]) for r in got.collect()}
    assert got[("child", "c_name", "parent", "name")] == ("prefix_stripped", 9, 9, 0)
    assert got[("child", "text", "parent", "text")] == ("equal_name", 4, 4, 0)
    assert got[("other", "id", "parent", "id")] == ("equal_name", 10, 10, 0)
    # ids 10 and 11 lie outside the range of the key; the other way round the target is not unique
    assert ("child", "owner", "parent", "id") not in got and ("parent", "id", "child", "owner") not in got
    assert len(got) == 3
    keyed = {**tables, "child": spark.createDataFrame([(i % 9 if i != 3 else 8,) for i in range(20)], "owner bigint"),
             "parent": spark.createDataFrame([(i,) for i in (0, 1, 2, 5, 8, 9)], "id bigint")}
    row = re.inclusion_dependencies(keyed, re.inclusion_candidates(ca.schema_rows(keyed), named)).where("matched_by = 'name_rule'").first()
    values = [i % 9 if i != 3 else 8 for i in range(20)]
    assert (row["source_values"], row["contained_values"]) == (len(set(values)), len(set(values) & {0, 1, 2, 5, 8, 9}))
    assert row["orphan_rows"] == sum(v not in {0, 1, 2, 5, 8, 9} for v in values)
    assert re.inclusion_dependencies(tables, candidates.limit(0)).count() == 0


@pytest.mark.parametrize("seed, slices", [(1, None), (2, 8), (3, 1)])
def test_history_matches_a_loop_for_a_hot_key(spark, seed, slices):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        key = 1 if rng.random() < 0.6 else rng.randint(2, 6)
        at = start + dt.timedelta(seconds=rng.randint(0, 3600 if key == 1 else 10 ** 6))
        rows.append((None if key == 6 else key, None if rng.random() < 0.1 else at, i, rng.choice(["a", "b", None])))
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, i int, s string")
    want, changes = [], []
    for key in {r[0] for r in rows}:
        runs = []
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] or dt.datetime.min, r[2])):
            if not runs or runs[-1][1] != r[3]:
                runs.append((r[1], r[3]))
        for v, (at, state) in enumerate(runs):
            after = runs[v + 1][0] if v + 1 < len(runs) else None
            want.append((key, state, at, after, v + 1, v + 1 == len(runs)))
            if v:
                since = runs[v - 1][0]
                changes.append((key, runs[v - 1][1], state, at, (at - since).days if at and since else None))
    # the hour of the hot key, the NULL key and the NULL times spread over several ranges
    ranges = hi._sliced(df, "k", ["ts", "i"], "s", 8)
    assert ranges.where("_key = 1").select("_slice").distinct().count() > 2
    got = [tuple(r) for r in hi.type2_dimension(df, "k", ["ts", "i"], "s", slices).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    got = [tuple(r) for r in hi.state_changes(df, "k", ["ts", "i"], "s", slices).collect()]
    assert sorted(got, key=str) == sorted(changes, key=str)


def test_series_needs_five_points_and_trends_seven(spark):
    def periods(totals):
        return spark.createDataFrame([("t", "m", dt.date(2024, 1, i + 1), float(v)) for i, v in enumerate(totals)],
                                     "table_name string, metric string, period date, total_value double")
    assert se.spikes(periods([1, 1, 1, 100])).count() == 0
    assert se.spikes(periods([1] * 9 + [100])).first()["period"] == dt.date(2024, 1, 10)
    assert se.trends(periods([1, 2, 3, 4, 5, 6])).count() == 0
    assert se.trends(periods([1] * 7)).first()["trend"] == "steady"
    assert se.trends(periods([1] * 7 + [2] * 7)).first()["trend"] == "up"
    assert [r["kind"] for r in se.stories(se.spikes(periods([1] * 7)), se.trends(periods([1] * 7))).collect()] == ["steady"]


def test_partition_formats(spark):
    values = ["20240825", "2024-08-25", "2024-08", "20241399", "x", "2024-13-01"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r["v"]: (r["f"], r["d"]) for r in df.select("v", pt.partition_format(F.col("v")).alias("f"), pt.partition_date(F.col("v")).alias("d")).collect()}
    day = dt.date(2024, 8, 25)
    assert got == {"20240825": ("YYYYMMDD", day), "2024-08-25": ("YYYY-MM-DD", day), "2024-08": ("YYYY-MM", dt.date(2024, 8, 1)),
                   "20241399": ("YYYYMMDD", None), "x": ("unknown", None), "2024-13-01": ("YYYY-MM-DD", None)}


def test_size_labels(spark):
    df = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (1024**3,), (1024**5 * 2,), (None,)], "b bigint")
    got = [r[0] for r in df.select(cl.size_label(F.col("b"))).collect()]
    assert got == ["unknown", "1023.0 B", "1.0 KB", "1.5 KB", "1.0 GB", "2.0 PB", "unknown"]


def test_size_labels_of_products_beyond_a_bigint(spark, tmp_path):
    from workload import collect

    for f in os.listdir("/root/testdata/sf0.001"):
        if f != "orders.parquet":
            os.symlink(f"/root/testdata/sf0.001/{f}", tmp_path / f)
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    keys = spark.createDataFrame([(2, 3), (9_000_000, 900_000)], "k bigint, c bigint")
    orders.limit(1).crossJoin(keys).withColumns({"o_orderkey": F.col("k"), "o_custkey": F.col("c")}).select(*orders.columns).write.parquet(str(tmp_path / "orders.parquet"))
    df = collect()[0]["f15_size_label"](spark, str(tmp_path))
    assert dict(df.dtypes)["size_bytes"] == "bigint"
    got = {r["table_name"]: (r["size_bytes"], r["label"]) for r in df.collect()}
    assert got["2"] == (24, "24.0 B")
    assert got["9000000"] == (None, f"{9_000_000 ** 3 * 900_000 / 1024 ** 5:.1f} PB") and len(got) == 16


def test_table_selection(spark):
    cat = catalog(spark, {t: (1, [("c", "int")]) for t in ["fact_a", "fact_b", "dim_a", "a.b"]})
    def names(x):
        return sorted(r["table_name"] for r in rd.select_tables(cat, x).collect())
    assert names("fact_*") == ["fact_a", "fact_b"] and names("dim_a, a.b") == ["a.b", "dim_a"] and len(names("all")) == 4


def test_recommendation_order_and_filter(spark):
    cat = catalog(spark, {"w": (2_000_000, [(f"c{i}", "string") for i in range(51)])})
    recs = rc.together(rc.wide_tables(cat), rc.partition_large_tables(cat.select("table_name", "row_count").distinct()),
                       rc.missing_primary_key(cl.key_columns(cat)))
    ranks = [r["priority"] for r in rc.sort_recommendations(recs).collect()]
    assert ranks == ["high", "high", "medium"]
    assert rc.filter_recommendations(recs, priority="medium", table="w").count() == 1
    assert rc.filter_recommendations(recs, category="none").count() == 0


def test_csv_sink_keeps_nested_columns_as_json(spark, tmp_path):
    df = spark.sql("select 'a\"b' as s, map('k', 1) as m, array(1, 2) as l")
    sk.write_result(df, str(tmp_path / "out"), "csv")
    row = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).first()
    assert (row["s"], row["m"], row["l"]) == ('a"b', '{"k":1}', "[1,2]")


def test_stored_partitions_are_listed_and_skipped_by_folder(spark, tmp_path):
    rows = [(i, None if i % 10 == 0 else f"2024-0{i % 3 + 1}", "a/b +:x" if i % 2 else "c") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, month string, kind string")
    path = str(tmp_path / "stored")
    sk.write_partitioned(df, path, ["month", "kind"])
    want = {}
    for _, month, kind in rows:
        spec = f"month={month or '__HIVE_DEFAULT_PARTITION__'}/kind={kind}"
        want[spec] = want.get(spec, 0) + 1
    got = {r["partition"]: r for r in pt.stored_partitions(spark, path).collect()}
    assert set(got) == set(want)
    assert sum(r["file_count"] for r in got.values()) == sum(f.endswith(".parquet") for _, _, fs in os.walk(path) for f in fs)
    stored = spark.read.schema(df.schema).parquet(path)
    counted = pt.partition_list(stored.select(pt.partition_spec(["month", "kind"]).alias("s")), "s")
    assert {r["partition"]: r["row_count"] for r in counted.collect()} == want
    sample = pt.recent_sample(stored, "month", "2024-02-10", "YYYY-MM")
    assert sample.first()["recent_sample_count"] == sum(m == "2024-02" for _, m, _ in rows)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2024-02" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "ReadSchema: struct<>" in plan
    listing = pt.stored_partitions(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in listing and "Parquet" not in listing
    spark.range(3).write.parquet(str(tmp_path / "flat"))
    assert pt.stored_partitions(spark, str(tmp_path / "flat")).count() == 0


@pytest.mark.parametrize("limit", [0.0, 29.0, 50.0, 70.0, 99.0])
def test_similar_schemas_equal_all_pairs(spark, limit):
    rng = random.Random(int(limit))
    sets = {}
    for i in range(120):
        base = set(rng.choice(list(sets.values()))) if sets and rng.random() < 0.5 else set()
        new = {f"c{int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.randint(1, 9))}
        sets[f"t{i:03}"] = {c for c in base if rng.random() < 0.8} | new
    cat = catalog(spark, {t: (10, [(c, "int") for c in sorted(cs)]) for t, cs in sets.items()})
    info = cat.groupBy("table_name").agg(F.max("row_count").alias("row_count")).withColumn(
        "is_partitioned", F.lit(False)).withColumn("table_classification", F.lit("unknown"))
    got = {(r["table1"], r["table2"]): r["common_columns_count"] for r in re.schema_similarity(cat, info, limit).collect()}
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) * 100 > limit}
    assert got == want


def test_a_column_of_every_table_forms_no_pairs(spark):
    lake = {f"t{i:04}": (10, [("id", "int"), ("updated_at", "date")] + [(f"c{i // 2}_{j}", "int") for j in range(4)])
            for i in range(2000)}
    assert re.similar_candidates(catalog(spark, lake)).count() == 1000
    assert re.similar_candidates(catalog(spark, lake).limit(0)).count() == 0

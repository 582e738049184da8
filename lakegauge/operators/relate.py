"""Relationships between tables: by name, by schema similarity and by values.

Column pairs are found with equi-joins on derived match keys; no pair of columns
is compared that does not share a key.  The name rules run on the catalog (one
row per column); the value check runs on the distinct values of the candidates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakegauge.functions import vocab
from lakegauge.functions.exprs import contains_any, fixed
from lakegauge.operators.classify import singular
from lakegauge.operators.values import cells, present, value_counts


def type_family(data_type: Column) -> Column:
    """integer, string, or the type itself: equal families can be joined."""
    t = F.lower(F.trim(data_type))
    return (F.when(contains_any(t, vocab.INTEGER_FAMILY), "integer")
            .when(contains_any(t, vocab.STRING_FAMILY), "string").otherwise(t))


def type_compatibility(catalog: DataFrame) -> DataFrame:
    """Type and family of every column; two columns are compatible if families match."""
    return catalog.withColumn("family", type_family(F.col("data_type")))


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of different tables with the same match key, as a_* and b_*."""
    def side(df, prefix):
        return df.select("key", *[F.col(c).alias(prefix + c) for c in ["table_name", "column_name", "row_count", "table_order"]],
                         type_family(F.col("data_type")).alias(prefix + "family"))
    return side(left, "a_").join(side(right, "b_"), "key").where("a_table_name <> b_table_name")


def _swapped(pairs: DataFrame) -> DataFrame:
    other = {"a_": "b_", "b_": "a_"}
    return pairs.select(*[F.col(c).alias(other.get(c[:2], c[:2]) + c[2:]) for c in pairs.columns])


def foreign_key_candidates(catalog: DataFrame) -> DataFrame:
    """Column pairs whose names suggest a relationship and whose types are compatible.

    Pairs share a match key: the column name itself, or, for the ``id`` column of
    a table, one of the names other tables use for it.  ``from`` is the earlier
    table in ``table_order`` (the table name when the catalog has no such column).
    """
    if "table_order" not in catalog.columns:
        catalog = catalog.withColumn("table_order", F.col("table_name"))
    name, one = F.lower("column_name"), singular(F.col("table_name"))
    named = catalog.withColumn("key", name)
    spelled = F.array_distinct(F.array(F.concat(one, F.lit("_id")), F.concat(one, F.lit("id")),
                                       F.concat("table_name", F.lit("_id"))))
    targets = catalog.where(name == "id").withColumn("key", F.explode(spelled))
    same = _pairs(named, named)
    refs = _pairs(named, targets)
    earlier, later = F.col("a_table_order") < F.col("b_table_order"), F.col("a_table_order") > F.col("b_table_order")
    # seen from the id side, the spelling without underscore is not a match
    found = same.where(earlier).unionByName(refs.where(earlier)).unionByName(
        _swapped(refs.where(later & F.col("key").endswith("_id"))))
    a, b = F.lower("a_column_name"), F.lower("b_column_name")
    standard = (a == F.concat(singular(F.col("b_table_name")), F.lit("_id"))) & (b == "id")
    confidence = F.least(F.lit(1.0), F.lit(0.5) + F.when(a == b, 0.3).otherwise(0.0)
                         + F.when(standard, 0.4).otherwise(0.0)
                         + F.when(a.contains("id") | b.contains("id"), 0.1).otherwise(0.0))
    return (found.where(F.col("a_family") == F.col("b_family"))
            .select(F.lit("foreign_key").alias("type"), F.col("a_table_name").alias("from_table"),
                    F.col("a_column_name").alias("from_column"), F.col("b_table_name").alias("to_table"),
                    F.col("b_column_name").alias("to_column"), confidence.alias("confidence"),
                    F.concat(F.lit("Column names suggest relationship: "), a, F.lit(" -> "), b).alias("reasoning"),
                    F.col("a_row_count").alias("from_rows"), F.col("b_row_count").alias("to_rows"))
            .distinct())


def degrees(relationships: DataFrame) -> DataFrame:
    """Incoming, outgoing and total relationships per table, hub and lookup flags."""
    ends = relationships.select(F.inline(F.array(
        F.struct(F.col("to_table").alias("table_name"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        F.struct(F.col("from_table").alias("table_name"), F.lit(0).alias("i"),
                 # a relationship of a table with itself counts as incoming only
                 F.when(F.col("from_table") == F.col("to_table"), 0).otherwise(1).alias("o")))))
    t = ends.groupBy("table_name").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))
    total = F.col("incoming") + F.col("outgoing")
    return (t.withColumn("total_relationships", total).withColumn("is_hub", total > 3)
            .withColumn("is_lookup", (F.col("incoming") > F.col("outgoing")) & (F.col("incoming") > 1)))


def named_foreign_keys(keys: DataFrame) -> DataFrame:
    """Foreign keys whose referenced table exists; ``keys`` comes from ``key_columns``."""
    tables = keys.select(F.col("table_name").alias("referenced_table")).distinct()
    return (keys.where("is_foreign_key").join(tables, "referenced_table")
            .select(F.lit("foreign_key").alias("type"), F.col("table_name").alias("from_table"),
                    F.col("column_name").alias("from_column"), F.col("referenced_table").alias("to_table"),
                    F.col("referenced_column").alias("to_column"), F.lit(0.8).alias("confidence")))


def potential_joins(catalog: DataFrame, skip=("id", "created_at", "updated_at")) -> DataFrame:
    """Tables that share a column name, apart from system columns."""
    c = catalog.where(~F.lower("column_name").isin(list(skip))).select("table_name", "column_name")
    return (c.select(F.col("table_name").alias("table1"), "column_name")
            .join(c.select(F.col("table_name").alias("table2"), "column_name"), "column_name")
            .where("table1 < table2")
            .select(F.lit("potential_join").alias("type"), "table1", F.col("column_name").alias("column1"), "table2",
                    F.col("column_name").alias("column2"), F.lit(0.6).alias("confidence"),
                    F.lit("common_column_name").alias("detected_by")))


def suffix_references(catalog: DataFrame) -> DataFrame:
    """References named by suffix: _id (high), _key, _code, _ref (medium); the
    table's own key and stems of up to two characters are left out."""
    name = F.lower("column_name")
    suffix = F.regexp_extract(name, "_(id|key|code|ref)$", 1)
    stem = F.regexp_replace(name, "_(id|key|code|ref)$", "")
    own = (suffix == "id") & (stem == singular(F.col("table_name")))
    return (catalog.where((suffix != "") & ~own & (F.length(stem) > 2))
            .groupBy("table_name", name.alias("column_name"))  # names may differ in case only
            .agg(F.max("row_count").alias("row_count"), F.first(stem).alias("stem"), F.first(suffix).alias("suffix"))
            .select("table_name", "column_name", "row_count",
                    F.concat("stem", F.when(F.col("suffix") == "code", " lookup table").otherwise(" table"))
                    .alias("likely_references"),
                    F.when(F.col("suffix") == "id", "high").otherwise("medium").alias("confidence")))


def shared_columns(catalog: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Shared column names per table pair with relationship type and strength."""
    c = catalog.select("table_name", "column_name").distinct()
    name = F.lower("column_name")
    kind = (F.when(contains_any(name, ["_id", "_key", "id_", "key_"]), "foreign_key")
            .when(name.isin("date", "created_at", "updated_at", "timestamp"), "temporal")
            .otherwise("common_attribute"))
    out = (c.select(F.col("table_name").alias("table1"), "column_name")
           .join(c.select(F.col("table_name").alias("table2"), "column_name"), "column_name").where("table1 < table2")
           .withColumn("relationship_type", kind)
           .withColumn("strength", F.when(F.col("relationship_type") == "foreign_key", "high")
                       .when(F.col("relationship_type") == "temporal", "medium").otherwise("low")))
    if classes is not None:
        k = classes.select("table_name", "table_classification")
        out = (out.join(k.toDF("table1", "table1_type"), "table1", "left")
               .join(k.toDF("table2", "table2_type"), "table2", "left"))
    return out


def shared_totals(shared: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Per table pair: shared columns in total, strong ones, and their names; with a
    catalog also the rows of both tables."""
    out = shared.groupBy("table1", "table2").agg(
        F.count(F.lit(1)).alias("total_relationships"), F.count_if(F.col("strength") == "high").alias("strong_relationships"),
        F.array_join(F.array_sort(F.collect_set("column_name")), ", ").alias("common_columns"))
    if catalog is not None:
        rows = catalog.groupBy("table_name").agg(F.max("row_count").alias("n"))
        out = (out.join(rows.toDF("table1", "row_count1"), "table1", "left")
               .join(rows.toDF("table2", "row_count2"), "table2", "left"))
    return out


def fact_dimension_links(catalog: DataFrame, classes: DataFrame) -> DataFrame:
    """Fact tables linked to dimension tables through equal column names."""
    t = catalog.select("table_name", "column_name").join(classes.select("table_name", "table_classification"), "table_name")
    name, kind = F.lower("table_name"), F.coalesce("table_classification", F.lit(""))
    facts = t.where(kind.startswith("fact") | name.contains("fact")).select(F.col("table_name").alias("fact_table"), "column_name")
    dims = t.where(kind.startswith("dim") | name.contains("dim")).select(F.col("table_name").alias("dimension_table"), "column_name")
    strong = F.col("column_name").contains("_id") | F.col("column_name").contains("_key")
    return (facts.join(dims, "column_name").where("fact_table <> dimension_table")
            .groupBy("fact_table", "dimension_table")
            .agg(F.array_join(F.array_sort(F.collect_set("column_name")), ", ").alias("linking_columns"),
                 F.bool_or(strong).alias("s"))
            .select("fact_table", "dimension_table", "linking_columns",
                    F.when(F.col("s"), "high").otherwise("medium").alias("relationship_strength")))


def column_frequency(catalog: DataFrame) -> DataFrame:
    """Case-folded column names that occur in at least two tables, with key flags."""
    return (catalog.groupBy(F.lower("column_name").alias("column_name"))
            .agg(F.array_sort(F.collect_list("table_name")).alias("t"), F.sum("row_count").alias("rows_covered"))
            .where(F.size("t") >= 2)
            .select("column_name", F.array_join("t", ", ").alias("tables"), F.size("t").cast("bigint").alias("frequency"),
                    (F.col("column_name").endswith("_id") | F.col("column_name").endswith("_key")).alias("likely_join_key"),
                    (contains_any(F.col("column_name"), ["date", "time"]) | F.col("column_name").endswith("_key"))
                    .alias("is_dimension_key"), "rows_covered"))


def join_key_pairs(catalog: DataFrame) -> DataFrame:
    """Table pairs that share a likely join key, with confidence."""
    name = F.lower("column_name")
    c = catalog.where(name.endswith("_id") | name.endswith("_key")).select("table_name", name.alias("join_column"))
    return (c.select(F.col("table_name").alias("table1"), "join_column")
            .join(c.select(F.col("table_name").alias("table2"), "join_column"), "join_column").where("table1 < table2")
            .withColumn("confidence", F.when(F.col("join_column").endswith("_id"), "high").otherwise("medium")))


def name_tokens(catalog: DataFrame) -> DataFrame:
    """Name parts (split on _, longer than two) that occur in at least two tables."""
    name = F.lower("column_name")
    return (catalog.where(name.contains("_"))
            .select("table_name", "row_count", F.explode(F.split(name, "_")).alias("pattern"))
            .where(F.length("pattern") > 2)
            .groupBy("pattern", "table_name").agg(F.max("row_count").alias("row_count"))
            .groupBy("pattern").agg(F.array_sort(F.collect_list("table_name")).alias("t"), F.sum("row_count").alias("rows_covered"))
            .where(F.size("t") >= 2)
            .select("pattern", F.array_join("t", ", ").alias("tables"), F.size("t").cast("bigint").alias("frequency"), "rows_covered"))


def similar_candidates(catalog: DataFrame, limit: float = 50.0) -> DataFrame:
    """(table1, table2) pairs, each once, that may share more than ``limit`` percent of their
    columns; no pair above the limit is missing.

    The columns of a table are put in order of rarity.  Sets of n columns that are similar
    enough share one of their rarest n - floor(n * limit / 100), so only these meet: a column
    of every table, like an audit date, is among them in tables of few columns only.  Pairs
    whose sizes or positions of the met column leave too little room are not formed.
    """
    slack = 1e-9  # rounding may only keep a pair too many
    c = catalog.where("column_name is not null").select("table_name", "column_name").distinct()
    rarity = c.groupBy("column_name").agg(F.count(F.lit(1)).alias("tables"))
    # bounded by the columns of one table
    mine = Window.partitionBy("table_name")
    placed = (c.join(rarity, "column_name")
              .withColumn("n", F.count(F.lit(1)).over(mine))
              .withColumn("at", F.row_number().over(mine.orderBy("tables", "column_name"))))
    rare = placed.where(F.col("at") <= F.col("n") - F.floor(F.col("n") * (limit / 100) - slack))
    one = rare.select(F.col("table_name").alias("table1"), "column_name", F.col("n").alias("n1"), F.col("at").alias("at1"))
    two = rare.select(F.col("table_name").alias("table2"), "column_name", F.col("n").alias("n2"), F.col("at").alias("at2"))
    most = F.least("at1", "at2") + F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2"))
    fits = ((F.least("n1", "n2") * 100 > F.greatest("n1", "n2") * limit - slack)
            & (most * (100 + limit) > (F.col("n1") + F.col("n2")) * limit - slack))
    return (one.join(two, (one["column_name"] == two["column_name"]) & (one["table1"] < two["table2"]) & fits)
            .select("table1", "table2").distinct())


def schema_similarity(catalog: DataFrame, tables: DataFrame, limit: float = 50.0) -> DataFrame:
    """Table pairs whose column sets overlap by more than ``limit`` percent (Jaccard).

    Only the pairs of :func:`similar_candidates` are formed.  ``tables`` has table_name,
    row_count, is_partitioned and table_classification.  Column lists of one table
    are bounded by its schema.
    """
    columns = catalog.groupBy("table_name").agg(
        F.collect_set("column_name").alias("columns"),
        F.map_from_entries(F.collect_set(F.struct("column_name", "data_type"))).alias("types"))
    info = columns.join(tables, "table_name")
    left = info.select(*[F.col(x).alias("table1" if x == "table_name" else "a_" + x) for x in info.columns])
    right = info.select(*[F.col(x).alias("table2" if x == "table_name" else "b_" + x) for x in info.columns])
    p = (similar_candidates(catalog, limit).join(left, "table1").join(right, "table2")
         .withColumn("common_columns_count", F.size(F.array_intersect("a_columns", "b_columns")).cast("bigint")))
    union = F.size("a_columns") + F.size("b_columns") - F.col("common_columns_count")
    exact = F.col("common_columns_count") / union * 100
    ratio = F.try_divide(F.col("a_row_count").cast("double"), F.col("b_row_count"))

    def names(arr):
        return F.array_join(F.array_sort(arr), ", ")

    def typed(arr, types):
        return F.array_join(F.transform(F.array_sort(arr), lambda n: F.concat(n, F.lit(" "), F.element_at(types, n))), ", ")

    only1, only2 = F.array_except("a_columns", "b_columns"), F.array_except("b_columns", "a_columns")
    label = (F.when((F.size(only1) == 0) & (F.size(only2) > 0),
                    F.concat("table1", F.lit(" appears to be a subset of "), "table2"))
             .when((F.size(only2) == 0) & (F.size(only1) > 0),
                   F.concat("table2", F.lit(" appears to be a subset of "), "table1"))
             .when(exact > 80, "Very similar tables with minor differences")
             .otherwise("Related tables with significant overlap"))
    return p.where(exact > limit).select(
        "table1", "table2", F.bround(exact, 1).alias("commonality_percentage"), exact.alias("commonality"),
        "common_columns_count", names(F.array_intersect("a_columns", "b_columns")).alias("common_columns"),
        typed(only1, F.col("a_types")).alias("table1_unique_columns"),
        typed(only2, F.col("b_types")).alias("table2_unique_columns"),
        ratio.alias("row_count_ratio"),
        F.when(ratio > 2, F.concat("table1", F.lit(" has "), fixed(ratio), F.lit("x more records than "), "table2"))
        .when(ratio < 0.5, F.concat("table2", F.lit(" has "), fixed(F.try_divide(F.lit(1.0), ratio)), F.lit("x more records than "), "table1"))
        .alias("row_count_insight"),
        (F.col("a_is_partitioned") != F.col("b_is_partitioned")).alias("partitioning_differs"),
        (F.col("a_table_classification") != F.col("b_table_classification")).alias("class_differs"),
        label.alias("relationship_type"))


def similarity_advice(similar: DataFrame) -> DataFrame:
    """Advice lines per similar pair: one tier of two lines plus notes on differences."""
    pc, pair = F.col("commonality"), F.concat("table1", F.lit(" and "), "table2")
    tiers = [
        (pc > 90, F.concat(F.lit("Consider consolidating "), pair, F.lit(" as they are nearly identical")),
         "Investigate if one table is a duplicate or backup of the other"),
        (pc > 80, F.concat(F.lit("Evaluate if "), pair, F.lit(" can be merged with additional columns")),
         "Consider creating a unified schema with optional columns"),
        (pc > 70, F.concat(F.lit("Analyze if "), pair, F.lit(" represent different versions or time periods")),
         "Consider implementing a versioning strategy or temporal tables"),
        (F.lit(True), F.concat(F.lit("Tables "), pair, F.lit(" are related but serve different purposes")),
         "Maintain as separate entities but ensure consistent naming and relationships")]
    chosen = F.coalesce(*[F.when(c, F.array(a, F.lit(b))) for c, a, b in tiers])
    notes = F.array_compact(F.array(
        F.when(F.col("relationship_type").contains("subset"), F.lit("Consider using views or derived tables for subset relationships")),
        F.when(F.col("partitioning_differs"), F.lit("Standardize partitioning strategy across related tables")),
        F.when(F.col("class_differs"), F.lit("Ensure proper fact-dimension relationships are maintained"))))
    return similar.select("table1", "table2", F.posexplode(F.concat(chosen, notes)).alias("line", "recommendation"))


# --- by values ----------------------------------------------------------------------

PAIR = ["from_table", "from_column", "to_table", "to_column"]


def inclusion_candidates(catalog: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Ordered column pairs to be checked by value, with the rule that matched them (``matched_by``).

    Columns of different tables and equal type families meet if their names are equal (``equal_name``) or equal
    without the prefix up to the first underscore (``prefix_stripped``, an addition of this library).  ``named``
    adds pairs of the name rules (columns of ``PAIR``) in both directions (``name_rule``): which side is the key is
    decided by the values.  Columns of arrays, maps and structs take no part.
    """
    family = type_family(F.col("data_type"))
    plain = catalog.where(~F.col("data_type").rlike("^(array|map|struct)")).select(
        "table_name", "column_name", family.alias("family"),
        F.regexp_replace(F.lower("column_name"), "^[a-z]+_", "").alias("key"))
    side = lambda p: plain.select("key", "family", F.col("table_name").alias(p + "_table"), F.col("column_name").alias(p + "_column"))
    equal = F.lower("from_column") == F.lower("to_column")
    found = (side("from").join(side("to"), ["key", "family"]).where("from_table <> to_table")
             .select(*PAIR, "family", F.when(equal, 1).otherwise(2).alias("rule")))
    if named is not None:
        there = named.select(*PAIR)
        back = named.select(*[F.col(c).alias(n) for c, n in zip(["to_table", "to_column", "from_table", "from_column"], PAIR)])
        kinds = lambda p: plain.select(F.col("table_name").alias(p + "_table"), F.col("column_name").alias(p + "_column"),
                                       F.col("family").alias(p + "_family"))
        both = (there.unionByName(back).where("from_table <> to_table").join(kinds("from"), ["from_table", "from_column"])
                .join(kinds("to"), ["to_table", "to_column"]).where("from_family = to_family"))
        found = found.unionByName(both.select(*PAIR, F.col("from_family").alias("family"), F.lit(3).alias("rule")))
    rules = F.array(F.lit("equal_name"), F.lit("prefix_stripped"), F.lit("name_rule"))
    return (found.groupBy(*PAIR, "family").agg(F.min("rule").alias("rule"))
            .select(*PAIR, "family", rules[F.col("rule") - 1].alias("matched_by")))


def inclusion_dependencies(tables: dict[str, DataFrame], candidates: DataFrame, min_distinct: int = 1) -> DataFrame:
    """Which candidate columns hold only values of another one: source, contained and orphan counts per pair.

    Every table is scanned once.  Its cells are counted by value, then one shuffle by value gathers the columns that
    hold it (at most as many as the candidates have), from which each value adds to the counts of all its pairs at once;
    counts are combined per task, so nothing grows with the number of rows but the two shuffles of distinct values.
    Targets are unique columns; numeric sources lie inside the target's range.  Long texts are compared by digest.
    NULLs belong to no column; a pair whose source has no value is left out.
    """
    pairs = [tuple(r) for r in candidates.select(*PAIR, "family", "matched_by").collect()]  # names: bounded by the catalog
    columns = sorted({(t, c) for p in pairs for t, c in (p[:2], p[2:4])})
    number = {c: i for i, c in enumerate(columns)}
    spark = candidates.sparkSession
    targets: dict[int, list] = {i: [] for i in range(len(columns))}
    roles: dict[int, list] = {i: [] for i in range(len(columns))}
    for k, p in enumerate(pairs):
        a, b = number[p[:2]], number[p[2:4]]
        targets[a].append((k, b))
        roles[a].append((k, 1))
        roles[b].append((k, 2))
    known = spark.createDataFrame(
        [(*c, i, targets[i], roles[i]) for c, i in number.items()],
        "table_name string, column_name string, id int, targets array<struct<pair:int,to:int>>, roles array<struct<pair:int,side:int>>")
    named = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "pair int, " + ", ".join(f"{c} string" for c in PAIR) + ", family string, matched_by string")
    wanted: dict[str, list[str]] = {}
    for t, c in columns:
        wanted.setdefault(t, []).append(c)
    all_cells = [cells(tables[t], t, cs) for t, cs in wanted.items()]
    if not all_cells:
        return (named.select(*PAIR, "matched_by", *[F.lit(0).cast("bigint").alias(c) for c in ("source_values", "contained_values", "orphan_rows")],
                             F.lit(0.0).alias("containment")))
    counted = present(value_counts(reduce(DataFrame.unionByName, all_cells)))
    # broadcast: one row per candidate column
    held = counted.join(F.broadcast(known.select("table_name", "column_name", "id")), ["table_name", "column_name"]).select(
        F.coalesce("value", "digest").alias("k"), F.col("digest").isNotNull().alias("long"), F.struct("id", "n").alias("holder"))
    by_value = held.groupBy("k", "long").agg(F.collect_list("holder").alias("holders"))  # at most one holder a column
    one = by_value.select(F.when(~F.col("long"), F.expr("try_cast(k as double)")).alias("v"), "holders", F.explode("holders").alias("h"))
    met = one.select("v", F.transform("holders", lambda h: h["id"]).alias("ids"), F.col("h.id").alias("id"), F.col("h.n").alias("n")).join(
        F.broadcast(known.select("id", "targets")), "id")
    own = F.struct(F.lit(0).alias("kind"), F.col("id").alias("ref"), F.lit(False).alias("hit"), "n", "v")
    tested = F.transform("targets", lambda t: F.struct(F.lit(1).alias("kind"), t["pair"].alias("ref"),
                                                       F.array_contains("ids", t["to"]).alias("hit"), F.col("n").alias("n"), F.col("v").alias("v")))
    sums = met.select(F.inline(F.concat(F.array(own), tested))).groupBy("kind", "ref").agg(
        F.count(F.lit(1)).alias("values"), F.count_if("hit").alias("hits"), F.sum(F.when(~F.col("hit"), F.col("n"))).alias("missed"),
        F.max("n").alias("most"), F.min("v").alias("low"), F.max("v").alias("high"))
    # a column's own counts go to all its pairs; one row per column and pair from here on
    placed = sums.join(F.broadcast(known.select(F.lit(0).alias("kind"), F.col("id").alias("ref"), "roles")), ["kind", "ref"], "left").select(
        "*", F.explode(F.coalesce("roles", F.array(F.struct(F.col("ref").alias("pair"), F.lit(0).alias("side"))))).alias("r"))
    of = lambda side, c: F.max(F.when(F.col("r.side") == side, F.col(c)))
    whole = placed.groupBy(F.col("r.pair").alias("pair")).agg(
        of(0, "values").alias("source_values"), of(0, "hits").alias("contained_values"), of(0, "missed").alias("orphan_rows"),
        of(2, "most").alias("most"), of(1, "low").alias("a_low"), of(1, "high").alias("a_high"), of(2, "low").alias("b_low"), of(2, "high").alias("b_high"))
    inside = (F.col("family") != "integer") | ((F.col("a_low") >= F.col("b_low")) & (F.col("a_high") <= F.col("b_high")))
    return (whole.join(F.broadcast(named), "pair").where((F.col("source_values") >= min_distinct) & (F.col("most") == 1) & inside)
            .select(*PAIR, "matched_by", "source_values", "contained_values", F.coalesce("orphan_rows", F.lit(0)).alias("orphan_rows"),
                    (F.col("contained_values") / F.col("source_values")).alias("containment")))


def relationship_counts(*relationships: DataFrame) -> DataFrame:
    """Total, foreign-key and potential-join relationships."""
    kinds = reduce(DataFrame.unionByName, [r.select("type") for r in relationships])
    return kinds.agg(F.count(F.lit(1)).alias("total_detected"), F.count_if(F.col("type") == "foreign_key").alias("foreign_keys"),
                     F.count_if(F.col("type") == "potential_join").alias("potential_joins"))

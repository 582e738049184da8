"""Mixing sources to target weights along a time-varying curriculum.

Targets: each source wants its weight's share of the budget; sources that would exceed ``cap`` times their size stop
there and the excess is shared again by weight until none is above.  The end state is target = min(cap, level * weight)
with one level for all, which sorted running sums give at once.

Curriculum: over the training fraction u in [0, 1] a source is drawn at the rate 1 + slope * (1 - 2u), whose integral is
u + slope * (u - u^2).  A word that stands at the share y of its source's demand is needed where that integral reaches y;
inverting it gives the schedule's position, and documents are range-sorted by position.  The rates of all sources at u add
up to 1 + slope * (1 - 2u) with the mean of the slopes, weighed by the targets; its integral ``progress`` is the fraction of all
taken words that are due up to u.  Over ``progress`` the sources' rates, as shares of what is drawn, add up to one.

Documents of a source follow each other in hash order and in passes; the last pass stops at the word where the target is
met, so a source's taken words differ from its target by less than one and no document is taken more than ``cap`` times.
Running sums are taken within range partitions and then over the partitions' totals, so a source that holds a third of
all rows is spread over many tasks.

Defined cases: null text has size 0; the null source comes last in order; documents of size 0 are taken 0 times and have
no position; a source of size 0 has target 0; repeated rows count each; all input columns are kept, those named like a
result (in any case of letters) are replaced.

Only row numbers, sources, sizes and orders travel through the sums.  Their results meet the documents again by row number,
which needs ``docs`` to be read in the same order twice, as a written table is; this is verified, and fails otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakegauge.sources.readers import quote
from lakegauge.sources.work import written

WEIGHTS = (3, 1, 2)
BUDGET_PERCENT = 150
CAP = 2
SLOPES = (0.5, 0.0, -0.5)  # the first sources fade, the third ones grow
RESULTS = ("size", "source_size", "target", "taken", "position", "passes")
SPACES = "\t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    plain = F.translate(text, SPACES, " " * len(SPACES))
    return F.coalesce(F.size(F.array_remove(F.split(plain, " "), "")), F.lit(0)).cast("bigint")


def running(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group that stand before, in a total order.

    Rows are range-partitioned by group and order and written, so that both passes below see the same partitions.
    """
    placed = written(df.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = placed.groupBy("__part", *group).agg(F.sum(value).alias("__sum"))
    # rows of totals: at most the partitions plus the groups; of one group: at most the partitions
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__earlier", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    inside = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    keys = ["__part", *group]
    local = placed.withColumn("__local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    offsets = offsets.select(*[F.col(k).alias(f"__o{i}") for i, k in enumerate(keys)], "__earlier")
    same = [F.col(k).eqNullSafe(F.col(f"__o{i}")) for i, k in enumerate(keys)]
    return local.join(offsets, [*same], "left").withColumn(out, F.col("__local") + F.col("__earlier")).drop(
        "__part", "__local", "__earlier", *[f"__o{i}" for i in range(len(keys))])


def targets(sizes: DataFrame, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, cap: int = CAP) -> DataFrame:
    """source, source_size -> rank (0-based, code points, null last), weight, target."""
    # one group of all sources, range-partitioned by name and summed per partition
    ranked = running(sizes.withColumn("one", F.lit(1)).withColumn("none", F.col("source").isNull().cast("int")).withColumn("all", F.lit(0)),
                     ["all"], ["none", "source"], "one", "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    weighted = ranked.withColumn("weight", weight.cast("bigint")).withColumn("cap", F.col("source_size") * cap)
    # sources fill up in the order of cap / weight; those filled before a source are known from running sums
    filling = weighted.withColumn("fill", F.col("cap") / F.col("weight"))
    capped = running(filling, ["all"], ["fill", "rank"], "cap", "cap_before")
    summed = running(capped, ["all"], ["fill", "rank"], "weight", "weight_before")
    total = summed.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights"))
    demand = F.lit(budget_percent) * F.col("total") - 100 * F.col("cap_before")  # in hundredths of a word
    left = F.col("weights") - F.col("weight_before")
    # the first source that does not fill up sets the level for all from there on
    judged = summed.withColumns({
        "total": total.select("total").scalar(), "weights": total.select("weights").scalar()})
    judged = judged.withColumn("open", F.col("cap") * 100 * left > demand * F.col("weight"))
    level = judged.filter("open").agg(F.min(F.struct("fill", "rank", demand.alias("demand"), left.alias("left"))).alias("l"))
    judged = judged.withColumn("l", level.select("l").scalar())
    isopen = F.col("l").isNotNull() & (F.struct("fill", "rank") >= F.struct("l.fill", "l.rank"))
    target = F.when(isopen, F.col("l.demand") * F.col("weight") / (100.0 * F.col("l.left"))).otherwise(F.col("cap").cast("double"))
    return judged.select("source", "source_size", "rank", "weight", target.cast("double").alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
        budget_percent: int = BUDGET_PERCENT, cap: int = CAP, slopes=SLOPES, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with size, source_size, target, taken, position (of its first word, as a fraction of the schedules; null if nothing
    is taken) and passes: for each pass that takes words of it its number, the words, the position, the source's rank,
    order and row that break ties of position, and progress, the fraction of all taken words due before it.  ``keep`` names columns short enough to travel with the sums; without it
    all columns are met again by row number."""
    carried = [c for c in keep or [] if c.lower() not in RESULTS]
    text, source = F.col(quote(text_col)), F.col(quote(source_col))
    order, size = F.xxhash64(F.col(quote(id_col)), text), n_words(text)
    rows = docs.select(*[F.col(quote(c)).alias(f"__k{i}") for i, c in enumerate(carried)], source.alias("__source"), size.alias("size"),
                       order.alias("__order"), F.monotonically_increasing_id().alias("__row"))
    sizes = docs.select(source.alias("source"), size.alias("n")).groupBy("source").agg(F.sum("n").cast("bigint").alias("source_size"))
    wanted = written(targets(sizes, weights, budget_percent, cap), "targets").withColumnRenamed("source", "__name").withColumn(
        "__slope", F.element_at(F.array(*[F.lit(float(x)) for x in slopes]), (F.col("rank") % len(slopes) + 1).cast("int")))
    mean = wanted.agg(F.coalesce(F.try_divide(F.sum(F.col("target") * F.col("__slope")), F.sum("target")), F.lit(0.0)).alias("mean"))
    wanted = wanted.withColumn("__mean", mean.scalar())
    placed = running(rows, ["__source"], ["__order", "__row"], "size", "__before")
    # one row per source; hot sources are split by adaptive execution
    joined = placed.join(wanted, F.col("__source").eqNullSafe(F.col("__name")), "left")
    words, s = F.floor("target"), F.col("__slope")

    def one(p: int) -> Column:
        before = F.col("__before") + p * F.col("source_size")
        share = F.when(F.col("target") > 0, before / F.col("target"))
        inverse = F.when(s == 0, share).otherwise(((1 + s) - F.sqrt((1 + s) * (1 + s) - 4 * s * share)) / (2 * s))
        u = F.least(F.greatest(inverse, F.lit(0.0)), F.lit(1.0))
        return F.struct(F.lit(p + 1).alias("pass"), F.least(F.greatest(words - before, F.lit(0)), F.col("size")).cast("bigint").alias("taken"),
                        u.alias("position"), "rank", F.col("__order").alias("order"), F.col("__row").alias("row"),
                        (u + F.col("__mean") * (u - u * u)).alias("progress"))

    passes = F.filter(F.array(*[one(p) for p in range(cap)]), lambda p: p["taken"] > 0)
    taken = F.aggregate("passes", F.lit(0).cast("bigint"), lambda n, p: n + p["taken"])
    mixed = joined.withColumn("passes", passes).withColumn("taken", taken).withColumn("position", F.get("passes", F.lit(0))["position"])
    if keep is not None:
        return mixed.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(carried)], *RESULTS)
    kept = [c for c in docs.columns if c.lower() not in RESULTS]
    # one struct beside the columns of docs, so that no name can clash
    found = mixed.select(F.col("__row").alias("row"), F.struct("__order", *RESULTS).alias("found"))
    whole = docs.select(F.struct(*[F.col(quote(c)) for c in kept]).alias("doc"), order.alias("order"), F.monotonically_increasing_id().alias("row"))
    met = whole.join(found, "row", "left")
    same = F.col("order").eqNullSafe(F.col("found.__order"))
    checked = met.withColumn("found", F.when(same, F.col("found")).otherwise(
        F.raise_error(F.lit("the documents were read in another order; write them first"))))
    return checked.select(*[F.col("doc")[c].alias(c) for c in kept], *[F.col("found")[c].alias(c) for c in RESULTS])


def in_training_order(mixed: DataFrame, progress: bool = False) -> DataFrame:
    """One row for each pass that takes words of a document, with its number ``pass``, its words ``taken``, its ``position`` and,
    if asked for, its ``progress``, range-sorted by position; ties follow the source, its order and the row."""
    shown = ["taken", "position", "pass", *(["progress"] if progress else [])]
    kept = [c for c in mixed.columns if c.lower() not in (*shown, "passes")]
    rows = mixed.select(F.struct(*[F.col(quote(c)) for c in kept]).alias("doc"), F.explode("passes").alias("p"))
    by = [F.col(f"p.{c}") for c in ("position", "rank", "order", "row", "pass")]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return placed.select(*[F.col("doc")[c].alias(c) for c in kept], *[F.col("p")[c].alias(c) for c in shown])


def training_text(text: Column, size: Column, taken: Column) -> Column:
    """What a pass takes of a text: all of it, or of the one that the pass ends in its first words, a space between."""
    plain = F.translate(text, SPACES, " " * len(SPACES))
    return F.when(taken == size, text).otherwise(F.array_join(F.slice(F.array_remove(F.split(plain, " "), ""), F.lit(1), taken.cast("int")), " "))


def digests(mixed: DataFrame, key: str) -> DataFrame:
    """One row for each document of :func:`mix`, told apart by the column ``key``: its words taken in all, the position of its first
    ones, and for each pass in training order its number, words, position, progress and the SHA-256 of its text.

    Documents that no pass takes stand in no training order; they are added without their texts."""
    ordered = in_training_order(mixed, progress=True)
    text = F.sha2(training_text(F.col("text"), F.col("size"), F.col("taken")), 256)
    drawn = F.struct("pass", "taken", "position", "progress", F.unhex(text).alias("sha"))
    same = [key, "doc_id", "size", "source_size", "target"]
    found = ordered.select(*same, drawn.alias("p")).groupBy(key).agg(
        *[F.first(c).alias(c) for c in same[1:]], F.sort_array(F.collect_list("p")).alias("passes"))
    taken = F.aggregate("passes", F.lit(0).cast("bigint"), lambda n, p: n + p["taken"])
    shown = F.transform("passes", lambda p: F.struct(*[p[c].alias(c) for c in ("pass", "taken", "position", "progress")],
                                                     F.lower(F.hex(p["sha"])).alias("text_sha256")))
    found = found.select(*same[1:], taken.alias("taken"), F.get("passes", F.lit(0))["position"].alias("position"), shown.alias("passes"))
    none = mixed.filter("taken = 0").select(*same[1:], "taken", "position", F.expr("cast(array() as array<{}>)".format(
        found.schema["passes"].dataType.elementType.simpleString())).alias("passes"))
    return found.unionByName(none)


def op5_mix_sources(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("__document", F.monotonically_increasing_id())
    return digests(mix(docs), "__document")

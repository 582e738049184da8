"""Value frequencies: one distributed count per distinct value, reused by all
distinct-value, length, pattern, top-value and key statistics.

Tables are unpivoted to cells and counted.  Numbers, dates and times are counted in their
own type and become texts afterwards, once a distinct value.  The count has a map-side partial step, so a value that fills a third of the
table reaches the shuffle once per task.  Texts longer than ``SHORT`` characters
travel as an MD5 digest of the whole text together with their first characters and
the length and pattern bits taken from the whole text, so a corpus is never shuffled
by its content.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lakegauge.functions import vocab
from lakegauge.functions.exprs import KEYS, clean, fields_of, is_text, percent, quoted

SHORT = 64  # longest value kept as its own shuffle key

# (?U): \d and \s cover all Unicode digits and spaces; (?d): only \n ends a line.
_FLAGS = "(?Ud)"
PATTERN_BITS = {
    **{name: 1 << i for i, name in enumerate(vocab.VALUE_PATTERNS)},
    "numeric_string": 1 << 7,
    **{name: 1 << (8 + i) for i, name in enumerate(vocab.DATE_PATTERNS)},
}
_ALL_PATTERNS = {**vocab.VALUE_PATTERNS, "numeric_string": vocab.NUMERIC_STRING_PATTERN,
                 **vocab.DATE_PATTERNS}


def cells(df: DataFrame, table: str, columns=None) -> DataFrame:
    """(table_name, column_name, value): every cell as text, NULLs included."""
    fields = fields_of(df, columns)
    if not fields:
        return df.select(F.lit(table).alias("table_name"), F.lit("").alias("column_name"),
                         F.lit("").alias("value")).where(F.lit(False))
    texts = df.select(*[clean(f).cast("string").alias(f.name) for f in fields])
    return (texts.unpivot([], [quoted(f.name) for f in fields], "column_name", "value")
            .select(F.lit(table).alias("table_name"), "column_name", "value"))


def _possible(name: str, value: Column) -> Column | None:
    """A cheap condition every match of the pattern meets, tested before the pattern.

    Lengths allow one closing line break, which ``$`` skips.
    """
    sizes = {"phone": (10, 18), "ssn": (9, 12), "credit_card": (16, 20), "ip_address": (7, 16), "uuid": (36, 37),
             **{d: (10, 11) for d in vocab.DATE_PATTERNS}}
    if name in sizes:
        return F.length(value).between(*sizes[name])
    return {"email": value.contains("@"), "url": value.startswith("http")}.get(name)


def pattern_bits(value: Column) -> Column:
    """One bit per whole-value pattern the text matches."""
    bits = F.lit(0)
    for name, pattern in _ALL_PATTERNS.items():
        match = value.rlike(_FLAGS + pattern)
        first = _possible(name, value)
        bits = bits + F.when(match if first is None else first & match, PATTERN_BITS[name]).otherwise(0)
    return bits


def _text_keys(value: Column, short: int) -> list[Column]:
    long = F.length(value) > short
    return [F.when(~long, value).alias("value"),
            F.when(long, F.md5(value)).alias("digest"),
            F.when(long, F.left(value, F.lit(short))).alias("head"),
            F.when(long, F.length(value)).alias("long_length"),
            F.when(long, pattern_bits(value)).alias("long_bits")]


_TEXT_KEYS = ["value", "digest", "head", "long_length", "long_bits"]


def _counted(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    # `held` tells present values from NULLs: a filter on it stays above the shuffle, which all statistics share
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("held"))


def value_counts(cell_rows: DataFrame, short: int = SHORT) -> DataFrame:
    """(table_name, column_name, value, digest, head, long_length, long_bits, n, held).

    ``value`` is NULL for long texts, which are identified by ``digest``; both
    are NULL for SQL NULLs.  ``head`` (the first characters), ``long_length`` and
    ``long_bits`` depend on the text alone, so they do not split groups.  ``held`` is
    ``n``, or 0 for SQL NULLs.
    """
    rows = cell_rows.select(*KEYS, *_text_keys(F.col("value"), short))
    return _counted(rows, [*KEYS, *_TEXT_KEYS], F.coalesce("value", "digest"))


def _counted_as(kind: T.DataType) -> str | None:
    """The type of fixed width in which values are equal exactly where their texts are; None for texts and others."""
    if isinstance(kind, T.IntegralType):
        return "bigint"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp_ntz"  # the text of a timestamp is its local time
    return kind.simpleString() if isinstance(kind, (T.FloatType, T.DoubleType, T.DateType, T.DecimalType)) else None


def table_counts(tables: dict[str, DataFrame], columns: dict | None = None, short: int = SHORT) -> DataFrame:
    """:func:`value_counts` of the cells of whole tables, or of some ``columns`` by table.

    Cells carry the numbers of their table and column; those of a type of fixed width are counted in
    that type, which is one shuffle a type, and cast to text where they are counted.
    """
    names, kinds, order = [], {}, list(tables)
    for table, df in tables.items():
        for f in fields_of(df, None if columns is None else columns.get(table)):
            names.append((table, f.name))
            kinds.setdefault(_counted_as(f.dataType), {}).setdefault(table, {})[str(len(names))] = f
    if not names:
        return value_counts(reduce(DataFrame.unionByName, [cells(df, table, []) for table, df in tables.items()]), short)
    # never NULL: joins by name would send a test of it below the shuffle
    named = lambda texts, i: F.coalesce(F.element_at(F.array(*map(F.lit, texts)), F.col(i)), F.lit(""))
    keys = [named(order, "of").alias(KEYS[0]), named([n[1] for n in names], "id").alias(KEYS[1])]
    out = []
    for kind, held in kinds.items():
        rows = [tables[t].select(*[clean(f).cast(kind or "string").alias(i) for i, f in fs.items()])
                # the table as a constant, so that a filter on its name leaves the others out
                .unpivot([], [quoted(i) for i in fs], "id", "v").select(F.lit(order.index(t) + 1).alias("of"), F.col("id").cast("int").alias("id"), "v")
                for t, fs in held.items()]
        rows = reduce(DataFrame.union, rows)
        if kind is None:
            texts = rows.select("of", "id", *_text_keys(F.col("v"), short))
            out.append(_counted(texts, ["of", "id", *_TEXT_KEYS], F.coalesce("value", "digest")).select(*keys, *_TEXT_KEYS, "n", "held"))
        else:
            none = [F.lit(None).cast(t).alias(n) for n, t in [("digest", "string"), ("head", "string"), ("long_length", "int"), ("long_bits", "int")]]
            out.append(_counted(rows, ["of", "id", "v"], F.col("v")).select(*keys, F.col("v").cast("string").alias("value"), *none, "n", "held"))
    return reduce(DataFrame.unionByName, out)


def presence(df: DataFrame, table: str, columns=None) -> DataFrame:
    """Rows, NULLs and present values per column: one wide aggregate, no value is shuffled or held."""
    wide = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*[F.struct(
        F.lit(f.name).alias("column_name"), F.count(clean(f)).alias("present")) for f in fields_of(df, columns)]).alias("columns"))
    one = wide.select(F.lit(table).alias("table_name"), "rows", F.inline("columns"))
    missing = F.col("rows") - F.col("present")
    return one.select(*KEYS, F.col("rows").alias("total_count"), missing.alias("null_count"),
                      F.coalesce(percent(missing, F.col("rows")), F.lit(0.0)).alias("null_percentage"), F.col("present").alias("non_null_count"))


def present(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("held") > 0)


def by_length(counts: DataFrame) -> DataFrame:
    """(table_name, column_name, length, n, distinct): rows and distinct values per text length, the length of NULLs being -1.

    Whoever reads this reads every column of it, so that one plan holds it once: the counts are
    summed once, however many statistics stand on them.  The length is never NULL for the same reason.
    """
    return (counts.withColumn("length", F.coalesce("long_length", F.length("value"), F.lit(-1)))
            .groupBy(*KEYS, "length").agg(F.sum("n").alias("n"), F.count_if(F.col("held") > 0).alias("distinct")))


def uniqueness(counts: DataFrame) -> DataFrame:
    """Per column: rows, NULLs, distinct values and duplicates (NULLs left out); no value becomes a text."""
    return uniqueness_of(counts.select(*KEYS, "n", (F.col("held") > 0).cast("bigint").alias("distinct")))


def uniqueness_of(lengths: DataFrame) -> DataFrame:
    """:func:`uniqueness` from rows of :func:`by_length`, where lengths are wanted beside it."""
    base = lengths.groupBy(*KEYS).agg(
        F.sum("n").alias("total_count"),
        F.coalesce(F.sum(F.when(F.col("distinct") == 0, F.col("n"))), F.lit(0)).alias("null_count"),
        F.sum("distinct").alias("unique_count"))
    non_null = F.col("total_count") - F.col("null_count")
    return base.select(
        *KEYS, "total_count", "null_count",
        F.coalesce(percent(F.col("null_count"), F.col("total_count")), F.lit(0.0)).alias("null_percentage"),
        non_null.alias("non_null_count"), "unique_count",
        F.coalesce(percent(F.col("unique_count"), non_null), F.lit(0.0)).alias("unique_percentage"),
        (non_null - F.col("unique_count")).alias("duplicate_count"))


def length_counts(counts: DataFrame) -> DataFrame:
    """(table_name, column_name, length, n): rows per text length."""
    return lengths_of(by_length(counts))


def lengths_of(lengths: DataFrame) -> DataFrame:
    """:func:`length_counts` from rows of :func:`by_length`."""
    return lengths.where(F.col("distinct") > 0).select(*KEYS, "length", "n")


def length_summary(lengths: DataFrame) -> DataFrame:
    """Length minimum, maximum, mean, spread and format consistency per column."""
    n, x = F.col("n").cast("double"), F.col("length").cast("double")
    sums = lengths.groupBy(*KEYS).agg(
        F.min("length").alias("min_length"), F.max("length").alias("max_length"),
        F.count(F.lit(1)).alias("distinct_lengths"), F.sum("n").alias("non_null"),
        F.sum(n * x).alias("s1"), F.sum(n * x * x).alias("s2"))
    size = F.col("non_null").cast("double")
    mean = F.col("s1") / size
    spread = F.greatest(F.col("s2") / size - mean * mean, F.lit(0.0))
    return sums.select(
        *KEYS, "min_length", "max_length", "non_null", "distinct_lengths",
        mean.alias("avg_length"),
        F.sqrt(spread).alias("std_pop_length"),
        F.sqrt(F.try_divide(spread * size, size - 1)).alias("std_length"),
        (1 - F.col("distinct_lengths") / size).alias("format_consistency"))


def text_lengths(df: DataFrame, table: str, columns=None) -> DataFrame:
    """Length statistics of the string columns of one table."""
    names = [f.name for f in fields_of(df, columns, is_text)]
    return length_summary(length_counts(table_counts({table: df}, {table: names})))


def _first(rows: DataFrame, n: Column, value: Column, limit: int, ties: bool = False) -> DataFrame:
    # rank <= limit is planned with a group limit before the shuffle: each task
    # forwards at most `limit` rows per column, and with `ties` those equal to its last one.
    number = F.rank() if ties else F.row_number()
    return rows.withColumn("rank", number.over(Window.partitionBy(*KEYS).orderBy(n, value))).where(F.col("rank") <= limit)


def _ranked(counts: DataFrame, cell_rows: DataFrame | None, limit: int, most: bool) -> DataFrame:
    """The first ``limit`` values per column: by count and value, the greatest counts and
    least values first, or (without ``most``) the other way round.

    Long texts are ranked by their first characters first, which cannot contradict the order of the whole texts; only
    those that may still be among the first are read again, and ranked by the whole text.  Texts that occur once, the
    usual ties, are cut to ``limit`` a task before any of them is shuffled.
    """
    n, value = (F.desc("n"), F.asc("order")) if most else (F.asc("n"), F.desc("order"))
    # short and long texts under one name, so that both branches below read the same columns and share the sort
    named = present(counts).select(*KEYS, "n", F.coalesce("value", "head").alias("order"), F.coalesce("value", "digest").alias("text"),
                                   F.col("digest").isNotNull().alias("long"))
    candidates = _first(named, n, value, limit, ties=True)
    if cell_rows is None:
        return _first(candidates.withColumn("value", F.col("order")), n, value, limit).select(*KEYS, "rank", "value", "n")
    short = candidates.where(~F.col("long")).select(*KEYS, "n", F.col("text").alias("value"))
    long = candidates.where("long").select(*KEYS, F.col("text").alias("digest"), "n")
    texts = cell_rows.where(F.length("value") > SHORT).withColumn("digest", F.md5("value"))
    # no hint: as many digests as texts tie with equal first characters
    once = texts.join(long.where("n = 1"), [*KEYS, "digest"]).withColumn("order", F.col("value"))
    once = _first(once, n, value, limit).select(*KEYS, "n", "value")
    often = texts.join(long.where("n > 1"), [*KEYS, "digest"]).groupBy(*KEYS, "digest", "n").agg(F.min("value").alias("value"))
    every = short.unionByName(once).unionByName(often.select(*KEYS, "n", "value")).withColumn("order", F.col("value"))
    return _first(every, n, value, limit).select(*KEYS, "rank", "value", "n")


def most_frequent(counts: DataFrame, cell_rows: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """(table_name, column_name, rank, value, n): count descending, then value ascending, for texts of every length.

    Without ``cell_rows`` long texts are ranked and shown by their first ``SHORT`` characters."""
    return _ranked(counts, cell_rows, limit, True)


def least_frequent(counts: DataFrame, cell_rows: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """The last values of the descending order; rank 1 is the very last."""
    return _ranked(counts, cell_rows, limit, False)


def least_kept(unique_count: Column) -> Column:
    """How many least frequent values are reported: 10 of more than 20 distinct, else up to 5."""
    return F.when(unique_count > 20, F.lit(10)).otherwise(F.least(F.lit(5), unique_count)).cast("int")


def _with_share(ranked: DataFrame, stats: DataFrame) -> DataFrame:
    return (ranked.join(F.broadcast(stats.select(*KEYS, "non_null_count", "unique_count")), KEYS)  # one row per column
            .withColumn("percentage", percent(F.col("n"), F.col("non_null_count"))))


def top_values(counts: DataFrame, stats: DataFrame, cell_rows: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """Most frequent values per column with their share of the present values."""
    return _with_share(most_frequent(counts, cell_rows, limit), stats).drop("non_null_count", "unique_count")


def least_values(counts: DataFrame, stats: DataFrame, cell_rows: DataFrame | None = None) -> DataFrame:
    """Least frequent values per column with their share of the present values."""
    rare = _with_share(least_frequent(counts, cell_rows), stats)
    return rare.where(F.col("rank") <= least_kept(F.col("unique_count"))).drop("non_null_count", "unique_count")

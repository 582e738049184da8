"""Many tables at once: unions of per-table metric plans, failures kept apart."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakegauge.functions.exprs import KEYS
from lakegauge.operators import numeric as nu, values as va
from lakegauge.sources.work import fresh_path


def union_tables(metric: Callable, tables: dict[str, DataFrame], **options) -> DataFrame:
    """``metric(df, name)`` of every table as one DataFrame (one Spark job for all)."""
    out = None
    for name, df in tables.items():
        one = metric(df, name, **options)
        out = one if out is None else out.unionByName(one)
    return out


def _basic(tables: dict[str, DataFrame]) -> DataFrame:
    """Counts and moments of every column; values and numbers of all tables share two
    shuffles, keyed by table and column."""
    stats = va.uniqueness(va.table_counts(tables))
    numeric = nu.moments(union_tables(nu.numbers, tables)).drop("non_null_count")
    return (stats.join(F.broadcast(numeric), KEYS, "left")  # proven bound: one row per column
            .withColumn("failed", F.lit(False)).withColumn("error", F.lit(None).cast("string")))


def _with_errors(out: DataFrame | None, errors: dict[str, str], spark: SparkSession) -> DataFrame | None:
    if not errors:
        return out
    bad = spark.createDataFrame(list(errors.items()), "table_name string, error string").withColumn("failed", F.lit(True))
    return bad if out is None else out.unionByName(bad, allowMissingColumns=True)


def _reason(problem: Exception) -> str:
    named = problem.getCondition() if isinstance(problem, PySparkException) else None
    return named or type(problem).__name__


def profile_all(loaders: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """Basic profile of every table in one plan; a table that cannot be loaded becomes an
    error row.  A table that fails while its rows are read fails the whole plan:
    :func:`profile_each` keeps such tables apart."""
    tables, errors = {}, {}
    for name, load in loaders.items():
        try:
            tables[name] = load()
        except PySparkException as problem:
            errors[name] = _reason(problem)
    return _with_errors(_basic(tables) if tables else None, errors, SparkSession.getActiveSession())


def profile_each(spark: SparkSession, loaders: dict[str, Callable[[], DataFrame]], workers: int = 4) -> DataFrame:
    """Basic profile of every table, each by jobs of its own; a table that fails, while it is
    loaded or while its rows are read, becomes an error row and the others are kept.

    ``workers`` tables run at a time.  The jobs of a table carry the tag
    ``profile-<table>`` (commas become underscores), by which ``spark.interruptTag`` ends
    them alone; an ended table is an error row too.  Profiles meet in the scratch folder,
    not on the driver.
    """
    def run(name):
        tag = "profile-" + name.replace(",", "_")
        spark.addTag(tag)
        try:
            path = fresh_path(spark, "profile")
            profile = _basic({name: loaders[name]()})
            profile.write.parquet(path)
            return name, path, profile.schema, None
        except (PySparkException, Py4JJavaError) as problem:
            return name, None, None, _reason(problem)
        finally:
            spark.removeTag(tag)

    with ThreadPoolExecutor(workers) as pool:
        done = list(pool.map(run, loaders))
    errors = {name: error for name, path, _, error in done if path is None}
    out = None
    for _, path, schema, _ in done:
        if path is not None:
            one = spark.read.schema(schema).parquet(path)
            out = one if out is None else out.unionByName(one)
    return _with_errors(out, errors, spark)

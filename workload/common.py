"""Table layout of the test data and helpers for writing long-form SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int",
                 "c_acctbal": "double", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string",
             "p_size": "int", "p_retailprice": "double"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
               "o_totalprice": "double", "o_orderdate": "timestamp", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
                 "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
                 "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp"},
    "events": {"event_id": "bigint", "ts": "timestamp", "user_id": "bigint", "event_type": "string",
               "value": "double", "props": "string"},
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "embeddings": {"vec_id": "bigint", "embedding": "array", "label": "int"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
}
NUMERIC = {"int", "bigint", "double"}


_schemas: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan; the schema is read from the file once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def lake(spark: SparkSession, sf_dir: str, names=tuple(TABLES)) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


def columns(name: str, kinds=None) -> list[str]:
    return [c for c, k in TABLES[name].items() if kinds is None or k in kinds]


def union_all(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def per_column(template: str, cols: dict[str, list[str]]) -> str:
    """One SELECT per (table, column), with {t} and {c} filled in."""
    return union_all(template.format(t=t, c=c) for t, cs in cols.items() for c in cs)


# planted columns: the same text is used in Spark and in DuckDB
PLANTED_CUSTOMER = {
    "seg_null60": "case when c_custkey % 10 < 6 then null else c_mktsegment end",
    "seg_null30": "case when c_custkey % 10 < 3 then null else c_mktsegment end",
    "note": "case when c_custkey % 4 = 0 then '  ' when c_custkey % 4 = 1 then 'N/A' else c_name end",
    "email": "concat('user', cast(c_custkey as string), '@example.com')",
    "phone": "concat('555-', lpad(cast(c_custkey % 1000 as string),3,'0'), '-', lpad(cast(c_custkey % 10000 as string),4,'0'))",
    "ssn": "concat(lpad(cast(c_custkey % 1000 as string),3,'0'), '-12-', lpad(cast(c_custkey % 10000 as string),4,'0'))",
    "num_text": "case when c_custkey % 50 = 0 then 'x' else cast(c_custkey as string) end",
    "all_null": "cast(null as double)",
    "constant_col": "cast(1.5 as double)",
}
PLANTED_ORDERS = {
    "order_day": "substr(cast(o_orderdate as string),1,10)",
    "date_key": "replace(substr(cast(o_orderdate as string),1,10),'-','')",
    "part_spec": "concat('date_key=', replace(substr(cast(o_orderdate as string),1,10),'-',''), '/status=', o_orderstatus)",
}


def planted_sql(base: str, extra: dict[str, str]) -> str:
    return f"select *, {', '.join(f'{e} as {n}' for n, e in extra.items())} from {base}"


def planted_customer(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("*", *[f"{e} as {n}" for n, e in PLANTED_CUSTOMER.items()])


def planted_orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("*", *[f"{e} as {n}" for n, e in PLANTED_ORDERS.items()])


CUSTOMER_SQL = planted_sql("customer", PLANTED_CUSTOMER)
ORDERS_SQL = planted_sql("orders", PLANTED_ORDERS)
CUSTOMER_COLUMNS = {**TABLES["customer"], **{n: "string" for n in PLANTED_CUSTOMER},
                    "all_null": "double", "constant_col": "double"}


def rounded(df: DataFrame, places: int = 4, keep=()) -> DataFrame:
    """Doubles rounded, so that two engines can be compared."""
    return df.select(*[(F.round(c, places) if t == "double" and c not in keep else F.col(c)).alias(c)
                       for c, t in df.dtypes])


def as_money(array_column: str):
    """An array of doubles as text with two decimals."""
    return F.array_join(F.transform(array_column, lambda x: F.round(x, 2).cast("decimal(18,2)").cast("string")), ",")

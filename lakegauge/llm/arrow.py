"""Helpers for row-wise Arrow functions: extra output columns beside untouched input columns."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def importable(df: DataFrame) -> DataFrame:
    """Lets Python workers on this machine import the package from where the driver did; on a cluster it is installed
    or shipped with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", root)
    return df


def tokens(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space of a UTF-8 text, A-Z lower-cased."""
    return text.translate(LOWER).split() if text else []


def with_columns(docs: DataFrame, inputs: list[str], make, added: StructType, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the columns that ``make(*python values of a row)`` returns as a tuple.
    Input columns with the names of added ones are replaced; ``inputs`` are expressions and are not returned."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added.names]
    frame = docs.select(*[f"`{c}`" for c in kept]).select("*") if not inputs else docs.selectExpr(
        *[f"`{c}`" for c in kept], *[f"{e} as `__in{i}`" for i, e in enumerate(inputs)])
    arrow = to_arrow_schema(added)

    def run(batches):
        work = make() if getattr(make, "per_task", False) else make
        for batch in batches:
            n = len(kept)
            values = [batch.column(n + i).to_pylist() for i in range(len(inputs))]
            rows = [work(*v) for v in zip(*values)]
            columns = list(zip(*rows)) if rows else [[] for _ in added.names]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(n)] + [pa.array(c, f.type) for c, f in zip(columns, arrow)],
                names=kept + added.names)

    return importable(frame).mapInArrow(run, StructType([docs.schema[c] for c in kept] + added.fields))

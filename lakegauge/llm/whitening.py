"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its triangular factor.

Entries become whole numbers, so counts, sums and scatters are exact and do not depend on how rows are dealt: values are
centred by the rounded mean before they are multiplied, blocks are multiplied by matrix products that stay below 2^53,
and the rest of the mean (under a half) is taken out of the sums, which are whole numbers again.  The scatter, one
number a pair of dimensions, is factored with diagonal pivoting as L L'; plane rotations make the columns of L
orthogonal.  Their squared norms are the eigenvalues and the normed columns the components.  Matrices of dimension by
dimension are all that the driver sees.  Three passes over the table: sums, scatter, and the spread of the whitened rows.

Defined cases: rows whose vector is null or holds null or non-finite entries are left out; a shorter vector counts as
padded with zeros up to the longest; an empty table has no rows in the result; directions without spread (a pivot or
eigenvalue below ``RANK`` of the greatest) have no component, so a table of equal vectors has none; repeated rows and
null ids count each as a row.  A deviation beyond 64 bits is null in the query and whole in ``deviation_text``.
A result column replaces one of its name; extra columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakegauge.llm.arrow import importable

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
RANK = 1e-11
BLOCK = 4096
LIMIT = 1 << 62


@dataclass
class Whitening:
    """What the fit keeps: counts, exact sums, and at most dims x dims numbers."""
    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray  # one column a component
    trace: float


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and vector (array<double>) of the rows that take part."""
    vector = F.col(f"`{vector_col}`")
    fine = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(fine).select(F.col(f"`{id_col}`").alias("id"), vector.cast("array<double>").alias("v"))


def _matrix(column: pa.Array, dims: int, scale: int, shift: int) -> np.ndarray:
    """Whole numbers of a batch of vectors, padded to ``dims``."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.full((len(column), dims), float(shift))
    out[np.arange(dims)[None, :] < lengths[:, None]] = np.floor(scale * values) + shift
    if len(values) and np.abs(out).max() >= 2.0 ** 53:
        raise ValueError("an entry is too large for a whole number of 53 bits")
    return out.astype(np.int64)


def _blocks(batches, dims, scale, shift):
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            yield part, _matrix(part.column(part.schema.get_field_index("v")), dims, scale, shift)


def exact_scatter(z: np.ndarray) -> list[list[int]]:
    """Whole-number z' z: in floating point where no sum can pass 2^53, in Python's whole numbers else."""
    most = int(np.abs(z).max()) if z.size else 0
    if most * most * max(len(z), 1) < 1 << 53:
        f = z.astype(np.float64)
        return [[int(x) for x in row] for row in f.T @ f]
    o = z.astype(object)
    return [list(row) for row in o.T @ o]


def _summed(rows: DataFrame, make, schema: str, keys: list[str]) -> list:
    """Exact totals of whole numbers that tasks give as text (whole numbers have no limit in Python)."""
    parts = importable(rows).mapInArrow(make, schema)
    return parts.groupBy(*keys).agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("value")).collect()


def fit(rows: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """The whitening of rows of :func:`usable`; None for none."""
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    if not dims:
        return None

    def sums(batches):
        total, n = [0] * dims, 0
        for _, x in _blocks(batches, dims, scale, shift):
            total = [a + int(b) for a, b in zip(total, x.astype(object).sum(0) if np.abs(x).max() * len(x) >= LIMIT else x.sum(0))]
            n += len(x)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, dims), pa.int32()), "value": [str(n), *map(str, total)]})

    got = {r["i"]: int(r["value"]) for r in _summed(rows, sums, "i int, value string", ["i"])}
    n, s = got.pop(-1), [got[i] for i in range(dims)]
    middle = np.array([round_half_up(x, n) for x in s], dtype=np.int64)

    def scatter(batches):
        total = np.zeros((dims, dims), dtype=object)
        for _, x in _blocks(batches, dims, scale, shift):
            total += np.array(exact_scatter(x - middle), dtype=object).reshape(dims, dims)
        i, j = np.triu_indices(dims)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()),
                                          "value": [str(v) for v in total[i, j]]})

    v = np.zeros((dims, dims))
    rest = [x - n * int(m) for x, m in zip(s, middle)]  # of the sums, once the rounded mean is out
    for r in _summed(rows, scatter, "i int, j int, value string", ["i", "j"]):
        i, j = r["i"], r["j"]
        # n^2 times the covariance is a whole number; one rounding to the nearest double
        v[i, j] = v[j, i] = (n * int(r["value"]) - rest[i] * rest[j]) / (n * n)
    values, vectors = decompose(v)
    return Whitening(n, s, values, vectors, float(np.trace(v)))


def round_half_up(a: int, b: int) -> int:
    return (2 * a + b) // (2 * b)


def pivoted_cholesky(v: np.ndarray, tolerance: float = RANK) -> np.ndarray:
    """L with L L' = v (rows in the order of ``v``): the largest remaining diagonal entry is the next pivot."""
    rest, columns = v.astype(np.float64).copy(), []
    first = rest.diagonal().max() if len(v) else 0.0
    while len(columns) < len(v):
        p = int(rest.diagonal().argmax())
        if rest[p, p] <= tolerance * first or rest[p, p] <= 0:
            break
        column = rest[:, p] / np.sqrt(rest[p, p])
        rest -= np.outer(column, column)
        rest[p, :] = rest[:, p] = 0.0
        columns.append(column)
    return np.array(columns).T if columns else np.zeros((len(v), 0))


def jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor with its columns turned pairwise until all are orthogonal; half of the columns meet the others at once."""
    a = factor.copy()
    n = a.shape[1]
    seats = list(range(n)) + [-1] * (n % 2)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(x, y) for x, y in zip(seats[:half], reversed(seats[half:])) if x >= 0 and y >= 0]
            p, q = np.array([x for x, _ in pairs], int), np.array([y for _, y in pairs], int)
            left, right = a[:, p], a[:, q]
            alpha, beta, gamma = (left * left).sum(0), (right * right).sum(0), (left * right).sum(0)
            size = np.sqrt(alpha * beta)
            off = np.divide(np.abs(gamma), size, out=np.zeros_like(size), where=size > 0)
            worst = max(worst, float(off.max(initial=0.0)))
            turn = off > 1e-16
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            s = c * t
            a[:, p], a[:, q] = c * left - s * right, s * left + c * right
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if worst < 1e-15:
            break
    return a


def decompose(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a positive semidefinite matrix, without those at zero."""
    a = jacobi(pivoted_cholesky(v))
    norms = np.sqrt((a * a).sum(0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] ** 2 > RANK * (norms.max(initial=0.0) ** 2)]
    vectors = a[:, order] / norms[order]
    # either sign is right; the largest entry is made positive so that reruns agree
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))]) if len(order) else np.ones(0)
    return norms[order] ** 2, vectors * signs


def project(x: np.ndarray, w: Whitening, k: int) -> np.ndarray:
    """Whitened rows of whole-number vectors: centred, projected, over the root of the eigenvalue."""
    middle = np.array([round_half_up(s, w.n) for s in w.sums], dtype=np.int64)
    rest = np.array([(s - w.n * int(m)) / w.n for s, m in zip(w.sums, middle)])
    return ((x - middle) - rest) @ (w.components[:, :k] / np.sqrt(w.eigenvalues[:k]))


def identity_error(rows: DataFrame, w: Whitening, k: int, scale: int = SCALE, shift: int = SHIFT) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity: one pass."""
    dims = len(w.sums)

    def sums(batches):
        total, square = np.zeros(k), np.zeros((k, k))
        for _, x in _blocks(batches, dims, scale, shift):
            y = project(x, w, k)
            total, square = total + y.sum(0), square + y.T @ y
        yield pa.RecordBatch.from_pydict({"one": pa.array([total.tolist() + square.ravel().tolist()], pa.list_(pa.float64()))})

    parts = importable(rows).mapInArrow(sums, "one array<double>").select(F.posexplode("one").alias("i", "x"))
    flat = np.zeros(k + k * k)
    for r in parts.groupBy("i").agg(F.sum("x").alias("x")).collect():
        flat[r["i"]] = r["x"]
    mean, square = flat[:k] / w.n, flat[k:].reshape(k, k) / w.n
    # the rows are centred before they are multiplied; what is left of the mean is of the order of rounding
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def deviations(x: np.ndarray, w: Whitening) -> list[int]:
    """Exact sum over the dimensions of (n x - S)^2."""
    bound = w.n * int(np.abs(x).max()) + max(abs(s) for s in w.sums) if x.size else 0
    if bound < LIMIT:
        d = w.n * x - np.array(w.sums, dtype=np.int64)
        if int(np.abs(d).max(initial=0)) ** 2 * x.shape[1] < LIMIT:
            return (d * d).sum(1).tolist()
    d = w.n * x.astype(object) - np.array(w.sums, dtype=object)
    return [int(v) for v in (d * d).sum(1)]


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """id, component (from 1), n, deviation_text, whitened, explained, identity_error: a row a vector and component."""
    rows = usable(df, id_col, vector_col)
    schema = f"id {dict(rows.dtypes)['id']}, component int, n bigint, deviation_text string, whitened double, explained double, identity_error double"
    w = fit(rows, scale, shift)
    k = 0 if w is None else min(components, len(w.eigenvalues))
    if not k:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    dims, error = len(w.sums), identity_error(rows, w, k, scale, shift)
    shares = w.eigenvalues[:k] / w.trace

    def run(batches):
        for part, x in _blocks(batches, dims, scale, shift):
            m = len(x)
            at = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_pydict({
                "id": part.column(part.schema.get_field_index("id")).take(pa.array(at)),
                "component": pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                "n": pa.array(np.full(m * k, w.n), pa.int64()),
                "deviation_text": pa.array([str(d) for d in deviations(x, w)], pa.string()).take(pa.array(at)),
                "whitened": project(x, w, k).ravel(),
                "explained": np.tile(shares, m), "identity_error": np.full(m * k, error)})

    return importable(rows).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op13_whiten(spark, sf_dir) -> DataFrame:
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "component", "n", F.expr("try_cast(deviation_text as bigint)").alias("deviation"),
                        "whitened", "explained", "identity_error")

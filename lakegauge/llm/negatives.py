"""Hard-negative mining with angular triangle filtering.

Every row stores its angles to a few reference directions: the mean directions of the most frequent labels, and fixed sign
patterns.  By the triangle inequality on the sphere the angle of two vectors lies between |a - b| and
min(a + b, 2 pi - a - b) for their angles a, b to any one direction, which bounds the cosine and, times the norms, the
inner product; the bounds are widened by more than rounding can move them.  Rows are range-sorted by their nearest
direction and the angle to it and packed into blocks, each with the hulls of its angles and norms.  Anchors, the stated
query set, come in blocks of a bounded number that are broadcast one after the other; a task streams row blocks past
them, and only anchors whose score window overlaps the bounds of a block are scored there, over the rows whose angle
lies in reach, by whole-number products.  A task's running fifth best score narrows the windows further.

Two searches an anchor block: positives (best rows of the same label), then negatives (rows of other labels whose score
lies in the window of a positive).  Each task hands on its best few rows an anchor and positive, and a window function
merges them, so what is shuffled does not grow with the groups.

Defined cases: rows whose label or vector is null, or whose vector holds a null or non-finite component, take no part;
a shorter vector counts as padded with zeros; an empty vector has norm 0 and score 0 with all.  Repeated rows are rows of
their own: an anchor's copy is one of its other rows, and a repeated anchor is mined once a row.  A row without an id
takes part and comes last in ties (2^63 - 1 is no id).  No rows or anchors give an empty result.  A score that does not
fit 64 bits is refused with an error.  Extra columns are not carried.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from lakegauge.llm.arrow import importable
from lakegauge.sources.work import dropped, fresh_path, written

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100  # percent of the positive's score
LABEL_DIRECTIONS, SIGN_DIRECTIONS = 12, 4
ROWS_A_BLOCK, ANCHORS_A_BLOCK = 1024, 4096
ROW_TASKS = 16  # tasks that share the rows of one anchor block; more blocks run at once on a larger cluster
NO_ID = (1 << 63) - 1
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9  # radians; share of the norms' product
MOST, LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def usable(df: DataFrame, id_col: str, vector_col: str, label_col: str, anchor: Column) -> DataFrame:
    """id, label, anchor, v (array<double>) of the rows that take part."""
    v, label = F.col(f"`{vector_col}`"), F.col(f"`{label_col}`")
    fine = label.isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(fine).select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NO_ID)).alias("id"),
                                  label.cast("bigint").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
                                  v.cast("array<double>").alias("v"))


def whole_numbers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * component) of a batch of vectors, padded with zeros to ``dims``."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims))
    out[np.arange(dims)[None, :] < lengths[:, None]] = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False))
    if out.size and np.abs(out).max() >= 2.0 ** 62:
        raise ValueError("a component is too large for scores of 64 bits")
    return out.astype(np.int64)


def directions(rows: DataFrame, dims: int, labels: int = LABEL_DIRECTIONS, signs: int = SIGN_DIRECTIONS) -> np.ndarray:
    """Unit reference directions, at most ``labels + signs``: any choice gives right bounds."""
    common = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(labels)

    def sums(batches):
        total = {}
        for batch in batches:
            x = whole_numbers(batch.column(1), dims, SCALE).astype(np.float64)
            named = batch.column(0).to_numpy(zero_copy_only=False)
            for label in np.unique(named):
                total[label] = total.get(label, 0.0) + x[named == label].sum(0)
        yield pa.RecordBatch.from_pydict({"label": pa.array(list(total), pa.int64()),
                                          "s": pa.array([list(v) for v in total.values()], pa.list_(pa.float64()))})

    wanted = rows.join(F.broadcast(common.select("label")), "label", "left_semi")  # at most `labels` rows
    parts = importable(wanted.select("label", "v")).mapInArrow(sums, "label bigint, s array<double>")
    found = np.zeros((labels, dims))
    each = parts.select("label", F.posexplode("s").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x")).collect()
    order = {label: i for i, label in enumerate(sorted({r["label"] for r in each}))}
    for r in each:
        found[order[r["label"]], r["i"]] = r["x"]
    patterns = np.array([[1.0 if (d >> s) & 1 else -1.0 for d in range(dims)] for s in range(signs)]).reshape(signs, dims)
    every = np.concatenate([found, patterns])
    norms = np.linalg.norm(every, axis=1)
    return every[norms > 0] / norms[norms > 0][:, None]


def angles_to(x: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to the directions (a right angle for a vector of norm 0), of whole-number rows."""
    f = x.astype(np.float64)
    norms = np.sqrt((f * f).sum(1))
    cosines = np.divide(f @ refs.T, norms[:, None], out=np.zeros((len(f), len(refs))), where=norms[:, None] > 0)
    return norms, np.arccos(np.clip(cosines, -1.0, 1.0))


BLOCK = "rows binary, ids binary, labels binary, anchors binary, first bigint, wide boolean, cell int, least_angle array<double>, most_angle array<double>, least_norm double, most_norm double"


@dataclass
class Rows:
    """Rows of one block, or anchors."""
    x: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    numbers: np.ndarray
    norms: np.ndarray
    angles: np.ndarray

    def at(self, chosen) -> "Rows":
        return Rows(*[a[chosen] for a in (self.x, self.ids, self.labels, self.numbers, self.norms, self.angles)])


def packed(rows: DataFrame, dims: int, refs: np.ndarray, scale: int = SCALE, size: int = ROWS_A_BLOCK) -> DataFrame:
    """Blocks of rows that are neighbours by nearest direction and angle, written to the shared folder."""
    def placed(batches):
        for batch in batches:
            _, angle = angles_to(whole_numbers(batch.column(3), dims, scale), refs)
            cell = angle.argmin(1) if len(refs) else np.zeros(len(angle), int)
            near = angle[np.arange(len(angle)), cell] if len(refs) else np.zeros(len(angle))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(near, pa.float64())],
                                             names=[*batch.schema.names, "cell", "near"])

    spread = importable(rows.select("id", "label", "anchor", "v")).mapInArrow(
        placed, "id bigint, label bigint, anchor boolean, v array<double>, cell int, near double")
    ordered = spread.repartitionByRange("cell", "near", "id").sortWithinPartitions("cell", "near", "id")

    def pack(batches):
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 40
        waiting: list[pa.RecordBatch] = []

        def block(table, cell):
            nonlocal number
            x = whole_numbers(table["v"].combine_chunks(), dims, scale)
            norms, angle = angles_to(x, refs)
            wide = bool(len(x) and np.abs(x).max() >= 1 << 31)
            out = {"rows": x.astype(np.int64 if wide else np.int32).tobytes(),
                   "ids": table["id"].to_numpy().astype(np.int64).tobytes(), "labels": table["label"].to_numpy().astype(np.int64).tobytes(),
                   "anchors": table["anchor"].to_numpy().astype(np.int8).tobytes(), "first": number, "wide": wide, "cell": cell,
                   "least_angle": angle.min(0).tolist(), "most_angle": angle.max(0).tolist(),
                   "least_norm": float(norms.min()), "most_norm": float(norms.max())}
            number += len(x)
            return pa.RecordBatch.from_pylist([out], schema=pa.schema([
                ("rows", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()), ("anchors", pa.binary()), ("first", pa.int64()),
                ("wide", pa.bool_()), ("cell", pa.int32()), ("least_angle", pa.list_(pa.float64())),
                ("most_angle", pa.list_(pa.float64())), ("least_norm", pa.float64()), ("most_norm", pa.float64())]))

        def pieces(flush):
            nonlocal waiting
            if not waiting:
                return
            table = pa.Table.from_batches(waiting)
            cells = table["cell"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for a, b in zip(edges, edges[1:]):
                last = b == len(cells) and not flush
                while b - a >= size or (a < b and not last):
                    yield block(table.slice(a, min(size, b - a)), int(cells[a]))
                    a = min(a + size, b)
            waiting = table.slice(a).to_batches() if a < len(cells) else []

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= size:
                yield from pieces(False)
        yield from pieces(True)

    return written(importable(ordered).mapInArrow(pack, BLOCK), "blocks")


def unpacked(r: dict, dims: int, refs: np.ndarray) -> tuple[Rows, np.ndarray]:
    x = np.frombuffer(r["rows"], np.int64 if r["wide"] else np.int32).reshape(-1, dims).astype(np.int64)
    ids, labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
    norms, angle = angles_to(x, refs)
    return (Rows(x, ids, labels, r["first"] + np.arange(len(ids)), norms, angle), np.frombuffer(r["anchors"], np.int8).astype(bool))


def score_bounds(anchor_norms, anchor_angles, least_angle, most_angle, least_norm, most_norm):
    """Bounds on the score of each anchor with any row of a block: arrays of least and greatest values."""
    if len(least_angle):
        apart = np.maximum(anchor_angles - most_angle, least_angle - anchor_angles).max(1, initial=0.0)
        together = np.minimum(anchor_angles + most_angle, 2 * math.pi - anchor_angles - least_angle).min(1, initial=math.pi)
    else:
        apart, together = np.zeros(len(anchor_norms)), np.full(len(anchor_norms), math.pi)
    top = np.cos(np.maximum(apart - ANGLE_SLACK, 0.0))
    bottom = np.cos(np.minimum(together + ANGLE_SLACK, math.pi))
    slack = SCORE_SLACK * anchor_norms * most_norm + SCORE_SLACK
    greatest = anchor_norms * np.where(top >= 0, most_norm, least_norm) * top + slack
    least = anchor_norms * np.where(bottom >= 0, least_norm, most_norm) * bottom - slack
    return least, greatest


def reach(anchor_norms, anchor_angles, needed, most_norm):
    """Least and greatest angle to one direction that a row of at most this norm can have at a score of ``needed``."""
    size = anchor_norms * most_norm
    share = np.divide(needed - SCORE_SLACK * size - SCORE_SLACK, size, out=np.full(len(size), -1.0), where=size > 0)
    widest = np.where(share <= 0, math.pi, np.arccos(np.clip(share, 0.0, 1.0))) + ANGLE_SLACK
    return anchor_angles - widest, anchor_angles + widest


def products(x: np.ndarray, y: np.ndarray, most: float) -> np.ndarray:
    """Exact whole-number inner products; ``most`` bounds them (norms, widened)."""
    if most < 2.0 ** 52:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    if most >= 2.0 ** 62:
        raise ValueError("a score does not fit 64 bits")
    return x @ y.T


class Search:
    """Best rows of a block of anchors, within windows of scores, over a stream of row blocks."""

    def __init__(self, anchors: Rows, tops: np.ndarray, bottoms: np.ndarray, count: int, same: bool):
        self.anchors, self.tops, self.count, self.same = anchors, tops, count, same
        self.bottoms = bottoms.copy()
        self.parts: list[tuple] = []
        self.waiting = self.scored = 0

    def block(self, rows: Rows, cell: int, least_angle, most_angle, least_norm, most_norm) -> None:
        a = self.anchors
        needed, allowed = self.bottoms.min(1), self.tops.max(1)
        least, greatest = score_bounds(a.norms, a.angles, np.asarray(least_angle), np.asarray(most_angle), least_norm, most_norm)
        active = np.flatnonzero((greatest >= needed) & (least <= allowed) & (needed <= allowed))
        if not len(active):
            return
        first, last = 0, len(rows.ids)
        if len(least_angle):
            near = rows.angles[:, cell]  # ascending within the block, but for the last bits
            low, high = reach(a.norms[active], a.angles[active, cell], needed[active].astype(np.float64), most_norm)
            hit = np.flatnonzero((near >= low.min()) & (near <= high.max()))
            if not len(hit):
                return
            first, last = hit[0], hit[-1] + 1
        part = rows.at(slice(first, last))
        scores = products(part.x, a.x[active], float(a.norms[active].max() * most_norm) * 1.001)
        self.scored += scores.size
        fits = (scores >= needed[active]) & (scores <= allowed[active])
        fits &= (part.labels[:, None] == a.labels[active]) == self.same
        i, j = np.nonzero(fits)
        if self.same:
            other = part.numbers[i] != a.numbers[active][j]
            i, j = i[other], j[other]
        if len(i):
            self.parts.append((active[j], scores[i, j], part.ids[i], part.numbers[i]))
            self.waiting += len(i)
        if self.waiting > 50_000:
            self.reduce()

    def reduce(self) -> list[np.ndarray]:
        """Keeps the first rows of every window; their places, a window each."""
        if not self.parts:
            return [np.zeros(0, int)] * self.tops.shape[1]
        who, score, ids, numbers = (np.concatenate(p) for p in zip(*self.parts))
        order = np.lexsort((numbers, ids, -score, who))
        who, score, ids, numbers = who[order], score[order], ids[order], numbers[order]
        start = np.searchsorted(who, who)  # of the anchor's rows
        chosen = []
        for w in range(self.tops.shape[1]):
            inside = (score <= self.tops[who, w]) & (score >= self.bottoms[who, w])
            upto = np.cumsum(inside)
            rank = upto - np.where(start > 0, upto[start - 1], 0)
            chosen.append(inside & (rank <= self.count))
            full = chosen[w] & (rank == self.count)
            self.bottoms[who[full], w] = np.maximum(self.bottoms[who[full], w], score[full])
        keep = np.logical_or.reduce(chosen)
        self.parts = [(who[keep], score[keep], ids[keep], numbers[keep])]
        self.waiting = 0
        return [np.flatnonzero(c[keep]) for c in chosen]

    def found(self) -> pa.RecordBatch:
        chosen = self.reduce()
        who, score, ids, numbers = self.parts[0] if self.parts else [np.zeros(0, np.int64)] * 4
        at = np.concatenate(chosen)
        window = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])
        return pa.RecordBatch.from_pydict({
            "anchor": self.anchors.numbers[who[at]].astype(np.int64), "window": window.astype(np.int32), "score": score[at].astype(np.int64),
            "id": ids[at].astype(np.int64), "number": numbers[at].astype(np.int64)})


def searched(blocks: DataFrame, dims: int, refs: np.ndarray, anchors: Rows, tops, bottoms, count: int, same: bool,
             tasks: int = ROW_TASKS) -> DataFrame:
    """anchor, window, score, id, number: the first ``count`` rows of every window of every anchor, a task each."""
    shared = blocks.sparkSession.sparkContext.broadcast((anchors, tops, bottoms, refs))  # at most ANCHORS_A_BLOCK anchors

    def run(batches):
        them, high, low, directions_ = shared.value
        search = Search(them, high, low, count, same)
        for batch in batches:
            for r in batch.to_pylist():
                rows, _ = unpacked(r, dims, directions_)
                search.block(rows, r["cell"], r["least_angle"], r["most_angle"], r["least_norm"], r["most_norm"])
        yield search.found()

    few = blocks.coalesce(tasks)
    return importable(few).mapInArrow(run, "anchor bigint, window int, score bigint, id bigint, number bigint")


def merged(found: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "number")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def anchor_blocks(blocks: DataFrame, dims: int, refs: np.ndarray, size: int):
    """Anchors, ``size`` at a time: the driver holds one block and the piece it reads."""
    def pick(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows, anchor = unpacked(r, dims, refs)
                if anchor.any():
                    a = rows.at(anchor)
                    yield pa.RecordBatch.from_pydict({"x": [a.x.tobytes()], "ids": [a.ids.tobytes()], "labels": [a.labels.tobytes()],
                                                      "numbers": [a.numbers.astype(np.int64).tobytes()]})

    def read(r):
        x, ids, labels, numbers = (np.frombuffer(r[c], np.int64) for c in ("x", "ids", "labels", "numbers"))
        x = x.reshape(len(ids), dims)
        return Rows(x, ids, labels, numbers, *angles_to(x, refs))

    def together(some):
        return Rows(*[np.concatenate([getattr(a, f) for a in some]) for f in ("x", "ids", "labels", "numbers", "norms", "angles")])

    waiting, n = [], 0
    for r in importable(blocks).mapInArrow(pick, "x binary, ids binary, labels binary, numbers binary").toLocalIterator():
        waiting.append(read(r))
        n += len(waiting[-1].ids)
        while n >= size:
            every = together(waiting)
            yield every.at(slice(0, size))
            rest = every.at(slice(size, None))
            waiting, n = [rest], len(rest.ids)
    if n:
        yield together(waiting)


def hard_negatives(df: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
                   anchors_a_block: int = ANCHORS_A_BLOCK, rows_a_block: int = ROWS_A_BLOCK, tasks: int = ROW_TASKS) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score."""
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col, label_col, anchor)
    schema = "anchor_id bigint, positive_id bigint, positive_rank int, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    if dims is None:
        return spark.createDataFrame([], schema)
    dims = max(dims, 1)
    refs = directions(rows, dims)
    blocks = packed(rows, dims, refs, scale, rows_a_block)
    path, any_block = fresh_path(spark, "negatives"), False
    at_once = max(1, spark.sparkContext.defaultParallelism // tasks)
    source = anchor_blocks(blocks, dims, refs, anchors_a_block)
    while some := list(itertools.islice(source, at_once)):
        any_block = True
        wide = [(np.full((len(a.ids), 1), MOST), np.full((len(a.ids), 1), LEAST)) for a in some]
        near = union([searched(blocks, dims, refs, a, t, b, positives, True, tasks) for a, (t, b) in zip(some, wide)])
        # bounded: `positives` rows an anchor of the blocks at hand
        best = merged(near, positives).select("anchor", "rank", "score", "id").toPandas()
        jobs = []
        for a in some:
            place = {n: i for i, n in enumerate(a.numbers.tolist())}
            tops, bottoms = np.full((len(a.ids), positives), LEAST), np.full((len(a.ids), positives), MOST)
            mine = best[best["anchor"].isin(place)]
            for n, rank, score in zip(mine["anchor"], mine["rank"], mine["score"]):
                tops[place[n], rank - 1], bottoms[place[n], rank - 1] = high * int(score) // 100, -(-low * int(score) // 100)
            jobs.append(searched(blocks, dims, refs, a, tops, bottoms, negatives, False, tasks))
        ids = {n: i for a in some for n, i in zip(a.numbers.tolist(), a.ids.tolist())}
        pairs = spark.createDataFrame(best.assign(window=best["rank"] - 1, anchor_id=best["anchor"].map(ids)).rename(
            columns={"id": "positive_id", "score": "positive_score"})[["anchor", "window", "anchor_id", "positive_id", "positive_score"]],
            "anchor bigint, window int, anchor_id bigint, positive_id bigint, positive_score bigint")
        known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
        # bounded: the positives of the anchors at hand
        (merged(union(jobs), negatives).join(F.broadcast(pairs), ["anchor", "window"])
         .select(known("anchor_id"), known("positive_id"), (F.col("window") + 1).cast("int").alias("positive_rank"), F.col("rank").cast("int").alias("rank"),
                 F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
         .withColumn("negative_id", F.when(F.col("negative_id") != NO_ID, F.col("negative_id")))
         .write.mode("append").parquet(path))
    dropped(blocks)
    return spark.read.schema(schema).parquet(path) if any_block else spark.createDataFrame([], schema)


def union(frames: list[DataFrame]) -> DataFrame:
    first, *rest = frames
    for f in rest:
        first = first.unionAll(f)
    return first


def op12_hard_negatives(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", "embedding", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0).drop("positive_rank")


ORACLE = f"""
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as l,
             list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v
           from embeddings where label is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.l = b.l as same, list_inner_product(a.v, b.v)::bigint as score
      from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, id) <= {POSITIVES}),
n as (select anchor_id, positive_id, id as negative_id, positive_score, s.score as negative_score,
        row_number() over (partition by anchor_id, positive_id order by s.score desc, id) as k
      from p join s using (anchor_id) where not same and {LOW} * positive_score <= 100 * score and 100 * score <= {HIGH} * positive_score)
select anchor_id, positive_id, k::int as rank, negative_id, positive_score, negative_score from n where k <= {NEGATIVES}
"""

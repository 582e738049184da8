"""Winnowing, hard negatives and whitening against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakegauge.llm import negatives, whitening, winnowing

MASK = (1 << 64) - 1


# ---- winnowing ----

def rolled(text, k):
    """Every run's hash by the rolling step: shift the oldest character out, take the new one in."""
    t = [(ord(c) * winnowing.CHARACTER << winnowing.PLACE_BITS) & MASK for c in text]
    h, out = 0, []
    for i, x in enumerate(t):
        if i >= k:
            h ^= (t[i - k] << (k - 1)) & MASK
        h = ((h << 1) & MASK) ^ x
        if i >= min(k, len(t)) - 1:
            signed = h - (1 << 64) if h >> 63 else h
            out.append((1 << (winnowing.BITS - 1)) - 1 - (signed >> winnowing.PLACE_BITS))
    return out


def chosen(text, k, w):
    hashes = rolled(text, k)
    found = set()
    for s in range(max(1, len(hashes) - w + 1)) if hashes else []:
        window = hashes[s:s + w]
        low = min(window)
        found.add((s + max(i for i, x in enumerate(window) if x == low), low))
    return sorted(found)


def texts(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "ünïcode", "日本語", "x", "😀", "gamma-ray"]
    long = " ".join(rng.choice(words) for _ in range(1200))
    return [None, "", "a", "short one", "z" * 700, long, long[:300], long[100:400] + "!" * 90, "ab" * 200, "exactly-16-chars"]


@pytest.mark.parametrize("k,w,chunk", [(16, 64, 4096), (4, 8, 32), (16, 16, 100)])
def test_fingerprints_equal_a_rolling_loop(spark, monkeypatch, k, w, chunk):
    monkeypatch.setattr(winnowing, "CHUNK", chunk)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts(3))], "doc_id bigint, text string")
    for r in winnowing.fingerprints(df, k=k, w=w).collect():
        assert [(e["at"], e["hash"]) for e in r["entries"]] == chosen(r["text"] or "", k, w), (r["doc_id"], k, w)


@pytest.mark.parametrize("k,w", [(16, 64), (4, 8)])
def test_edited_texts_get_the_fingerprint_of_a_fresh_look(spark, k, w):
    rows = [(10 * i, t) for i, t in enumerate(texts(4))] + [(None, "no id " * 60), (30, "a repeated id " * 20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("entries", F.lit(1)).withColumn("a.b", F.lit(2))
    got = winnowing.edited(df, k=k, w=w).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    following = {r: order[(i + 1) % len(order)] for i, r in enumerate(order)}
    for r in got:
        text = r["text"]
        after = next(v for q, v in following.items() if q[0] == r["doc_id"] and (q[1] or "") == text)[1] or ""
        half = len(text) // 2
        assert r["edited_text"] == text[:len(text) - half] + after[:half]
        assert [(e["at"], e["hash"]) for e in r["edited_entries"]] == chosen(r["edited_text"], k, w)
        assert [(e["at"], e["hash"]) for e in r["next_entries"]] == chosen(after, k, w)


def test_next_rows_over_many_buckets_and_tables_of_none_or_one(spark):
    rows = [(i * 7 % 501, f"t{i}") for i in range(501)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r["other"] for r in winnowing.with_next(df, "doc_id", {"other": "doc_id"}, "text").collect()}
    assert got == {i: (i + 1) % 501 for i in range(501)}
    assert winnowing.edited(df.limit(0)).count() == 0
    one = winnowing.edited(df.filter("doc_id = 3")).first()
    assert one["edited_text"][:1] == one["text"][:1] and len(one["edited_text"]) == len(one["text"])
    a = spark.createDataFrame([([1, 2], [2, 3]), ([], []), ([1], [])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in a.select(winnowing.likeness(F.col("a"), F.col("b"))).collect()] == [1 / 3, 1.0, 0.0]


# ---- hard negatives ----

def mined(rows, positives=5, negatives_=5, low=80, high=100):
    """Every pair scored."""
    use = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows
           if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda s, i: (-s, i if i is not None else 1 << 70)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (anchor, label, v) in enumerate(use):
        if anchor is None or anchor % 100:
            continue
        scored = [(dot(v, u), i, other) for m, (i, other, u) in enumerate(use) if m != n]
        near = sorted([(s, i) for s, i, o in scored if o == label], key=lambda x: key(*x))[:positives]
        for p, (ps, pid) in enumerate(near):
            inside = sorted([(s, i) for s, i, o in scored if o != label and low * ps <= 100 * s <= high * ps], key=lambda x: key(*x))
            out += [(anchor, pid, p + 1, k + 1, i, ps, s) for k, (s, i) in enumerate(inside[:negatives_])]
    return sorted(out, key=str)


def vectors(seed, n=700, dims=12):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(3)]
    rows = []
    for i in range(n):
        c = rng.choice(centres + [[0.0] * dims])
        rows.append((i, rng.randrange(4), [x + rng.gauss(0, 0.3) for x in c]))
    rows += [(rows[i][0], rows[i][1], rows[i][2]) for i in (0, 5, 100)]  # repeated rows, an anchor among them
    rows += [(9000 + i, rng.randrange(4), [1.0] * dims) for i in range(60)]  # ties
    rows += [(None, 1, [0.5] * dims), (9100, None, [1.0] * dims), (9200, 1, None), (9300, 2, [None] * dims), (9400, 2, [float("nan")] * dims),
             (9500, 3, []), (9600, 2, [2.0] * (dims - 4)), (9700, 1, [1000.0] * dims), (9800, 2, [900.0] * dims)]
    return rows


@pytest.mark.parametrize("seed,block,anchors,tasks", [(1, 1024, 4096, 16), (2, 37, 5, 2)])
def test_hard_negatives_equal_every_pair_scored(spark, seed, block, anchors, tasks):
    rows = vectors(seed)
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").withColumn("near", F.lit(0)).repartition(5)
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, rows_a_block=block, anchors_a_block=anchors, tasks=tasks)
    assert sorted(map(tuple, got.collect()), key=str) == mined(rows)


def test_hard_negatives_of_few_rows_and_large_numbers(spark):
    schema = "vec_id bigint, label int, embedding array<double>"
    assert negatives.hard_negatives(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(1, 1, [1.0])], schema), F.col("vec_id") % 100 == 0).count() == 0
    rows = [(0, 1, [1e6, 3.0]), (1, 1, [1e6, 2.0]), (2, 2, [1e6, 1.0]), (3, 2, [9e5, 1.0])]
    got = negatives.hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, got), key=str) == mined(rows) and got


def test_bounds_hold_and_leave_rows_out():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (200, 8)) * 256 + 900, rng.normal(0, 1, (200, 8)) * 256 - 900]).astype(np.int64)
    refs = np.eye(8)[:4] * 0.6 + 0.2
    refs /= np.linalg.norm(refs, axis=1)[:, None]
    norms, angle = negatives.angles_to(x, refs)
    for a, b in ((0, 50), (50, 200), (200, 400)):
        least, greatest = negatives.score_bounds(norms, angle, angle[a:b].min(0), angle[a:b].max(0), norms[a:b].min(), norms[a:b].max())
        s = x @ x[a:b].T
        assert (s.min(1) >= least).all() and (s.max(1) <= greatest).all()
    assert (greatest[:200] < 0).any()  # the far cluster cannot score above 0 with some anchors of the other one


# ---- whitening ----

def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(0, 1, (900, 10)) @ rng.normal(0, 1, (10, 10)) + 5
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    extra = [(None, rows[0][1]), (1, rows[1][1]), (901, None), (902, [None] * 10), (903, [float("inf")] * 10), (904, [1.0] * 6)]
    df = spark.createDataFrame(rows + extra, "vec_id bigint, embedding array<double>").withColumn("n", F.lit(1)).repartition(4)
    got = whitening.whiten(df).toPandas()
    used = [v for _, v in rows] + [rows[0][1], rows[1][1], [1.0] * 6 + [0.0] * 4]
    x = np.floor(1024 * np.array(used)) + 100_000
    c = x - x.mean(0)
    e, u = np.linalg.eigh(c.T @ c / len(x))
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 8 * len(x) and set(got["n"]) == {len(x)} and got["identity_error"].max() < 1e-9
    for k in range(8):
        mine = got[got["component"] == k + 1].sort_values(["vec_id", "whitened"])["whitened"].to_numpy()
        want = c @ u[:, k] / math.sqrt(e[k])
        assert min(np.abs(np.sort(mine) - np.sort(s * want)).max() for s in (1, -1)) < 1e-8
        assert got[got["component"] == k + 1]["explained"].iloc[0] == pytest.approx(e[k] / e.sum(), rel=1e-9)
    whole = (len(x) * x.astype(object) - x.astype(object).sum(0)) ** 2
    assert sorted(int(d) for d in got[got["component"] == 1]["deviation_text"]) == sorted(whole.sum(1))


def test_whitening_of_no_spread_and_of_few_directions(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(20)], schema)
    got = whitening.whiten(flat).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1.0)


def test_jacobi_and_cholesky_of_a_nearly_singular_matrix():
    rng = np.random.default_rng(8)
    a = rng.normal(0, 1, (15, 9))
    v = a @ a.T
    factor = whitening.pivoted_cholesky(v)
    assert factor.shape[1] == 9 and np.allclose(factor @ factor.T, v, atol=1e-10)
    e, u = whitening.decompose(v)
    assert np.allclose(np.sort(e), np.sort(np.linalg.eigvalsh(v))[-9:], rtol=1e-10) and np.allclose(u.T @ u, np.eye(9), atol=1e-10)

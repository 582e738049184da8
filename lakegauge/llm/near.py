"""Near-duplicate groups from bottom-k sketches.

One hash function orders the shingles of ``width`` words (two by default); the ``K`` smallest values of a document are its sketch.  Inverted lists
of retained values generate candidates: the length of each list is known, every document enters the lists of its rarest
values only, as many as a linked pair can be sure to share one of.  For sets up to ``K`` that is certain; beyond, two
sketches of a pair at the threshold share fewer than ``T`` = 25 of 64 values with a probability of 7e-12.  A document with
more private values than it may have is alone at once.  List entries carry 128 bits, one for the smallest value of each bin
of shingles: sets at the threshold differ in more than ``BITS`` of them with a probability of 1e-12, so most chance
meetings end in the join itself.  Full sets are read for the documents of the pairs left only; on their heads, the sketch of
the union estimates the similarity and filters (with the same ``T``), and the exact test decides.

Links are sought until the groups are certain, but not all links inside a group: each open list sends its members to a
leader (later 8, 64, ... leaders), pairs that are already in one group are dropped, a leader leaves its list, and a list
is closed once all its members are in one group.  So a group of near copies meets its first members and not itself.
Equal sets are one class from the start.  All rounds work on written tables; nothing is gathered in one task.

Defined cases: a null text, or one without words, has no shingles, is linked with nothing and is kept; one word is a
shingle by itself; among null and other ids the smallest id that is not null names the group, and a group of null ids
only is named null, with all its documents kept; equal rows get equal results; other columns are ignored.
Shingles are compared by 64-bit hashes, classes of equal sets by 128-bit hashes.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructField, StructType

from lakegauge.llm.arrow import tokens, with_columns
from lakegauge.sources.work import dropped, written

K, T = 64, 25
BITS, BINS = 44, 32
_SALTS = np.array([1, 2, 3, 4], np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # BINS bins for each
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 5)
WIDTH, PERCENT = 2, 80
FASTER = 8  # from round to round, so many times more leaders a list


class Hashes(dict):
    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_known = Hashes()


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of shingles of ``width`` words (of the whole sequence, if it is shorter)."""
    words = tokens(text)
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    size = min(width, len(h))
    n = len(h) - size + 1
    found = mixed(h[size - 1:])
    for i in range(size - 2, -1, -1):
        found = mixed(h[i:i + n] * np.uint64(0x9E3779B97F4A7C15) + found)
    return np.unique(found.view(np.int64))


def set_class(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def signature(found: np.ndarray) -> list[int]:
    """Two numbers of 64 bits: for each bin of each hash the lowest bit of its smallest value, 0 for an empty bin.  Each bin
    whose smallest value two sets share is equal, so sets of similarity J differ in (1 - J) / 2 of the bits at most."""
    bits = np.zeros((len(_SALTS), BINS), np.uint8)
    hashes = np.sort(mixed(found.view(np.uint64) + _SALTS[:, None]), axis=1)
    for row, h in zip(bits, hashes):
        at = np.searchsorted(h, _EDGES)
        filled = np.append(at[1:], len(h)) > at
        row[filled] = h[at[filled]] & np.uint64(1)
    return np.packbits(bits).view(np.int64).tolist()


SKETCH = StructType([StructField("n", LongType()), StructField("cls", BinaryType()), StructField("sketch", ArrayType(LongType())),
                     StructField("s1", LongType()), StructField("s2", LongType())])


def sketches(docs: DataFrame, text_col: str, keep: list[str], width: int = WIDTH) -> DataFrame:
    def make(text):
        found = shingles(text, width)
        return len(found), set_class(found) if len(found) else None, found[:K], *signature(found)

    return with_columns(docs, [f"cast(`{text_col}` as binary)"], make, SKETCH, keep)


def list_quota(n: Column) -> Column:
    """In how many of the rarest of its retained values a set of n must be listed."""
    sure = n - F.ceil(n * PERCENT / 100) + 1
    return F.when(n <= K * PERCENT // 100, sure).otherwise(F.least(n, F.lit(K)) - T + 1)


def listings(classes: DataFrame) -> DataFrame:
    """(value, c, n, s1, s2): inverted lists of the rarest retained values."""
    entries = classes.select("c", F.explode("sketch").alias("value"))
    lengths = entries.groupBy("value").agg(F.count("*").alias("length")).filter("length > 1")
    shared = entries.join(lengths, "value").groupBy("c").agg(F.collect_list(F.struct("length", "value")).alias("lists"))
    shared = shared.join(classes.select("c", "n", "s1", "s2"), "c")
    private = F.least(F.col("n"), F.lit(K)) - F.size("lists")
    quota = (list_quota(F.col("n")) - private).cast("int")
    return shared.filter(quota > 0).select("c", "n", "s1", "s2", F.explode(F.slice(F.sort_array("lists"), F.lit(1), quota)).alias("e")).select(
        F.col("e.value").alias("value"), "c", "n", "s1", "s2")


def similar_bits(a: str, b: str) -> Column:
    differ = lambda s: F.bit_count(F.col(a + s).bitwiseXOR(F.col(b + s)))
    return differ("s1") + differ("s2") <= BITS


def similar_sizes(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def possible(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the sketch of the union, made from the sketches of two sorted sets, leaves room for the threshold."""
    x, y = x[:K], y[:K]
    union = np.union1d(x, y)[:K]
    common = len(np.intersect1d(np.intersect1d(x, y, assume_unique=True), union, assume_unique=True))
    return 100 * common >= PERCENT * len(union) if len(union) < K else common >= T


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the exact similarity of the full sets at the threshold or above.  The sketch of a set is its head,
    so the estimate that spares most exact tests needs no shuffle of its own."""
    side = lambda x: sets.select(F.col("c").alias(x), F.col("full").alias(f"f{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def test(a, b):
        x, y = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
        if not possible(x, y):
            return (False,)
        common = len(np.intersect1d(x, y, assume_unique=True))
        return (100 * common >= PERCENT * (len(x) + len(y) - common),)

    return with_columns(both, ["fa", "fb"], test, StructType([StructField("linked", BooleanType())]), pairs.columns)


def rooted(links: DataFrame) -> DataFrame:
    """(node, root) from links to smaller nodes, one per node, by pointer jumping."""
    tree = written(links.select("node", F.col("to").alias("root")), "roots")
    while True:
        up = tree.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = written(tree.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        tree = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            return tree


def moved(frame: DataFrame, roots: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        frame = frame.join(roots.select(F.col("node").alias(c), "root"), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
    return frame


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (low < high) but the roots: every node hangs itself below its smallest
    neighbour, trees are flattened, and the edges left between trees go on until there are none."""
    out = None
    while not edges.isEmpty():
        roots = rooted(edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("to")))
        out = roots if out is None else written(
            moved(out.withColumnRenamed("root", "g"), roots, "g").withColumnRenamed("g", "root").unionByName(roots), "components")
        left = moved(edges, roots, "low", "high").filter("low <> high")
        edges = written(left.select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")).distinct(), "edges")
    return out


def groups(classes: DataFrame, sets_of) -> DataFrame:
    """(c, g): classes of documents and the smallest class of their group, for all that were merged."""
    lists = written(listings(classes).withColumn("g", F.col("c")), "lists")
    stored, merged, leaders = lists, lists.select("c", "g").limit(0), 1
    while True:
        # the next leaders of lists whose members are not yet in one group: the first of each share of the members
        part = F.pmod(F.xxhash64("c"), F.lit(leaders)).alias("part")
        shares = lists.groupBy("value", part).agg(
            F.min(F.struct("c", "n", "g", "s1", "s2")).alias("h"), F.min("g").alias("low"), F.max("g").alias("high"))
        if leaders > 1:
            shares = written(shares, "shares")
            spread = shares.groupBy("value").agg(F.min("low").alias("low"), F.max("high").alias("high"))
            shares = shares.drop("low", "high").join(spread, "value")
        heads = written(shares.filter("low < high").select("value", "part", "h"), "heads")
        if heads.isEmpty():
            return merged
        met = lists.join(heads.select("value", "h"), "value").filter(
            (F.col("g") != F.col("h.g")) & similar_sizes(F.col("n"), F.col("h.n")) & similar_bits("", "h."))
        first = F.col("h.c") < F.col("c")
        this, that = F.struct("c", "g"), F.struct(F.col("h.c").alias("c"), F.col("h.g").alias("g"))
        pairs = written(met.select(F.when(first, that).otherwise(this).alias("x"), F.when(first, this).otherwise(that).alias("y")).distinct().select(
            F.col("x.c").alias("a"), F.col("y.c").alias("b"), F.least("x.g", "y.g").alias("low"), F.greatest("x.g", "y.g").alias("high")), "pairs")
        sets = written(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()), "sets")
        edges = written(confirmed(pairs, sets).filter("linked").select("low", "high").distinct(), "edges")
        for done in (pairs, sets):
            dropped(done)
        led = heads.select("value", "part", F.col("h.c").alias("leader"))
        lists = lists.withColumn("part", part).join(led, ["value", "part"]).filter("c <> leader").drop("part", "leader")
        roots = components(edges)
        if roots is not None:
            lists = moved(lists, roots, "g")
            merged = written(moved(merged, roots, "g").unionByName(roots.select(F.col("node").alias("c"), F.col("root").alias("g"))), "merged")
        before, lists = stored, written(lists.select("value", "c", "n", "s1", "s2", "g"), "lists")
        stored = lists
        dropped(before)
        dropped(heads)
        leaders *= FASTER


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Two frames: rows (row, doc_id, n_shingles, root, component_id, kept), row being the number of the row in
    ``docs``, and the classes (cls, root, component_id)."""
    numbered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = written(sketches(numbered, "text", ["row", "doc_id"], width), "rows")
    classes = written(rows.filter("n > 0").groupBy("cls").agg(
        F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.min("row").alias("row"), F.min("doc_id").alias("least"))
        .withColumn("c", F.monotonically_increasing_id()), "classes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """Full sets of the wanted classes from the texts of their first rows; the class is checked again."""
        # a written table has a known size: Spark broadcasts a small one, so later rounds need not shuffle the texts
        asked = written(classes.select("c", "cls", "row").join(wanted, "c", "left_semi"), "asked")

        def full(text, cls):
            found = shingles(text, width)
            if set_class(found) != cls:
                raise ValueError("the documents were read in another order; write them first")
            return (found.tobytes(),)

        return with_columns(numbered.select("row", "text").join(asked, "row"), ["cast(text as binary)", "cls"], full,
                            StructType([StructField("full", BinaryType())]), ["c"])

    merged = groups(classes.select("c", "n", "sketch", "s1", "s2"), sets_of).withColumnRenamed("g", "root")
    placed = classes.select("c", "cls", "least").join(merged, "c", "left").withColumn("root", F.coalesce("root", "c"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(placed.join(names, "root").select("cls", "root", "component_id"), "named")
    out = rows.drop("sketch", "s1", "s2").join(named, "cls", "left").withColumn(
        "component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("row", "doc_id", F.col("n").alias("n_shingles"), "root", "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), named


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with one document of each group; documents without words all stay.  ``docs`` must be read in the same
    order twice, as a written table is."""
    rows = near_duplicates(docs, id_col, text_col, width)[0]
    full = rows.filter("n_shingles > 0").withColumnRenamed("row", "__row")
    first = full.filter("kept").groupBy("root").agg(F.min("__row").alias("__row")).select("__row")
    # written, so that Spark knows the size and need not shuffle the texts for a small one
    gone = written(full.select("__row").join(first, "__row", "left_anti"), "gone")
    return docs.withColumn("__row", F.monotonically_increasing_id()).join(gone, "__row", "left_anti").drop("__row")


def op4_near_duplicates(spark, sf_dir) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0].drop("row", "root")


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE = f"""
with recursive d as (select doc_id, {_W} as w from documents),
s as (select doc_id, case when len(w) >= 2 then list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]))
  else w end as s from d),
x as (select doc_id, len(s)::bigint as n, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i, any_value(a.n) as na, any_value(b.n) as nb
  from x a join x b on a.g = b.g and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n) group by 1, 2),
l as (select a, b from p where 100 * i >= {PERCENT} * (na + nb - i)),
r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on r.b = l.a)
select s.doc_id, len(s.s)::bigint as n_shingles, c.c as component_id, s.doc_id = c.c as kept
from s join (select a, min(b) as c from r group by a) c on c.a = s.doc_id
"""

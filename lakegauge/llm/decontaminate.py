"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are all windows of ``width`` consecutive item words (an item with fewer words is one window).  For each
window length a shift table over blocks of two words says how far the search may move on; where it says nought, the
block's bucket and the first word select the test strings, and a direct comparison confirms an occurrence.

Windows are cut and de-duplicated in Spark.  They reach the tasks in blocks of about ``block_bytes``, so that what is
broadcast at once is bounded for any benchmark; with more than one block, the documents pass once per block (a stated
query set against all rows) and carry their hits along.  Documents are never shuffled.

Defined cases: a null or wordless text has no words and no hits; a null item id counts as one item named ``null``;
items with equal ids count once; an empty benchmark leaves all documents clean; all document columns are kept, those
named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from lakegauge.llm.arrow import with_columns
from lakegauge.sources.work import written

WIDTH = 10
BLOCK_BYTES = 16 << 20
# every ASCII character but 0-9 and a-z parts words; A-Z count as a-z; all other characters belong to words
WORDS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORDS).split(b" ") if text else []


def split_words(text: bytes | None) -> list[bytes]:
    return [w for w in words(text) if w]


def windows(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Distinct (window, item)."""
    def cut(text):
        found = split_words(text)
        if not found:
            return ([],)
        return ([b" ".join(found[i:i + width]) for i in range(max(1, len(found) - width + 1))],)

    cuts = with_columns(benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text")),
                        ["cast(text as binary)"], cut, StructType([StructField("windows", ArrayType(BinaryType()))]), ["item"])
    return cuts.select(F.explode("windows").alias("window"), "item").distinct()


class Tables:
    """Shift table and buckets for windows of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.move = length - self.block + 1
        self.shift, self.buckets = {}, {}

    def add(self, window: tuple, items: list):
        n, b = self.length, self.block
        for end in range(b, n + 1):
            key = window[end - b:end]
            self.shift[key] = min(self.shift.get(key, self.move), n - end)
        self.buckets.setdefault(window[n - b:], {}).setdefault(window[0], []).append((window, items))

    def search(self, text: list, spans: list, items: set):
        n, shift, move, buckets, block = self.length, self.shift, self.move, self.buckets, self.block
        at, last = n, len(text)
        while at <= last:
            key = tuple(text[at - block:at])
            step = shift.get(key, move)
            if step:
                at += step
                continue
            start = at - n
            for window, found in buckets[key].get(text[start], ()):
                if tuple(text[start:at]) == window:
                    spans.append((start, at))
                    items.update(found)
            at += 1


def merged(spans: list) -> list:
    out = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
FOUND = StructType([StructField("n_words", LongType()), StructField("spans", SPANS), StructField("items", ArrayType(StringType()))])


def find_windows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, spans (word ranges hit), items (ids as text, sorted), n_hit, n_items, contaminated."""
    spark = docs.sparkSession
    cut = written(windows(benchmark, item_col, item_text_col, width), "windows")
    size = cut.agg(F.sum(F.length("window") + F.length("item") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    names = [f.name for f in FOUND.fields]
    out = docs
    for block in range(blocks):
        # about block_bytes of rows, by the hash above
        part = cut.filter(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == block)
        by_window: dict[bytes, list] = {}
        for window, item in part.toLocalIterator():
            by_window.setdefault(bytes(window), []).append(item)
        tables: dict[int, Tables] = {}
        for window, found in by_window.items():
            key = tuple(window.split(b" "))
            tables.setdefault(len(key), Tables(len(key))).add(key, found)
        shared = spark.sparkContext.broadcast(list(tables.values()))

        def scan(text, before=None, known=None, shared=shared):
            found = split_words(text)
            spans, items = [(s["start"], s["end"]) for s in before or ()], set(known or ())
            for table in shared.value:
                table.search(found, spans, items)
            return len(found), [{"start": s, "end": e} for s, e in merged(spans)], sorted(items)

        later = ["spans", "items"] if block else []
        out = with_columns(out, [f"cast(`{text_col}` as binary)", *later], scan, FOUND)
        if block + 1 < blocks:
            out = written(out, "hits")
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return out.select(*[f"`{c}`" for c in out.columns if c not in ("n_hit", "n_items", "contaminated", *names)], *names,
                      hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), (F.size("spans") > 0).alias("contaminated"))


def op2_decontaminate(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_windows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
with d as (select doc_id, row_number() over () as k, coalesce({_WORDS}, []) as w from documents),
b as (select item_id, {_WORDS} as w from benchmark where len({_WORDS}) > 0),
bw as (select distinct item_id, list_aggregate(w[i:i+{WIDTH - 1}], 'string_agg', ' ') as win, least(len(w), {WIDTH}) as n
  from (select *, unnest(range(1, greatest(len(w) - {WIDTH - 2}, 2))) as i from b)),
ns as (select distinct n from bw),
dw as (select k, n, i, list_aggregate(w[i:i+n-1], 'string_agg', ' ') as win
  from (select k, w, n, unnest(range(1, len(w) - n + 2)) as i from d, ns where len(w) >= n)),
h as (select k, dw.n, i, item_id from dw join bw using (win)),
hw as (select k, count(distinct p) as n_hit from (select k, unnest(range(i, i + n)) as p from (select distinct k, i, n from h)) group by k),
hi as (select k, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as items from (select distinct k, item_id from h) group by k)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join hw using (k) left join hi using (k)
"""

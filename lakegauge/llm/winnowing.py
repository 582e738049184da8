"""Document fingerprints by winnowing, in DataFrame functions only.

Every run of ``k`` characters has a rolling hash: the hashes of its characters, each shifted left by one bit for every
character after it, joined by exclusive or, so that stepping on by a character shifts the oldest one out and takes the
new one in.  The hash of a run is rolled up from those of its halves (the first one shifted, joined with the second), so
every character is hashed once and four passes over whole arrays serve runs of 16; neighbouring minima are taken alike.
Of every ``w`` neighbouring runs the one with the smallest hash is chosen, the rightmost one of equal ones, and kept
with its position.  Two texts that share ``w + k - 1`` characters in a row share a chosen hash.

Long texts are worked through in chunks of a few thousand windows inside their row, so no array grows with the text but
the chosen runs.

Edited texts, which end in the beginning of another document, get their fingerprint from the two known ones: windows
inside a beginning choose what they chose before, and only those across the seam are hashed again.

Defined cases: a null text counts as empty and has no runs; a text shorter than ``k`` has one hash, that of all its
characters, at position 0; one with fewer than ``w`` runs is one window.  ``likeness`` is the share of common hashes among
all hashes of two fingerprints (Jaccard); two empty fingerprints are alike (1), an empty and another one are not (0).
Repeated rows get equal fingerprints; extra columns are kept, those named like a result are replaced.  For the next
document, ids are numbers in ascending order with null ids last; rows of one id are ordered by their text
and stand in one bucket, which may spill; a table of one row follows itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

K, W = 16, 64  # characters a run, runs a window: 79 common characters in a row are sure to be found
CHUNK = 4096  # windows hashed at once
BITS = 49  # of a hash; the bits below hold the position within a chunk
PLACE_BITS = 15
CHARACTER = 0x2B7E151628B  # a character's hash is its code point times this odd number, in the low 49 bits
ENTRIES = "array<struct<at:bigint,hash:bigint>>"
BUCKETS_A_PARTITION, MOST_BUCKETS = 16, 10_000


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def chain(value: Column, steps) -> Column:
    return let(value, lambda v: chain(steps[0](v), steps[1:])) if steps else value


def character_hash(c: Column) -> Column:
    """The hash in the upper bits; whole numbers of 64 bits wrap around in shifts."""
    return F.shiftleft(F.ascii(c) * F.lit(CHARACTER), PLACE_BITS)


def _doublings(n: int) -> list[int]:
    if n < 1 or n & (n - 1):
        raise ValueError("k and w are powers of two")
    return [1 << i for i in range(n.bit_length() - 1)]


def _paired(n: int, combine):
    """Steps from values of single places to values of ``n`` neighbouring places; the last ``n - 1`` places are short."""
    return [lambda m, s=s: F.zip_with(m, F.slice(m, F.lit(s + 1), F.size(m)), lambda x, y: combine(x, y, s)) for s in _doublings(n)]


def hash_of(key: Column) -> Column:
    """The greatest key has the smallest hash; equal hashes are told apart by position, the rightmost one first."""
    return F.lit((1 << (BITS - 1)) - 1) - F.shiftright(key, PLACE_BITS)


def _chosen(text: Column, k: int, w: int) -> Column:
    """Keys of the windows' minima of a text of at least ``k`` characters."""
    keyed = lambda h: F.transform(h, lambda x, i: x.bitwiseOR(i.cast("bigint")))
    runs = F.length(text) - (k - 1)
    minima = lambda m: F.when(runs < w, F.array(F.array_max(m))).otherwise(F.array_distinct(F.slice(
        chain(m, _paired(w, lambda x, y, s: F.greatest(x, y))), F.lit(1), runs - (w - 1))))
    characters = F.transform(F.split(text, ""), character_hash)
    rolled = _paired(k, lambda x, y, s: F.shiftleft(x, s).bitwiseXOR(y))
    return chain(characters, [*rolled, keyed, minima])


def winnow(text: Column, n: Column, k: int = K, w: int = W) -> Column:
    """Chosen runs (position from 0, hash) of a text of ``n`` characters, by position."""
    windows = F.greatest(n - (k + w - 2), F.lit(1))
    whole = F.aggregate(F.split(text, ""), F.lit(0).cast("bigint"), lambda h, c: F.shiftleft(h, 1).bitwiseXOR(character_hash(c)))

    def chunk(c):
        part = F.substr(text, (c * CHUNK + 1).cast("int"), F.lit(CHUNK + w + k - 2))
        return let(part, lambda p: F.transform(_chosen(p, k, w), lambda x: F.struct(
            (c * CHUNK + x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))).alias("at"), hash_of(x).alias("hash"))))

    chunks = F.flatten(F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor((windows - 1) / CHUNK)), chunk))
    return (F.when(F.coalesce(n, F.lit(0)) == 0, F.array().cast(ENTRIES))
            .when(n < k, F.array(F.struct(F.lit(0).cast("bigint").alias("at"), hash_of(whole).alias("hash"))))
            .when(windows <= CHUNK, chunks).otherwise(joined(chunks)))


def joined(entries: Column) -> Column:
    """Runs in order of position; those chosen on both sides of a border once."""
    return let(entries, lambda e: F.filter(e, lambda x, i: (i == 0) | (x["at"] != F.get(e, i - 1)["at"])))


def beginning(entries: Column, length: Column, k: int = K, w: int = W) -> Column:
    """What winnowing the first ``length`` characters of the text chooses, if they fill a window; else nothing.

    Chosen positions never fall from window to window, so these are the runs up to the one chosen by the last window.
    """
    first = length - (k + w - 1)  # of the last window
    inside = F.filter(entries, lambda x: (x["at"] >= first) & (x["at"] < first + w))
    least = F.array_min(F.transform(inside, lambda x: F.struct(x["hash"].alias("hash"), (-x["at"]).alias("left"))))
    return F.when(first < 0, F.array().cast(ENTRIES)).otherwise(
        let(-least["left"], lambda end: F.filter(entries, lambda x: x["at"] <= end)))


def written_out(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda x: F.concat(x["hash"].cast("string"), F.lit(":"), x["at"].cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Common share of two arrays of hashes."""
    common, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


def fingerprints(docs: DataFrame, text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """``docs`` with ``n_chars`` and ``entries``, the chosen runs (at, hash); no shuffle."""
    kept = [c for c in docs.columns if c not in ("n_chars", "entries")]
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    return docs.select(*[F.col(quoted(c)) for c in kept], F.length(text).cast("bigint").alias("n_chars"),
                       winnow(text, F.length(text).cast("bigint"), k, w).alias("entries"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _bounds(keys: DataFrame, count: int) -> list:
    """Up to ``count`` ids that cut the table into buckets of about equal size; the first one is the smallest id."""
    shares = [i / count for i in range(count)]
    row = keys.agg(F.min("key").alias("least"), F.percentile_approx("key", shares, 10 * MOST_BUCKETS).alias("cuts")).first()
    return [] if row["least"] is None else sorted({row["least"], *row["cuts"]})


def with_next(docs: DataFrame, id_col: str, columns: dict[str, str], tie_col: str) -> DataFrame:
    """``docs`` with columns of the next row by ascending id (``columns``: name of the result to column of the row).

    One shuffle: rows go to buckets of neighbouring ids, cut at ids of the table, and the first row of a bucket also
    to the bucket before it (that of the first bucket to the last one).
    """
    spark = docs.sparkSession
    id_ = F.col(quoted(id_col)).cast("decimal(20,0)")
    most = docs.agg(F.max(id_)).first()[0]
    key = F.coalesce(id_, F.lit(0 if most is None else most + 1).cast("decimal(20,0)"))
    count = min(BUCKETS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    bounds = _bounds(docs.select(key.alias("key")), count) or [0]
    group = 64
    lits = lambda values: F.array(*[F.lit(v).cast("decimal(20,0)") for v in values])
    # two steps through the cuts, 64 at most in the second one
    coarse = F.size(F.filter(F.col("__cuts")["coarse"], lambda b: b <= F.col("__key"))) - 1
    fine = F.filter(F.slice(F.col("__cuts")["all"], F.col("__coarse") * group + 1, F.lit(group)), lambda b: b <= F.col("__key"))
    frame = docs.select("*", key.alias("__key"), F.struct(lits(bounds[::group]).alias("coarse"), lits(bounds).alias("all")).alias("__cuts"))
    frame = frame.select("*", coarse.alias("__coarse"))
    frame = frame.select("*", (F.col("__coarse") * group + F.size(fine) - 1).alias("__b"), F.element_at(fine, -1).alias("__cut"))
    place = lambda bucket, late, copy: F.struct(bucket.cast("int").alias("bucket"), F.lit(late).alias("late"), F.lit(copy).alias("copy"))
    b = F.col("__b")
    places = F.when(F.col("__key") == F.col("__cut"), F.array(
        place(b, 0, False), F.when(b == 0, place(F.lit(len(bounds) - 1), 1, True)).otherwise(place(b - 1, 0, True)))
    ).otherwise(F.array(place(b, 0, False)))
    placed = frame.select(*[F.col(quoted(c)) for c in docs.columns], "__key", F.explode(places).alias("__place"))
    order = Window.partitionBy("__place.bucket").orderBy("__place.late", "__key", F.col(quoted(tie_col)), "__place.copy")
    return (placed.select("*", *[F.lead(F.col(quoted(c))).over(order).alias(name) for name, c in columns.items()])
            .filter("not __place.copy").drop("__key", "__place"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """id, ``n_chars``, ``text``, ``entries``, ``edited_text``, ``edited_entries`` and ``next_entries`` of every document.

    The edited text has the last half of the characters replaced by as many first ones of the next document.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    own = fingerprints(docs.select(F.col(quoted(id_col)).alias("id"), text.alias("text")), "text", k, w)
    two = with_next(own, "id", {"next_text": "text", "next_chars": "n_chars", "next_entries": "entries"}, "text")
    half = F.floor(F.col("n_chars") / 2)
    three = two.select("*", (F.col("n_chars") - half).alias("stays"), F.least(half, F.col("next_chars")).alias("comes"))
    four = three.select("*", F.concat(F.substr("text", F.lit(1), F.col("stays").cast("int")),
                                      F.substr("next_text", F.lit(1), F.col("comes").cast("int"))).alias("edited_text"))
    # windows across the seam, or all windows of a short text
    stays, comes = F.col("stays"), F.col("comes")
    start = F.greatest(stays - (k + w - 2), F.lit(0))
    end = F.when(comes >= k + w - 1, stays + (k + w - 2)).otherwise(stays + comes)
    five = four.select("*", start.alias("seam_start"),
                       F.substr("edited_text", (start + 1).cast("int"), (end - start).cast("int")).alias("seam"))
    short = stays + comes < k + w - 1
    across = F.when(short | (F.length("seam") >= k + w - 1),
                    F.transform(winnow(F.col("seam"), F.length("seam").cast("bigint"), k, w), lambda x: F.struct(
                        (x["at"] + F.col("seam_start")).alias("at"), x["hash"].alias("hash")))).otherwise(F.array().cast(ENTRIES))
    after = F.transform(beginning(F.col("next_entries"), comes, k, w), lambda x: F.struct(
        (x["at"] + stays).alias("at"), x["hash"].alias("hash")))
    return five.select(F.col("id").alias(id_col), "n_chars", "text", "entries", "next_entries", "edited_text",
                       joined(F.concat(beginning(F.col("entries"), stays, k, w), across, after)).alias("edited_entries"))


def op11_fingerprints(spark, sf_dir) -> DataFrame:
    found = edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    hashes = lambda c: F.array_distinct(F.transform(c, lambda x: x["hash"]))
    ready = found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
                         written_out(F.col("entries")).alias("fingerprint"),
                         written_out(F.col("edited_entries")).alias("edited_fingerprint"),
                         *[hashes(F.col(c)).alias(c) for c in ("entries", "edited_entries", "next_entries")])
    return ready.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                        likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"),
                        likeness(F.col("entries"), F.col("next_entries")).alias("near_next"))


def _sql_doubled() -> str:
    steps = [f"c{2 * s} as (select k, part, i, n, xor((h & {(1 << (BITS - s)) - 1}) << {s}, lead(h, {s}) over (partition by k, part order by i)) as h from c{s})"
             for s in _doublings(K)]
    return ", ".join(steps)


_HASH = f"({(1 << BITS) - 1} - xor(h, {1 << (BITS - 1)}))"

#: every window of both texts, one by one
ORACLE = f"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over (order by doc_id) as k from documents),
p as (select *, length(t) as n, coalesce(lead(t) over (order by k), first_value(t) over (order by k)) as u from d),
e as (select k, doc_id, n, t, substr(t, 1, n - n // 2) || substr(u, 1, n // 2) as x from p),
both_texts as (select k, 0 as part, t as s, n from e union all select k, 1, x, length(x) from e),
ch as (select k, part, n, unnest(regexp_extract_all(s, '(?s).')) as c, unnest(range(0, n)) as i from both_texts where n > 0),
c1 as (select k, part, n, i, (unicode(c)::bigint * {CHARACTER}) & {(1 << BITS) - 1} as h from ch),
{_sql_doubled()},
g as (select k, part, n, i, {_HASH}::hugeint * {1 << 24} + {(1 << 24) - 1} - i as key from c{K} where i <= n - {K}),
m as (select k, part, n, i, min(key) over (partition by k, part order by i rows between current row and {W - 1} following) as key from g),
s as (select distinct k, part, key from m where i <= greatest(n - {K} - {W - 1}, 0)),
z as (select k, part, (key // {1 << 24})::bigint as hash, ({(1 << 24) - 1} - key % {1 << 24})::bigint as pos from s
      union all
      select k, part, {_HASH}, 0 from (select k, part, bit_xor(((h & ((1::bigint << ({BITS} - (n - 1 - i))) - 1)) << (n - 1 - i))) as h
                                       from c1 where n < {K} group by k, part)),
f as (select k, part, string_agg(hash::varchar || ':' || pos::varchar, ',' order by pos) as fp, list_distinct(list(hash)) as hs from z group by k, part),
j as (select e.*, coalesce(a.fp, '') as fa, coalesce(b.fp, '') as fb, coalesce(a.hs, []) as ha, coalesce(b.hs, []) as hb
      from e left join f a on a.k = e.k and a.part = 0 left join f b on b.k = e.k and b.part = 1),
q as (select *, coalesce(lead(ha) over (order by k), first_value(ha) over (order by k)) as hn from j)
select doc_id, n::bigint as n_chars, sha256(x) as edited_sha256, fa as fingerprint, fb as edited_fingerprint,
  case when len(ha) + len(hb) = 0 then 1.0 else len(list_intersect(ha, hb))::double / len(list_distinct(list_concat(ha, hb))) end::double as near_edited,
  case when len(ha) + len(hn) = 0 then 1.0 else len(list_intersect(ha, hn))::double / len(list_distinct(list_concat(ha, hn))) end::double as near_next
from q
"""

import collections
import hashlib
import random
import time

import pyarrow as pa
import pytest
from lakegauge.llm import chat, cleaning, decontaminate, mixing, near, passages, personal, suffix_tree, suffixes, warc
from lakegauge.sources import work

WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(WORDS[:120])
DOCS = [
    (1, LONG, "a"), (2, LONG.replace("w50 ", "x "), "a"), (3, LONG, None), (4, None, "b"), (5, "", "b"), (6, "one", "b"),
    (7, "one", "a"), (None, LONG, "a"), (8, " ".join(WORDS[200:300]) + " " + " ".join(WORDS[:70]), "c"), (1, LONG, "a"),
    (9, "z " * 3000, "c")]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    spark.createDataFrame(DOCS, "doc_id bigint, text string, source string").selectExpr("*", "doc_id as n", "text as kept").write.parquet(path)
    return spark.read.parquet(path)


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 100
    rows = [(2, "u\r\nv", big), (1, None, big), (3, "u", "x"), (4, "u", "x"), (5, "u", None), (None, "u", big), (2, "u\r\nv", big)]
    a = warc.write_archive(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    got = warc.read_archive(a).collect()
    assert len(got) == 7 and a.payloads.count() == 3
    assert [(r.page_id, r.record_type) for r in got if r.record_type == "response" and r.payload_bytes > 100] == [(1, "response")]
    assert sorted((r.page_id or 0, r.refers_to) for r in got if r.record_type == "revisit") == [(0, 1), (2, 1), (2, 1)]
    for r in warc.warc_records(a, originals=True).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
    bodies = collections.Counter(bytes(r.payload) for r in got)
    assert bodies[big.encode()] == 4 and bodies[b"x"] == 2 and bodies[b""] == 1


def test_windows_equal_brute_force(spark, docs):
    items = [(1, " ".join(WORDS[:12])), (2, "One!"), (2, "one"), (3, None), (None, " ".join(WORDS[60:70]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (16 << 20, 300):  # one block and several
        got = {(r.doc_id, r.text): r for r in decontaminate.find_windows(docs, bench, block_bytes=block).collect()}
        assert got[(1, LONG)].n_hit == 22 and got[(1, LONG)]["items"] == ["1", "null"]
        assert got[(6, "one")].n_hit == 1 and got[(6, "one")]["items"] == ["2"]
        assert got[(4, None)].n_words == 0 and not got[(9, "z " * 3000)].contaminated
    assert decontaminate.find_windows(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_personal_spans():
    t = "Mail jo@ex.org, jane at site dot example dot com, bob [at] web.de; call +1 (743) 555-3824; 4111 1111 1111 1111; 10.0.0.256 10.0.0.1"
    base, every = personal.find(t)
    cut = lambda x: [(k, t[a:b]) for k, a, b in x]
    assert cut(base) == [("email", "jo@ex.org"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (743) 555-3824")]
    assert ("email", "jane at site dot example dot com") in cut(every) and ("email", "bob [at] web.de") in cut(every)
    assert personal.find(None) == ([], []) and personal.find("look at that. There is one dot more") == ([], [])
    assert personal.find("mail j\u043e@ex.org") == ([], [("email", 5, 14)])  # a Cyrillic letter
    s = "plus one seven four three five five five three eight two four"
    assert personal.find(s)[1] == [("phone", 0, len(s))]
    assert personal.redact("a b@c.de f", [{"kind": "email", "start": 2, "end": 8}]) == "a [EMAIL] f"
    assert personal.detect("1" * 200_000)["card"] == [] and personal.detect("a" * 200_000 + "@")["email"] == []


def test_disguised_spans_that_hold_a_base_fragment():
    for t, kind in [("j\u043ehn@ex.org", "email"), ("jo\u200bhn@ex.org", "email"), ("jo\uff48n@ex.org", "email"), ("jane@example.c\u043em", "email"),
                    ("john@mail.example dot com", "email"), ("+49 30 1234 five six seven", "phone")]:
        base, every = personal.find(f"see {t}, or")
        assert (kind, 4, 4 + len(t)) in every and set(base) <= set(every), t
        spans = [{"kind": k, "start": a, "end": b} for k, a, b in every]
        assert personal.redact(f"see {t}, or", spans) == f"see [{kind.upper()}], or"
    assert personal.find("a jo@ex.org b\u043e")[1] == [("email", 2, 11)]  # rewriting elsewhere adds nothing


def brute_groups(rows):
    sets = []
    for _, text, _ in rows:
        w = (text or "").lower().split()
        sets.append(set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    group[i] = group[j] = min(group[i], group[j])
    ids = collections.defaultdict(list)
    for g, r in zip(group, rows):
        ids[g].append(r[0])
    return collections.Counter((r[0], len(s), min([i for i in ids[g] if i is not None], default=None)) for g, r, s in zip(group, rows, sets))


def test_near_duplicates_equal_brute_force(docs):
    got = near.near_duplicates(docs)[0].collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(DOCS)
    left = near.one_of_each(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 4, 5, 6, 8, 9]
    assert near.near_duplicates(docs.limit(0))[0].count() == 0


def test_pipeline_stage_takes_five_words(spark, tmp_path):
    import corpus_pipeline

    base = [f"q{i}" for i in range(100)]
    changed = lambda *at: " ".join(f"x{i}" if i in at else w for i, w in enumerate(base))
    texts = [changed(), changed(10, 30, 50, 70, 90), changed(50), changed(50, 51), changed(0, 99), "a b c", "a b c", "a b", None, "", "a b c d e f", "a b c d e"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    cut = lambda w: {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    sets = [cut((t or "").split()) for t in texts]
    group = list(range(len(texts)))
    for _ in texts:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    group[i] = group[j] = min(group[i], group[j])
    left = corpus_pipeline.near_duplicates(spark, spark.read.parquet(str(tmp_path / "d")), None)
    assert sorted(r.doc_id for r in left.collect()) == sorted({i for i, g in enumerate(group) if g == i})
    assert group[1] == 1  # five words of a hundred changed: stays


def test_mix_meets_targets(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(DOCS) and set(docs.columns) <= set(got[0].asDict())
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.taken <= 2 * r["size"] and (r.position is None) == (r.taken == 0)
    total = sum(r["size"] for r in got)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) < 1 and rows[0].source_size == sum(r["size"] for r in rows)
    assert abs(sum(rows[0].target for rows in by.values()) - 1.5 * total) < 1e-6
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.in_training_order(mixing.mix(docs.limit(0))).count() == 0


def test_positions_invert_the_schedules(docs):
    got = mixing.mix(docs, weights=(3, 1, 2), budget_percent=170).collect()
    assert any(len(r.passes) == 2 for r in got)
    sources = sorted({r.source for r in got}, key=lambda x: (x is None, x))
    for rank, source in enumerate(sources):
        slope, before = mixing.SLOPES[rank % 3], 0
        drawn = sorted((p["pass"], p.order, p.row, p.taken, p.position, r.target) for r in got if r.source == source for p in r.passes)
        for _, _, _, taken, position, target in drawn:
            low, high = 0.0, 1.0
            for _ in range(60):  # the share of the demand that the schedule has met at u is u + slope * (u - u^2)
                u = (low + high) / 2
                low, high = (u, high) if u + slope * (u - u * u) < before / target else (low, u)
            assert abs(position - low) < 1e-9
            before += taken
    mixed = mixing.mix(docs, budget_percent=170)
    ordered = mixing.in_training_order(mixed).collect()
    expected = sorted((p.position, p["rank"], p.order, p.row, p["pass"], r.doc_id, p.taken) for r in got for p in r.passes)
    assert [(r.position, r["pass"], r.doc_id, r.taken) for r in ordered] == [(e[0], e[4], e[5], e[6]) for e in expected]


def test_progress_is_the_fraction_of_all_words(spark, tmp_path):
    """Sources of unlike slopes and targets: the words taken before a document are its progress, which its position is not."""
    rows = [(i, f"w{i} x y z", "abc"[0 if i % 10 < 7 else 1 + i % 2]) for i in range(2000)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "d"))
    got = mixing.mix(spark.read.parquet(str(tmp_path / "d")), weights=(8, 1, 1), slopes=(0.9, 0.0, -0.2)).collect()
    passes = sorted((p.position, p["rank"], p.order, p.row, p["pass"], p.taken, p.progress) for r in got for p in r.passes)
    total, before, away = sum(p[5] for p in passes), 0, 0.0
    for p in passes:
        assert abs(p[6] - before / total) < 0.005
        away = max(away, abs(p[0] - before / total))
        before += p[5]
    assert away > 0.05


def test_mix_with_clashing_names(docs, spark, tmp_path):
    names = ["doc_id", "text", "source", "__row", "__order", "a.b", "c`d", "Size", "found", "pass"]
    rows = [(*r, 1, 2, 3, 4, 5, 6, 7) for r in DOCS]
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "clash"))
    clash = spark.read.parquet(str(tmp_path / "clash"))
    mixed = mixing.mix(clash)
    assert mixed.columns == [n for n in names if n != "Size"] + list(mixing.RESULTS)
    assert {(r["__row"], r["__order"], r["a.b"], r["c`d"], r["found"]) for r in mixed.collect()} == {(1, 2, 3, 4, 6)}
    ordered = mixing.in_training_order(mixed)
    assert ordered.columns == [n for n in names if n not in ("Size", "pass")] + ["size", "source_size", "target", "taken", "position", "pass"]
    assert ordered.count() == sum(len(r.passes) for r in mixed.collect())


def test_op5_runs_the_whole_mix_in_training_order(docs, spark, tmp_path):
    """All passes of a document with what each takes of its text, one row a document, also for those that no pass takes."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op5_mix_sources(spark, str(tmp_path)).collect()
    whole = mixing.mix(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    take = lambda r, n: r.text if n == r["size"] else " ".join(r.text.split()[:n])
    key = lambda x: tuple((v is None, v) for v in x[:6])
    want = sorted(((r.doc_id, r["size"], r.source_size, r.target, r.taken, r.position,
                    [(p["pass"], p.taken, p.position, p.progress, sha(take(r, p.taken))) for p in r.passes]) for r in whole), key=key)
    assert sorted(((*r[:6], [tuple(p) for p in r.passes]) for r in got), key=key) == want
    assert any(len(w[6]) == 2 for w in want) and any(not w[6] for w in want)
    assert any(p[1] < w[1] for w in want for p in w[6])  # one that a pass ends in
    plan = mixing.op5_mix_sources(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "text" in plan.split("RepartitionByExpression")[0]


def test_fuzzy_passages(docs):
    found = {(r.doc_id, r.other_id) for r in passages.shared_passages(docs).collect()}
    assert (8, 1) in found or (8, None) in found
    assert not {9, 6, 4} & {x for p in found for x in p}
    assert passages.shared_passages(docs.limit(0)).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_fuzzy_passages_are_all_found(spark, tmp_path):
    """Planted passages of 80 to 95 %, and passages whose seeds stood in earlier documents."""
    rnd = random.Random(7)
    alone = lambda n: [f"u{rnd.randrange(10 ** 9)}" for _ in range(n)]
    texts, planted = [], []
    for n in (52, 60, 100, 150):
        for changed in (0.05, 0.1, 0.15, 0.19, None):
            core = alone(n)
            at = set(range(5, n, 6)) if changed is None else set(rnd.sample(range(1, n - 1), int(n * changed)))
            other = [alone(1)[0] if i in at else w for i, w in enumerate(core)]
            planted.append((len(texts), len(texts) + 1))
            texts += [alone(40) + core + alone(40), alone(90) + other + alone(10)]
    parts, split = alone(60), len(texts)  # both halves stood in earlier documents
    texts += [alone(50) + parts[:30] + alone(50), alone(50) + parts[30:] + alone(50), alone(20) + parts + alone(20), alone(60) + parts + alone(5)]
    planted.append((split + 2, split + 3))
    whole, variant = alone(60), len(texts)  # the first holder is a variant under 80 %
    texts += [alone(30) + [w if i % 20 < 14 else f"v{i}" for i, w in enumerate(whole)] + alone(30), alone(20) + whole + alone(9), whole + alone(70)]
    planted.append((variant + 1, variant + 2))
    again, places = alone(70), len(texts)  # seeds that stood in the same document before, in pieces
    texts += [alone(5) + again[:25] + alone(90) + again[25:50] + alone(90) + again + alone(60), alone(8) + again + alone(30)]
    planted.append((places, places + 1))
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    got = passages.shared_passages(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert {(r.other_id, r.doc_id) for r in got} == set(planted)
    for r in got:
        a, b = texts[r.doc_id][r.start:r.end], texts[r.other_id][r.other_start:r.other_end]
        assert min(len(a), len(b)) > 50 and r.n_matched == lcs(a, b) and r.percent == 100 * r.n_matched // max(len(a), len(b)) >= 80


def test_passages_of_members_that_only_met_a_leader(spark, tmp_path, monkeypatch):
    """Each two of a group of near copies, also where other documents come first in some of their lists; copies once."""
    rnd = random.Random(3)
    core = [f"k{i}" for i in range(80)]
    texts = [[f"a{d}x{i}" for i in range(30)] + [w if i % 20 != d else f"q{d}x{i}" for i, w in enumerate(core)] for d in range(5)]
    texts += [core[:12] + [f"b{i}" for i in range(60)], texts[2]]
    half = [f"h{i}" for i in range(55)]  # a first holder of some of the seeds that the two after it share
    texts += [half[:30] + [f"c{i}" for i in range(40)], half + [f"d{i}" for i in range(20)], [f"e{rnd.random()}" for _ in range(9)] + half]
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    table = spark.read.parquet(str(tmp_path / "d"))
    want = {(a, b) for a in range(5) for b in range(a + 1, 5)} | {(2, 6), (8, 9)}
    for meetings in (passages.MEETINGS, 500):  # one round and several
        monkeypatch.setattr(passages, "MEETINGS", meetings)
        assert sorted((r.other_id, r.doc_id) for r in passages.shared_passages(table).collect()) == sorted(want)


def plain_common(a, b):
    """Places of a longest common subsequence by a table of all suffixes."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i, j, out = 0, 0, []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_common_words_and_close_pairs_equal_plain_loops():
    r = random.Random(11)
    for _ in range(400):
        a, b = ([r.choice("abcdefgh"[:r.randint(1, 8)]) for _ in range(r.randint(0, 70))] for _ in range(2))
        assert passages.common(a, b) == plain_common(a, b)
        assert passages.may_go_on(a, b) or not any(2 * i > max(u, v) for i, (u, v) in enumerate(plain_common(a, b), 1))
    pairs = [[(r.randrange(200), r.randrange(200), r.randint(1, 3)) for _ in range(r.randint(1, 9))] for _ in range(300)]
    struct = pa.list_(pa.struct([(f, pa.int64()) for f in ("place", "other_place", "w")]))
    m = pa.array([[dict(zip(("place", "other_place", "w"), x)) for x in p] for p in pairs], struct)
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(range(300)), m], names=["row", "other", "m"])
    near = [i for i, p in enumerate(pairs) if any(sum(w for y, _, w in p if x <= y < x + 51) >= 6 for x, _, _ in p)]
    got = [i for part in (batch.slice(0, 100), batch.slice(100)) for b in passages.close([part]) for i in b.column(0).to_pylist()]
    assert got == near and 0 < len(near) < 300


def test_passage_beside_a_denser_short_stretch():
    dense = [(i, i) for i in range(49)]
    sparse = [(1000 + i, 1000 + i) for i in range(60) if i % 5 != 4 or i == 59]
    found = passages.stretch(passages.np.array(dense + sparse), 50, 80)
    assert found is not None and (found[0], found[1]) == (49, 49 + len(sparse) - 1)


def test_suffix_dedup_equals_brute_force(spark, docs):
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r["kept"])).hexdigest())
                              for r in suffixes.remove_repeats(docs).collect())
    data = [(d, (t or "").encode()) for d, t, _ in DOCS]
    seen = collections.Counter(b[i:i + 200] for _, b in data for i in range(len(b) - 199))
    want = collections.Counter()
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        runs = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        want[(d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())] += 1
    assert got == want


def test_suffix_dedup_works_in_bounded_batches(spark, docs, monkeypatch):
    """However long a text or a task's share is, no batch of positions is larger than twice the limit, and the result is the same."""
    data = [(g, bytes(random.Random(g).choices(b"abc", k=n))) for g, n in enumerate((5000, 300, 200, 700))]
    whole = pa.RecordBatch.from_pydict({"g": [g for g, _ in data], "data": [b for _, b in data]})
    rows = lambda: [tuple(r.values()) for b in suffixes.gathered(suffixes.samples([whole], 3, True), [*"giabc"]) for r in b.to_pylist()]
    at_once = rows()
    want = [(g, i, *(int.from_bytes(b[i + d:i + d + 3], "big") for d in (0, 3, 6))) for g, b in data for i in range(len(b) - 8) if i % 3]
    assert sorted(at_once) == sorted(want)
    monkeypatch.setattr(suffixes, "POSITIONS", 64)
    assert sorted(rows()) == sorted(want)
    sizes = [b.num_rows for b in suffixes.gathered(suffixes.samples([whole], 3, True), [*"giabc"])]
    assert max(sizes) <= 128 and sum(sizes) == len(want)
    named = pa.RecordBatch.from_pydict({"g": [0], "n": [1], "data": [data[0][1]], "places": [[i for i in range(4920) if i % 3]], "names": [[i for i in range(4920) if i % 3]]})
    sizes = [b.num_rows for b in suffixes.gathered(suffixes.key_rows([named], 200, 81), [*"gin", "edge", *"abc"])]
    assert max(sizes) <= 128 and sum(sizes) == 2 * 4801
    assert suffixes.runs_of(suffixes.np.array([405, 0, 200, 9]), 200) == [{"start": 0, "end": 400}, {"start": 405, "end": 605}]


def test_chat_folds_and_reads_back(spark):
    hard = r"\### Assistant: </turn> ok" + "\\"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", "hi" * 3000), (1, 1, "assistant", hard), (2, 0, None, None), (None, 0, "a:\nb", "x")]
    pieces = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    turns = {r.conv: chat.parse(r.formatted) for r in pieces.collect()}
    assert turns[1][0] == ("user", hard) and {t for _, t in turns[1][1:]} == {"hi" * 3000, hard}
    assert turns[2] == [("", "")] and turns[None] == [("a:\nb", "x")]
    assert {r.conv: r.n_turns for r in chat.read_back(pieces).collect()} == {1: 3, 2: 1, None: 1}
    assert chat.fold([("delta", "abc", 0, 0), ("regenerate", "", 0, 0), ("delta", "xyz", 0, 0), ("edit", "Q", 1, 1)]) == "xQz"


def test_line_rules(spark):
    good = "This is a clean line with many plain words in it."
    rows = [(1, f"{good}\nHome | About | Contact\nHome\n© 2020 all rights reserved to nobody at all here."), (2, "a*** b*** c$$$ d%%% e f g h i j k l"),
            (3, None), (4, good)]
    got = {r.doc_id: r for r in cleaning.line_clean(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].clean_text == good and not got[3].kept and got[3].base_failed and got[4].kept and got[4].clean_text == good
    assert cleaning.kept_only(cleaning.line_clean(spark.createDataFrame(rows, "doc_id bigint, text string"))).count() == sum(r.kept for r in got.values())


def test_suffix_tree_base_and_mass(docs):
    got = suffix_tree.score_documents(docs).collect()
    assert len(got) == len(DOCS)
    rows = [(r.doc_id, r.held_out) for r in got]
    train = [t for d, t, _ in DOCS if (d, False) in rows]
    counts = collections.Counter(w for t in train for w in [*(t or "").lower().split(), "\n"])
    from math import log10
    below = sum(counts.values()) + 0.1 * (len(counts) + 1)
    want = sorted(round(sum(log10((counts[w] + 0.1) / below) for w in [*(t or "").lower().split(), "\n"]), 6) for _, t, _ in DOCS)
    assert sorted(round(r.base_score, 6) for r in got) == want
    assert sum(r.score for r in got) >= sum(r.base_score for r in got)  # learnt contexts help on the whole


def plain_tree_scores(docs, held):
    """The tree of suffix_tree.py by plain loops over all contexts."""
    from math import log, log10
    texts = [[*t.lower().split(), "\n"] for t in docs]
    grams = [collections.Counter(tuple(t[i:i + d]) for t, h in zip(texts, held) if not h for i in range(len(t) - d + 1)) for d in range(5)]
    n, vocabulary = sum(grams[1].values()), len(grams[1])
    root = lambda w: (grams[1][(w,)] + 0.1) / (n + 0.1 * (vocabulary + 1))
    kept, p = {}, {}

    def probability(c, w):
        while c and c not in kept:
            c = c[1:]
        if not c:
            return root(w)
        return p[c + (w,)] if c + (w,) in p else kept[c] * probability(c[1:], w)

    for d in (1, 2, 3):
        by = collections.defaultdict(list)
        for g, k in grams[d + 1].items():
            if k >= 8:
                by[g[:-1]].append((g[-1], k))
        for c, symbols in by.items():
            q, total = [probability(c[1:], w) for w, _ in symbols], grams[d][c]
            known, rest = min(sum(q), 1 - 1e-9), total - sum(k for _, k in symbols)
            gain = sum(k * log(k / total / x) for (_, k), x in zip(symbols, q)) + (rest * log(rest / total / (1 - known)) if rest else 0)
            if gain > 4 * (len(symbols) + 1):
                kept[c] = (rest + 20 * (1 - known)) / ((total + 20) * (1 - known))
                p.update({c + (w,): (k + 20 * x) / (total + 20) for (w, k), x in zip(symbols, q)})
    assert len(kept) > 20
    return [sum(log10(probability(tuple(t[max(i - 3, 0):i]), t[i])) for i in range(len(t))) for t in texts]


def test_suffix_tree_equals_plain_loops_whatever_is_broadcast(spark):
    r = random.Random(5)
    phrases = [[r.choice(WORDS[:60]) for _ in range(r.randint(2, 5))] for _ in range(25)]
    texts = [" ".join(w for _ in range(r.randint(0, 40)) for w in (r.choice(phrases) if r.random() < 0.8 else [r.choice(WORDS)])) for _ in range(150)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for cached in (1_000_000, 100, 10, 0):  # all of the tree, parts of it, and nothing but the end token is broadcast
        got = {r.doc_id: r for r in suffix_tree.score_documents(frame, "doc_id", "text", 3, cached).collect()}
        want = plain_tree_scores(texts, [got[i].held_out for i in range(len(texts))])
        assert [round(got[i].score, 6) for i in range(len(texts))] == [round(x, 6) for x in want]


def test_frequent_tops_equal_plain_counts(spark):
    """First 32 bits at the ends of the parts, of which at least eight numbers share them, over several tasks."""
    r = random.Random(9)
    tops = [0, 1, (1 << 16) - 1, 1 << 16, (1 << 22) - 1, 1 << 22, (1 << 31) + 5, (1 << 32) - 1, *(r.getrandbits(32) for _ in range(300))]
    rows = [[(r.choice(tops) << 32) | r.getrandbits(32) for _ in range(r.randint(0, 60))] for _ in range(60)]
    counts = collections.Counter(k >> 32 for x in rows for k in x)
    frame = spark.createDataFrame([(bytearray(b"".join(k.to_bytes(8, "little") for k in x)),) for x in rows], "x binary").repartition(3)
    got = sorted(b.b & 0xFFFFFFFF for b in suffix_tree.frequent_tops(frame, lambda x, at: x).collect())
    assert got == sorted(b for b, n in counts.items() if n >= 8) and 0 < len(got) < len(tops)


def test_shuffles_of_frames_let_go_are_deleted(spark):
    def files():
        folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return folder.getAllBlocks().size()

    work.freed(spark)
    time.sleep(1)
    before = files()
    spark.range(1000).repartition(7).groupBy("id").count().write.format("noop").mode("overwrite").save()
    held = files()
    assert held > before
    until = time.time() + 20
    while files() > before and time.time() < until:
        work.freed(spark)
        time.sleep(0.5)
    assert files() <= before


def test_suffix_tree_empty_table(spark):
    assert suffix_tree.score_documents(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []

"""Operators of chronotext.llm against plain versions, and on nulls, empty texts, ties, repeats and clashing columns."""

import gzip
import hashlib
import itertools
import math
import random
import re
import uuid

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronotext.llm import balltree, chunks, crosspolytope, langid, mixing, segments, simhash, suffixes, toxicity, warc
from chronotext.llm.registry import prepared

ODD = [(1, "One two three four five", "a"), (2, "one two three four five", None), (2, "one two three four five", None), (3, None, "a"),
       (4, "", "b"), (None, " \t\n", None), (None, "x", "b"), (5, "word " * 3000, "c")]


@pytest.fixture
def odd(spark):
    """Documents with every oddity and columns named like inner ones."""
    prepared(spark)
    rows = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return rows.select("*", *[F.lit("z").alias(c) for c in ("fp", "id", "data", "size", "tie", "block", "key", "score", "rest", "first")])


def key(row):
    return tuple((x is None, x) for x in row)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_odd_rows(spark, odd):
    got = simhash.groups(odd).collect()
    assert sorted(((r.doc_id, r.fp % (1 << 64)) for r in got), key=key) == sorted(((i, plain_fingerprint(t)) for i, t, _ in ODD), key=key)
    assert {r.component_id for r in got if r.fp == 0} == {3}
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)) == [1, 3, 5, None]
    assert simhash.groups(odd.limit(0)).count() == simhash.one_of_each(odd.limit(0)).count() == 0


def test_simhash_links_equal_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (1 << 64) - 1 for b in base for _ in range(30)} | {0, 1, 3}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    roots = simhash.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")))
    found = {r.node: r.root for r in roots.collect()}
    root = {p: p for p in signed}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(signed, 2):
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert all(found.get(p, p) == root[p] for p in signed)


def test_near_copies_equal_brute_force(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rng = random.Random(7)
    for n, i in enumerate(sorted(i for i, t in texts.items() if t and len(t.split()) > 100)[:60]):  # planted: some words changed
        words = texts[i].split()
        for at in rng.sample(range(len(words)), max(1, len(words) * (n % 4) // 200)):
            words[at] = f"other{at}"
        texts[10_000_000 + i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets, holders = {i: set(simhash.shingle_set((t or "").encode(), 5).tolist()) for i, t in texts.items()}, {}
    shared = {}
    for i in sorted(sets):
        for s in sets[i]:
            for j in holders.setdefault(s, []):
                shared[j, i] = shared.get((j, i), 0) + 1
            holders[s].append(i)
    want = {(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) and sets[a] != sets[b]}
    group = {r.doc_id: r.root for r in simhash.near_groups(docs).collect()}
    linked = sum(group[a] == group[b] for a, b in want)
    print(f"near copies: {linked} of {len(want)} pairs linked")
    assert len(want) > 40 and linked >= 0.95 * len(want)
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in [*want, *((a, b) for (a, b), n in shared.items() if sets[a] == sets[b])]:
        root[top(a)] = top(b)
    by_group = {}
    for i, g in group.items():
        by_group.setdefault(g, set()).add(top(i))
    assert all(len(g) == 1 for g in by_group.values() if not any(not sets[i] for i in g))  # nothing else is linked
    kept = simhash.one_of_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)) == [1, 3, 5, None]
    assert simhash.one_of_near_copies(odd.limit(0)).count() == 0


def plain_cut(rows):
    rows = [(suffixes.NO_ID if i is None else i, (t or "").encode(), i) for i, t in rows]
    first = {}
    for i, b, _ in rows:
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    out = []
    for i, b, own in rows:
        off = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                off[p : p + 50] = True
        spans = int((off[1:] & ~off[:-1]).sum() + off[:1].sum())
        out.append((own, len(b), int(off.sum()), spans, np.frombuffer(b, np.uint8)[~off].tobytes()))
    return sorted(out, key=key)


def test_suffix_cut_equals_brute_force(spark, monkeypatch):
    prepared(spark)
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 200)
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b = text(200), text(70)
    rows = [(1, a), (2, a), (2, a), (2, b + a[:60]), (3, None), (4, ""), (None, a), (None, b), (5, b * 3), (6, text(30) + b + text(30)),
            (0, "x" * 300), (7, "x" * 49), (8, "x" * 50), (9, "yy" + "x" * 80 + "é" * 40), (10, "é" * 60), (11, text(9) + "é" * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("z")).withColumn("id", F.lit(None).cast("int"))
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.cut(docs, carry=True).collect()), key=key)
    assert got == plain_cut(rows)
    assert suffixes.without_repeats(docs).columns == docs.columns
    assert suffixes.cut(docs.limit(0)).count() == 0


def test_suffix_blocks_stay_small_with_one_id(spark, monkeypatch, tmp_path):
    prepared(spark)
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 4000)
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common, same = text(60), text(150)
    rows = [(None, text(100) + common + text(100)) for _ in range(150)] + [(None, same)] * 150 + [(1, same + common), (7, same)] + [(7, same)] * 40
    rows += [(9, text(50) + common) for _ in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder, real = tmp_path, suffixes.opened

    def watched(texts, side):
        (folder / uuid.uuid4().hex).write_text(str(sum(len(x.as_buffer()) for x in texts["data"])))
        return real(texts, side)

    monkeypatch.setattr(suffixes, "opened", watched)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.cut(docs).collect()), key=key)
    assert got == plain_cut(rows)
    sizes = [int(f.read_text()) for f in folder.iterdir()]
    assert len(sizes) > 10 and max(sizes) < 4 * 4000


def test_suffix_groups_are_sorted():
    rng = random.Random(2)
    data = bytes(rng.choice(b"ab") for _ in range(400)) + b"x" * 150 + bytes(rng.choice(b"ab") for _ in range(60)) * 3
    order, first = suffixes.suffix_groups(data, np.arange(len(data) - 49))
    strings = [data[i : i + 50] for i in order]
    assert strings == sorted(strings)
    assert first.tolist() == [i for i in range(len(strings)) if i == 0 or strings[i] != strings[i - 1]]


def test_chunks_keep_first_copies(spark, odd):
    got = {(r.doc_id, bytes(r.kept)) for r in chunks.without_repeats(odd).collect()}
    assert (3, b"") in got and (4, b"") in got and (1, b"One two three four five") in got
    long = random.Random(5).randbytes(30_000).hex()
    rows = spark.createDataFrame([(1, long), (2, "an insertion " + long)], "doc_id long, text string")
    second = next(r for r in chunks.without_repeats(rows).collect() if r.doc_id == 2)
    assert second.n_removed > 0.95 * second.n_bytes
    assert chunks.without_repeats(odd.limit(0)).count() == 0


def test_chunks_remove_planted_passages_and_keep_short_tails(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 2000").orderBy("doc_id").select("text").limit(300).collect()]
    rng, rows, bare, planted = random.Random(11), [], [], {}
    for n in range(0, 300, 3):
        words = texts[n].split(" ")
        size = rng.choice([51, 60, 80, 100])
        at = rng.randrange(max(1, len(words) - size))
        passage = " ".join(words[at : at + size])
        for i, host in ((n, texts[n + 1]), (n + 1, texts[n + 2])):
            place = host.find(" ", rng.randrange(len(host) // 2)) + 1
            rows.append((i, host[:place] + passage + " " + host[place:]))
            bare.append((i, host))
        planted[n + 1] = len(passage.encode())
    removed = [{r.doc_id: r.n_removed for r in chunks.without_repeats(spark.createDataFrame(x, "doc_id long, text string")).collect()} for x in (rows, bare)]
    found = {i: removed[0][i] - removed[1][i] for i in planted}  # hosts also share strings of their own
    assert sum(n > 0 for n in found.values()) >= 0.95 * len(planted)
    assert 0.75 * sum(planted.values()) <= sum(found.values()) <= sum(planted.values())
    tail = "the same short tail"
    bodies = [random.Random(s).randbytes(2000).hex() for s in (1, 2)]
    cut = [chunks.runs_of((b + tail).encode())[0] for b in bodies]
    assert all(c[-1] - c[-2] < chunks.RUN for c in cut)
    ended = [(1, bodies[0] + tail), (2, bodies[1] + tail), (3, "a whole text"), (4, "a whole text")]
    got = {r.doc_id: r.n_removed for r in chunks.without_repeats(spark.createDataFrame(ended, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 12}


def test_mix_odd_rows(spark, odd):
    got = mixing.mixed(odd).collect()
    assert len(got) == len(ODD) and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    assert sum(r.taken for r in got) <= 1.5 * sum(r.size for r in got)
    assert mixing.mixed(odd.limit(0)).count() == 0
    repeated = mixing.repeated(odd, mixing.mixed(odd))
    assert repeated.columns == odd.columns and repeated.count() == sum(r.taken // r.size for r in got if r.size)


def test_mix_refines_crowded_cuts(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 7 as int))").alias("text"),
                                    F.expr("concat('s', id % 4 % 3)").alias("source"))
    plain = sorted(map(tuple, mixing.mixed(docs).collect()))
    monkeypatch.setattr(mixing, "CUT_ROWS", 5)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    assert sorted(map(tuple, mixing.mixed(docs).collect())) == plain
    by_source = {}
    for _, source, _, _, target, taken in plain:
        by_source.setdefault(source, [target, 0])[1] += taken
    assert all(abs(t - n) <= 20 for t, n in by_source.values())


def test_marginals_equal_enumeration(monkeypatch):
    monkeypatch.setattr(langid, "LANE", 4)
    rng, lengths = np.random.default_rng(0), np.array([1, 3, 4, 5, 9, 2])
    score, moves, at = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3)), 0
    got = langid.marginals(score, lengths, moves)
    for n in lengths:
        want = np.zeros((n, 3))
        for labels in itertools.product(range(3), repeat=int(n)):
            weight = math.exp(sum(score[at + i, c] for i, c in enumerate(labels)) + sum(moves[a, b] for a, b in itertools.pairwise(labels)))
            for i, c in enumerate(labels):
                want[i, c] += weight
        assert np.allclose(want / want.sum(axis=1, keepdims=True), got[at : at + n])
        at += n


def test_language_of_held_out_and_odd_texts(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where("doc_id % 4 <> 2"), 60)
    found = langid.labelled(docs.where("doc_id % 4 = 2"), model).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.where("lang_pred = lang").count() >= 0.97 * found.count()
    rows = langid.labelled(odd, model).collect()
    assert len(rows) == len(ODD) and {r.lang_pred for r in rows if r.doc_id in (3, 4)} == {"und"} and all(0 <= r.score <= 1 for r in rows)
    assert langid.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.labelled(odd, None).collect()} == {"und"}


def test_toxicity_learns_from_documents_and_finds_the_sentence(spark, odd):
    rng = random.Random(4)
    sentence = lambda: " ".join("".join(rng.choice("aeiourst") for _ in range(4)) for _ in range(8)).capitalize()
    rows, labels = [], []
    for i in range(400):
        lines = [sentence() for _ in range(5)]
        if i % 3 == 0:
            lines[rng.randrange(5)] += " " + rng.choice(["zblark", "zquonk"])
        rows.append((i, ". ".join(lines)))
        labels.append((i, int(i % 3 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id < 300"), marks.where("doc_id < 300"))
    held = toxicity.scored(docs.where("doc_id >= 300"), model).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in held)
    assert all(re.search("zblark|zquonk", r.sentence) for r in held if r.doc_id % 3 == 0)
    assert {r.score for r in toxicity.scored(odd, model).collect() if r.doc_id in (3, 4)} == {0.0}
    assert toxicity.clean(odd, model).columns == odd.columns
    nothing = toxicity.fit(docs.limit(0), marks.limit(0))
    assert {r.score for r in toxicity.scored(docs, nothing).collect()} == {0.0}


VECTORS = [(i, [float(x) for x in np.random.default_rng(i).normal(size=8)]) for i in range(300)] + [(400 + i, [1.0] * 8) for i in range(60)]
BROKEN = [(500, None), (501, [1.0, None]), (502, [float("nan")]), (503, [float("inf")]), (None, [1.0] * 8)]


def test_fits_are_bounded_when_one_id_has_most_rows(spark, monkeypatch):
    """One id on 3,000 of 3,200 rows: the cap holds, every label is learned from, rows alike count once."""
    rows = [(7, f"hot wasser nummer {i % 1500}", "de") for i in range(3000)]
    rows += [(100 + i, f"cold water number {i}", "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    learned = {}

    def seen(name):
        def learn(texts, labels, *rest):
            learned[name] = list(zip(texts, labels))

        return learn

    monkeypatch.setattr(langid, "learn", seen("lang"))
    langid.fit(docs, 60)
    assert {lab: sum(x == lab for _, x in learned["lang"]) for lab in ("de", "en")} == {"de": 60, "en": 60}
    assert len(set(learned["lang"])) == 120
    marks = docs.select("doc_id", (F.col("doc_id") == 7).cast("int").alias("toxic"))
    monkeypatch.setattr(toxicity, "learn", seen("toxic"))
    toxicity.fit(docs, marks, 60)
    assert {lab: sum(x == lab for _, x in learned["toxic"]) for lab in (0, 1)} == {0: 60, 1: 60}
    monkeypatch.setattr(toxicity, "LABEL_BYTES", 200)
    toxicity.fit(docs, marks, 60)
    for lab in (0, 1):
        size = [len(t) for t, x in learned["toxic"] if x == lab]
        assert 0 < sum(size) <= 200 and sum(size) + 30 > 200
    monkeypatch.setattr(toxicity, "LABEL_BYTES", 1)
    toxicity.fit(docs, marks, 60)
    assert sorted(x for _, x in learned["toxic"]) == [0, 1]


def test_headers_with_numbers_beyond_64_bits():
    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    record = lambda page, size: (
        b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: %s\r\nContent-Length: %s\r\n\r\n" % (page, size) + block + b"\r\n\r\n"
    )
    size = b"%d" % len(block)
    found = list(warc.records(record(b"9" * 19, size) + record(b"5", b"9" * 19) + record(b"-7", size)))
    pages = [r.get("page_id") for r in found if r["kind"] == "record"]
    assert pages == [None, -7] and any(r["kind"] != "record" for r in found)


def test_ball_tree_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(balltree, "SHARD", 64)
    rows = spark.createDataFrame(VECTORS + BROKEN, "vec_id long, embedding array<double>").withColumn("shard", F.lit("z"))
    got = sorted(map(tuple, balltree.top_inner_products(rows, rows.where("vec_id % 20 = 0"), 5).collect()))
    ids, points = np.array([i for i, _ in VECTORS]), np.floor(256 * np.array([v for _, v in VECTORS])).astype(int)
    want = []
    for n in np.flatnonzero(ids % 20 == 0):
        score = points @ points[n]
        best = [j for j in np.lexsort((ids, -score)) if j != n][:5]
        want += [(ids[n], rank, ids[j], score[j]) for rank, j in enumerate(best, 1)]
    assert got == sorted(tuple(map(int, w)) for w in want)
    assert balltree.top_inner_products(rows.limit(0), rows, 5).count() == 0


def test_cross_polytope_recall_ties_and_few_rows(spark):
    rows = spark.createDataFrame([*VECTORS, *BROKEN, (600, [0.0] * 8)], "vec_id long, embedding array<double>").withColumn("class", F.lit("z"))
    found = {}
    for r in crosspolytope.nearest(rows, rows.where("vec_id % 20 = 0"), 10).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    ids, points = np.array([i for i, _ in VECTORS]), np.array([v for _, v in VECTORS])
    hits = 0
    for n in np.flatnonzero(ids % 20 == 0):
        best = [int(ids[j]) for j in np.lexsort((ids, -(points @ points[n]))) if j != n][:10]
        got = [i for _, i in sorted(found[int(ids[n])])]
        assert len(got) == 10
        hits += len(set(best) & set(got))
    assert hits >= 9 * len(found)
    few = rows.where("vec_id < 4")
    assert crosspolytope.nearest(few, few, 10).count() == 12
    assert crosspolytope.nearest(rows.limit(0), rows.limit(0), 10).count() == 0


def repeated_queries():
    """VECTORS, of which some queries are repeated: alike, with other vectors near by, and past any k."""
    rng = np.random.default_rng(9)
    rows = list(VECTORS)
    for i, v in VECTORS:
        if i % 20 == 0 and i < 300:
            rows += [(i, v)] * (i // 20)
            rows += [(i, [x + float(e) for x, e in zip(v, rng.normal(size=8) / 50, strict=True)]) for _ in range(i // 10)]
    return rows + [(7, VECTORS[40][1])] * 3


def plain_nearest(rows, points, k):
    ids, found = np.array([i for i, _ in rows]), {}
    for n in np.flatnonzero(ids % 20 == 0):
        score = points @ points[n]
        score = np.round(score, 9)  # equal vectors score alike
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[n]][:k]
        found[n] = [(int(ids[j]), score[j]) for j in order]
    return found


def test_ball_tree_with_repeated_query_rows(spark, monkeypatch):
    monkeypatch.setattr(balltree, "SHARD", 128)
    rows = repeated_queries()
    points = np.floor(256 * np.array([v for _, v in rows])).astype(int)
    asks, want = {}, []
    for n, best in plain_nearest(rows, points, 5).items():
        asks[rows[n][0]] = min(asks.get(rows[n][0], (rows[n][1], best)), (rows[n][1], best))  # the least vector asks
    for i, (_, best) in asks.items():
        want += [(i, rank, j, int(s)) for rank, (j, s) in enumerate(best, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, balltree.top_inner_products(table, table.where("vec_id % 20 = 0"), 5).collect())) == sorted(want)


def test_cross_polytope_with_repeated_query_rows(spark):
    rows = repeated_queries()
    unit = [(i, [float(x) for x in np.array(v) / np.linalg.norm(v)]) for i, v in rows]
    points, want = np.array([v for _, v in unit]), {}
    asked = set()
    for n, best in plain_nearest(unit, points, 10).items():
        if (unit[n][0], tuple(unit[n][1])) not in asked:  # each distinct vector of a query id asks
            asked.add((unit[n][0], tuple(unit[n][1])))
            want.setdefault(unit[n][0], []).extend((j, round(float(s), 6)) for j, s in best)
    table = spark.createDataFrame(unit, "vec_id long, embedding array<double>")
    got = {}
    for r in crosspolytope.nearest(table, table.where("vec_id % 20 = 0"), 10, probes=16).collect():  # 16 signed axes: all rows
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    assert got.keys() == want.keys()
    for i, best in want.items():
        assert np.allclose(sorted(got[i]), sorted(best), rtol=0, atol=3e-6), i


def test_segments_follow_their_distribution():
    lattices, words, n = segments.Lattices(segments.Vocabulary()), ["▁the", "▁at"], 8000
    lattices.add(words)

    def paths(state):
        for e in range(lattices.first[state], lattices.first[state + 1]):
            ends = [((), 0.0)] if lattices.following[e] == segments.END else paths(lattices.following[e])
            yield from (((e, *p), lattices.chance[e] + q) for p, q in ends)

    each = [list(paths(lattices.start[w])) for w in words]
    chance = {a + b: math.exp(x + y) for a, x in each[0] for b, y in each[1]}
    keys = [int(k) for k in segments.scramble(np.arange(1, n + 1, dtype=np.uint64))]
    rows = segments.segmented(lattices, [words] * n, keys, 3)
    assert all(len({tuple(s[0].tolist()) for s in r}) == 3 and r[0][2] > r[1][2] > r[2][2] for r in rows)
    for path, p in chance.items():
        second = sum(q * p / (1 - q) for o, q in chance.items() if o != path)
        for place, want in ((0, p), (1, second)):
            share = sum(tuple(r[place][0].tolist()) == path for r in rows) / n
            assert abs(share - want) < 5 * math.sqrt(want / n) + 1e-3
    assert abs(np.mean([sum(math.exp(s[1]) / s[3] for s in r) for r in rows]) - 1) < 0.02


def test_segments_round_trip(spark, odd):
    texts = ["", None, " ", "a▁b  c", "漢字🙂 é\n\x00x", "word " * 500, "the the"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = segments.decoded(segments.encoded(rows, 3)).collect()
    assert all(r.text == (texts[r.doc_id] or "") for r in found) and {r.doc_id for r in found} == set(range(len(texts)))
    assert {r.inclusion for r in found if r.doc_id in (0, 1)} == {1.0}
    assert segments.encoded(odd, 2).count() >= len(ODD) and segments.encoded(odd.limit(0), 2).count() == 0


def test_archives_round_trip(spark):
    big = "<p>é" + "y" * 200
    pages = [(1, "http://a", big), (2, "http://b\r\nX: 1", big), (None, None, big), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\n\r\n" + big),
             (6, "u", "small"), (7, "u", "small"), (1, "again", big)]
    path = warc.fresh_path(spark, "test")
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("z")), path)
    got = warc.read_archives(spark, path).collect()
    assert {r.kind for r in got} == {"record"} and len(got) == len(pages)
    want = {(i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), 1 if h == big and i != 1 else None) for i, _, h in pages}
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in got} == want
    empty = warc.fresh_path(spark, "test")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_archives(spark, empty).count() == 0


def record(n, body):
    digest = hashlib.sha256(body).hexdigest()
    head = f"WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: {n}\r\nWARC-Payload-Digest: sha256:{digest}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def test_salvage_skips_and_logs_damage():
    good = [record(i, bytes([65 + i]) * 300) for i in range(4)]
    broken = good[1].replace(b"BBB", b"BxB", 1)
    found = list(warc.records(good[0] + broken + good[2][:200] + good[3] + b"tail"))
    assert [(r["kind"], r.get("page_id")) for r in found] == [("record", 0), ("gap", None), ("record", 3), ("gap", None)]
    assert sum(r["length"] for r in found) == len(good[0] + broken + good[2][:200] + good[3] + b"tail")
    members = [gzip.compress(g) for g in good]
    hurt = members[1][:40] + b"\0\0\0" + members[1][43:]
    found = list(warc.records(members[0] + hurt + members[2] + members[3][:50]))
    assert [(r["kind"], r.get("page_id")) for r in found] == [("record", 0), ("gap", None), ("record", 2), ("gap", None)]


def test_salvage_keeps_good_records_of_damaged_members():
    rng = random.Random(8)
    good = [record(i, rng.randbytes(3000).hex().encode()) for i in range(40)]
    broken = good[7][:200] + b"x" + good[7][201:]
    assert broken != good[7] and len(broken) == len(good[7])
    plain = b"".join([*good[:7], broken, *good[8:]])
    kinds = lambda data: [(r["kind"], r.get("page_id")) for r in warc.records(data)]
    whole = [("record", i) for i in range(40)]
    with_gap = [*whole[:7], ("gap", None), *whole[8:]]
    assert kinds(gzip.compress(plain)) == with_gap
    assert kinds(gzip.compress(plain) + gzip.compress(good[0])) == [*with_gap, ("record", 0)]
    packed = gzip.compress(b"".join(good), mtime=0)
    cut = [r for r in warc.records(packed[:-5000] + gzip.compress(good[3]))]
    ids = [r["page_id"] for r in cut if r["kind"] == "record"]
    assert ids[-1] == 3 and ids[:-1] == list(range(len(ids) - 1)) and len(ids) > 36
    assert [r["error"] for r in cut if r["kind"] == "gap"]
    assert kinds(packed[:-3]) == [*whole, ("gap", None)]
    hurt = packed[:-9000] + bytes(50) + packed[-8950:]
    found = kinds(hurt)
    assert found[:30] == whole[:30] and ("gap", None) in found

"""Spelling variants, hard negatives and packing against plain versions, and on odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronotext.llm import negatives, packing, variants
from chronotext.llm.registry import prepared

CLASHES = ("word", "n", "h", "id", "run", "piece", "size", "block", "ids", "length", "start", "n_near", "shard", "label_", "rest", "my col", "a.b")


def with_clashes(rows, *but):
    return rows.select("*", *[F.lit("z").alias(c) for c in CLASHES if c not in but and c not in rows.columns])


# ---- spelling variants ------------------------------------------------------------------------------------------


def plain_words(rows, least_length=5, least_count=3):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts):
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def grouped(docs):
    got = variants.variant_groups(docs).collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}
    assert len(out) == len(got)
    return out


def test_variants_equal_brute_force(spark):
    prepared(spark)
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.randrange(5, 10))) for _ in range(60)]
    rows = []
    for doc in range(300):
        words = []
        for _ in range(40):
            w = base[int(rng.random() ** 2 * 60)]
            if rng.random() < 0.3:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + "q" + w[i:], w[:i] + "z" + w[i + 1 :], w.upper(), w + w[0]])
            words.append(w)
        rows.append((doc if doc % 9 else None, rng.choice([" ", "-", "ß1 ", "\n", "×"]).join(words)))
    got = grouped(with_clashes(spark.createDataFrame(rows, "doc_id long, text string")))
    want = plain_groups(plain_words(rows))
    assert got == want and sum(f is not None for f, *_ in want.values()) > 50


def test_variants_chains_of_forms_and_ties(spark):
    prepared(spark)
    rows = [(i, w) for w, n in (("abcdef", 64), ("abcdeg", 30), ("abcdhg", 14), ("abcihg", 6), ("abjihg", 3), ("zzzzza", 6), ("zzzzzb", 6), ("zzzzz", 3)) for i in range(n)]
    rows = [(i, w) for i, w in rows if zlib.crc32(f"{i}:{w}".encode()) % 97]  # none loses a letter
    counts = plain_words(rows)
    got = grouped(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == plain_groups(counts)
    assert got["abjihg"][1] == "abcdef" and got["zzzzz"][0] == min("zzzzza", "zzzzzb", key=lambda w: (-counts[w], w))


def test_variants_long_texts_nulls_and_nothing(spark):
    prepared(spark)
    rng = random.Random(5)
    some = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(4, 8))) for _ in range(300)]
    long = " ".join(rng.choice(some) for _ in range(60_000)) + "\U0001F600\n" + "x" * 200_000 + ", " + "Éa" * 40_000
    rows = [(1, long), (1, long), (2, None), (None, ""), (None, " \n\t"), (None, "y" * 70_000), (3, "y" * 70_000), (4, "Y" * 70_000)]
    assert len(long) > 6 * variants.PIECE
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word: r.n for r in variants.words(docs).collect()} == plain_words(rows)
    assert grouped(docs)["y" * 70_000][2] == 3
    assert variants.variant_groups(docs.limit(0)).count() == 0
    assert variants.variant_groups(docs.where("text is null")).count() == 0


def test_signatures_of_near_words_meet():
    rng = random.Random(6)
    for _ in range(300):
        word = "".join(rng.choice("aabcdeé") for _ in range(rng.randrange(5, 14)))
        i = rng.randrange(len(word))
        other = rng.choice([word[:i] + word[i + 1 :], word[:i] + "x" + word[i:], word[:i] + "y" + word[i + 1 :]])
        codes = np.array([ord(c) for c in word + other])
        one, two = variants.signatures(codes, np.array([0, len(word)]))
        assert len(one) == 28 and (one == two).any()


# ---- hard negatives ---------------------------------------------------------------------------------------------


def plain_negatives(rows, anchors, positives=5, negatives_=3, low=50, high=95):
    def usable(table):
        return [(i, y, np.floor(256 * np.array(v, float)).astype(int)) for i, y, v in table
                if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]

    width = max((len(v) for _, _, v in usable(rows)), default=0)
    pad = lambda v: np.pad(v, (0, width - len(v)))
    asked = {}
    for i, y, v in sorted(usable(anchors), key=lambda r: (r[0], r[1], list(r[2]))):
        asked.setdefault(i, (y, v))
    out = []
    for a, (y, v) in asked.items():
        scored = sorted((-int(pad(v) @ pad(u)), i, z) for i, z, u in usable(rows) if i != a)
        for s, p, _ in [r for r in scored if r[2] == y][:positives]:
            fit = [r for r in scored if r[2] != y and low * -s <= 100 * -r[0] <= high * -s][:negatives_]
            out += [(a, p, n + 1, r[1], -s, -r[0]) for n, r in enumerate(fit)]
    return sorted(out)


KIND = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("shard,block,step", [(4096, 256, 512), (40, 8, 16)])
def test_negatives_equal_brute_force(spark, monkeypatch, shard, block, step):
    prepared(spark)
    for name, value in (("SHARD", shard), ("BLOCK", block), ("STEP", step), ("PER_CLUSTER", 8)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(6, 8))
    x = base[rng.integers(0, 6, 400)] + rng.normal(size=(400, 8)) * 0.4
    x[100:230] = x[100]  # a third are one vector: ties everywhere
    x[5] = 0
    rows = [(i, int(rng.integers(0, 4)), v.tolist()) for i, v in enumerate(x)]
    rows += [(7, 1, x[7].tolist())] * 8 + [(20, 2, x[3].tolist())]  # repeated ids, an anchor with two vectors
    docs = with_clashes(spark.createDataFrame(rows, KIND))
    anchors = docs.where("vec_id % 10 = 0 or vec_id = 7")
    got = sorted(tuple(r) for r in negatives.hard_negatives(docs, anchors).collect())
    assert got == plain_negatives(rows, [r for r in rows if r[0] % 10 == 0 or r[0] == 7]) and len(got) > 100


def test_negatives_odd_rows(spark):
    prepared(spark)
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [0.9, 0.1]), (3, 1, [0.8, 0.0]), (4, 1, [0.7]), (5, None, [1.0, 0.0]), (6, 1, None), (None, 1, [0.5, 0.0]),
            (7, 1, [None, 0.5]), (8, 1, [float("nan"), 0.5]), (9, 1, [float("inf"), 0.5]), (10, 1, []), (11, 0, [-1.0, 0.0]), (12, 2, [0.0, 0.0])]
    docs = spark.createDataFrame(rows, KIND)
    got = sorted(tuple(r) for r in negatives.hard_negatives(docs, docs).collect())
    assert got == plain_negatives(rows, rows) and got
    assert negatives.hard_negatives(docs.limit(0), docs.limit(0)).count() == 0
    assert negatives.hard_negatives(docs, docs.limit(0)).count() == 0
    assert negatives.hard_negatives(docs.where("vec_id = 1"), docs.where("vec_id = 1")).count() == 0
    far = spark.createDataFrame([(1, 0, [1e12]), (2, 1, [1e12])], KIND)
    with pytest.raises(Exception, match="too long for exact"):
        negatives.hard_negatives(far, far).count()


def test_the_list_ends_before_its_rows_do():
    rng = np.random.default_rng(8)
    centre = np.eye(16)[0]
    points = negatives.scaled(np.concatenate([centre + rng.normal(size=(200, 16)) * 0.1, -centre + rng.normal(size=(2000, 16)) * 0.1]))
    anchors = negatives.scaled(centre + rng.normal(size=(10, 16)) * 0.05)
    order, bound = negatives.shared_list(anchors, negatives.unit(anchors.sum(axis=0)), points)
    length = np.linalg.norm(anchors, axis=1)
    assert ((anchors @ points[order].T) <= length[:, None] * bound[None, :]).all() and (np.diff(bound) <= 0).all()
    fifth = np.sort(anchors @ points.T, axis=1)[:, -5]
    assert max((length * bound[i] >= fifth).any() * i for i in range(len(order))) < 250  # of 2,200


# ---- packing ----------------------------------------------------------------------------------------------------


def plain_ids(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def check_pieces(rows, got, longest=4096):
    want = Counter((doc, tuple(plain_ids(text))) for doc, text in rows)
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and len(r.ids) == r.length for r in got)
    assert all(r.length <= longest and r.length & (r.length - 1) == 0 for r in got)
    found, whole = Counter(), []
    for r in got:
        if r.start == 0:
            whole.append([r.doc_id, [], r.doc_tokens])
        assert whole[-1][0] == r.doc_id and len(whole[-1][1]) == r.start and whole[-1][2] == r.doc_tokens
        whole[-1][1].extend(r.ids)
    for doc, ids, n in whole:
        assert len(ids) == n
        found[doc, tuple(ids)] += 1
    assert found == want
    fewest = sum((len(i) >> 12) + bin(len(i) & 4095).count("1") for (_, i), n in want.items() for _ in range(n))
    assert longest != 4096 or len(got) == fewest


ODD = ["One two, three!", "", " \n\t ", None, "<|endoftext|> x <|startoftext|>y", "a\x1cb c d ́é ÉÈ'S we'LL 123 \U0001F600\U0001F468‍\U0001F469 中文字",
       "word " * 5000, "x" * 3000, "Å\r\n\r\nİstanbul ΣΑΣ ſ", "one  two   three"]


def test_packing_equals_plain_tokens(spark):
    prepared(spark)
    rows = [(i if i % 3 else None, t) for i, t in enumerate(ODD)] + [(2, "same"), (2, "same")]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "ids")
    got = packing.packed(docs).collect()
    check_pieces(rows, got)
    sums = packing.with_crc32(packing.packed(docs)).collect()
    assert sorted((r.sequence_id, r.ids_crc32) for r in sums) == sorted((r.sequence_id, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got)
    assert packing.packed(docs.limit(0)).count() == 0
    check_pieces(rows, packing.packed(docs, longest=8).collect(), 8)
    with pytest.raises(ValueError):
        packing.packed(docs, longest=100)


def test_packing_long_texts_and_forgotten_words(spark, monkeypatch):
    prepared(spark)
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcdé,.") for _ in range(rng.randrange(1, 9))) for _ in range(n)) for n in (3000, 10, 900, 5000, 1)]
    rows = list(enumerate([*texts, "z" * 5000, *texts]))
    for name, value in (("PIECE", 1000), ("HANDED", 500), ("WORDS", 50)):
        monkeypatch.setattr(packing, name, value)
    check_pieces(rows, packing.packed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())


def test_buckets_hold_one_length(spark, tmp_path):
    prepared(spark)
    rows = [(i, "word " * i) for i in range(40)]
    pieces = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"))
    packing.write_buckets(pieces, str(tmp_path / "buckets"))
    back = spark.read.parquet(str(tmp_path / "buckets"))
    assert back.count() == pieces.count() and back.where(F.size("ids") != F.col("length")).isEmpty()
    assert {p.name for p in (tmp_path / "buckets").glob("length=*")} == {f"length={1 << i}" for i in range(6)}

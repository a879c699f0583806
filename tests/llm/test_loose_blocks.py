"""Near copies in a crowd: no table grows with the square of the crowd, and blocks of any size give the same links."""

import random

import numpy as np
from chronotext.llm import simhash


def crowd(n, most, seed):
    rng = random.Random(seed)
    texts = {}
    for i in range(n):
        words = [f"w{j}" for j in range(150)][: 150 - i % 40]
        for at in rng.sample(range(len(words)), i % most):
            words[at] = f"other{rng.randrange(50)}"
        texts[i] = " ".join(words)
    return texts


def test_a_crowd_is_never_listed_as_pairs(spark, monkeypatch):
    rows, kept = [], simhash.stage

    def counted(df, name, *partition_by):
        rows.append(kept(df, name, *partition_by).count())
        return kept(df, name, *partition_by)

    monkeypatch.setattr(simhash, "stage", counted)
    docs = spark.createDataFrame(list(crowd(600, 5, 3).items()), "doc_id long, text string")
    simhash.near_groups(docs).collect()
    assert max(rows) <= 600 * simhash.WIDE * simhash.BITS // simhash.BAND  # a link a text and band


def test_small_blocks_lose_no_link(spark, monkeypatch):
    texts = crowd(120, 9, 4)
    sets = {i: simhash.shingle_set(t.encode(), 5) for i, t in texts.items()}
    least = np.arange(120)
    for a in texts:
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                least = simhash.least_reached(np.array([a]), np.array([b]), least)
    assert 10 < len(set(least.tolist())) < 110
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(simhash, "REACH", 128)
    for block, row, terms, many in ((1 << 20, 512, 4096, 32), (400, 0, 7, 2)):
        for name, value in (("BLOCK", block), ("ROW", row), ("TERMS", terms), ("MANY", many)):
            monkeypatch.setattr(simhash, name, value)
        got = {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()}
        assert [got[i] for i in range(120)] == least.tolist()


def test_alike_texts_that_no_band_brings_together_are_linked(spark, monkeypatch):
    rng = random.Random(11)
    texts = {}
    for pair in range(80):
        words = [f"p{pair}x{i}" for i in range(124)]
        texts[2 * pair] = " ".join(words)
        for at in range(rng.randrange(1, 5), 100, 50):  # 10 of 120 shingles go and 10 come
            words[at + 5] = f"other{at}"
        texts[2 * pair + 1] = " ".join([*words, *(f"more{pair}y{i}" for i in range(5))])
    sets = {i: simhash.shingle_set(t.encode(), 5) for i, t in texts.items()}
    for i in range(0, 160, 2):
        both = len(np.intersect1d(sets[i], sets[i + 1]))
        assert both >= 0.8 * (len(sets[i]) + len(sets[i + 1]) - both)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for reach in (36, -1):  # -1: no fingerprints are near
        monkeypatch.setattr(simhash, "REACH", reach)
        got = {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()}
        assert [got[i] for i in range(160)] == [i - i % 2 for i in range(160)]

"""Crowds of near copies: every pair that is alike is linked, also where a band has more members than are compared at once."""

import random

import numpy as np
from chronotext.llm import simhash


def test_no_link_of_a_crowd_is_lost(spark, monkeypatch):
    tree = simhash.near_tree

    def unlucky(checks):  # a tree that joins all to the first, alike or not
        found, at = tree(checks), np.arange(1, len(checks))
        return (np.zeros_like(at), at, *([False] if len(found) == 3 else []))

    monkeypatch.setattr(simhash, "near_tree", unlucky)
    monkeypatch.setattr(simhash, "REACH", 128)  # members of a band are candidates
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(90):
        words = list(base)
        for at in rng.sample(range(200), 3 + i % 4):
            words[at] = f"other{rng.randrange(3)}"
        texts[i] = " ".join(words)
    sets = {i: simhash.shingle_set(t.encode(), 5) for i, t in texts.items()}
    bands = {i: simhash.wide_print(s).view(np.uint16) for i, s in sets.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    alike = 0
    for a in texts:
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) and (bands[a] == bands[b]).any():
                alike += 1
                root[top(a)] = top(b)
    want = {}
    for i in texts:
        want.setdefault(top(i), set()).add(i)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {}
    for r in simhash.near_groups(docs).collect():
        got.setdefault(r.root, set()).add(r.doc_id)
    assert alike > 5 and len(want) > 10
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))

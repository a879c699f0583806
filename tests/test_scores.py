import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotext.operators.scores import (
    agreement,
    assign_max,
    best_mapping,
    classification_scores,
    contingency,
    f1_report,
    silhouette,
    silhouette_rows,
    silhouette_rows_sparse,
)


def _cells(spark, pairs):
    return contingency(spark.createDataFrame(pairs, "t string, p string"), "t", "p")


@pytest.mark.parametrize(
    "pairs, ari, nmi",
    [
        ([("a", "x"), ("a", "x"), ("b", "y")], 1.0, 1.0),
        ([("a", "x"), ("a", "x")], 1.0, 1.0),
        ([("a", "x"), ("b", "y"), ("c", "z")], 1.0, 1.0),
        ([("a", "x"), ("b", "x"), ("c", "x")], 0.0, 0.0),
        ([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")], -0.5, 0.0),
    ],
)
def test_agreement(spark, pairs, ari, nmi):
    got = agreement(_cells(spark, pairs)).first()
    assert got.ari == pytest.approx(ari) and got.nmi == pytest.approx(nmi)


def test_f1_of_a_class_that_is_never_true(spark):
    cells = _cells(spark, [("a", "a"), ("a", "c"), ("b", "a"), ("b", "b")])
    report = {r.label: (r.precision, r.recall, r.f1, r.support) for r in f1_report(cells).collect()}
    assert report == {"a": (0.5, 0.5, 0.5, 2), "b": (1.0, 0.5, pytest.approx(2 / 3), 2), "c": (0.0, 0.0, 0.0, 0)}
    assert classification_scores(cells).first().f1_weighted == pytest.approx((0.5 + 2 / 3) / 2)


def _brute_silhouette(x, c):
    length = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    d = 1 - u @ u.T
    np.fill_diagonal(d, 0)
    out = []
    for i in range(len(x)):
        mine = (c == c[i]) & (np.arange(len(x)) != i)
        if not mine.any():
            out.append(0.0)
            continue
        a, b = d[i, mine].mean(), min(d[i, c == o].mean() for o in set(c) - {c[i]})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.array(out)


def test_silhouette_dense_and_sparse_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)) * (rng.random((60, 5)) < 0.6)
    x[7] = 0
    c = rng.integers(0, 3, 60)
    c[11] = 9
    unit = x / np.where(np.linalg.norm(x, axis=1) > 0, np.linalg.norm(x, axis=1), 1)[:, None]
    want = _brute_silhouette(x, c)
    clusters = spark.createDataFrame([(i, int(v)) for i, v in enumerate(c)], "row_id bigint, cluster int")
    dense = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id bigint, features array<double>")
    got = {r.row_id: r.silhouette for r in silhouette_rows(dense, clusters).collect()}
    assert np.allclose([got[i] for i in range(60)], want)
    long = [(int(i), f"t{j}", float(unit[i, j])) for i, j in zip(*np.nonzero(unit))]
    weights = spark.createDataFrame(long, "row_id bigint, term string, weight double")
    got = {r.row_id: r.silhouette for r in silhouette_rows_sparse(weights, clusters).collect()}
    assert np.allclose([got[i] for i in range(60)], want)
    one = clusters.withColumn("cluster", F.lit(1))
    assert silhouette(silhouette_rows(dense, one)).first()[0] is None
    assert silhouette(silhouette_rows_sparse(weights, one)).first()[0] is None


def test_assignment_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 5))
        m = int(rng.integers(n, 6))
        grid = rng.integers(0, 20, (n, m))
        chosen = assign_max(grid)
        best = max(sum(grid[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert len(set(chosen)) == n and grid[np.arange(n), chosen].sum() == best


def test_best_mapping_leaves_extra_clusters_out(spark):
    pairs = [("a", "1")] * 5 + [("b", "2")] * 4 + [("a", "3")] * 6 + [("b", "3")] * 2
    got = {(r.pred, r.truth, r.n) for r in best_mapping(_cells(spark, pairs)).collect()}
    assert got == {("3", "a", 6), ("2", "b", 4)}


def test_comparison_shows_no_fraction_for_nan(spark):
    from chronotext.operators.report import score_comparison

    rows = [("tfidf-lr", float("nan"), 0.5, None)]
    kinds = "Method string, TrainFrac double, LR_F1_weighted double, LLM_F1_weighted double"
    assert score_comparison(spark.createDataFrame(rows, kinds)).first()["label"] == "TFIDF LR"

"""What is shuffled and written is small and does not stay longer than it is read."""

import os

import numpy as np
import pytest
from chronotext import session
from chronotext.operators import blocks as blocks_module
from chronotext.operators import cluster, coded, neighbours, reduce, regression, wordfit
from chronotext.operators.blocks import SHARES, SURPRISE, Part, counted_row, dense_blocks
from chronotext.operators.packed import loosened, tightened
from chronotext.operators.tfidf import tfidf_blocks
from pyspark.sql import functions as F


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(found.apply(i).getName().endswith(".data") for i in range(found.size()))


def test_a_staged_table_leaves_no_shuffle_files_and_can_be_discarded(spark):
    before = shuffle_files(spark)
    made = session.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "swept")
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        __import__("time").sleep(0.1)
    assert shuffle_files(spark) <= before and made.count() == 7
    path = made.staged_at.removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(path)
    session.discard(made)
    assert not os.path.exists(path)
    assert spark.conf.get(session.SWEEP) == "false"


def test_numbers_survive_packing():
    for kind in (np.int32, np.int64, np.float64):
        for values in (np.zeros(0, kind), np.arange(-5, 1000).astype(kind)):
            assert (loosened(tightened(values), kind, len(values)) == values).all()
    assert len(tightened(np.ones(10000, np.int64))) < 100


def test_blocks_of_counts_hold_the_values():
    ids, starts, at = np.array([4, 7, 9]), np.array([0, 2, 2, 5]), np.array([30, 50, 10, 30, 40])
    count, of_row, of_column = np.array([1, 2, 3, 1, 1]), np.array([2.0, 1.0, 4.0]), np.array([1.5, 0.5, 2.5, 1.5, 3.0])
    row = np.array([0, 0, 2, 2, 2])
    for width, want in ((SHARES, count * of_column / of_row[row]), (SURPRISE, np.log(count / (of_row[row] * of_column)))):
        part = Part(counted_row(width, 3, ids, starts, at, count, of_row, of_column).to_pylist()[0])
        assert part.values.tolist() == want.tolist() and part.at[part.local].tolist() == at.tolist() and part.ids.tolist() == [4, 7, 9]


def test_tfidf_blocks_are_a_third_of_their_values(spark):
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 300) % 500)) for i in range(400)]
    with tfidf_blocks(spark.createDataFrame(texts, "row_id long, text string"), 2, 0.95, (1, 2)) as blocks:
        for row in blocks.rows.collect():
            part = Part(row.asDict())
            assert len(row["local"]) + len(row["slim"]) - 8 * (part.n + len(part.at) + 1) < 12 * len(part.values) / 3


@pytest.fixture
def tables(monkeypatch):
    """How many bytes of tables of each name are there at most."""
    there, most = {}, {}
    kept, dropped = session.stage, session.discard

    def stage(df, name, *by):
        made = kept(df, name, *by)
        there[made.staged_at] = name
        most[name] = max(most.get(name, 0), sum(n == name for n in there.values()))
        return made

    def discard(*tables):
        for table in tables:
            there.pop(table.staged_at)
        dropped(*tables)

    for module in (blocks_module, cluster, coded, reduce, regression, wordfit):
        for name, put in (("stage", stage), ("discard", discard)):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, put)
    return most


def test_iterations_keep_two_states(spark, tables, monkeypatch):
    monkeypatch.setattr(cluster, "FEW_CELLS", 0)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)]
    features = spark.createDataFrame(rows, "row_id long, features array<double>")
    train = spark.createDataFrame([(i, int(x[0] + x[1] > 0)) for i, x in rows], "row_id long, label long")
    with dense_blocks(features) as blocks:
        assert cluster.kmeans(blocks, 3, restarts=2, max_iter=4).steps == 4
        regression.fit(blocks, train, 2, max_iter=4)
        reduce.factors(blocks, 2, iterations=3)
    assert {n: tables[n] for n in ("step", "centres", "coefficients", "directions")} == {"step": 2, "centres": 2, "coefficients": 2, "directions": 2}


def test_waves_of_asking_blocks_find_the_same_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(600)]
    features = spark.createDataFrame(rows, "row_id long, features array<double>")
    asked = []
    kept = neighbours._waves
    monkeypatch.setattr(neighbours, "_waves", lambda wanted, sizes, most, slots: asked.append(kept(wanted, sizes, most, 2)) or asked[-1])
    found = {}
    for wave in (1 << 20, 0):
        monkeypatch.setattr(neighbours, "WAVE", wave)
        found[wave] = sorted(tuple(r) for r in neighbours.knn(features, 5, block_rows=64).collect())
    assert len(asked[0]) == 1 and len(asked[1]) > 2 and found[0] == found[1 << 20] and len(found[0]) == 3000

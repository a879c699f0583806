import random

import pytest
from pyspark.sql import functions as F

from chronotext.operators.ranking import cut_below, nth_smallest, number_in_order, positions, quota_cut, within_cut
from chronotext.operators.split import stratified_split, temporal_split
from chronotext.session import stage


@pytest.mark.parametrize("values", [[5], [-3, -3, 9, 1 << 62, -(1 << 62)], [7] * 50 + list(range(100)), list(range(-40000, 40000, 7))])
def test_nth_smallest(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "k bigint")
    ordered = sorted(values)
    for rank in {1, len(values) // 2 + 1, len(values)}:
        value, below, equal = nth_smallest(df, "k", rank)
        assert value == ordered[rank - 1] and below == sum(v < value for v in values)
        assert equal == values.count(value)


def test_cut_below_breaks_a_large_tie_by_id(spark):
    rows = [(i, 5 if i % 3 else i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, k bigint").repartition(7)
    want = {i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))[:1000]}
    assert {r.id for r in df.where(cut_below(df, "k", "id", 1000)).collect()} == want


def test_quota_cut_with_a_hot_group(spark):
    rng = random.Random(0)
    rows = [(i, "hot" if i % 3 else f"g{i % 11}", rng.randrange(1 << 60)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id bigint, g string, k bigint")
    quota = {"hot": 700, "g0": 3, "g3": 10_000, "g6": 0}
    asked = spark.createDataFrame(list(quota.items()), "g string, quota bigint")
    cuts = quota_cut(df, "g", "k", "id", asked)
    got = {(r.g, r.id) for r in df.join(cuts, "g").where(within_cut("k", "id")).collect()}
    want = set()
    for g, n in quota.items():
        mine = sorted((k, i) for i, h, k in rows if h == g)[:n]
        want |= {(g, i) for _, i in mine}
    assert got == want


@pytest.mark.parametrize("ranked", [1, 40, 100_000])
def test_quota_cut_with_a_crowded_key(spark, monkeypatch, ranked):
    monkeypatch.setattr("chronotext.operators.ranking.RANKED", ranked)
    rows = [((i - 900) * 7_919_000_001, "hot" if i % 3 else "small", 5 if i % 4 else i) for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, g string, k bigint").repartition(3)
    quota = {"hot": 611, "small": 77}
    cuts = quota_cut(df, "g", "k", "id", spark.createDataFrame(list(quota.items()), "g string, quota bigint")).collect()
    ordered = {g: sorted((k, i) for i, h, k in rows if h == g) for g in quota}
    assert {(r.g, r.cut_key, r.cut_tie) for r in cuts} == {(g, *ordered[g][n - 1]) for g, n in quota.items()}
    assert all(r.cut_key == 5 for r in cuts)


def test_positions_are_dense_under_ties(spark):
    rows = [(i, 1 if i % 2 else i % 17) for i in range(5000)]
    df = spark.createDataFrame(rows, "id bigint, k bigint").repartition(9)
    got = {r.id: r.position for r in positions(df, ["k", "id"]).collect()}
    assert got == {i: at for at, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}


def test_number_in_order_keeps_partition_order(spark):
    df = spark.range(0, 1000, 1, 6).where("id % 3 = 0")
    got = [(r.id, r.n) for r in number_in_order(df, "n").collect()]
    assert sorted(got) == [(3 * i, i) for i in range(334)]


def _corpus(spark, stamps):
    return spark.createDataFrame(list(enumerate(stamps)), "row_id bigint, t string").select(
        "row_id", F.to_timestamp("t").alias("timestamp")
    )


def test_temporal_split_half_even_and_clamped(spark):
    five = _corpus(spark, [f"2024-01-0{i}" for i in range(1, 6)])
    assert temporal_split(five, 0.5).where("split = 'train'").count() == 2  # 2.5 rounds to the even number
    two = _corpus(spark, ["2024-01-02", "2024-01-01"])
    assert [(r.row_id, r.split) for r in temporal_split(two, 0.01).orderBy("row_id").collect()] == [(0, "test"), (1, "train")]
    assert temporal_split(two, 0.99).where("split = 'test'").count() == 1
    with pytest.raises(ValueError):
        temporal_split(_corpus(spark, ["2024-01-01"]), 0.5)


def test_temporal_split_one_time_and_missing_time(spark):
    same = _corpus(spark, ["2024-01-01"] * 10)
    assert {r.row_id for r in temporal_split(same, 0.3).where("split = 'train'").collect()} == {0, 1, 2}
    gaps = _corpus(spark, [None, "2024-01-01", None, "2023-01-01"])
    assert {r.row_id for r in temporal_split(gaps, 0.5).where("split = 'train'").collect()} == {1, 3}


def test_split_does_not_depend_on_partitions(spark):
    df = _corpus(spark, [f"2024-01-{1 + i % 9:02d}" for i in range(500)])
    a = {r.row_id for r in temporal_split(df.repartition(1), 0.37).where("split = 'train'").collect()}
    b = {r.row_id for r in temporal_split(df.repartition(13), 0.37).where("split = 'train'").collect()}
    assert a == b and len(a) == 185


def test_stratified_split_quotas(spark):
    rows = [(i, 0 if i < 70 else 1 if i < 97 else 2) for i in range(100)]
    df = spark.createDataFrame(rows, "row_id bigint, label int")
    test = stratified_split(df, "label", 0.3).where("split = 'test'").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in test} == {0: 21, 1: 8, 2: 1}
    with pytest.raises(ValueError):
        stratified_split(df.where("row_id < 98"), "label", 0.3)


def test_stratified_split_nulls(spark):
    df = spark.createDataFrame([(i, "a" if i < 10 else None) for i in range(20)], "row_id bigint, label string")
    test = stratified_split(df, "label", 0.3).where("split = 'test'").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in test} == {"a": 3, None: 3}


def test_cutting_plan_has_no_global_window(spark):
    df = stage(spark.range(1000).withColumn("k", F.col("id") % 10), "plain")
    plan = df.where(cut_below(df, "k", "id", 100))._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan and "PushedFilters: [" in plan

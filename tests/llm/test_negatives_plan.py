"""Hard negatives: what stands there for every shard is never sent through the driver."""

import random

from chronotext.llm import negatives


def test_blocks_of_anchors_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD", 8)
    rng = random.Random(2)
    rows = [(i, i % 3, [rng.random() for _ in range(8)]) for i in range(200)]
    docs = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    found = negatives.hard_negatives(docs, docs.where("vec_id % 5 = 0"))
    assert found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [shard#" in plan and "BroadcastHashJoin [shard#" not in plan

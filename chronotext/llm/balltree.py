"""Exact top-k inner products by branch and bound over ball trees, one tree per shard.

A ball holds vectors within `radius` of `centre`, so no inner product with q in it exceeds q.centre + |q| radius. Nodes are
visited by that bound, best first, until it falls below the kth score found. The kth score is shared: a query first
searches one shard, and every shard then starts from the kth score found there. Trees are built once and stored as rows;
queries travel in blocks, a block and a shard meet in one row, and only the k best of a block leave it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotext.llm.registry import query, table
from chronotext.llm.vectors import matrix, usable
from chronotext.session import stage

#: Vectors of a shard, queries of a block, vectors of a leaf.
SHARD, BLOCK, LEAF = 4096, 128, 32
SCALE = 256.0


def scaled(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) of every component, as whole numbers (they and their inner products must fit 64 bits)."""
    return np.floor(SCALE * vectors).astype(np.int64)


def tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, nodes, centres, radii); a node is (start, end, left, right) over `order`, a leaf has no children (-1)."""
    order, nodes, centres, radii = np.arange(len(points)), [], [], []
    todo = [(0, len(points), -1, 0)]
    while todo:
        start, end, parent, side = todo.pop()
        mine = points[order[start:end]].astype(float)
        centre = mine.mean(axis=0)
        far = np.sqrt(((mine - centre) ** 2).sum(axis=1))
        number = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = number
        nodes.append([start, end, -1, -1])
        centres.append(centre)
        radii.append(far.max())
        if end - start <= LEAF or far.max() == 0:
            continue
        one = mine[far.argmax()]
        other = mine[((mine - one) ** 2).sum(axis=1).argmax()]
        along = mine @ (other - one)
        order[start:end] = order[start:end][np.argsort(along, kind="stable")]
        middle = (start + end) // 2
        todo += [(start, middle, number, 0), (middle, end, number, 1)]
    return order, np.array(nodes, np.int64), np.array(centres), np.array(radii)


def best(q: np.ndarray, own: int, k: int, floor: int | None, ids, points, nodes, centres, radii) -> list[tuple[int, int]]:
    """The k best (score, vec_id) of one shard, those below `floor` left out; ties go to the smaller id."""
    size = float(np.sqrt((q.astype(float) ** 2).sum()))
    bound = centres @ q.astype(float) + size * radii
    bound += 1e-9 * (np.abs(bound) + size * (radii + 1)) + 1e-6  # rounding must not hide a tie
    queue, found = [(-bound[0], 0)], []
    while queue:
        upper, node = heapq.heappop(queue)
        if (len(found) == k and -upper < found[0][0]) or (floor is not None and -upper < floor):
            break
        start, end, left, right = nodes[node]
        if left >= 0:
            heapq.heappush(queue, (-bound[left], left))
            heapq.heappush(queue, (-bound[right], right))
            continue
        others = ids[start:end] != own  # a repeated id may fill the leaf: its rows go before the cut to k
        score, some = (points[start:end] @ q)[others], ids[start:end][others]
        if len(some) > k:
            top = np.lexsort((some, -score))[:k]
            score, some = score[top], some[top]
        for s, i in zip(score.tolist(), some.tolist(), strict=True):
            if floor is not None and s < floor:
                continue
            if len(found) < k:
                heapq.heappush(found, (s, -i))
            elif (s, -i) > found[0]:
                heapq.heapreplace(found, (s, -i))
    return [(s, -i) for s, i in found]


def top_inner_products(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """`query_id, rank, vec_id, score`: the k rows with the greatest inner products of scaled vectors, for every query.

    Both take vec_id and embedding. Rows with a null id or embedding, or with null or non-finite components, take no part;
    shorter vectors are filled up with zeros. A row is no candidate for a query of its own id. Of queries that repeat an
    id the least vector asks; repeated candidates count as often as they occur. Empty tables give no rows.
    """
    rows = stage(usable(rows), "vectors")
    count, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    shards = max(1, -(-count // SHARD))
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")  # where a query begins: any shard would do
    dealt = F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(shards)).cast("int")

    def grown(points: pa.Table) -> pa.Table:
        ids, vectors = points["vec_id"].to_numpy(), scaled(matrix(points["v"], width))
        order, nodes, centres, radii = tree(vectors)
        parts = [ids[order], vectors[order], nodes, centres, radii]
        cells = [pa.array([points["shard"][0].as_py()], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)]
        return pa.Table.from_arrays(cells, names=["shard", "ids", "points", "nodes", "centres", "radii"])

    kind = "shard int, ids binary, points binary, nodes binary, centres binary, radii binary"
    index = stage(rows.withColumn("shard", dealt).groupBy("shard").applyInArrow(grown, kind), "trees")
    asked = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = stage(asked.select(F.col("vec_id").alias("query_id"), "v", home.alias("home")), "queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(len(batch)):
                at = lambda name, dtype: np.frombuffer(batch.column(name)[row].as_buffer(), dtype)  # noqa: E731, B023
                ids, nodes, radii = at("ids", np.int64), at("nodes", np.int64).reshape(-1, 4), at("radii", float)
                points, centres = at("points", np.int64).reshape(len(ids), width), at("centres", float).reshape(-1, width)
                block = pa.array(batch.column("block")[row].as_py(), batch.column("block").type.value_type)
                vectors = scaled(matrix(block.field("v"), width))
                own, floors = block.field("query_id").to_pylist(), block.field("floor").to_pylist()
                for q, i, floor in zip(vectors, own, floors, strict=True):
                    out += [(i, s, c) for s, c in best(q, i, k, floor, ids, points, nodes, centres, radii)]
            columns = [pa.array([o[c] for o in out], pa.int64()) for c in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "score", "vec_id"])

    def searched(asked_: DataFrame) -> DataFrame:
        """Results of queries (query_id, v, floor, shard) in the shard they name."""
        salt = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asks // BLOCK)))).alias("salt")
        blocks = asked_.groupBy("shard", salt).agg(F.collect_list(F.struct("query_id", "v", "floor")).alias("block"))
        met = blocks.join(index, "shard")
        met = met.repartition(max(8, spark.sparkContext.defaultParallelism), "shard", "salt")
        return met.drop("salt").mapInArrow(search, "query_id long, score long, vec_id long")

    spark = rows.sparkSession
    asks = asked.count()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    nothing = F.lit(None).cast("long").alias("floor")
    near = searched(asked.select("query_id", "v", nothing, F.col("home").alias("shard")))
    kth = near.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k)
    kth = stage(kth.select("query_id", "floor"), "floors")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")  # a stated query set against all shards
    found = searched(asked.join(kth, "query_id", "left").select("query_id", "v", "floor", every))
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


BALL_SQL = """
WITH v AS (
    SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op5_ball_tree_top_k", BALL_SQL)
def ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_inner_products(rows, rows.where("vec_id % 50 = 0"), 5)

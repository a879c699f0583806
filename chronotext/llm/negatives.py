"""Hard negatives: rows of another label that score below an anchor's positives, by lists shared in clusters of anchors.

Anchors are clustered by direction. For a cluster, no anchor within the angle `spread` of the centre can score more than
|anchor| |x| cos(max(0, angle(x, centre) - spread)) with a row x (Abuzaid, Sethi, Bailis and Zaharia 2019). The rows of a
shard are sorted by that bound once for a block of a cluster, and all its anchors walk the one list, some rows at a time:
each leaves it when the bound times its own length falls below what it still needs, so nothing better can follow.

Positives come first, the best rows of the anchor's label. Their scores bound the negatives from both sides, and a second
walk finds the best rows of other labels between the bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotext.llm.registry import query, table
from chronotext.llm.vectors import matrix
from chronotext.session import stage

#: Rows of a shard, anchors of a block, rows of a list taken at a time.
SHARD, BLOCK, STEP = 4096, 256, 512
#: Anchors from which the cluster centres are learned (the ones of least hash), anchors a cluster.
FIT, PER_CLUSTER = 2048, 64
SCALE = 256.0
#: Whole numbers below this are exact as doubles, and so are sums of their products while the lengths' product is.
EXACT = 2.0**53


def usable(rows: DataFrame) -> DataFrame:
    """`vec_id, label, v` of the rows with a vec_id, a label and a vector of finite components."""
    limit = F.lit(float("inf"))
    fine = F.forall("v", lambda x: F.coalesce((F.abs(x) < limit) & ~F.isnan(x), F.lit(False)))
    found = rows.where("vec_id is not null and label is not null and embedding is not null")
    vector = F.col("embedding").cast("array<double>").alias("v")
    return found.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector).where(fine)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) of every component, as whole numbers held in doubles."""
    return np.floor(SCALE * vectors)


def unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def centres_of(anchors: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Directions that the anchors gather around (spherical k-means from evenly spaced rows)."""
    points = unit(anchors)
    centres = points[:: max(1, len(points) // clusters)][:clusters]
    for _ in range(rounds):
        near = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = unit(np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, sums, centres))
    return centres


def hundredth(value: Column) -> Column:
    """A whole number divided by 100 and rounded down, as a double."""
    return (value - F.pmod(value, F.lit(100))) / F.lit(100.0)


def shared_list(anchors: np.ndarray, centre: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the points by the bound that holds for every anchor, and the bounds for an anchor of length one."""
    length = np.linalg.norm(points, axis=1)
    cosine = np.divide(points @ centre, length, out=np.ones(len(points)), where=length > 0)
    angle = np.arccos(np.clip(cosine, -1.0, 1.0))
    spread = np.arccos(np.clip((unit(anchors) @ centre).min(), -1.0, 1.0)) + 1e-7
    if not centre.any() or not anchors.any(axis=1).all():  # no direction: lengths alone bound the score
        spread = np.pi
    bound = length * np.cos(np.maximum(0.0, angle - spread)) + 1e-6 * (length + 1)
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def walk(
    anchors: np.ndarray,
    owner: np.ndarray,
    same: bool,
    low: np.ndarray,
    high: np.ndarray,
    k: int,
    ids: np.ndarray,
    labels: np.ndarray,
    own: np.ndarray,
    own_label: np.ndarray,
    points: np.ndarray,
    order: np.ndarray,
    bound: np.ndarray,
) -> list[tuple[int, int, int]]:
    """(ask, score, id): for each ask the k best rows of scores low..high whose label is the anchor's (or is not).

    Ask j belongs to anchor owner[j]. It ends when the bound of the next row falls below the kth score found, or below low.
    """
    size = np.linalg.norm(anchors, axis=1)
    if len(points) and size.max(initial=0.0) * np.linalg.norm(points, axis=1).max() >= EXACT:
        raise ValueError("vectors are too long for exact whole-number scores")
    need = low.astype(float)
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(owner)
    active = np.arange(len(owner))
    for at in range(0, len(order), STEP):
        active = active[size[owner[active]] * bound[at] >= need[active]]
        if not len(active):
            break
        some = order[at : at + STEP]
        who, row = np.unique(owner[active], return_inverse=True)
        score = (anchors[who] @ points[some].T)[row]
        fits = (score >= need[active, None]) & (score <= high[active, None])
        fits &= (labels[some][None, :] == own_label[owner[active], None]) == same
        fits &= ids[some][None, :] != own[owner[active], None]
        for r in np.flatnonzero(fits.any(axis=1)):
            ask, cells = active[r], np.flatnonzero(fits[r])
            scores = np.concatenate([found[ask][0], score[r, cells]])
            names = np.concatenate([found[ask][1], ids[some][cells]])
            top = np.lexsort((names, -scores))[:k]
            found[ask] = (scores[top], names[top])
            if len(top) == k:
                need[ask] = max(need[ask], scores[top[-1]])
    return [(j, int(s), int(i)) for j, f in enumerate(found) for s, i in zip(*f, strict=True)]


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """`anchor_id, positive_id, rank, negative_id, positive_score, negative_score`.

    Both tables take vec_id, label, embedding. An anchor's positives are the `positives` best other rows of its label; for
    each, the `negatives` best rows of other labels whose score is at least `low` and at most `high` percent of the
    positive's. Scores are inner products of floor(256 x); higher ones come first, equal ones by vec_id. Rows with a null
    vec_id, label or embedding or with null or non-finite components take no part; shorter vectors are filled up with
    zeros; vectors too long for exact scores are refused. Rows of the anchor's own vec_id are neither positives nor
    negatives; of anchors that repeat a vec_id the least (label, vector) asks; repeated rows count as often as they occur,
    so a repeated positive gives its rows again. Empty tables give no rows.
    """
    spark = rows.sparkSession
    rows = stage(usable(rows), "vectors")
    count, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    shards = max(1, -(-count // SHARD))
    asked = usable(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a"))
    asked = stage(asked.select(F.col("vec_id").alias("anchor_id"), "a.label", "a.v"), "anchors")

    drawn = asked.orderBy(F.xxhash64("anchor_id"), "anchor_id").limit(FIT).select("v").toArrow()
    fitted = centres_of(scaled(matrix(drawn["v"], width)), max(1, len(drawn) // PER_CLUSTER)) if len(drawn) else np.zeros((1, width))

    def clustered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (unit(scaled(matrix(batch.column("v"), width))) @ fitted.T).argmax(axis=1) if len(batch) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names=[*batch.schema.names, "cluster"])

    asked = asked.mapInArrow(clustered, "anchor_id long, label long, v array<double>, cluster int")
    sizes = F.count("*").over(Window.partitionBy("cluster", "part"))  # a cluster may hold most anchors: dealt before it is counted
    parts = max(1, asked.count() // (BLOCK * len(fitted)))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("anchor_id"), F.lit(parts)).cast("int")).withColumn("n", sizes)
    piece = F.pmod(F.xxhash64("anchor_id", F.lit(1)), F.ceil(F.col("n") / BLOCK)).cast("int")
    asked = stage(asked.select("anchor_id", "label", "v", "cluster", "part", piece.alias("piece")), "clustered")

    def gathered(points: pa.Table) -> pa.Table:
        vectors = scaled(matrix(points["v"], width))
        small = np.abs(vectors).max(initial=0.0) < 1 << 15
        cells = [points["vec_id"].to_numpy(), points["label"].to_numpy(), vectors.astype(np.int16 if small else float)]
        cells = [points["shard"][0].as_py(), bool(small), *(c.tobytes() for c in cells)]
        kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], names=["shard", "small", "ids", "labels", "points"])

    dealt = F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    kind = "shard int, small boolean, ids binary, labels binary, points binary"
    shard_rows = stage(rows.withColumn("shard", dealt).groupBy("shard").applyInArrow(gathered, kind), "shards")

    def search(same: bool, k: int):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple[int, int, int, int]] = []
                for row in range(len(batch)):
                    at = lambda name, dtype: np.frombuffer(batch.column(name)[row].as_buffer(), dtype)  # noqa: E731, B023
                    ids, labels = at("ids", np.int64), at("labels", np.int64)
                    points = at("points", np.int16 if batch.column("small")[row].as_py() else float)
                    points = points.reshape(len(ids), width).astype(float)
                    block = batch.column("block")[row].values
                    vectors = scaled(matrix(block.field("v"), width))
                    own, own_label = block.field("anchor_id").to_numpy(), block.field("label").to_numpy()
                    asks = block.field("asks").to_pylist()
                    owner = np.array([i for i, a in enumerate(asks) for _ in a], np.int64)
                    every = [(a["place"], a["low"], a["high"]) for some in asks for a in some]
                    place, least, most = (np.array(c) for c in zip(*every, strict=True))
                    order, bound = shared_list(vectors, fitted[batch.column("cluster")[row].as_py()], points)
                    got = walk(vectors, owner, same, least, most, k, ids, labels, own, own_label, points, order, bound)
                    out += [(int(own[owner[j]]), int(place[j]), s, i) for j, s, i in got]
                columns = [pa.array([o[c] for o in out], pa.int64()) for c in range(4)]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor_id", "place", "score", "vec_id"])

        return each

    def searched(asking: DataFrame, same: bool, k: int) -> DataFrame:
        """The k best rows of each ask (anchor_id, label, v, cluster, part, piece, asks), ranked."""
        member = F.struct("anchor_id", "label", "v", "asks")
        blocks = asking.groupBy("cluster", "part", "piece").agg(F.collect_list(member).alias("block"))
        everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")  # a stated set of anchors against all rows
        # merged: a block is counted once by the planner but stands there for every shard, too much to be sent to all through the driver
        met = blocks.select("cluster", "part", "piece", "block", everywhere).join(shard_rows.hint("merge"), "shard")
        met = met.repartition(max(8, spark.sparkContext.defaultParallelism), "shard", "cluster", "part", "piece")
        found = met.drop("part", "piece").mapInArrow(search(same, k), "anchor_id long, place long, score long, vec_id long")
        order = Window.partitionBy("anchor_id", "place").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)

    anything = F.array(F.struct(F.lit(0).alias("place"), F.lit(-EXACT).alias("low"), F.lit(EXACT).alias("high")))
    best = stage(searched(asked.withColumn("asks", anything), True, positives), "positives")
    bounds = best.select(
        "anchor_id",
        F.col("rank").alias("place"),
        F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
        (-hundredth(F.col("score") * -low)).alias("low"),
        hundredth(F.col("score") * high).alias("high"),
    ).where("low <= high")
    asks = bounds.groupBy("anchor_id").agg(F.collect_list(F.struct("place", "low", "high")).alias("asks"))
    found = searched(asked.join(asks, "anchor_id"), False, negatives)
    named = found.join(bounds.select("anchor_id", "place", "positive_id", "positive_score"), ["anchor_id", "place"])
    return named.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


NEGATIVE_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.e, r.e) AS BIGINT) AS score
    FROM v a JOIN v r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
    SELECT anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
        CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
    FROM positives JOIN scored s USING (anchor_id)
    WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""


@query("op12_hard_negatives", NEGATIVE_SQL)
def mined_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", moved)
    return hard_negatives(rows, rows.where("vec_id % 50 = 0"))

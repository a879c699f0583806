"""Approximate nearest neighbours by cross-polytope hashing.

A table rotates a unit vector by three rounds of random signs and a fast Hadamard transform and assigns it to the nearest
signed axis. Every row is in one bucket of each table; a query looks into the buckets of its `PROBES` nearest signed
axes. Candidates are ranked by the exact inner product of the original vectors.

Equal vectors are one entry of the index and are told apart only in the answers, so a vector that a third of the rows
share costs one entry. Large buckets are dealt over salts; a group of points and its queries meet in one matrix product and
only the best of each query leave it. A query that finds fewer than k rows looks into all buckets of one table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotext.llm.registry import query, table
from chronotext.llm.vectors import matrix, usable
from chronotext.session import stage

TABLES, PROBES = 8, 16
#: Points meant for one group.
GROUP = 1024


def rotated(vectors: np.ndarray, number: int) -> np.ndarray:
    """Vectors (width a power of two) after the pseudo-rotation of table `number`."""
    rng = np.random.default_rng(1000 + number)
    width = vectors.shape[1]
    for _ in range(3):
        vectors = vectors * rng.choice([-1.0, 1.0], width)
        half = 1
        while half < width:
            pairs = vectors.reshape(len(vectors), -1, 2, half)
            vectors = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(vectors), width)
            half *= 2
        vectors = vectors / np.sqrt(width)
    return vectors


def axes(vectors: np.ndarray, number: int, probes: int) -> np.ndarray:
    """The `probes` nearest signed axes (2 * axis + 1 for the negative side) of each vector, nearest first."""
    turned = rotated(vectors, number)
    both = np.stack([turned, -turned], axis=2).reshape(len(vectors), -1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def nearest(rows: DataFrame, queries: DataFrame, k: int, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """`query_id, rank, vec_id, score`: k rows near each query, by inner product in double precision, ties to smaller ids.

    Both take vec_id and embedding. Rows with a null id or embedding, with null or non-finite components or with no
    component but zero take no part; shorter vectors are filled up with zeros. A row is no candidate for a query of its own
    id. Of rows that repeat an id each is a candidate; of queries that repeat an id each distinct vector asks. Directions
    are hashed, so recall is that of cosine neighbours. Empty tables give no rows.
    """
    some = F.exists("v", lambda x: x != 0)
    rows = usable(rows).where(some)
    within = Window.partitionBy("v").orderBy("vec_id")
    # k + 1 distinct ids of a class are enough: all its members score alike and ties go to smaller ids
    distinct = stage(rows.groupBy("v", "vec_id").agg(F.count("*").alias("times")), "distinct")
    members = stage(distinct.withColumn("n", F.row_number().over(within)).where(F.col("n") <= k + 1), "members")
    classes = members.where("n = 1").select(F.col("vec_id").alias("entry"), F.col("v").alias("cv"))
    shared = members.where("n = 2").select("v")
    sole = F.when(F.col("v").isNull(), F.col("entry")).alias("sole")  # the one id of a class, if it has no other
    classes = classes.join(shared, classes["cv"] == shared["v"], "left").select("entry", "cv", sole)
    classes = stage(classes.withColumn("class", F.xxhash64("entry", "cv")), "classes")
    count, width = classes.agg(F.count("*"), F.coalesce(F.max(F.size("cv")), F.lit(1))).first()
    total = distinct.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    full = 1 << max(0, int(width) - 1).bit_length()
    salts = max(1, -(-count // (2 * full * GROUP)))
    members = members.join(classes.select("class", "cv"), members["v"] == classes["cv"]).select("class", "vec_id", "times")
    asked = usable(queries).where(some).distinct()
    asked = asked.join(classes, asked["v"] == classes["cv"]).select(F.col("vec_id").alias("query_id"), "class")
    # queries of a class ask as one, but those whose id has other vectors too ask alone, so that all own rows stay out
    mine = distinct.groupBy("vec_id").agg(F.count("*").alias("vectors"), F.sum("times").alias("rows"))
    mine = mine.withColumnRenamed("vec_id", "query_id")
    asked = asked.join(mine, "query_id", "left").withColumn("own", F.when(F.col("vectors") > 1, F.col("query_id")))
    need = F.least(F.lit(k), F.lit(total) - F.coalesce("rows", F.lit(0))).alias("need")
    asked = asked.withColumn("asker", F.xxhash64("class", F.coalesce("own", F.lit(0)), F.col("own").isNull()))
    asked = stage(asked.select("query_id", "class", "own", "asker", need), "queries")
    asking = asked.select("class", "own", "asker").distinct().join(classes.select("class", "cv"), "class")
    asking = stage(asking.select(F.col("asker").alias("class"), "cv", F.col("own").alias("sole")), "asking")

    def hashed(of: DataFrame, n_tables: int, n_probes: int) -> DataFrame:
        """`class, cv, sole, bucket`, one row per table and probe; a bucket is table * 2 * width + axis."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = matrix(batch.column(1), full)
                unit = vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))
                for number in range(n_tables):
                    found = axes(unit, number, n_probes) + number * 2 * full
                    for probe in range(found.shape[1]):
                        yield pa.RecordBatch.from_arrays(
                            [*batch.columns, pa.array(found[:, probe], pa.int64())], names=["class", "cv", "sole", "bucket"]
                        )

        return of.select("class", "cv", "sole").mapInArrow(each, "class long, cv array<double>, sole long, bucket long")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("asker", pa.int64()), ("class", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        names, points = right["class"].to_numpy(), matrix(right["cv"], full)
        by_name = np.argsort(names)
        names, points = names[by_name], points[by_name]
        sole = right["sole"].combine_chunks().take(pa.array(by_name))
        only, single = sole.fill_null(0).to_numpy(), sole.is_valid().to_numpy(zero_copy_only=False)
        parts = []
        for low in range(0, left.num_rows, 512):
            part = left.slice(low, 512)
            vectors, own = matrix(part["cv"], full), part["class"].to_numpy()
            score = vectors @ points.T
            barred = part["sole"].combine_chunks()
            for row in np.flatnonzero(barred.is_valid().to_numpy(zero_copy_only=False)).tolist():
                score[row, single & (only == barred[row].as_py())] = -np.inf
            keep = min(k + 1, len(names))
            top = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
            asker = np.repeat(np.arange(len(own)), keep)
            open_, top = np.isfinite(np.take_along_axis(score, top, axis=1).ravel()), top.ravel()
            asker, top = asker[open_], top[open_]
            exact = (vectors[asker] * points[top]).sum(axis=1)  # the same number wherever a pair is met
            parts.append(pa.Table.from_arrays([pa.array(own[asker]), pa.array(names[top]), pa.array(exact)], schema=schema))
        return pa.concat_tables(parts)

    def answers(asking_: DataFrame, n_tables: int, n_probes: int) -> DataFrame:
        points = hashed(classes, n_tables, 1).withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(salts)).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
        probing = hashed(asking_, n_tables, n_probes).select("class", "cv", "sole", "bucket", every)
        met = probing.groupBy("bucket", "salt").cogroup(points.groupBy("bucket", "salt"))
        found = met.applyInArrow(compare, "asker long, class long, score double")
        return found.distinct()

    def expanded(found: DataFrame) -> DataFrame:
        """Ranked answers of every query id, from answers between classes."""
        by_class = Window.partitionBy("asker").orderBy(F.col("score").desc(), "entry")
        found = found.join(classes.select("class", "entry"), "class")
        found = found.withColumn("n", F.row_number().over(by_class)).where(F.col("n") <= k + 1).drop("n", "entry")
        found = found.join(asked.select("asker", F.col("own").alias("out")).distinct(), "asker").join(members, "class")
        by_member = Window.partitionBy("asker").orderBy(F.col("score").desc(), "vec_id")
        found = found.where("out is null or vec_id <> out")
        found = found.withColumn("n", F.row_number().over(by_member)).where(F.col("n") <= k + 1)
        own = found.select("asker", "vec_id", "score", "times").join(asked.select("asker", "query_id"), "asker")
        own = own.where("vec_id <> query_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)).cast("int"))))
        by_query = Window.partitionBy("query_id", "asker").orderBy(F.col("score").desc(), "vec_id")
        own = own.withColumn("rank", F.row_number().over(by_query).cast("int"))
        return own.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "asker")

    first = stage(expanded(answers(asking, tables, probes)), "answers")
    got = first.groupBy("asker", "query_id").agg(F.count("*").alias("got"))
    short = asked.join(got, ["asker", "query_id"], "left").where(F.coalesce("got", F.lit(0)) < F.col("need"))
    short = stage(short.select(F.col("asker").alias("class")).distinct(), "short")
    found = first
    if short.count():  # looked up in every bucket of one table: all rows
        again = expanded(answers(asking.join(short, "class", "left_semi"), 1, 2 * full))
        found = first.join(short.withColumnRenamed("class", "asker"), "asker", "left_anti").unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")


@query("op6_cross_polytope")
def cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"), 20)

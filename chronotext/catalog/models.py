"""Queries over estimators: scaling, clustering, reduction, neighbours, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.catalog import query, table
from chronotext.catalog.scoring import SQL_CLUSTERED, clustered
from chronotext.operators.classify import fit_predict
from chronotext.operators.cluster import assign, cluster_means
from chronotext.operators.descent import approximate_knn
from chronotext.operators.features import dense_vectors, deviations, scale
from chronotext.operators.graph import fuzzy_graph, graph_layout, local_scales
from chronotext.operators.neighbours import knn
from chronotext.operators.reduce import covariance, pca
from chronotext.operators.split import temporal_split
from pyspark.ml.functions import vector_to_array

NEIGHBOURS = 10

SQL_LONG = """long AS (SELECT vec_id, label, unnest(range(len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS v
FROM embeddings)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("features"))


@query(
    "scaled_features",
    f"""WITH {SQL_LONG}, sd AS (SELECT dim, stddev_pop(v) AS s FROM long GROUP BY dim)
SELECT vec_id AS row_id, dim, round(v / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS value FROM long JOIN sd USING (dim)""",
)
def scaled_features(spark, sf_dir):
    dense = dense_vectors(vectors(spark, sf_dir))
    scaled = scale(dense, deviations(dense))
    long = scaled.select("row_id", F.posexplode(vector_to_array("features")).alias("dim", "value"))
    return long.select("row_id", "dim", F.round("value", 6).alias("value"))


@query(
    "nearest_centre",
    f"""WITH {SQL_CLUSTERED}, long AS (
  SELECT vec_id, cluster, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM clustered),
c AS (SELECT cluster, dim, avg(v) AS m FROM long GROUP BY ALL),
d AS (SELECT l.vec_id, c.cluster, sqrt(sum((l.v - c.m) ** 2)) AS d FROM long l JOIN c USING (dim) GROUP BY ALL)
SELECT vec_id AS row_id, arg_min(cluster, d) AS cluster, round(min(d), 6) AS distance FROM d GROUP BY vec_id""",
)
def nearest_centre(spark, sf_dir):
    """One reassignment step from the means of the stand-in clusters."""
    data = clustered(spark, sf_dir)
    centres = cluster_means(data.select("row_id", "features"), data)
    return assign(data, centres).select("row_id", "cluster", F.round("distance", 6).alias("distance"))


@query(
    "feature_covariance",
    f"""WITH {SQL_LONG}, m AS (SELECT dim, avg(v) AS m FROM long GROUP BY dim),
c AS (SELECT vec_id, dim, v - m AS v FROM long JOIN m USING (dim))
SELECT a.dim AS i, b.dim AS j, round(sum(a.v * b.v) / (count(*) - 1), 6) + 0.0 AS value
FROM c a JOIN c b USING (vec_id) GROUP BY ALL""",
)
def feature_covariance(spark, sf_dir):
    return covariance(vectors(spark, sf_dir)).select("i", "j", (F.round("value", 6) + F.lit(0.0)).alias("value"))


def _leading(name: str, of: str) -> str:
    """CTEs {name}: the unit vector of the largest eigenvalue of the matrix `of` (i, j, v), by squaring it 14 times."""
    out = [f"{name}0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {of} WHERE i = j) AS v FROM {of})"]
    for t in range(14):
        out += [
            f"{name}s{t} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {name}{t} a JOIN {name}{t} b ON a.j = b.i GROUP BY ALL)",
            f"{name}{t + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {name}s{t} WHERE i = j) AS v FROM {name}s{t})",
        ]
    return ",\n".join(out) + f""",
{name}c AS MATERIALIZED (SELECT i, v FROM {name}14 WHERE j = (SELECT arg_max(i, v) FROM {name}14 WHERE i = j)),
{name} AS MATERIALIZED (SELECT i, v / (SELECT sqrt(sum(v * v)) * sign(arg_max(v, abs(v))) FROM {name}c) AS v FROM {name}c)"""


SQL_COMPONENTS = f"""WITH {SQL_LONG}, m AS (SELECT dim, avg(v) AS m FROM long GROUP BY dim),
c AS MATERIALIZED (SELECT vec_id, dim, v - m AS v FROM long JOIN m USING (dim)),
cov AS MATERIALIZED (SELECT a.dim AS i, b.dim AS j, sum(a.v * b.v) AS v FROM c a JOIN c b USING (vec_id) GROUP BY ALL),
{_leading("p", "cov")},
size AS (SELECT sum(a.v * cov.v * b.v) AS s FROM cov JOIN p a ON a.i = cov.i JOIN p b ON b.i = cov.j),
rest AS MATERIALIZED (SELECT cov.i, cov.j, cov.v - s * a.v * b.v AS v FROM cov JOIN p a ON a.i = cov.i JOIN p b ON b.i = cov.j, size),
{_leading("q", "rest")}
SELECT vec_id AS row_id, round(sum(c.v * p.v), 6) + 0.0 AS x, round(sum(c.v * q.v), 6) + 0.0 AS y
FROM c JOIN p ON p.i = dim JOIN q ON q.i = dim GROUP BY vec_id"""


@query("principal_components", SQL_COMPONENTS)
def principal_components(spark, sf_dir):
    found = pca(vectors(spark, sf_dir), 2)
    return found.select("row_id", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in "xy"])


SQL_KNN = f"""
u AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT a.vec_id AS row_id, b.vec_id AS neighbour, list_distance(a.e, b.e) AS distance
      FROM u a JOIN u b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(distance, 9), neighbour) AS place FROM d)
"""


@query(
    "nearest_neighbours",
    f"""WITH {SQL_KNN} SELECT row_id, neighbour, round(distance, 6) AS distance, place::INT AS place FROM r
WHERE place <= {NEIGHBOURS}""",
)
def nearest_neighbours(spark, sf_dir):
    found = knn(vectors(spark, sf_dir), NEIGHBOURS)
    return found.select("row_id", "neighbour", F.round("distance", 6).alias("distance"), "place")


@query("approximate_neighbours")
def approximate_neighbours(spark, sf_dir):
    """By descent on the neighbour graph; tests hold its recall against brute force."""
    found = approximate_knn(vectors(spark, sf_dir), NEIGHBOURS)
    return found.select("row_id", "neighbour", F.round("distance", 6).alias("distance"), "place")


SQL_SCALES = f"""WITH RECURSIVE {SQL_KNN},
near AS (SELECT row_id, neighbour, distance FROM r WHERE place <= {NEIGHBOURS - 1}),
base AS (SELECT row_id, coalesce(min(distance) FILTER (distance > 0), 0) AS rho, sum(distance) / {NEIGHBOURS} AS own FROM near GROUP BY ALL),
gaps AS (SELECT row_id, list(greatest(distance - rho, 0)) AS g FROM near JOIN base USING (row_id) GROUP BY row_id),
step AS (
  SELECT row_id, 0::DOUBLE AS lo, 'infinity'::DOUBLE AS hi, 1::DOUBLE AS mid, 0 AS i FROM gaps
  UNION ALL
  SELECT row_id, CASE WHEN above THEN lo ELSE mid END, CASE WHEN above THEN mid ELSE hi END,
         CASE WHEN above THEN (lo + mid) / 2 WHEN isinf(hi) THEN mid * 2 ELSE (mid + hi) / 2 END, i + 1
  FROM (SELECT s.*, list_sum(list_transform(g, lambda x: exp(-x / mid))) > log2({NEIGHBOURS}) AS above
        FROM step s JOIN gaps USING (row_id) WHERE i < 64)),
scales AS (
  SELECT row_id, rho, greatest(mid, 0.001 * CASE WHEN rho > 0 THEN own ELSE (SELECT avg(own) FROM base) END) AS sigma
  FROM step JOIN base USING (row_id) WHERE i = 64)
"""


@query(
    "neighbour_scales",
    f"{SQL_SCALES} SELECT row_id, round(rho, 6) AS rho, round(sigma, 6) AS sigma FROM scales",
)
def neighbour_scales(spark, sf_dir):
    scales = local_scales(knn(vectors(spark, sf_dir), NEIGHBOURS - 1), NEIGHBOURS)
    return scales.select("row_id", F.round("rho", 6).alias("rho"), F.round("sigma", 6).alias("sigma"))


@query(
    "fuzzy_graph",
    f"""{SQL_SCALES}, m AS (
  SELECT row_id AS src, neighbour AS dst, exp(-greatest(distance - rho, 0) / sigma) AS w FROM near JOIN scales USING (row_id)),
e AS (SELECT src, dst, w AS a, 0::DOUBLE AS b FROM m UNION ALL SELECT dst, src, 0::DOUBLE, w FROM m)
SELECT src, dst, round(max(a) + max(b) - max(a) * max(b), 6) AS weight FROM e GROUP BY ALL""",
)
def fuzzy_neighbour_graph(spark, sf_dir):
    graph = fuzzy_graph(knn(vectors(spark, sf_dir), NEIGHBOURS - 1), NEIGHBOURS)
    return graph.select("src", "dst", F.round("weight", 6).alias("weight"))


@query("graph_layout")
def laid_out_graph(spark, sf_dir):
    return graph_layout(vectors(spark, sf_dir), 2, NEIGHBOURS)


def vector_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`embeddings` as a labelled corpus without text, one row per day."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.concat(F.lit("class-"), F.col("label")).alias("label_name"),
        F.timestamp_add("DAY", F.col("vec_id").cast("int"), F.lit("2020-01-01").cast("timestamp")).alias("timestamp"),
        "label",
    )


@query("future_predictions")
def future_predictions(spark, sf_dir):
    split = temporal_split(vector_corpus(spark, sf_dir), 0.3)
    return fit_predict(dense_vectors(vectors(spark, sf_dir)), split)

"""Scores from a contingency table, the cosine silhouette, and the best cluster-to-label mapping."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.operators.blocks import SUM_KIND, Blocks, Part, Sent, dense_blocks, labels_of, sparse_blocks, sums
from chronotext.operators.ranking import positions
from chronotext.session import stage

MAX_GRID = 4_000_000
#: Clusters whose sums a task compares at a time.
CLUSTERS_AT_A_TIME = 64


def contingency(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(truth, pred, n) of the pairs that occur."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_grid(cells: DataFrame) -> DataFrame:
    """(truth, pred, n) over the union of both code sets, zeros included."""
    codes = cells.select(F.explode(F.array("truth", "pred")).alias("code")).distinct()
    n_codes = codes.count()
    if n_codes * n_codes > MAX_GRID:
        raise ValueError(f"{n_codes} codes are too many for a full grid")
    every = codes.agg(F.sort_array(F.collect_list("code"))).scalar()
    grid = codes.select(F.col("code").alias("truth"), F.explode(every).alias("pred"))
    return grid.join(cells, ["truth", "pred"], "left").select(
        "truth", "pred", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def _margins(cells: DataFrame) -> DataFrame:
    """(kind, n): the cell counts and both marginal counts, in one long frame."""
    by_truth = cells.groupBy("truth").agg(F.sum("n").alias("n"))
    by_pred = cells.groupBy("pred").agg(F.sum("n").alias("n"))
    return (
        cells.select(F.lit("cell").alias("kind"), "n")
        .unionByName(by_truth.select(F.lit("truth").alias("kind"), "n"))
        .unionByName(by_pred.select(F.lit("pred").alias("kind"), "n"))
        .withColumn("n", F.col("n").cast("double"))
    )


def _sum_of(kind: str, value: Column) -> Column:
    return F.sum(F.when(F.col("kind") == kind, value))


def agreement(cells: DataFrame) -> DataFrame:
    """One row (ari, nmi): adjusted Rand index and normalised mutual information (arithmetic mean)."""
    n = F.col("n")
    pairs, plogp = n * (n - 1) / 2, n * F.log(n)
    sums = _margins(cells).agg(
        _sum_of("cell", n).alias("total"),
        *[_sum_of(k, pairs).alias(f"pairs_{k}") for k in ("cell", "truth", "pred")],
        *[_sum_of(k, plogp).alias(f"nlogn_{k}") for k in ("cell", "truth", "pred")],
        *[F.count(F.when(F.col("kind") == k, n)).alias(f"groups_{k}") for k in ("truth", "pred")],
    )
    total = F.col("total")
    expected = F.col("pairs_truth") * F.col("pairs_pred") / F.nullif(total * (total - 1) / 2, F.lit(0.0))
    ceiling = (F.col("pairs_truth") + F.col("pairs_pred")) / 2
    # the quotient is undefined only where both sides agree completely
    ari = F.coalesce((F.col("pairs_cell") - expected) / F.nullif(ceiling - expected, F.lit(0.0)), F.lit(1.0))

    def entropy(kind: str) -> Column:
        return F.log(total) - F.col(f"nlogn_{kind}") / total

    shared = entropy("truth") + entropy("pred") - entropy("cell")
    nmi = (
        F.when((F.col("groups_truth") == 1) & (F.col("groups_pred") == 1), 1.0)
        .when(shared <= 1e-12, 0.0)
        .otherwise(2 * shared / (entropy("truth") + entropy("pred")))
    )
    return sums.select(ari.alias("ari"), nmi.alias("nmi"))


def f1_report(cells: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) per class that is true or predicted; undefined scores are 0."""
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    side = F.explode(
        F.array(
            F.struct(
                F.col("truth").alias("label"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).alias("said")
            ),
            F.struct(
                F.col("pred").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("support"), F.col("n").alias("said")
            ),
        )
    )
    sums = (
        cells.select(side.alias("s"))
        .groupBy(F.col("s.label").alias("label"))
        .agg(F.sum("s.tp").alias("tp"), F.sum("s.support").alias("support"), F.sum("s.said").alias("said"))
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(a.cast("double") / F.nullif(b, F.lit(0)), F.lit(0.0))

    tp, support, said = F.col("tp"), F.col("support"), F.col("said")
    return sums.select(
        "label",
        ratio(tp, said).alias("precision"),
        ratio(tp, support).alias("recall"),
        ratio(2 * tp, support + said).alias("f1"),
        "support",
    )


def classification_scores(cells: DataFrame) -> DataFrame:
    """One row (accuracy, f1_weighted); labels are compared as given, so cast them to text for text comparison."""
    report = f1_report(cells)
    support = F.col("support")
    return report.agg(
        (F.sum(F.col("recall") * support) / F.sum(support)).alias("accuracy"),
        (F.sum(F.col("f1") * support) / F.sum(support)).alias("f1_weighted"),
    )


def silhouette_rows(features: DataFrame, clusters: DataFrame) -> DataFrame:
    """(row_id, cluster, silhouette) for dense features (row_id, features array) under cosine distance."""
    placed = features.join(clusters.select("row_id"), "row_id", "left_semi")
    with dense_blocks(placed) as blocks:
        return silhouettes(blocks, clusters)


def silhouette_rows_sparse(weights: DataFrame, clusters: DataFrame) -> DataFrame:
    """(row_id, cluster, silhouette) for long features (row_id, term, weight); a row without entries is a zero vector."""
    index = stage(positions(weights.select("term").distinct(), ["term"], "at"), "term-index")
    values = weights.join(index, "term").join(clusters.select("row_id"), "row_id", "left_semi")
    with sparse_blocks(values.select("row_id", "at", F.col("weight").alias("value")), clusters) as blocks:
        return silhouettes(blocks, clusters)


def silhouettes(blocks: Blocks, clusters: DataFrame) -> DataFrame:
    """(row_id, cluster, silhouette) of rows in blocks. Cosine distance is linear in unit vectors, so the sum of each cluster's unit vectors replaces all pairs.

    The sums are a table (column, cluster, value) that meets the rows block by block; a null value for a single cluster.
    """
    named = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    numbered = [(i, r["cluster"], float(r["n"])) for i, r in enumerate(named.orderBy("cluster").collect())]
    if len(numbered) < 2:
        return clusters.select("row_id", "cluster", F.lit(None).cast("double").alias("silhouette"))
    slots = F.broadcast(blocks.spark.createDataFrame([(i, c) for i, c, _ in numbered], f"slot long, cluster {named.schema['cluster'].dataType.simpleString()}"))
    sizes, n_buckets = np.array([n for *_, n in numbered]), blocks.n_buckets
    owners = blocks.labelled(clusters.join(slots, "cluster").select("row_id", F.col("slot").alias("label")))

    def inverse_lengths(part: Part) -> np.ndarray:
        length = np.sqrt(part.squares())
        return np.divide(1.0, length, out=np.zeros(part.n), where=length > 0)

    def summed(part: Part, _sent, payload) -> pa.Table:
        mine, own = labels_of(part, payload)
        weight, out = inverse_lengths(mine), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for first in range(0, len(sizes), CLUSTERS_AT_A_TIME):
            some = np.arange(first, min(first + CLUSTERS_AT_A_TIME, len(sizes)))
            total = mine.transposed((own[:, None] == some[None, :]) * weight[:, None])
            at, slot = np.nonzero(total)
            out.append((mine.at[at], some[slot], total[at, slot]))
        return sums(*(np.concatenate(c) for c in zip(*out, strict=True)), n_buckets)

    def scored(part: Part, sent: Sent, payload) -> pa.Table:
        mine, own = labels_of(part, payload)
        weight = inverse_lengths(mine)
        inner, outside = np.zeros(mine.n), np.full(mine.n, np.inf)
        for first in range(0, len(sizes), CLUSTERS_AT_A_TIME):
            some = np.arange(first, min(first + CLUSTERS_AT_A_TIME, len(sizes)))
            dots = mine.products(mine.columns(sent, some)) * weight[:, None]
            is_own = own[:, None] == some[None, :]
            inner += (dots * is_own).sum(axis=1)
            outside = np.minimum(outside, np.where(is_own, np.inf, 1 - dots / sizes[some]).min(axis=1))
        n, itself = sizes[own], (weight > 0).astype(float)
        inside = np.divide(n - 1 - (inner - itself), n - 1, out=np.zeros(mine.n), where=n > 1)
        widest = np.maximum(inside, outside)
        value = np.divide(outside - inside, widest, out=np.zeros(mine.n), where=(n > 1) & (widest != 0))
        return pa.table([pa.array(mine.ids), pa.array(own), pa.array(value)], names=["row_id", "slot", "silhouette"])

    totals = stage(blocks.summed(blocks.met(None, summed, SUM_KIND, owners)), "cluster-sums")
    found = stage(blocks.met(totals, scored, "row_id long, slot long, silhouette double", owners), "silhouettes")
    return found.join(slots, "slot").select("row_id", "cluster", "silhouette")


def silhouette(rows: DataFrame) -> DataFrame:
    """One row: the mean silhouette, NULL for a single cluster."""
    return rows.agg(F.avg("silhouette").alias("silhouette"))


def assign_max(grid: np.ndarray) -> np.ndarray:
    """Column chosen for each row of a rows <= columns grid, maximising the total (shortest augmenting paths)."""
    n, m = grid.shape
    cost = -grid.astype("float64")
    row_price, col_price = np.zeros(n), np.zeros(m)
    holder = np.full(m, -1)
    for start in range(n):
        slack, came_from = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, dtype=bool)
        row, col, reach = start, -1, 0.0
        while True:
            offer = reach + cost[row] - row_price[row] - col_price
            better = ~done & (offer < slack)
            slack[better], came_from[better] = offer[better], row
            col = int(np.argmin(np.where(done, np.inf, slack)))
            reach = slack[col]
            done[col] = True
            if holder[col] < 0:
                break
            row = holder[col]
        row_price[start] += reach
        for j in np.flatnonzero(done):
            if holder[j] >= 0:
                row_price[holder[j]] += reach - slack[j]
            col_price[j] -= reach - slack[j]
        while col >= 0:
            row = came_from[col]
            previous = np.flatnonzero(holder == row)
            holder[col] = row
            if row == start:
                break
            col = int(previous[0] if previous[0] != col else previous[1])
    chosen = np.full(n, -1)
    for j in np.flatnonzero(holder >= 0):
        chosen[holder[j]] = j
    return chosen


def best_mapping(cells: DataFrame) -> DataFrame:
    """(pred, truth, n): the one-to-one mapping of predicted to true codes with the most matches.

    Extra codes on either side stay unmapped. The counted table is checked to be small before one task takes it.
    """
    t, p = cells.agg(F.count_distinct("truth"), F.count_distinct("pred")).first()
    if t * p > MAX_GRID:
        raise ValueError(f"{t} labels x {p} clusters are too many to map")
    schema = cells.schema

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        grid = frame.pivot(index="pred", columns="truth", values="n").fillna(0).sort_index().sort_index(axis=1)
        values = grid.to_numpy()
        flip = values.shape[0] > values.shape[1]
        chosen = assign_max(values.T if flip else values)
        pairs = [(j, i) if flip else (i, j) for i, j in enumerate(chosen)]
        return pd.DataFrame(
            {
                "pred": [grid.index[i] for i, _ in pairs],
                "truth": [grid.columns[j] for _, j in pairs],
                "n": [int(values[i, j]) for i, j in pairs],
            }
        )

    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    return cells.groupBy().applyInPandas(solve, f"pred {kinds['pred']}, truth {kinds['truth']}, n bigint")


register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

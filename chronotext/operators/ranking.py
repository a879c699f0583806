"""Exact ranks without a global window.

`cut_below` and `quota_cut` find the n-th smallest key by counting ranges of the key, so that only counts move and no
task holds more than a narrow range. `positions` numbers rows by a range-partitioned sort.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.session import held, stage

FANOUT_BITS = 12
#: Rows of one group that are ranked in one task, once their range has been found.
RANKED = 100_000
POSITION_MASK = (1 << 33) - 1


def nth_smallest(df: DataFrame, key: str, rank: int) -> tuple[int, int, int]:
    """The `rank`-th smallest non-null integer key, the number of rows below it and the number of rows equal to it.

    Each pass counts at most 4,097 ranges of the remaining interval and goes on within the extremes of the range that
    holds the rank; a 64-bit key needs at most six passes, a key with few values one or two.
    """
    keys = df.select(F.col(key).cast("bigint").alias("k")).where("k IS NOT NULL")
    lo, hi, n = keys.agg(F.min("k"), F.max("k"), F.count("k")).first()
    if not 1 <= rank <= n:
        raise ValueError(f"rank {rank} is outside 1..{n}")
    below, equal = 0, n
    while lo < hi:
        shift = max(0, (hi - lo).bit_length() - FANOUT_BITS)
        counts = (
            keys.where(F.col("k").between(lo, hi))
            .groupBy(F.shiftright("k", shift).alias("b"))
            .agg(F.count("*").alias("n"), F.min("k").alias("first"), F.max("k").alias("last"))
            .collect()
        )
        for b in sorted(counts):
            if below + b["n"] >= rank:
                lo, hi, equal = b["first"], b["last"], b["n"]
                break
            below += b["n"]
    return lo, below, equal


def cut_below(df: DataFrame, key: str, tie: str, n: int) -> Column:
    """Condition true for exactly the `n` rows lowest by (key, tie); `tie` is a unique integer.

    The result is a plain comparison with literals, usable as a filter on any frame with the same columns. `df` is
    read several times, so pass a narrow or held frame.
    """
    value, below, equal = nth_smallest(df, key, n)
    if below + equal == n:
        return F.col(key) <= F.lit(value)
    last, _, _ = nth_smallest(df.where(F.col(key) == F.lit(value)), tie, n - below)
    return (F.col(key) < F.lit(value)) | ((F.col(key) == F.lit(value)) & (F.col(tie) <= F.lit(last)))


def quota_cut(rows: DataFrame, group: str, key: str, tie: str, quota: DataFrame) -> DataFrame:
    """Per group, the (key, tie) of the `quota`-th smallest row; `key` is a non-negative integer.

    Counting levels narrow each group to a range of the key, then among equal keys to a range of the tie, until it has at
    most `RANKED` rows; only those are ranked. So neither a group nor a key that holds most of the table meets in one
    task. `quota` has columns (group, quota); groups with a quota of zero or below are left out of the result, groups
    smaller than their quota end at their last row. `tie` is an integer, unique among equal keys of a group.
    """
    slim = rows.select(group, F.col(key).alias("k"), F.col(tie).alias("t"))
    running = Window.partitionBy(group).orderBy("kb", "tb").rowsBetween(Window.unboundedPreceding, 0)
    with held(slim):
        top = slim.agg(F.max("k")).first()[0] or 0
        sizes = slim.groupBy(group).agg(F.count("*").alias("n_rows"))
        wanted = F.least("n_rows", F.col("quota").cast("bigint"))
        edge = stage(
            sizes.join(quota, group)
            .where("quota > 0")
            .select(group, wanted.alias("need"), F.lit(0).cast("bigint").alias("kb"), F.lit(0).cast("bigint").alias("tb")),
            "edge",
        )
        pool = slim.join(edge, group)
        for on_key, shift in _levels(top):
            by_key = F.shiftright("k", shift if on_key else 0)
            by_tie = F.lit(0).cast("bigint") if on_key else F.shiftright("t", shift)
            edge = stage(
                pool.groupBy(group, "need", by_key.alias("kb"), by_tie.alias("tb"))
                .agg(F.count("*").alias("n"))
                .withColumn("upto", F.sum("n").over(running))
                .where("upto >= need AND upto - n < need")
                .select(group, "kb", "tb", "n", (F.col("need") - F.col("upto") + F.col("n")).alias("need")),
                "edge",
            )
            pool = slim.join(edge.drop("n"), group).where((by_key == F.col("kb")) & (by_tie == F.col("tb")))
            if edge.where(F.col("n") > RANKED).isEmpty():
                break
        in_range = Window.partitionBy(group).orderBy("k", "t")
        cuts = (
            pool.withColumn("rank", F.row_number().over(in_range))
            .where("rank = need")
            .select(group, F.col("k").alias("cut_key"), F.col("t").alias("cut_tie"))
        )
        return stage(cuts, "cuts")


def _levels(top: int) -> list[tuple[bool, int]]:
    """(on the key, right shift) from coarse to exact: keys up to `top`, then 64-bit ties of equal keys."""
    bits = top.bit_length()
    keys = [max(0, bits - FANOUT_BITS * level) for level in range(1, max(1, -(-bits // FANOUT_BITS)) + 1)]
    ties = [max(0, 64 - FANOUT_BITS * level) for level in range(1, -(-64 // FANOUT_BITS) + 1)]
    return [(True, s) for s in keys] + [(False, s) for s in ties]


def within_cut(key: str, tie: str) -> Column:
    """Condition for rows joined with the result of `quota_cut`."""
    return (F.col(key) < F.col("cut_key")) | ((F.col(key) == F.col("cut_key")) & (F.col(tie) <= F.col("cut_tie")))


def number_in_order(ordered: DataFrame, name: str) -> DataFrame:
    """Add dense 0-based numbers in the existing partition order of `ordered`."""
    marked = stage(ordered.withColumn("_at", F.monotonically_increasing_id()), name)
    return _dense(marked, name)


def _dense(marked: DataFrame, name: str) -> DataFrame:
    part = F.shiftright("_at", 33)
    sizes = sorted(tuple(r) for r in marked.groupBy(part).count().collect())  # one row per task of the sort
    offsets, before = [], 0
    for index, n in sizes:
        offsets.append((index, before))
        before += n
    table = marked.sparkSession.createDataFrame(offsets, "_part bigint, _offset bigint")
    return (
        marked.withColumn("_part", part)
        .join(table, "_part")
        .withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND(F.lit(POSITION_MASK)))
        .drop("_at", "_part", "_offset")
    )


def positions(df: DataFrame, order: list[str | Column], name: str = "position") -> DataFrame:
    """Dense 0-based positions under `order`, whose last entry should be unique.

    The sort is range partitioned on the whole order, so equal leading values spread over several tasks.
    """
    return number_in_order(df.orderBy(*order), name)



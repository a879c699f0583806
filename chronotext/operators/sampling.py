"""Seeded sampling over timestamped, labelled tables: spines, prevalence resampling, label noise, shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotext.functions.hashing import hash60, pick, uniform
from chronotext.operators.ranking import cut_below, positions
from chronotext.operators.trends import share_within
from chronotext.session import held, stage

# Fixed value: seconds in a day.
DAY_SECONDS = 86400
CDF_BINS = 1024


def date_spine(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """(day) from the one-row `bounds`, both ends included."""
    return bounds.select(
        F.explode(
            F.sequence(F.to_date(start), F.to_date(end), F.expr("INTERVAL 1 DAY"))
        ).alias("day")
    )


def time_of_day(u: Column) -> Column:
    """Whole seconds in [0, 86400)."""
    return pick(u, DAY_SECONDS)


def daily_prevalence(df: DataFrame, label_col: str = "label_name", timestamp_col: str = "timestamp") -> DataFrame:
    """(label, day, weight): the share of each label among the rows of the day."""
    counts = df.groupBy(F.col(label_col).alias("label"), F.to_date(timestamp_col).alias("day")).agg(
        F.count("*").alias("n")
    )
    return share_within(counts, "day", name="weight").select("label", "day", "weight")


def cumulative(weights: DataFrame, group: str, item: str, weight: str = "weight") -> DataFrame:
    """(group, item, lo, hi): the unit interval cut in proportion to the weights; a zero total cuts it evenly."""
    whole = Window.partitionBy(group)
    upto = whole.orderBy(item).rowsBetween(Window.unboundedPreceding, 0)
    total, n = F.sum(weight).over(whole), F.count("*").over(whole)
    p = F.when(total > 0, F.col(weight) / F.nullif(total, F.lit(0.0))).otherwise(1.0 / n)
    cut = weights.withColumn("p", p).withColumn("hi", F.sum("p").over(upto))
    ordered = whole.orderBy(item)
    # an interval starts exactly where the one before ends, and the last one has no end: rounding leaves no gap
    return cut.select(
        group,
        item,
        F.coalesce(F.lag("hi").over(ordered), F.lit(0.0)).alias("lo"),
        F.when(F.lead(item).over(ordered).isNull(), F.lit(2.0)).otherwise(F.col("hi")).alias("hi"),
    )


def draw_by_cdf(draws: DataFrame, cdf: DataFrame, group: str, item: str, u: str = "u") -> DataFrame:
    """Add `item` to each draw (group, u): the interval lo <= u < hi of its group.

    The range join is an equality join on bins of the unit interval plus a comparison; an interval is listed in every
    bin it touches, so a heavy interval spreads over many bins.
    """
    first, last = F.floor(F.col("lo") * CDF_BINS), F.floor(F.least("hi", F.lit(1.0)) * CDF_BINS)
    bins = F.sequence(F.greatest(first, F.lit(0)), F.greatest(F.least(last, F.lit(CDF_BINS - 1)), first))
    listed = stage(cdf.select(group, item, "lo", "hi", F.explode(bins).alias("bin")), "cdf")
    binned = draws.withColumn("bin", F.floor(F.col(u) * CDF_BINS))
    joined = binned.join(listed, [group, "bin"])
    return joined.where((F.col("lo") <= F.col(u)) & (F.col(u) < F.col("hi"))).drop("bin", "lo", "hi")


def resample_by_prevalence(
    df: DataFrame, n_per_class: int, seed: int = 42, label_col: str = "label_name", timestamp_col: str = "timestamp"
) -> DataFrame:
    """(label, i, timestamp): `n_per_class` draws per label, days weighted by the label's share, random time of day."""
    weights = stage(daily_prevalence(df, label_col, timestamp_col), "prevalence")
    labels = positions(weights.select("label").distinct(), ["label"], "at")
    labels = stage(labels, "labels")
    n_labels = labels.count()
    spark = df.sparkSession
    draws = (
        spark.range(n_per_class * n_labels)
        .select((F.col("id") % n_labels).alias("at"), F.expr(f"id div {n_labels}").alias("i"))
        .join(labels, "at")
        .select("label", "i", uniform(seed, "day", "label", "i").alias("u"))
    )
    drawn = draw_by_cdf(draws, cumulative(weights, "label", "day"), "label", "day")
    return drawn.select("label", "i", _moment(F.col("day"), uniform(seed, "time", "label", "i")).alias("timestamp"))


def draw_unbalanced(
    spark: SparkSession, weights: DataFrame, n: int, seed: int = 42
) -> DataFrame:
    """(i, label, timestamp): `n` draws of a uniform day, then a label by that day's weights (label, day, weight)."""
    days = stage(positions(weights.select("day").distinct(), ["day"], "at"), "days")
    n_days = days.count()
    draws = (
        spark.range(n)
        .select(F.col("id").alias("i"), pick(uniform(seed, "any-day", "id"), n_days).cast("bigint").alias("at"))
        .join(days, "at")
        .select("i", "day", uniform(seed, "class", "i").alias("u"))
    )
    drawn = draw_by_cdf(draws, cumulative(weights, "day", "label"), "day", "label")
    return drawn.select("i", "label", _moment(F.col("day"), uniform(seed, "time", "i")).alias("timestamp"))


def _moment(day: Column, u: Column) -> Column:
    return F.timestamp_add("SECOND", time_of_day(u), day.cast("timestamp"))


def label_noise(
    df: DataFrame, rate: float, seed: int = 42, label_col: str = "label", id_col: str = "row_id"
) -> DataFrame:
    """Give exactly int(n * rate) rows another of the occurring codes; names stay as they are."""
    codes = df.agg(F.sort_array(F.collect_set(label_col))).scalar()
    keyed = df.withColumn("_draw", hash60(seed, "noise", id_col))
    with held(keyed.select("_draw", id_col)) as keys:
        n_flip = int(keys.count() * rate)
        if n_flip == 0:
            return df
        flipped = cut_below(keys, "_draw", id_col, n_flip)
    other = F.filter("_codes", lambda c: c != F.col(label_col))
    swapped = F.element_at(other, pick(uniform(seed, "swap", id_col), F.size(other)) + 1)
    return (
        keyed.withColumn("_codes", codes)
        .withColumn(label_col, F.when(flipped, swapped).otherwise(F.col(label_col)))
        .drop("_draw", "_codes")
    )


def shuffled(df: DataFrame, seed: int = 42, id_col: str = "row_id", name: str = "position") -> DataFrame:
    """Add dense positions in a seeded random order."""
    return positions(df, [hash60(seed, "shuffle", id_col), id_col], name)

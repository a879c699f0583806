"""A bounded sample of labelled rows to learn from, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.session import stage


def remainder(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))


def bounded_sample(rows: DataFrame, key: str, label: str, per_label: int) -> DataFrame:
    """At most `per_label` rows of each label, those with the least hash of the key; null labels give none.

    A first pass counts the labels; the second keeps about twice as many rows as are wanted before it ranks them, so a
    label that most rows have is never ranked whole. Few labels are assumed (their counts are collected).
    """
    rows = rows.where(F.col(label).isNotNull()).withColumn("_draw", F.xxhash64(F.col(key).cast("string"), F.lit(17)))
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    share = F.lit(None).cast("double")
    for value, count in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, (2 * per_label + 50) / count))).otherwise(share)
    drawn = rows.where((F.col("_draw").cast("double") / F.lit(2.0**64) + 0.5) < share)
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_draw", key))
    return drawn.withColumn("_rank", rank).where(F.col("_rank") <= per_label).drop("_rank", "_draw")


def bounded_texts(rows: DataFrame, label: str, per_label: int, total_bytes: int) -> DataFrame:
    """Of `rows` (doc_id, text, label) the different ones, at most `per_label` of each label, within `total_bytes` a label.

    A drawn id may stand on any number of rows, so this bounds what `bounded_sample` of ids cannot. Texts are taken in the
    order of a hash of id and text as long as they have `total_bytes` together; the first is always taken.
    """
    row = F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256))
    once = stage(rows.select("doc_id", "text", label).dropDuplicates().withColumn("_row", row), "texts")
    kept = bounded_sample(once, "_row", label, per_label)
    upto = Window.partitionBy(label).orderBy(F.xxhash64("_row"), "_row").rowsBetween(Window.unboundedPreceding, 0)
    measured = kept.withColumn("_sum", F.sum(F.octet_length("text")).over(upto))
    fits = (F.col("_sum") <= total_bytes) | (F.col("_sum") == F.octet_length("text"))
    return measured.where(fits).drop("_sum", "_row")

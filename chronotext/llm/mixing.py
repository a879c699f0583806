"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every document has one entry per pass over its source (a source is passed at most `max_passes` times). An entry's
virtual finish time is the number of words its source has sent up to and including it, in shuffled order, divided by the
source's target; a source is at its target exactly when its clock shows 1. All entries are then ordered by finish time
and cut where the total budget is spent.

Neither order is built in one task. A source's running total is a prefix sum over ranges of the shuffle key, then a sum
inside one range. The global cut is found by counting words per range of finish times, again inside the range where the
budget ends, until that range is small; only counts reach the driver (at most `RANGES` at a time).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotext.llm.registry import query, table
from chronotext.session import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeated as often as needed; null comes last.
WEIGHTS = (3, 1, 2)
SHARE, MAX_PASSES = 1.5, 2
#: Rows meant to share one range of the shuffle key, and at most to be ordered in one task at the cut.
RANGE_ROWS, CUT_ROWS = 4096, 20_000
#: Finish times are cut into 2**10 ranges per unit, then each range into as many again, down to 2**-40.
LEVEL_BITS, KEY_BITS, RANGES = 10, 40, 4096


def words(text: Column) -> Column:
    """Number of words of a text; 0 if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, max_passes: int) -> DataFrame:
    """One row per source (null is one): `sid`, `source_size`, `target`.

    Targets are `min(max_passes * size, weight * level)`. Going through the sources by rising cap per weight, the level
    that spends the budget if all earlier ones are capped rises while caps bind and falls after, so it is the greatest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(by_name))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_passes)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy()
    budget = F.sum("source_size").over(every).cast("double") * F.lit(share)
    level = (budget - before.cast("double")) / left.cast("double")
    sources = sources.withColumn("level", level)
    target = F.least(F.col("cap").cast("double"), F.col("weight").cast("double") * F.max("level").over(every))
    return sources.withColumn("target", target).select("source", "sid", "source_size", "target")


def clocked(sized: DataFrame, targets: DataFrame, ranges: int) -> DataFrame:
    """`sized` with its source's numbers and `sent`: the words its source has sent when the document's first entry ends.

    Documents are shuffled by `tie`. Rows alike in source, tie and size end at the same time.
    """
    at = F.least(F.floor(F.conv(F.substring("tie", 1, 8), 16, 10).cast("long") * F.lit(ranges) / F.lit(1 << 32)), F.lit(ranges - 1))
    keyed = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"]).withColumn("at", at)
    earlier = Window.partitionBy("sid").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("sid", "at").agg(F.sum("size").alias("here"))
    starts = starts.withColumn("start", F.coalesce(F.sum("here").over(earlier), F.lit(0))).drop("here")
    inside = Window.partitionBy("sid", "at").orderBy("tie", "size")
    return keyed.join(starts, ["sid", "at"]).withColumn("sent", F.col("start") + F.sum("size").over(inside)).drop("at", "start")


def entries(clocks: DataFrame, max_passes: int) -> DataFrame:
    """One row per document and pass, with its finish time; documents without words have none."""
    passes = F.explode(F.array(*[F.lit(i) for i in range(max_passes)]))
    rows = clocks.where("size > 0").select("sid", "tie", "size", "sent", "source_size", "target", passes.alias("lap"))
    finish = (F.col("lap") * F.col("source_size") + F.col("sent")).cast("double") / F.col("target")
    rows = rows.withColumn("finish", finish)
    key = F.floor(F.least(F.col("finish"), F.lit(3.999)) * F.lit(float(1 << KEY_BITS))).cast("long")
    return rows.withColumn("key", key).select("finish", "sid", "lap", "tie", "size", "key")


def last_taken(queue: DataFrame, budget: float) -> tuple | None:
    """(finish, sid, lap, tie, size) of the last entry within the budget; None if not even the first fits."""
    shift, prefix, spent = KEY_BITS - LEVEL_BITS, None, 0
    while True:
        part = queue if prefix is None else queue.where(F.shiftright("key", shift + LEVEL_BITS) == prefix)
        counts = part.groupBy(F.shiftright("key", shift).alias("at")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        found = counts.orderBy("at").limit(RANGES).collect()
        over = None
        for row in found:
            if spent + row["words"] > budget:
                over = row
                break
            spent += row["words"]
        if over is None or over["rows"] <= CUT_ROWS or shift == 0:
            break
        prefix, shift = over["at"], shift - LEVEL_BITS
    order = ["finish", "sid", "lap", "tie", "size"]
    last = None
    if over is not None:
        inside = queue.where(F.shiftright("key", shift) == over["at"])
        inside = inside.withColumn("total", F.sum("size").over(Window.orderBy(*order)) + F.lit(spent))
        last = inside.where(F.col("total") <= budget).orderBy(*[F.col(c).desc() for c in order]).limit(1).collect()
        below = F.shiftright("key", shift) < over["at"]
    if not last:
        rest = queue if over is None else queue.where(below)
        last = rest.agg(F.max(F.struct(*order)).alias("top")).where("top is not null").select("top.*").collect()
    return tuple(last[0][c] for c in order) if last else None


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_passes: int = MAX_PASSES
) -> DataFrame:
    """How much of each document the mix takes: doc_id, source, size, source_size, target, taken.

    `docs` needs doc_id, text and source; other columns are not read. A null or blank text has size 0 and is taken 0
    times; a null source is a source of its own, behind all others; a null doc_id is shuffled by its size. Repeated rows
    count as often as they occur; rows alike in doc_id, source and size are taken alike. An empty table gives none.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    sized = sized.withColumn("tie", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.col("size")))))
    sized = stage(sized, "mix-sizes")
    rows, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = stage(source_targets(sized, weights, share, max_passes), "mix-targets")
    clocks = stage(clocked(sized, targets, max(1, rows // RANGE_ROWS)), "mix-clocks")
    cut = last_taken(entries(clocks, max_passes), total * share)
    taken = F.lit(0).cast("long")
    if cut is not None:
        end = F.struct(*[F.lit(v).cast(t) for v, t in zip(cut, ("double", "int", "int", "string", "long"), strict=True)])
        for lap in range(max_passes):
            finish = (F.lit(lap) * F.col("source_size") + F.col("sent")).cast("double") / F.col("target")
            entry = F.struct(finish, F.col("sid").cast("int"), F.lit(lap), F.col("tie"), F.col("size"))
            taken = taken + F.when(F.col("size") > 0, F.when(entry <= end, F.col("size")).otherwise(0)).otherwise(0)
    return clocks.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def repeated(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """The rows of `docs` as the mix holds them: each as often as it was taken."""
    passes = taken.where("taken > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"),
        (F.col("taken") / F.col("size")).cast("int").alias("_times"),
    ).distinct()
    same = (
        docs["doc_id"].eqNullSafe(F.col("_id")) & docs["source"].eqNullSafe(F.col("_source")) & (words(docs["text"]) == F.col("_size"))
    )
    kept = docs.join(passes, same).withColumn("_pass", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return kept.select(*docs.columns)


MIX_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
           md5(CAST(doc_id AS VARCHAR)) AS tie
    FROM documents
), named AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid
    FROM sized GROUP BY source
), weighted AS (
    SELECT *, [3, 1, 2][(sid - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM named
), levels AS (
    SELECT *,
           (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
             - CAST(coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                    AS DOUBLE))
           / CAST(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE)
             AS level
    FROM weighted
), targets AS (
    SELECT source, sid, source_size, least(cap::DOUBLE, weight::DOUBLE * max(level) OVER ()) AS target FROM levels
), clocks AS (
    SELECT d.doc_id, t.sid, d.size, d.tie, t.source_size, t.target,
           sum(d.size) OVER (PARTITION BY t.sid ORDER BY d.tie, d.size) AS sent
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), queue AS (
    SELECT doc_id, size, sid, lap, tie, CAST(lap * source_size + sent AS DOUBLE) / target AS finish
    FROM clocks, (VALUES (0), (1)) laps(lap) WHERE size > 0
), spent AS (
    SELECT doc_id, size, sum(size) OVER (ORDER BY finish, sid, lap, tie, size) AS total FROM queue
), taken AS (
    SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM spent
    WHERE total <= 1.5 * (SELECT sum(size) FROM sized) GROUP BY doc_id
)
SELECT c.doc_id, c.size, c.source_size, c.target, coalesce(t.taken, 0) AS taken
FROM clocks c LEFT JOIN taken t ON c.doc_id = t.doc_id
"""


@query("op7_fair_queue_mix", MIX_SQL)
def fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")

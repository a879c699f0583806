"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotext.session import stage


def components(edges: DataFrame) -> DataFrame:
    """`node, root` for every end of an edge (columns a, b: long); root is the least node that can be reached.

    Each round hangs every node's larger neighbours under its least one, then every node's smaller neighbours; edges
    stay an edge table, so no group of links is ever held. Rounds go on until the table no longer changes, which takes a
    number of them logarithmic in the nodes. The state is written to the shared folder after each round.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    links = stage(links, "links")
    seen = None
    while True:
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
        least = F.least(F.col("u"), F.min("v").over(Window.partitionBy("u")))
        large = both.withColumn("m", least).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = F.min("lo").over(Window.partitionBy("hi"))
        small = large.withColumn("m", least)
        small = small.select(F.explode(F.array(F.struct("hi", "m"), F.struct(F.col("lo").alias("hi"), "m"))).alias("e"))
        small = small.where("e.hi <> e.m").select(F.col("e.hi").alias("hi"), F.col("e.m").alias("lo")).distinct()
        links = stage(small, "links")
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)

"""Connected components of a link table, without bringing it to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm.common import written


def _downward(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")


def _handed(links: DataFrame) -> DataFrame:
    """The links (u, v), v < u, after every node has handed its larger neighbours to the smallest node it sees, then its smaller ones likewise; some may be repeated."""
    down = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = links.unionByName(down).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    return large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.withColumnRenamed("m", "v"))


def contracted(links: DataFrame) -> DataFrame:
    """(node, to) after one pass over `links` (a, b), which must be written: for nodes that see a smaller one then, the smallest. Whether two nodes come to the
    same one does not tell that they are not connected."""
    return _handed(_downward(links)).groupBy("u").agg(F.min("v").alias("to")).withColumnRenamed("u", "node")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b): root is the smallest node reachable.

    Alternating star contraction: every node hands its larger neighbours to the smallest node it sees, then its smaller ones likewise,
    until only stars around the smallest nodes remain. Each round is aggregations and joins on nodes; its links are written."""
    links = written(_downward(links).distinct(), "links")
    before = None
    while True:
        links = written(_handed(links).distinct(), "links")
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def relabelled(roots: DataFrame | None, new: DataFrame) -> DataFrame:
    """(node, root) after the links `new`: those between what is connected already are followed through its roots."""
    if roots is None:
        return written(components(new), "roots")
    side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias("r" + c))
    new = new.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    joint = written(components(new), "joint").select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(joint, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return written(moved.unionByName(joint.select(F.col("root").alias("node"), F.col("top").alias("root")).join(roots, "node", "left_anti")), "roots")

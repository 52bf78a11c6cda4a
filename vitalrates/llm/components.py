"""Connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalrates.llm.common import stored


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node``, ``root``: a root per component, for every node of a link
    (columns ``a``, ``b``).

    A round joins every node to the neighbour of least hash, if that is below
    its own, and contracts the links; the hash changes from round to round, so
    that chains shrink by a constant factor. Each round is stored on shared
    storage. Only the number of links left reaches the driver."""
    links = stored(links.where(F.col("a") != F.col("b")).select("a", "b").distinct(), f"{name}-links")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = stored(nodes.select("node", F.col("node").alias("root")), f"{name}-roots")
    turn = 0
    while not links.isEmpty():
        turn += 1
        rank = lambda c: F.xxhash64(F.col(c), F.lit(turn))
        both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
        near = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("h"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(rank("a").alias("h"), F.col("a").alias("n"))
        parent = stored(near.select(F.col("a").alias("x"), F.least(F.col("m"), own)["n"].alias("p")), f"{name}-parents")
        links = (links.join(parent.withColumnRenamed("x", "a").withColumnRenamed("p", "pa"), "a")
                 .join(parent.withColumnRenamed("x", "b").withColumnRenamed("p", "pb"), "b")
                 .where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        links = stored(links, f"{name}-links")
        roots = stored(roots.join(parent, roots["root"] == parent["x"], "left")
                       .select("node", F.coalesce("p", "root").alias("root")), f"{name}-roots")
    return roots

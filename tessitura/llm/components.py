"""Connected components of links that are spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _smallest(arrows: DataFrame) -> DataFrame:
    """(u, m): the least of u and what its arrows point to; combined map-side.
    Checkpointed, so that a join with it is a stage of its own that adaptive
    execution can split where a node has very many links."""
    return checkpointed(arrows.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link; root is the least node reached.

    Alternates the large-star and small-star steps until the links are stars
    around their roots, which takes a number of rounds about logarithmic in
    the size of a component. Nulls and self links are ignored.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = checkpointed(edges)
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        m = _smallest(large)
        small = large.join(m, "u").select(F.col("v").alias("x"), "m").where("x <> m").unionAll(m.select("u", "m").where("u <> m"))
        edges = checkpointed(small.select(F.col("x").alias("u"), F.col("m").alias("v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

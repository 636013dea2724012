"""Connected components of links by alternating large-star and small-star steps, each a staged table."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import Staged


def are_stars(edges: DataFrame) -> bool:
    """Whether every node u of edges (u, v; u > v; distinct) has one edge only, and so hangs on the smallest of its component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("end")).select("end.*")
    others = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where("ups > 0 AND n > 1")
    return others.agg(F.count("*")).first()[0] == 0


def components(links: DataFrame, staged: Staged, tag: str = "cc") -> DataFrame:
    """node, label: the smallest node that a node reaches. links: columns a, b (long); nodes without links are not listed.

    A step sends each node's neighbours to the smallest of them; the minimum is a partial aggregate joined back by a
    sort-merge join, so a node with any number of neighbours is spread over tasks.
    """
    name = f"{tag}-0"
    edges = staged.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), name)
    for i in count(1):
        if are_stars(edges):  # then a step changes nothing
            break
        # large star: larger neighbours of u go to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.col("w")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: smaller neighbours of u, and u, go to the smallest of them
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        joined = large.join(least.hint("merge"), F.col("u") == F.col("w"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u > v").distinct()
        edges = staged.write(small, f"{tag}-{i}")
        staged.drop(name)
        name = f"{tag}-{i}"
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())

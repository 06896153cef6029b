"""Connected components of an undirected graph by alternating large-star and small-star steps.

Every step replaces edges by edges to smaller nodes and keeps the components; the loop ends when every node is linked
with the smallest node of its component only. A step is one aggregate with map-side combine and one join, which adaptive
execution can split at a hot node."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showerframe.workspace import Workspace


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _smallest(both).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = _smallest(edges)
    rest = edges.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.select("u", F.col("m").alias("v")))


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b), with ``comp`` the smallest node of its component. Edges that
    join a node with itself or have a null end are ignored; without edges the result is empty."""
    star = (edges.filter(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    star, before = ws.save(star, "edges"), None
    while True:
        print_of = star.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if print_of == before:
            break
        before = print_of
        new = ws.save(_small_star(_large_star(star).distinct()).distinct(), "edges")
        ws.release(star)
        star = new
    ends = star.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return star.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(ends)

"""Following pointers: components of functional graphs and roots of forests, by pointer doubling.

Both loops write their state each round (log2 of the longest path rounds) and stop on an exact test."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showerframe.session import cleaned
from showerframe.workspace import Workspace


def started(edges: DataFrame) -> DataFrame:
    """Doubling state of ``edges`` (event_id, obj, next; one row per ``obj``).

    A state row holds the node reached after 2**k steps and the smallest node among those steps. ``mark`` is the
    smallest node on the next 2**k steps; once it is equal at both ends of every edge it names the component, cycles
    of any length included."""
    return edges.select("event_id", "obj", "next", F.col("next").alias("ptr"), F.col("obj").alias("low"))


def doubled(state: DataFrame) -> DataFrame:
    ahead = state.select("event_id", F.col("obj").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("low").alias("low2"))
    mark = F.coalesce("low2", "ptr")
    return (state.join(ahead, ["event_id", "ptr"], "left")
            .select("event_id", "obj", "next", F.coalesce("ptr2", "ptr").alias("ptr"),
                    F.least("low", mark).alias("low"), mark.alias("mark")))


def unsettled(step: DataFrame) -> DataFrame:
    """Edges whose ends do not have one mark yet; without any, ``named`` is right."""
    other = step.select("event_id", F.col("obj").alias("next"), F.col("mark").alias("mark2"))
    return (step.join(other, ["event_id", "next"], "left")
            .filter(F.col("mark") != F.coalesce("mark2", "next")).select("event_id", "obj"))


def named(step: DataFrame) -> DataFrame:
    """(event_id, obj, comp) of every node that an edge touches, ``comp`` the smallest node of its component."""
    ends = (step.select("event_id", F.explode(F.array("obj", "next")).alias("obj"), "mark")
            .groupBy("event_id", "obj").agg(F.min("mark").alias("mark")))
    names = (step.groupBy("event_id", "mark").agg(F.least(F.min("obj"), F.min("next")).alias("comp")))
    return ends.join(names, ["event_id", "mark"]).select("event_id", "obj", "comp")


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """Weakly connected components where every node has at most one outgoing edge (``started``, ``named``)."""
    state, previous = started(edges), None
    while True:
        # two doublings a round: most chains of merging objects are shorter than four
        step = ws.save(doubled(doubled(state)), "components")
        if previous is not None:
            ws.release(previous)
        with cleaned(ws.spark):
            settled = unsettled(step).isEmpty()
        if settled:
            return named(step)
        state = previous = step


def roots(ws: Workspace, forest: DataFrame, keys: list[str]) -> DataFrame:
    """Root of every node of an acyclic pointer forest.

    ``forest``: keys..., idx, parent (-1 at a root). Returns (keys..., idx, root). A node that already points at a
    root drops out of the join, so a large tree does not load one key again each round."""
    parents = forest.select(*keys, F.col("idx").alias("ptr"), (F.col("parent") < 0).alias("at_root"))
    start = forest.select(*keys, "idx", F.when(F.col("parent") >= 0, F.col("parent")).otherwise(F.col("idx")).alias("ptr"),
                          (F.col("parent") < 0).alias("self"))
    state, seen = ws.save_counting(
        start.join(parents, [*keys, "ptr"]).select(*keys, "idx", "ptr", "at_root"),
        "roots", moving=F.count_if(~F.col("at_root")))
    while seen["moving"]:
        ahead = state.select(*keys, F.col("idx").alias("ptr"), F.col("ptr").alias("ptr2"),
                             F.col("at_root").alias("at_root2"))
        moved = (state.filter(~F.col("at_root")).join(ahead, [*keys, "ptr"])
                 .select(*keys, "idx", F.col("ptr2").alias("ptr"), F.col("at_root2").alias("at_root")))
        new, seen = ws.save_counting(state.filter("at_root").unionByName(moved), "roots",
                                     moving=F.count_if(~F.col("at_root")))
        ws.release(state)
        state = new
    return state.select(*keys, "idx", F.col("ptr").alias("root"))

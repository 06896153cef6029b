"""Objects of a clustering as weighted memberships.

``weights`` is (event_id, obj, member, w) where a member is a cell (level "rh") or a cell group (level "lc");
``roster`` is (event_id, obj) and keeps objects that touch nothing."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showerframe.functions.ranking import ordinals
from showerframe.schema import LEVELS


@dataclass(frozen=True)
class Objects:
    weights: DataFrame
    roster: DataFrame
    level: str  # "rh" or "lc": what ``member`` refers to


def member_level(level: str) -> str:
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}, not {level!r}")
    return "rh" if level == "rh" else "lc"


def from_labels(labels: DataFrame, level: str) -> Objects:
    """One object per non-negative label; the label itself is the object key. ``labels``: event_id, idx, label, and
    ``setting`` if they are those of several settings."""
    by = [c for c in ("setting",) if c in labels.columns]
    held = labels.filter(F.col("label") >= 0)
    weights = held.select("event_id", *by, F.col("label").alias("obj"), F.col("idx").alias("member"), F.lit(1.0).alias("w"))
    return Objects(weights, weights.select("event_id", *by, "obj").distinct(), member_level(level))


def from_tracksters(trackster_lc: DataFrame, collection: str) -> Objects:
    """A stored collection; rows with a NULL ``lc`` only say that an empty trackster exists."""
    rows = trackster_lc.filter(F.col("collection") == collection)
    weights = (rows.filter(F.col("lc").isNotNull())
               .groupBy("event_id", F.col("ts").alias("obj"), F.col("lc").alias("member"))
               .agg(F.sum("weight").alias("w")))
    return Objects(weights, rows.select("event_id", F.col("ts").alias("obj")).distinct(), "lc")


def from_cell_weights(weights: DataFrame) -> Objects:
    """Arbitrary cell fractions: event_id, obj, rh, w; duplicates are summed."""
    summed = (weights.groupBy("event_id", "obj", F.col("rh").alias("member")).agg(F.sum("w").alias("w")))
    return Objects(summed, summed.select("event_id", "obj").distinct(), "rh")


def to_cells(objects: Objects, lch: DataFrame) -> DataFrame:
    """Cell fractions (event_id, obj, rh, w) of any objects."""
    if objects.level == "rh":
        return objects.weights.withColumnRenamed("member", "rh")
    return (objects.weights.join(lch.withColumnRenamed("lc", "member"), ["event_id", "member"])
            .groupBy("event_id", "obj", "rh").agg(F.sum(F.col("w") * F.col("frac")).alias("w")))


def renumbered(objects: Objects) -> Objects:
    """The same objects numbered 0..n-1 per event in key order."""
    number = ordinals(objects.roster, ["event_id"], "obj", "_n")

    def swap(df: DataFrame) -> DataFrame:
        return df.join(number, ["event_id", "obj"]).drop("obj").withColumnRenamed("_n", "obj")

    return Objects(swap(objects.weights), swap(objects.roster), objects.level)

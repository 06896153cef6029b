"""Points of a level and their clustering coordinates."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showerframe.functions.scalars import by_detector, number, real
from showerframe.params import Params
from showerframe.schema import DETECTORS, LAST_LAYER, LEVELS, SIZE_CUT_ALGOS, EventTables

EV = "event_id"


def points(tables: EventTables, level: str) -> DataFrame:
    """event_id, idx, E, x, y, z, layer, side, det, tag, active."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}, not {level!r}")
    det_ok = F.col("det").isin(*DETECTORS)
    if level == "rh":
        return tables.rh.select(
            EV, F.col("rh").alias("idx"), "E", "x", "y", "z", "layer", (F.col("z") > 0).cast("int").alias("side"),
            "det", F.col("id").cast("long").alias("tag"), (det_ok & (F.col("E") > 0)).alias("active"))
    active = (F.col("mask") > 0) & det_ok
    if level == "lc_all":
        active = active | (det_ok & F.col("algo").isin(*SIZE_CUT_ALGOS))
    return tables.lc.select(EV, F.col("lc").alias("idx"), "E", "x", "y", "z", "layer", "side", "det",
                            F.col("seed").cast("long").alias("tag"), active.alias("active"))


def coordinates(pts: DataFrame, p: Params) -> DataFrame:
    """Coordinates of the active points: event_id, side, idx, tag, E, X, Y, Z, rel, sig, r.

    Transverse coordinates are slopes in units of the smallest sigma, ``rel`` is the point's sigma in the same unit
    and ``sig`` its position in the list of distinct sigmas. Every operation is rounded to the working precision in
    the order written: neighbours a whole number of layers away sit exactly on the density radius, so the rounding
    of ``Z`` decides whether they count."""
    f32 = p.f32

    def rnd(c):
        return real(c, f32)

    one = number(1.0, f32)
    smallest = number(min(p.sigmaT), f32)
    inv_smallest = rnd(one / smallest)
    inv_scale = rnd(one / number(p.layerScale, f32))
    gap = number(2.0, f32) * number(max(p.dc, p.outlierDistance), f32)
    distinct = sorted(set(p.sigmaT))
    # A point at z = 0 has no slope; it stays without a place and hence without a cluster.
    act = pts.filter(F.col("active") & F.col("side").isin(0, 1) & (F.col("z") != 0)).select(
        EV, "side", "idx", "tag", "layer", rnd(F.col("E")).alias("E"), *[rnd(F.col(c)).alias(c) for c in "xyz"],
        rnd(by_detector(F.col("det"), [F.lit(float(s)) for s in p.sigmaT])).alias("sigma"),
        by_detector(F.col("det"), [F.lit(distinct.index(s)) for s in p.sigmaT]).alias("sig"))
    act = (act.withColumn("inv", rnd(one / F.abs("z")))
           .withColumn("rel", rnd(F.col("sigma") / smallest))
           .withColumn("zl", rnd(F.col("layer") - 1 + F.col("side") * LAST_LAYER))
           .withColumn("gap", F.when(F.col("side") == 1, gap).otherwise(number(0.0, f32))))
    if p.fma:
        z = rnd(F.col("zl").cast("double") * inv_scale.cast("double") + F.col("gap").cast("double"))
    else:
        z = rnd(rnd(F.col("zl") * inv_scale) + F.col("gap"))
    radius = rnd(rnd(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))) * F.col("inv"))
    return act.select(EV, "side", "idx", "tag", "E",
                      rnd(rnd(F.col("x") * F.col("inv")) * inv_smallest).alias("X"),
                      rnd(rnd(F.col("y") * F.col("inv")) * inv_smallest).alias("Y"),
                      z.alias("Z"), "rel", "sig", radius.alias("r"))

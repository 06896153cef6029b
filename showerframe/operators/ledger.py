"""The truth seen from one member (cell or cell group), written once and shared by every scored clustering.

A ledger row is (event_id, member, t, E, floor). Rows with a target struct ``t`` carry the energy of that target in the
member; the one row with ``t`` NULL carries the member's own energy and the part of it that is not its largest target.
Keeping both kinds in one relation lets a clustering be scored with a single join on the member. ``t`` carries the
attributes of the target, so that no later join has to fetch them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showerframe.functions.scalars import energy_bin

KEY = "event_id"


def target_struct() -> Column:
    return F.struct(
        F.col("target"), F.col("E").alias("energy"), F.col("signal"),
        F.when(F.col("em"), 0).otherwise(1).alias("cls"), energy_bin(F.col("E")).alias("ebin"),
    ).alias("t")


def cell_totals(rh: DataFrame, target_cell: DataFrame) -> DataFrame:
    """Per cell: its energy and its largest target energy (0 if it holds none). One shuffle instead of a join."""
    rows = (rh.select(KEY, "rh", F.col("E").cast("double").alias("e"), F.lit(None).cast("double").alias("te"))
            .unionByName(target_cell.select(KEY, "rh", F.lit(None).cast("double").alias("e"), F.col("E").alias("te"))))
    return (rows.groupBy(KEY, "rh").agg(F.sum("e").alias("E"), F.coalesce(F.max("te"), F.lit(0.0)).alias("top"))
            .filter(F.col("E").isNotNull()))


def cell_ledger(rh: DataFrame, target_cell: DataFrame, targets: DataFrame) -> DataFrame:
    described = targets.select(KEY, "target", target_struct())
    held = (target_cell.join(described, [KEY, "target"])
            .select(KEY, F.col("rh").alias("member"), "t", "E", F.lit(0.0).alias("floor")))
    own = cell_totals(rh, target_cell).select(
        KEY, F.col("rh").alias("member"), F.lit(None).cast(held.schema["t"].dataType).alias("t"), "E",
        (F.col("E") - F.col("top")).alias("floor"))
    return held.unionByName(own)


def group_ledger(lch: DataFrame, cells: DataFrame) -> DataFrame:
    """The cell ledger projected on cell groups. (labels x lch) x truth equals labels x (lch x truth); the second
    order is paid once, however many clusterings are scored."""
    return (lch.join(cells.withColumnRenamed("member", "rh"), [KEY, "rh"])
            .groupBy(KEY, F.col("lc").alias("member"), "t")
            .agg(F.sum(F.col("frac") * F.col("E")).alias("E"), F.sum(F.col("frac") * F.col("floor")).alias("floor")))


def dominant(ledger: DataFrame, members: DataFrame) -> DataFrame:
    """Ideal labels: every member to its largest target (lowest index on a tie), -1 where no target has energy.
    ``members``: event_id, member, each once."""
    held = ledger.filter(F.col("t").isNotNull()).select(KEY, "member", F.col("E").alias("e"), "t.target")
    rows = held.unionByName(members.select(
        KEY, "member", F.lit(None).cast("double").alias("e"), F.lit(None).cast("long").alias("target")))
    best = F.max(F.when(F.col("e") > 0, F.struct("e", (-F.col("target")).alias("neg"))))
    return (rows.groupBy(KEY, "member").agg(best.alias("b"))
            .select(KEY, F.col("member").alias("idx"), F.coalesce(-F.col("b.neg"), F.lit(-1)).alias("label")))

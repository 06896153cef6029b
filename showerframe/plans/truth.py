"""Targets per event, how they were made, and the natural fragmentation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showerframe.operators.targets import Targets
from showerframe.schema import EventTables

EV = "event_id"
MEANS = ("units", "targets", "signal_targets", "merged_units", "unreachable", "signal_unreachable", "iterations",
         "E_signal", "E_pileup", "E_no_truth")


def truth_summary(tables: EventTables, built: Targets) -> DataFrame:
    """One row: means per event of the counters, Phi_nat_signal and the number of events. All counters add up over
    events, so the per-event step of the definition is not needed. No row without events."""
    keys = (*MEANS, "phi_num", "phi_den", "events")

    def part(df: DataFrame, **values: Column) -> DataFrame:
        return df.select(*[values.get(k, F.lit(0)).cast("double").alias(k) for k in keys]).agg(
            *[F.sum(k).alias(k) for k in keys])

    signal = F.col("signal")

    def when(cond: Column, value) -> Column:
        return F.when(cond, value).otherwise(0)

    e, one = F.col("E"), F.lit(1)
    parts = [
        part(built.targets, targets=one, signal_targets=when(signal, 1), unreachable=when(F.col("unreachable"), 1),
             signal_unreachable=when(F.col("unreachable") & signal, 1), E_signal=when(signal, e),
             E_pileup=when(~signal, e), phi_num=when(signal, e), phi_den=when(signal, e * F.col("n_pieces"))),
        part(built.unit_target, units=one, merged_units=when(F.col("merged_at") >= 0, 1)),
        part(built.rounds, iterations=F.col("n_iterations")),
        part(tables.rh, E_no_truth=F.col("noTruthE")),
        part(tables.event, events=one)]
    total = parts[0]
    for more in parts[1:]:
        total = total.unionByName(more)
    total = total.agg(*[F.sum(k).alias(k) for k in keys]).filter(F.col("events") > 0)
    return total.select(
        *[(F.col(k) / F.col("events")).alias(k) for k in MEANS],
        F.when(F.col("phi_den") != 0, 1 - F.col("phi_num") / F.col("phi_den")).otherwise(0.0).alias("Phi_nat_signal"),
        F.col("events").cast("long").alias("events"))

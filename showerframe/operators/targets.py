"""Truth: atoms -> units -> targets, and the natural pieces of every target."""
from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showerframe.functions.scalars import is_em
from showerframe.operators import merging
from showerframe.schema import DEFAULT_FRAC, EventTables
from showerframe.workspace import Workspace

EV = "event_id"


@dataclass(frozen=True)
class Targets:
    targets: DataFrame      # event_id, target, E, signal, em, unreachable, n_units, completeness, purity, n_pieces
    unit_target: DataFrame  # event_id, unit, target, E_unit, merged_at, partner
    target_cell: DataFrame  # event_id, rh, target, E
    rounds: DataFrame       # event_id, n_iterations


def unit_cells(tra: DataFrame, atom: DataFrame) -> DataFrame:
    """Energy of every unit in every cell."""
    return (tra.join(atom.select(EV, "atom", "unit"), [EV, "atom"])
            .groupBy(EV, "rh", "unit").agg(F.sum("E").alias("E")))


def _unit_cells(tables: EventTables) -> DataFrame:
    """``unit_cells`` of a sample, which may know them (``derived.Sample``)."""
    known = getattr(tables, "unit_cells", None)
    return unit_cells(tables.tra, tables.atom) if known is None else known


def attributes(unit_target: DataFrame, un: DataFrame) -> DataFrame:
    """Per target: number of units, signal if any unit is, EM if its hardest unit is. ``unit_target`` needs event_id,
    unit, target, E_unit."""
    units = unit_target.select(EV, "unit", "target", "E_unit").join(
        un.select(EV, "unit", "signal", is_em(F.col("pdg"), F.col("kind")).alias("em")), [EV, "unit"])
    lead = F.max(F.struct("E_unit", (-F.col("unit")).alias("neg"), "em"))
    return (units.groupBy(EV, "target")
            .agg(F.count("*").alias("n_units"), F.bool_or(F.col("signal") > 0).alias("signal"), lead.alias("lead"))
            .select(EV, "target", "n_units", "signal", F.col("lead.em").alias("em"),
                    (-F.col("lead.neg")).alias("lead_unit")))


def given(ws: Workspace, tables: EventTables, assignment: DataFrame) -> Targets:
    """Targets of a given unit -> target assignment (event_id, unit, target), taken without the test."""
    cells = ws.save(_unit_cells(tables), "unit_cells")
    rows = (assignment.select(EV, "unit", "target", F.lit(0.0).alias("E"))
            .unionByName(cells.select(EV, "unit", F.lit(None).cast("long").alias("target"), "E")))
    unit_target = (rows.groupBy(EV, "unit").agg(F.max("target").alias("target"), F.sum("E").alias("E_unit"))
                   .withColumns({"merged_at": F.lit(-1), "partner": F.lit(-1).cast("long")}))
    target_cell = (cells.join(assignment, [EV, "unit"]).groupBy(EV, "rh", "target").agg(F.sum("E").alias("E")))
    energy = unit_target.groupBy(EV, "target").agg(F.sum("E_unit").alias("E"))
    found = attributes(unit_target, tables.un).join(energy, [EV, "target"])
    return Targets(found, unit_target, target_cell, assignment.select(EV, F.lit(0).alias("n_iterations")).distinct())


class Built:
    """``Targets`` of a separation, each table written when first asked for."""

    def __init__(self, ws: Workspace, tables: EventTables, sep: merging.Separation, frac: float, pieces: bool):
        self._ws, self._tables, self._sep, self._frac, self._pieces = ws, tables, sep, frac, pieces
        self.rounds = sep.rounds

    @cached_property
    def unit_target(self) -> DataFrame:
        rows = self._sep.members.select(EV, F.col("base").alias("unit"), F.col("obj").alias("target"),
                                        F.col("E_base").alias("E_unit"), "merged_at", "partner")
        return self._ws.save(rows, "unit_target")

    @cached_property
    def target_cell(self) -> DataFrame:
        return self._ws.save(self._sep.cells.withColumnRenamed("obj", "target"), "target_cell")

    @cached_property
    def targets(self) -> DataFrame:
        found = (self._sep.objects.drop("grp", "head").withColumnRenamed("obj", "target")
                 .join(attributes(self.unit_target, self._tables.un), [EV, "target"]))
        if self._pieces:
            found = (found.join(natural_pieces(self._ws, self._tables, self.unit_target, self._frac), [EV, "target"], "left")
                     .withColumn("n_pieces", F.coalesce("n_pieces", F.lit(0))))
        else:
            found = found.withColumn("n_pieces", F.lit(1).cast("long"))
        return self._ws.save(found, "targets")


def build(ws: Workspace, tables: EventTables, frac: float = DEFAULT_FRAC, pieces: bool = True) -> Built:
    """Targets of all events: units merged by the ideal-clustering test, never across interactions."""
    un = tables.un.select(EV, "unit", F.struct("bx", "evt").alias("grp"))
    known = getattr(tables, "unit_cells", None)
    if known is None:
        # The interaction rides on the small side, so that the contributions are shuffled once.
        located = tables.tra.join(tables.atom.select(EV, "atom", "unit").join(un, [EV, "unit"]), [EV, "atom"])
    else:
        located = known.join(un, [EV, "unit"])
    cells = located.select(EV, "rh", F.col("unit").alias("base"), "grp", F.col("E").cast("double").alias("E"))
    bases = un.select(EV, F.col("unit").alias("base"), "grp", F.lit(None).cast("long").alias("pref"))
    return Built(ws, tables, merging.separate(ws, cells, bases, ["rh"], frac), frac, pieces)


def atom_targets(atom: DataFrame, unit_target: DataFrame) -> DataFrame:
    """(event_id, atom, parent, target); the parent is kept only if it belongs to the same target."""
    located = atom.select(EV, "atom", "parent", "unit").join(
        unit_target.select(EV, "unit", "target"), [EV, "unit"]).select(EV, "atom", "parent", "target")
    parents = located.select(EV, F.col("atom").alias("parent"), F.col("target").alias("p_target"))
    return (located.join(parents, [EV, "parent"], "left")
            .select(EV, "atom", F.when(F.col("p_target") == F.col("target"), F.col("parent"))
                    .otherwise(F.lit(-1)).alias("parent"), "target"))


def natural_pieces(ws: Workspace, tables: EventTables, unit_target: DataFrame,
                   frac: float = DEFAULT_FRAC) -> DataFrame:
    """Number of pieces of every target: the same test on its atoms, on its own energy only, a failing piece joining
    the piece of its parent atom.

    Pieces of different targets never meet, so every target is an event of its own to the test, under a number that is written
    once: targets, not events, are dealt out to tasks, and each leaves the loop as soon as nothing merges in it."""
    atoms = ws.save(atom_targets(tables.atom, unit_target), "atoms")
    apart = ws.save(atoms.select(EV, "target").distinct().withColumn("own", F.monotonically_increasing_id()), "apart")
    atoms = ws.save(atoms.join(apart, [EV, "target"]), "atoms")
    own = F.col("own").alias(EV)
    held = None
    if hasattr(tables, "contributions_of"):
        held = tables.contributions_of(unit_target.select(EV, "unit", "target").join(apart, [EV, "target"]), "target", "own")
    if held is None:
        held = tables.tra.join(atoms.select(EV, "atom", "target", "own"), [EV, "atom"])
    cells = held.select(own, "rh", F.col("atom").alias("base"), F.col("target").alias("grp"), F.col("E").cast("double").alias("E"))
    bases = atoms.select(own, F.col("atom").alias("base"), F.col("target").alias("grp"),
                         F.when(F.col("parent") >= 0, F.col("parent")).alias("pref"))
    sep = merging.separate(ws, cells, bases, ["rh"], frac, use_pref=True)
    pieces = sep.objects.groupBy(F.col(EV).alias("own")).agg(F.count("*").alias("n_pieces"))
    return apart.join(pieces, "own").select(EV, "target", "n_pieces")

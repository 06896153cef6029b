"""Scoring of settings, ideal references and a stored collection over one sample."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showerframe.operators import density, ledger, objects, scoring, summary, targets
from showerframe.operators.points import points
from showerframe.params import Params
from showerframe.schema import DEFAULT_FRAC, SCHEMAS, EventTables
from showerframe.workspace import Workspace

EV = "event_id"


class Truth:
    """Targets and ledgers of a sample, built once and used by every scoring."""

    def __init__(self, ws: Workspace, tables: EventTables, frac: float = DEFAULT_FRAC, pieces: bool = False,
                 built: targets.Targets | None = None):
        self.ws, self.tables = ws, tables
        self.targets = built or targets.build(ws, tables, frac, pieces)
        self._ledgers: dict[str, DataFrame] = {}

    def ledger(self, level: str) -> DataFrame:
        level = objects.member_level(level)
        if level not in self._ledgers:
            if level == "rh":
                df = ledger.cell_ledger(self.tables.rh, self.targets.target_cell, self.targets.targets)
            else:
                df = ledger.group_ledger(self.tables.lch, self.ledger("rh"))
            self._ledgers[level] = self.ws.save(df, f"ledger_{level}")
        return self._ledgers[level]

    def ideal_labels(self, level: str) -> DataFrame:
        """Dominant target of every cell ("rh") or cell group (any other level)."""
        own = self.tables.rh if level == "rh" else self.tables.lc
        members = own.select(EV, F.col("rh" if level == "rh" else "lc").alias("member"))
        return ledger.dominant(self.ledger("rh" if level == "rh" else "lc"), members)

    def evaluate(self, objs: objects.Objects, events: DataFrame | None = None, settings: tuple = ()) -> scoring.Scored:
        return scoring.evaluate(self.ws, objs, self.ledger(objs.level), self.targets.targets,
                                self.tables.event if events is None else events, settings)

    def score_labels(self, labels: DataFrame, level: str, settings: tuple = ()) -> scoring.Scored:
        """With the names of ``settings``, those of column ``setting`` of the labels. ``labels`` should be a stored or written table: their join with the ledger then starts from a shuffle on
        both sides, which adaptive execution can split at a hot member."""
        return self.evaluate(objects.from_labels(labels, level), settings=settings)

    def score_collection(self, collection: str) -> scoring.Scored:
        """Only the events that store the collection count, with their targets; there may be none."""
        stored = self.tables.trackster_lc
        if stored is None:
            stored = self.ws.spark.createDataFrame([], SCHEMAS["trackster_lc"])
        events = stored.filter(F.col("collection") == collection).select(EV).distinct()
        objs = objects.from_tracksters(stored, collection)
        found = self.targets.targets.join(events, EV, "left_semi")
        return scoring.evaluate(self.ws, objs, self.ledger("lc"), found, events)


def score(ws: Workspace, tables: EventTables, settings: list[dict], level: str = "lc",
          collection: str | None = None, truth: Truth | None = None) -> DataFrame:
    """Long summary (setting, metric, value): every setting clustered at ``level``, the ideal clustering at both
    levels as ideal_rh and ideal_lc, and a stored collection as stored:<name>. A later setting of the same name
    replaces an earlier one. All settings are clustered and scored in the jobs of one (``lanes``)."""
    return summary.summary(score_sums(ws, tables, settings, level, collection, truth), by=("setting",))


def score_sums(ws: Workspace, tables: EventTables, settings: list[dict], level: str = "lc",
               collection: str | None = None, truth: Truth | None = None) -> DataFrame:
    """(setting, cls, ebin, sums) of which ``score`` is the summary."""
    truth = truth or Truth(ws, tables)
    named = {s.get("name", "setting"): Params.from_setting(s) for s in settings}
    labels: dict[str, list[DataFrame]] = {"rh": [], "lc": []}
    names: dict[str, list[str]] = {"rh": [], "lc": []}
    if named:
        with ws.child() as tmp:
            labels[objects.member_level(level)].append(ws.save(density.cluster_all(tmp, points(tables, level), named), "labels"))
        names[objects.member_level(level)] += named
    for lv in ("rh", "lc"):
        if f"ideal_{lv}" in named:
            raise ValueError(f"ideal_{lv} is the name of a reference, not of a setting")
        labels[lv].append(ws.save(truth.ideal_labels(lv).withColumn("setting", F.lit(f"ideal_{lv}")), "labels"))
        names[lv].append(f"ideal_{lv}")
    runs = [truth.score_labels(reduce(lambda a, b: a.unionByName(b), labels[lv]), lv, tuple(names[lv])).sums() for lv in ("rh", "lc")]
    if collection:
        runs.append(truth.score_collection(collection).sums().withColumn("setting", F.lit(f"stored:{collection}")))
    return reduce(DataFrame.unionByName, runs)

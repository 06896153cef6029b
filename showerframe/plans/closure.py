"""The clustering of this package against stored results, at cell-group level."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showerframe.operators import closure, density
from showerframe.operators.points import points
from showerframe.params import DEFAULT, Params
from showerframe.schema import EventTables
from showerframe.workspace import Workspace

EV = "event_id"


@dataclass(frozen=True)
class Closure:
    raw: DataFrame | None             # one row, or none if no event was compared
    final: DataFrame | None
    per_event_raw: DataFrame | None
    per_event_final: DataFrame | None


def run(ws: Workspace, tables: EventTables, params: Params = DEFAULT, collection: str | None = None) -> Closure:
    """Raw labels (before the size cut) against the stored assignment, and final labels against a stored collection,
    each over the events that have it."""
    pts = points(tables, "lc")
    active = pts.filter("active").select(EV, "idx")
    raw = final = None
    if tables.assign is not None:
        stored = tables.assign.select(EV, F.col("lc").alias("idx"), "label")
        events = ws.save(stored.select(EV).distinct(), "events")
        have = pts.join(events, EV, "left_semi")
        with ws.child() as tmp:
            labels = density.cluster(tmp, have, params, drop_small=False)
            raw = ws.save(closure.compare(closure.both_labels(labels, stored, active), events), "closure_raw")
    if collection and tables.trackster_lc is not None:
        stored = closure.collection_labels(tables.lc, tables.trackster_lc, collection)
        events = ws.save(stored.select(EV).distinct(), "events")
        have = pts.join(events, EV, "left_semi")
        with ws.child() as tmp:
            labels = density.cluster(tmp, have, params, drop_small=True)
            final = ws.save(closure.compare(closure.both_labels(labels, stored, active), events), "closure_final")
    return Closure(None if raw is None else closure.aggregate(raw), None if final is None else closure.aggregate(final),
                   raw, final)

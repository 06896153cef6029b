"""Scoring of samples that arrive one by one."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from showerframe.operators import summary
from showerframe.operators.partials import PartialSums
from showerframe.params import Params
from showerframe.plans.score import score_sums
from showerframe.sources import files
from showerframe.workspace import Workspace


def score_folders(spark: SparkSession, state: str, folders: list[str], settings: list[dict], level: str = "lc",
                  collection: str | None = None) -> tuple[DataFrame | None, list[str]]:
    """The long summary (``plans.score.score``) of all folders scored so far, and which of ``folders`` were scored for it:
    those that are new or have a changed file. ``state`` is a folder that keeps the sums, for every (settings, level,
    collection) its own; folders given earlier stay in the total."""
    named = {s.get("name", "setting"): Params.from_setting(s).as_dict() for s in settings}
    kept = PartialSums(spark, state, json.dumps([named, level, collection], sort_keys=True))
    done = []
    for folder in dict.fromkeys(files.address(spark, f) for f in folders):
        def sums(folder: str = folder) -> DataFrame:
            return score_sums(ws, files.read_tables(spark, folder), settings, level, collection)

        with Workspace(spark) as ws:
            if kept.add(folder, files.fingerprint(spark, folder), sums, by=("setting",)):
                done.append(folder)
    total = kept.total(by=("setting",))
    return (None if total is None else summary.summary(total, by=("setting",))), done

"""Stored sums of samples scored one by one. Sums of disjoint events add up, so a new sample never reads the others again."""
from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showerframe.schema import SUM_KEYS


class PartialSums:
    """Sums per sample under ``path``, a folder that every executor can reach: one Parquet folder for each (sample, version).
    ``of`` names what was summed; sums of different things share a path without meeting.

    A sample counts once, however often it is added, and only when its folder was written to the end: what an interrupted
    job left is written again. Another version of a sample takes the place of the earlier one. Samples may be added by
    several jobs at a time, but one sample by one job only."""

    def __init__(self, spark: SparkSession, path: str, of: str = ""):
        self.spark, self.path = spark, f"{path.rstrip('/')}/{_name(of)}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def add(self, sample: str, version: str, sums: Callable[[], DataFrame], by: tuple = ()) -> bool:
        """Store ``sums()``, (by..., cls, ebin, SUM_KEYS), unless this version of the sample is stored. True if it was
        computed."""
        home = f"{self.path}/{_name(sample)}"
        folder = f"{home}/{_name(version)}"
        fresh = not self._whole(folder)
        if fresh:
            rows = sums().select(F.lit(sample).alias("sample"), *by, "cls", "ebin", *SUM_KEYS)
            rows.coalesce(1).write.mode("overwrite").parquet(folder)  # a row for each (by, cls, ebin)
        for other in self._fs.listStatus(self._path(home)):
            if other.getPath().getName() != _name(version):
                self._fs.delete(other.getPath(), True)
        return fresh

    def total(self, by: tuple = ()) -> DataFrame | None:
        """(by..., cls, ebin, SUM_KEYS) of all samples, None if there is none."""
        whole = self._stored()
        if not whole:
            return None
        rows = self.spark.read.parquet(*whole)
        return rows.groupBy(*by, "cls", "ebin").agg(*[F.sum(k).alias(k) for k in SUM_KEYS])

    def samples(self) -> list[str]:
        whole = self._stored()
        return sorted(r[0] for r in self.spark.read.parquet(*whole).select("sample").distinct().collect()) if whole else []

    def _stored(self) -> list[str]:
        """The latest whole version of every sample; a job that ended before it deleted the earlier one leaves two."""
        root = self._path(self.path)
        if not self._fs.exists(root):
            return []
        found = []
        for home in self._fs.listStatus(root):
            whole = [s for s in self._fs.listStatus(home.getPath()) if self._whole(s.getPath().toString())]
            found += [max(whole, key=lambda s: s.getModificationTime()).getPath().toString()] if whole else []
        return found

    def _whole(self, folder: str) -> bool:
        return self._fs.exists(self._path(f"{folder}/_SUCCESS"))


def _name(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()

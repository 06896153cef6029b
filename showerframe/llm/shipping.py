"""Makes this package importable on executors, as ``spark-submit --py-files`` would."""
from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import showerframe

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to all executors, once per application. The archive leaves this machine through Spark's file service;
    executors never look for it at the driver's path."""
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    root = os.path.dirname(os.path.abspath(showerframe.__file__))
    archive = os.path.join(tempfile.mkdtemp(), "showerframe.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _done.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)
    return run

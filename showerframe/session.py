"""Session construction and the runtime SQL settings the plans rely on."""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Adaptive execution coalesces small shuffles, broadcasts sides whose measured size allows it and splits skewed
# join partitions. Forcing the split accepts one more exchange after the join, which is the price of a hot key.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

# The planner takes the size of a file for that of its rows, before any of them is repeated for neighbouring cells. Lattices
# compress so well that a table below the usual 10 MB can fill the driver. Before a side is written out by an exchange only
# one of very small files is sent around; from then on its measured size decides.
PLANNED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
LARGEST = {PLANNED: 32 << 10, MEASURED: 4 << 20}
# Where an exchange has measured that every part of one side is small, the parts are joined by hash instead of being sorted.
HASHED, HASHED_BYTES = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", 64 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else built; smaller limits of its own stay."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    planned = _bytes(spark, spark.conf.get(PLANNED))
    measured = spark.conf.get(MEASURED, None)
    measured = planned if measured is None else _bytes(spark, measured)
    for key, own in ((MEASURED, measured), (PLANNED, planned)):
        spark.conf.set(key, str(min(own, LARGEST[key])))
    if _bytes(spark, spark.conf.get(HASHED)) == 0:  # not set by the session
        spark.conf.set(HASHED, str(HASHED_BYTES))
    return spark


def _bytes(spark: SparkSession, size: str) -> int:
    """A configured size in bytes; a negative one sends nothing around."""
    return int(size) if size.lstrip("-").isdigit() else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size)


#: Rows a task gets where ``parts_for`` says how many tasks there are.
LEAST_ROWS, MOST_ROWS = 20_000, 500_000

#: Tables bucketed by one key meet on more keys without an exchange, and no side is sent around instead.
KEYED = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


#: What a job has shuffled is deleted from the disks of the executors when the job ends; without this, it stays until the driver
#: happens to collect the garbage that refers to it.
CLEANED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def keyed(spark: SparkSession):
    """Settings for plans over tables that are bucketed by one key (``Workspace.save_by``) or were dealt out by part of their keys,
    restored afterwards."""
    return _settings(spark, KEYED)


def cleaned(spark: SparkSession):
    """Settings for actions whose plan is run once: their shuffle files go as soon as they end. A plan that is run again would
    have to make them again."""
    return _settings(spark, CLEANED)


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def parts_for(spark: SparkSession, rows: int) -> int:
    """Number of tasks that ``rows`` rows are dealt out to where each row is repeated after the exchange, so that its bytes do not
    tell what a task will hold."""
    return max(1, -(-rows // MOST_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // LEAST_ROWS)))


def session(master: str | None = None, app: str = "showerframe", **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # Call sites of every column expression are not needed and cost driver time in long plans.
    quiet = {"spark.python.sql.dataFrameDebugging.enabled": "false"}
    for key, value in {**RUNTIME, **quiet, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())

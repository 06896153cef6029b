"""Written intermediate tables.

Fixed-point loops cut their lineage by writing each state as Parquet under ``spark.checkpoint.dir``, a folder all
executors share. The tables outlive lost executors, and their known size lets the planner choose broadcast or shuffle
on facts. What a job shuffled is deleted once its table is written (``session.cleaned``).
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from showerframe.session import cleaned

CHECKPOINT_DIR = "spark.checkpoint.dir"


def _root(spark: SparkSession) -> str:
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured
    context_dir = spark._jsc.sc().getCheckpointDir()  # set on the context instead of in the configuration
    if context_dir.isDefined():
        return context_dir.get()
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    return tempfile.mkdtemp(prefix="showerframe-")


class Workspace:
    """Scratch tables of one computation. Results returned to the caller may still read them, so the caller decides
    when to ``close``."""

    _local_roots: dict[str, str] = {}

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        app = spark.conf.get("spark.app.id", "local")
        if root is None and app not in self._local_roots:
            self._local_roots[app] = _root(spark)
        self.path = f"{(root or self._local_roots[app]).rstrip('/')}/showerframe-{uuid.uuid4().hex}"
        self._count = 0
        self._tables: list[str] = []
        if root is None:  # what nobody closes goes with the session
            target = spark._jvm.org.apache.hadoop.fs.Path(self.path)
            target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(target)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a DataFrame that scans the written table."""
        self._count += 1
        path = f"{self.path}/{self._count:04d}-{name}"
        with cleaned(self.spark):
            df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._written_at = path
        return saved

    def save_counting(self, df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, dict]:
        """``save`` that also returns aggregates taken while writing. A re-run task may count twice, so use them only
        where zero or non-zero decides, or where no result depends on them."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        saved = self.save(df.observe(seen, *[c.alias(k) for k, c in counters.items()]), name)
        return saved, {k: v or 0 for k, v in seen.get.items()}

    def save_by(self, df: DataFrame, name: str, key: str, buckets: int, **counters: Column) -> tuple[DataFrame, dict]:
        """``save_counting`` into ``buckets`` files by the hash of ``key``: within ``keyed``, whatever groups or joins such tables
        by keys that contain it needs no exchange."""
        self._count += 1
        path = f"{self.path}/{self._count:04d}-{name}"
        table = f"showerframe_{uuid.uuid4().hex}"
        seen = Observation(table)
        observed = df.observe(seen, *[c.alias(k) for k, c in counters.items()]) if counters else df
        with cleaned(self.spark):
            observed.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table)
        self._tables.append(table)
        saved = self.spark.table(table)
        saved._written_at = path
        return saved, {k: v or 0 for k, v in seen.get.items()} if counters else {}

    def child(self) -> "Workspace":
        """A workspace for tables that are not needed once a result is saved here: ``with ws.child() as tmp: ...``."""
        return Workspace(self.spark, self.path)

    def release(self, *tables: DataFrame) -> None:
        """Delete written tables that nothing reads any more."""
        for table in tables:
            path = getattr(table, "_written_at", None)
            if path and path.startswith(self.path):
                self._delete(path)

    def close(self) -> None:
        for name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._tables.clear()
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)

    def __enter__(self) -> "Workspace":
        return self

    def __exit__(self, *exc) -> None:
        self.close()

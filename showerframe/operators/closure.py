"""Comparison of two partitions of the same points, blind to how clusters are numbered."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showerframe.workspace import Workspace

EV = "event_id"
COUNTERS = ("n_lc", "lc_agree", "clusters_a", "clusters_b", "identical_clusters", "outliers_a", "outliers_b")


def canonical(ws: Workspace, labels: DataFrame) -> DataFrame:
    """``labels`` (event_id, idx, label) with every label replaced by the smallest index of its cluster."""
    names = labels.filter(F.col("label") >= 0).groupBy(EV, "label").agg(F.min("idx").alias("canon"))
    names = ws.save(names, "names")
    return labels.join(names, [EV, "label"], "left").select(EV, "idx", F.coalesce("canon", F.lit(-1)).alias("label"))


def both_labels(a: DataFrame, b: DataFrame, consider: DataFrame | None = None) -> DataFrame:
    """(event_id, idx, a, b) over the considered points (event_id, idx), all points by default."""
    rows = (a.select(EV, "idx", F.col("label").alias("a"))
            .join(b.select(EV, "idx", F.col("label").alias("b")), [EV, "idx"]))
    return rows if consider is None else rows.join(consider.select(EV, "idx"), [EV, "idx"], "left_semi")


def compare(rows: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Counters per event of ``both_labels`` rows, and of all ``events`` if given, also those without a considered point.

    Everything follows from the table of (a, b) counts, which is aggregated before it moves: a cluster of ``a`` is
    identical to one of ``b`` exactly if each is the other's only counterpart."""
    table = (rows.select(EV, F.greatest("a", F.lit(-1)).alias("a"), F.greatest("b", F.lit(-1)).alias("b"))
             .groupBy(EV, "a", "b").agg(F.count("*").alias("n")))

    def only(side: str, other: str) -> DataFrame:
        return (table.filter(F.col(side) >= 0).groupBy(EV, side)
                .agg(F.count("*").alias("k"), F.min(other).alias(other), F.sum("n").alias("n")))

    clusters_a, clusters_b = only("a", "b"), only("b", "a")
    identical = (clusters_a.filter((F.col("k") == 1) & (F.col("b") >= 0)).select(EV, "a", "b", "n")
                 .join(clusters_b.filter((F.col("k") == 1) & (F.col("a") >= 0)).select(EV, "a", "b"), [EV, "a", "b"]))

    def part(df: DataFrame, **values: Column) -> DataFrame:
        return df.select(EV, *[values.get(c, F.lit(0)).cast("long").alias(c) for c in COUNTERS])

    a, b, n, one = F.col("a"), F.col("b"), F.col("n"), F.lit(1)
    parts = [
        part(table, n_lc=n, lc_agree=F.when((a < 0) & (b < 0), n).otherwise(0),
             outliers_a=F.when((a < 0) & (b >= 0), n).otherwise(0),
             outliers_b=F.when((b < 0) & (a >= 0), n).otherwise(0)),
        part(clusters_a, clusters_a=one), part(clusters_b, clusters_b=one),
        part(identical, identical_clusters=one, lc_agree=n)]
    if events is not None:
        parts.append(part(events))
    total = parts[0]
    for more in parts[1:]:
        total = total.unionByName(more)
    out = total.groupBy(EV).agg(*[F.sum(c).alias(c) for c in COUNTERS])
    return out.withColumn("lc_agree_frac", _share(F.col("lc_agree"), F.col("n_lc")))


def _share(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(float("nan")))


def aggregate(per_event: DataFrame) -> DataFrame:
    """One row over all compared events; no row if none was compared."""
    return (per_event.agg(*[F.sum(c).alias(c) for c in COUNTERS],
                          F.count_if(F.col("lc_agree") == F.col("n_lc")).alias("events_identical"),
                          F.count("*").alias("events"))
            .filter(F.col("events") > 0)
            .withColumn("lc_agree_frac", _share(F.col("lc_agree"), F.col("n_lc"))))


def collection_labels(lc: DataFrame, trackster_lc: DataFrame, collection: str) -> DataFrame:
    """A stored collection as one label per cell group (the last trackster holding it, -1 if none), for the events
    that have the collection."""
    rows = trackster_lc.filter(F.col("collection") == collection)
    held = rows.filter(F.col("lc").isNotNull()).groupBy(EV, F.col("lc").alias("idx")).agg(F.max("ts").alias("label"))
    return (lc.select(EV, F.col("lc").alias("idx"))
            .join(rows.select(EV).distinct(), EV, "left_semi")
            .join(held, [EV, "idx"], "left").select(EV, "idx", F.coalesce("label", F.lit(-1)).alias("label")))

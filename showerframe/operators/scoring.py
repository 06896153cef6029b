"""Objects against targets: shares, best targets and the 19 additive sums per (class, energy bin)."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showerframe.operators.ledger import KEY, target_struct
from showerframe.operators.objects import Objects
from showerframe.schema import SUM_KEYS
from showerframe.workspace import Workspace

COUNTED = ("n_targets", "n_targets_obj", "n_obj", "n_pu_obj", "n_noise_obj", "events")


def shares(objects: Objects, ledger: DataFrame, by: tuple = ()) -> DataFrame:
    """Energy every object shares with every target, and in rows with ``t`` NULL its whole energy and its floor.
    A stored zero makes a row."""
    return (objects.weights.join(ledger, [KEY, "member"]).groupBy(KEY, *by, "obj", "t")
            .agg(F.sum(F.col("w") * F.col("E")).alias("share"), F.sum(F.col("w") * F.col("floor")).alias("floor")))


def assign(share_rows: DataFrame, roster: DataFrame, by: tuple = ()) -> DataFrame:
    """Best target of every object: the largest share, then the larger target, then the lower index. Objects that
    touch no target keep a NULL ``t``."""
    t_type = share_rows.schema["t"].dataType
    zero = roster.select(KEY, *by, "obj", F.lit(None).cast(t_type).alias("t"), F.lit(0.0).alias("share"),
                         F.lit(0.0).alias("floor"))
    on_target = F.col("t").isNotNull()
    best = F.max(F.when(on_target, F.struct("share", F.col("t.energy").alias("energy"),
                                            (-F.col("t.target")).alias("neg"), "t")))
    return (share_rows.unionByName(zero).groupBy(KEY, *by, "obj")
            .agg(best.alias("b"),
                 F.sum(F.when(~on_target, F.col("share")).otherwise(0.0)).alias("E"),
                 F.sum(F.when(~on_target, F.col("floor")).otherwise(0.0)).alias("floor"),
                 F.sum(F.when(F.col("t.signal"), F.col("share")).otherwise(0.0)).alias("in_signal"))
            .select(KEY, *by, "obj", F.col("b.t").alias("t"), F.coalesce(F.col("b.share"), F.lit(0.0)).alias("own"), "E",
                    "floor", "in_signal"))


def best_targets(assigned: DataFrame) -> DataFrame:
    """(event_id, obj, best, own) with best -1 for unassigned objects."""
    return assigned.select(KEY, "obj", F.coalesce(F.col("t.target"), F.lit(-1)).alias("best"), "own")


def collected(share_rows: DataFrame, assigned: DataFrame, targets: DataFrame, by: tuple = ()) -> DataFrame:
    """Per target: energy in its own objects, number of them, energy in any object. Targets without objects stay.
    The three inputs meet in one aggregate on the target, which no hot target can skew."""
    def rows(df: DataFrame, c: Column, n: Column, in_any: Column) -> DataFrame:
        return df.select(KEY, *by, "t", c.cast("double").alias("c"), n.cast("long").alias("n"),
                         in_any.cast("double").alias("in_any"))

    zero = F.lit(0)
    return (rows(targets.select(KEY, *by, target_struct()), zero, zero, zero)
            .unionByName(rows(share_rows.filter(F.col("t").isNotNull()), zero, zero, F.col("share")))
            .unionByName(rows(assigned.filter(F.col("t").isNotNull()), F.col("own"), F.lit(1), zero))
            .groupBy(KEY, *by, "t").agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.sum("in_any").alias("in_any")))


@dataclass(frozen=True)
class Scored:
    """The relations one scoring derives; ``sums`` is what most callers want."""

    shares: DataFrame
    assigned: DataFrame
    collected: DataFrame
    events: DataFrame
    settings: tuple = ()  # names, if column ``setting`` tells several scorings apart

    def sums(self, by_event: bool = False) -> DataFrame:
        """The additive sums, dense over the 2 x 4 (cls, ebin) grid, per event or over all of them, and per setting."""
        by = ("setting",) if self.settings else ()
        keys = [*([KEY] if by_event else []), *by]
        parts = [object_sums(self.assigned, by), target_sums(self.collected, by), event_sums(self.events, by)]
        rows = [_all_keys(p, keys) for p in parts]
        one = _named(self.events.sparkSession.range(1), self.settings)
        grid = _all_keys(_grid(self.events.select(*keys) if by_event else one, keys), keys)
        return _total(rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(grid), keys)


def _named(df: DataFrame, settings: tuple) -> DataFrame:
    """Every row once per setting."""
    return df.withColumn("setting", F.explode(F.array(*[F.lit(n) for n in settings]))) if settings else df


def evaluate(ws: Workspace, objects: Objects, ledger: DataFrame, targets: DataFrame, events: DataFrame,
             settings: tuple = ()) -> Scored:
    """Scoring of objects, or, with the names of ``settings``, of objects whose column ``setting`` says which scoring they belong
    to: all of them in the jobs of one. Both consumers of the shares need different columns of them, so Catalyst would run the join for each; the shares
    are written once instead, and so are the assigned objects."""
    by = ("setting",) if settings else ()
    share_rows = ws.save(shares(objects, ledger, by), "shares")
    assigned = ws.save(assign(share_rows, objects.roster, by), "assigned")
    return Scored(share_rows, assigned, collected(share_rows, assigned, _named(targets, settings), by),
                  _named(events.select(KEY), settings), tuple(settings))


def object_sums(assigned: DataFrame, by: tuple = ()) -> DataFrame:
    """Sums over objects. An object counts in the class and bin of its best target; unassigned ones in (0, 0)."""
    signal, pileup = F.col("t.signal"), ~F.col("t.signal")
    unassigned = F.col("t").isNull()

    def when(cond: Column, value) -> Column:
        return F.when(cond, value).otherwise(0)

    one = F.lit(1)
    return assigned.select(
        KEY, *by, F.coalesce("t.cls", F.lit(0)).alias("cls"), F.coalesce("t.ebin", F.lit(0)).alias("ebin"),
        when(signal, F.col("E") - F.col("own")).alias("k_num"), when(signal, F.col("E")).alias("k_den"),
        when(signal, F.col("floor")).alias("k_floor"), when(signal, one).alias("n_obj"),
        when(pileup, F.col("in_signal")).alias("pu_sig"), when(pileup, F.col("E")).alias("pu_den"),
        when(pileup, one).alias("n_pu_obj"), when(unassigned, one).alias("n_noise_obj"))


def target_sums(per_target: DataFrame, by: tuple = ()) -> DataFrame:
    """Sums over targets. Energy lost to other objects counts every object, pileup ones included."""
    signal, pileup = F.col("t.signal"), ~F.col("t.signal")
    energy = F.col("t.energy")

    def when(cond: Column, value) -> Column:
        return F.when(cond, value).otherwise(0)

    return per_target.select(
        KEY, *by, F.col("t.cls").alias("cls"), F.col("t.ebin").alias("ebin"),
        when(signal, F.col("c")).alias("e_num"), when(signal, energy).alias("e_den"),
        when(signal, F.col("c")).alias("f_c"), when(signal, F.col("c") * F.col("n")).alias("f_cn"),
        when(signal, F.col("in_any") - F.col("c")).alias("lost_other"),
        when(signal, energy - F.col("in_any")).alias("lost_none"),
        when(signal, F.lit(1)).alias("n_targets"), when(signal & (F.col("n") > 0), F.lit(1)).alias("n_targets_obj"),
        when(pileup, F.col("c")).alias("pu_eps_num"), when(pileup, energy).alias("pu_eps_den"))


def event_sums(events: DataFrame, by: tuple = ()) -> DataFrame:
    return events.select(KEY, *by, F.lit(0).alias("cls"), F.lit(0).alias("ebin"), F.lit(1).alias("events"))


def combine(*sums: DataFrame, by: tuple = ()) -> DataFrame:
    """Total of sums of disjoint sets of events (jobs, batches, single events). Without ``by`` the grid is always dense."""
    first, *rest = (s.select(*by, "cls", "ebin", *SUM_KEYS) for s in sums)
    if not by:
        rest.append(no_sums(first.sparkSession))
    for other in rest:
        first = first.unionByName(other)
    return _total(first, list(by))


def no_sums(spark) -> DataFrame:
    """The sums of no event: a dense grid of zeros."""
    return _all_keys(_grid(spark.range(1), []), [])


def _grid(rows: DataFrame, keys: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("cls"), F.lit(b).alias("ebin")) for c in range(2) for b in range(4)])
    return rows.select(*keys, F.explode(cells).alias("g")).select(*keys, "g.cls", "g.ebin")


def _all_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    have = set(df.columns)
    return df.select(*keys, "cls", "ebin", *[
        (F.col(k) if k in have else F.lit(0)).cast("long" if k in COUNTED else "double").alias(k) for k in SUM_KEYS])


def _total(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "cls", "ebin").agg(*[F.sum(k).alias(k) for k in SUM_KEYS])

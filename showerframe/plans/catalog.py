"""Named queries: every operator over the samples that ``sources.derived`` makes of whole warehouse tables.

Most scoring queries use one target per interaction, given without the merging test, so that each query shows its own
operator; the queries of the merging and of the full plans use real targets."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showerframe.functions.scalars import share_weight
from showerframe.operators import closure, density, ledger, merging, objects, scoring, summary, targets
from showerframe.operators.chains import components
from showerframe.operators.neighbours import pairs
from showerframe.operators.partials import PartialSums
from showerframe.operators.points import coordinates, points
from showerframe.params import DEFAULT
from showerframe.plans import closure as closure_plan
from showerframe.plans.score import Truth, score
from showerframe.plans.truth import truth_summary
from showerframe.schema import DEFAULT_FRAC, SUM_KEYS
from showerframe.session import tune
from showerframe.sources import derived, files, settings
from showerframe.workspace import Workspace

EV = "event_id"
TWO = [{"name": "default"}, {"name": "wide", "dc": 1.5, "outlierDistance": 4.0, "seedingDistance": 3.5}]


class Context:
    """Lazily derived inputs of one query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir
        self.ws = Workspace(spark)

    @cached_property
    def tables(self):
        return derived.sample(self.spark, self.sf_dir)

    @cached_property
    def points_only(self) -> derived.Sample:
        """Tables of a plan that needs cells and cell groups but no truth."""
        return derived.Sample(self.spark, self.sf_dir, self.ws.save)

    @cached_property
    def stored(self) -> derived.Sample:
        return derived.Sample(self.spark, self.sf_dir, self.ws.save, truth=True)

    @cached_property
    def merged(self) -> targets.Targets:
        return targets.build(self.ws, self.stored, pieces=False)

    @cached_property
    def interactions(self) -> targets.Targets:
        """One target per interaction, named by its smallest unit number."""
        unit = F.col("unit")
        first = F.when(unit % 5 == 4, unit).otherwise(F.col("evt") * 5)
        tables = self.stored
        return targets.given(self.ws, tables, tables.un.select(EV, "unit", first.alias("target")))

    @cached_property
    def truth(self) -> Truth:
        given = self.interactions
        return Truth(self.ws, self.stored, built=replace(given, targets=self.ws.save(given.targets, "targets")))

    @cached_property
    def cell_objects(self) -> objects.Objects:
        return objects.from_labels(self.ws.save(derived.cell_labels(self.stored.rh), "labels"), "rh")

    @cached_property
    def group_objects(self) -> objects.Objects:
        return objects.from_labels(self.ws.save(derived.group_labels(self.stored.lc), "labels"), "lc")

    @cached_property
    def scored(self) -> scoring.Scored:
        """The cell labels under test, scored."""
        return self.truth.evaluate(self.cell_objects)

    @cached_property
    def unit_state(self) -> DataFrame:
        """Cells of units as the merging starts from: event_id, rh, obj, grp, E."""
        un = self.tables.un.select(EV, "unit", F.struct("bx", "evt").alias("grp"))
        cells = self.tables.tra.join(self.tables.atom.select(EV, "atom", "unit").join(un, [EV, "unit"]), [EV, "atom"])
        return cells.groupBy(EV, "rh", F.col("unit").alias("obj"), "grp").agg(F.sum("E").alias("E"))

    @cached_property
    def unit_owners(self) -> DataFrame:
        return merging.owners(self.unit_state, ["rh"])

    @cached_property
    def unit_quality(self) -> DataFrame:
        bases = self.tables.un.select(EV, F.col("unit").alias("base"), F.struct("bx", "evt").alias("grp"),
                                      F.lit(None).cast("long").alias("pref"))
        return merging.quality(merging.start_members(self.unit_state, bases), self.unit_owners, DEFAULT_FRAC)

    @cached_property
    def cloud(self) -> DataFrame:
        return self.ws.save(coordinates(derived.embedding_points(self.spark, self.sf_dir), DEFAULT), "cloud")

    @cached_property
    def cloud_density(self) -> DataFrame:
        return self.ws.save(density.densities(self.ws, self.cloud, DEFAULT), "cloud_density")

    @cached_property
    def cloud_links(self) -> DataFrame:
        return density.nearest_higher(self.ws, self.cloud_density, DEFAULT)

    def edges(self) -> DataFrame:
        """Failing unit -> partner of the first round."""
        failing = self.unit_quality.filter("fail")
        return (merging.best_partner(self.unit_state, self.unit_owners, failing, ["rh"])
                .select(EV, "obj", F.col("partner").alias("next")))


QUERIES: dict[str, Callable[[Context], DataFrame]] = {}


def query(fn: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


# Sources


@query
def scan_truth_cells(c):
    return c.tables.tra


@query
def trackster_select(c):
    return c.tables.trackster_lc.filter(F.col("collection").isin(derived.WIDE, "absent")).select(
        EV, "collection", "ts", "lc", "weight")


@query
def event_slice(c):
    some = files.take_events(c.tables, 12, 5)
    return some.rh.groupBy(EV).agg(F.count("*").alias("n_cells"), F.sum("E").alias("E"))


@query
def event_counts(c):
    t = c.tables
    parts = [df.select(EV, F.lit(name).alias("what")) for name, df in (("lc", t.lc), ("rh", t.rh), ("unit", t.un))]
    parts.append(t.trackster_lc.select(EV, "collection", "ts").distinct().select(EV, F.col("collection").alias("what")))
    return reduce(DataFrame.unionByName, parts).groupBy(EV, "what").agg(F.count("*").alias("n"))


@query
def event_union(c):
    """One stored sample read twice as two: equal ids stay apart, and every deposit meets the atoms of its own event."""
    folder = f"{c.ws.path}/stored"
    files.write_tables(c.tables, folder)
    both = files.read_tables(c.spark, folder, folder)
    met = both.tra.join(both.atom.select(EV, "atom", "unit"), [EV, "atom"])
    return met.groupBy(EV).agg(F.count("*").alias("n"), F.sum("E").alias("E")).join(both.event, EV).select(
        EV, "file_ordinal", "n", "E")


@query
def trackster_offsets(c):
    return files.offsets(c.tables.trackster_lc)


@query
def trackster_owner(c):
    return files.owner_rows(c.tables.trackster_lc)


@query
def trackster_weights(c):
    held = c.tables.trackster_lc.filter(F.col("lc").isNotNull()).groupBy(EV, "collection", "lc").agg(
        F.count("*").alias("holders"))
    return held.select(EV, "collection", "lc", share_weight(F.col("holders") - 1).alias("weight"))


@query
def trackster_events(c):
    some = c.tables.trackster_lc.filter(F.col("collection") == derived.WIDE).select(EV)
    return c.tables.event.select(EV).join(some, EV, "left_semi")


@query
def trackster_labels(c):
    t = c.tables
    return closure.collection_labels(t.lc, t.trackster_lc, derived.WIDE)


# Points


def _points(c, level):
    return points(c.tables, level).select(EV, "idx", "E", "x", "y", "z", "layer", "side", "det", "tag", "active")


@query
def points_lc(c):
    return _points(c, "lc")


@query
def points_lc_all(c):
    return _points(c, "lc_all")


@query
def points_rh(c):
    return _points(c, "rh")


# Truth relations


@query
def unit_cells(c):
    return targets.unit_cells(c.tables.tra, c.tables.atom)


@query
def unit_energy(c):
    return c.interactions.unit_target.select(EV, "unit", F.col("E_unit").alias("E"))


@query
def target_cells(c):
    return c.interactions.target_cell


@query
def target_energy(c):
    return c.interactions.targets.select(EV, "target", "E")


@query
def target_units(c):
    return c.interactions.targets.select(EV, "target", "n_units")


@query
def target_signal(c):
    return c.interactions.targets.select(EV, "target", "signal")


@query
def target_class(c):
    return c.interactions.targets.select(EV, "target", "em")


@query
def target_lead_unit(c):
    return c.interactions.targets.select(EV, "target", "lead_unit")


@query
def atom_target(c):
    return targets.atom_targets(c.tables.atom, c.interactions.unit_target).select(EV, "atom", "target")


@query
def atom_parent_pruned(c):
    """Every third unit leaves its interaction, and parents are shifted by one unit, so that some get pruned."""
    moved = c.interactions.unit_target.withColumn(
        "target", F.when(F.col("unit") % 3 == 0, F.col("unit")).otherwise(F.col("target")))
    atoms = c.tables.atom.withColumn("parent", F.when(F.col("parent") >= 0, F.col("parent")).otherwise(
        F.col("atom") - 3))
    return targets.atom_targets(atoms, moved)


@query
def confusion_matrix(c):
    return merging.confusion(c.unit_state, c.unit_owners, ["rh"], F.lit(True))


@query
def confusion_symmetric(c):
    k = merging.confusion(c.unit_state, c.unit_owners, ["rh"], F.lit(True))
    both = k.unionByName(k.select(EV, F.col("dom").alias("obj"), F.col("obj").alias("dom"), "v"))
    return both.groupBy(EV, "dom", "obj").agg(F.sum("v").alias("v"))


@query
def ideal_quality(c):
    return c.unit_quality.select(EV, F.col("obj").alias("unit"), "E", "completeness", "purity")


@query
def dominant_target(c):
    return c.unit_owners.select(EV, "rh", "dom", F.col("top").alias("E"))


@query
def cell_floor(c):
    totals = ledger.cell_totals(c.tables.rh, c.interactions.target_cell)
    return totals.select(EV, "rh", "E", "top", (F.col("E") - F.col("top")).alias("floor"))


@query
def merge_round0_fail(c):
    return c.unit_quality.filter("fail").select(EV, F.col("obj").alias("unit"))


@query
def merge_round0_partner(c):
    return c.edges().withColumnsRenamed({"obj": "unit", "next": "partner"})


@query
def merge_components(c):
    return components(c.ws, c.ws.save(c.edges(), "edges"))


@query
def merged_targets(c):
    return c.merged.targets.select(EV, "target", "E", "signal", "em", "unreachable", "n_units", "completeness", "purity")


@query
def merged_units(c):
    return c.merged.unit_target.select(EV, "unit", "target", "merged_at", "partner")


@query
def merge_rounds(c):
    return c.merged.rounds.select(EV, F.col("n_iterations").cast("long").alias("n_iterations"))


@query
def natural_pieces(c):
    return targets.natural_pieces(c.ws, c.stored, c.merged.unit_target)


@query
def truth_totals(c):
    return truth_summary(c.stored, targets.build(c.ws, c.stored))


def _ideal(c, level):
    return Truth(c.ws, c.stored, built=c.merged).ideal_labels(level)


@query
def ideal_labels_rh(c):
    return _ideal(c, "rh")


@query
def ideal_labels_lc(c):
    return _ideal(c, "lc")


# Objects and their scores


@query
def objects_rh(c):
    labels = c.ws.save(derived.cell_labels(c.points_only.rh), "labels")
    return objects.renumbered(objects.from_labels(labels, "rh")).weights.select(EV, "obj", F.col("member").alias("rh"))


@query
def objects_lc(c):
    labels = c.ws.save(derived.group_labels(c.points_only.lc), "labels")
    return objects.to_cells(objects.from_labels(labels, "lc"), c.points_only.lch)


@query
def objects_tracksters(c):
    return objects.to_cells(objects.from_tracksters(c.tables.trackster_lc, derived.MAIN), c.tables.lch)


@query
def lc_truth(c):
    held = c.truth.ledger("lc").filter(F.col("t").isNotNull())
    return held.select(EV, F.col("member").alias("lc"), "t.target", "E")


@query
def shares(c):
    return c.scored.shares.filter(F.col("t").isNotNull()).select(EV, "obj", "t.target", "share")


@query
def assign_best(c):
    return scoring.best_targets(c.scored.assigned)


@query
def object_energy(c):
    return c.scored.assigned.select(EV, "obj", "E")


@query
def object_floor(c):
    return c.scored.assigned.select(EV, "obj", "floor")


@query
def object_signal_energy(c):
    return c.scored.assigned.select(EV, "obj", "in_signal")


@query
def eval_objects(c):
    """Objects of the cell groups, each with its best target's flags."""
    assigned = c.truth.evaluate(c.group_objects).assigned
    return assigned.filter(F.col("t").isNotNull()).select(
        EV, "obj", F.col("t.target").alias("best"), "own", "E", "t.signal", "t.cls", "t.ebin")


@query
def noise_objects(c):
    """Objects of the stored collection without a target, the empty trackster included."""
    return c.truth.score_collection(derived.MAIN).assigned.filter(F.col("t").isNull()).select(EV, "obj")


@query
def target_collected(c):
    return c.scored.collected.select(EV, "t.target", "c", "n")


@query
def target_in_any(c):
    return c.scored.collected.select(EV, "t.target", "in_any")


def _sums(c, *keys):
    return c.scored.sums().select("cls", "ebin", *keys)


@query
def sums_signal_objects(c):
    return _sums(c, "k_num", "k_den", "k_floor", "n_obj")


@query
def sums_pileup_objects(c):
    return _sums(c, "pu_sig", "pu_den", "n_pu_obj")


@query
def sums_signal_targets(c):
    return _sums(c, "e_num", "e_den", "f_c", "f_cn", "lost_other", "lost_none", "n_targets", "n_targets_obj")


@query
def sums_pileup_targets(c):
    return _sums(c, "pu_eps_num", "pu_eps_den")


@query
def sums_counters(c):
    return c.scored.sums().filter("cls = 0 AND ebin = 0").select("n_noise_obj", "events")


@query
def evaluate_sums(c):
    return c.scored.sums(by_event=True).select(EV, "cls", "ebin", *SUM_KEYS)


@query
def combine_sums(c):
    """Sums of two jobs, each over its own events, combined."""
    sums = c.ws.save(c.scored.sums(by_event=True), "sums")
    even = F.col(EV) % 2 == 0
    return scoring.combine(scoring.combine(sums.filter(even)), scoring.combine(sums.filter(~even))).select(
        "cls", "ebin", *SUM_KEYS)


@query
def stored_sums(c):
    """The same total from stored sums of three samples, the first of them added twice."""
    sums = c.ws.save(c.scored.sums(by_event=True), "sums")
    kept = PartialSums(c.spark, f"{c.ws.path}/partials")
    for k in (0, 1, 2, 0):
        kept.add(f"sample {k}", "1", lambda k=k: scoring.combine(sums.filter(F.col(EV) % 3 == k)))
    return kept.total()


@query
def summary_metrics(c):
    return summary.summary(c.scored.sums())


@query
def mean_over_samples(c):
    sums = c.scored.sums(by_event=True).withColumn("sample", F.col(EV) % 3)
    return summary.mean_over_samples(summary.summary(sums, by=("sample",)))


def _three_runs(c, truth):
    runs = {"cells": truth.evaluate(c.cell_objects), "groups": truth.evaluate(c.group_objects),
            "stored": truth.score_collection(derived.MAIN)}
    sums = reduce(DataFrame.unionByName, [r.sums().withColumn("setting", F.lit(n)) for n, r in runs.items()])
    return summary.summary(sums, by=("setting",))


@query
def summary_pivot(c):
    return settings.pivot(_three_runs(c, c.truth), ["cells", "groups", "stored"])


@query
def summary_merged(c):
    """The same three clusterings against merged targets."""
    return _three_runs(c, Truth(c.ws, c.stored, built=c.merged))


# Density clustering


@query
def point_coordinates(c):
    return c.cloud.select(EV, "side", "idx", F.col("X").alias("gx"), F.col("Y").alias("gy"), F.col("Z").alias("gz"),
                          "rel", "r")


@query
def neighbour_pairs(c):
    return pairs(c.ws, c.cloud, DEFAULT)


@query
def density_points(c):
    return c.cloud_density.select(EV, "side", "idx", "rho", "dense")


@query
def nearest_higher(c):
    return c.cloud_links.select(EV, "side", "idx", "parent")


@query
def chain_root(c):
    return density.seeds_and_roots(c.ws, c.cloud_links)[1]


@query
def cluster_labels(c):
    return density.cluster(c.ws, derived.embedding_points(c.spark, c.sf_dir), drop_small=False)


@query
def cluster_labels_double(c):
    """The same in double precision."""
    return density.cluster(c.ws, derived.embedding_points(c.spark, c.sf_dir), DEFAULT.with_(f32=False))


@query
def cluster_labels_final(c):
    return density.cluster(c.ws, derived.embedding_points(c.spark, c.sf_dir))


@query
def cluster_labels_lc(c):
    return density.cluster(c.ws, points(c.points_only, "lc"))


@query
def cluster_labels_lc_all(c):
    return density.cluster(c.ws, points(c.points_only, "lc_all"))


@query
def cluster_labels_rh(c):
    return density.cluster(c.ws, points(c.points_only, "rh"))


# Partitions


@query
def canonical_labels(c):
    return closure.canonical(c.ws, derived.group_labels(c.tables.lc))


def _compared(c):
    stored = c.tables.assign.select(EV, F.col("lc").alias("idx"), "label")
    seen = points(c.tables, "lc_all").filter("active")
    return closure.compare(closure.both_labels(derived.group_labels(c.tables.lc), stored, seen))


@query
def partition_compare(c):
    return _compared(c)


@query
def closure_agg(c):
    return closure.aggregate(_compared(c))


@query
def closure_raw(c):
    return closure_plan.run(c.ws, c.points_only).raw


@query
def closure_final(c):
    return closure_plan.run(c.ws, c.points_only, collection=derived.WIDE).final


@query
def absent_collection(c):
    """All metrics of a collection that no event stores."""
    scored = Truth(c.ws, c.stored, built=c.merged).score_collection("absent")
    return summary.summary(scored.sums())


@query
def score_many_settings(c):
    """Eight settings of a tuning round and both ideal references, in the jobs of one setting."""
    many = [{"dc": 0.8}, {"dc": 1.5}, {"rhoc": 1.2}, {"outlierDistance": 2.0}, {"seedingDistance": 2.2, "outlierDistance": 3.2},
            {"minNumLayerCluster": 3}]
    listed = TWO + [{"name": f"many{k}", **changes} for k, changes in enumerate(many)]
    return score(c.ws, c.stored, listed, "lc", truth=Truth(c.ws, c.stored, built=c.merged))


@query
def score_settings(c):
    """Two settings, both ideal references and the stored collection against merged targets."""
    listed = TWO
    return score(c.ws, c.stored, listed, "lc", derived.MAIN, Truth(c.ws, c.stored, built=c.merged))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, fn=fn: fn(Context(spark, sf_dir))) for name, fn in QUERIES.items()}

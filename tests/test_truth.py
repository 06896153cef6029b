"""Targets of small events, one situation each, and what must hold on a whole derived sample."""
import pytest
from conftest import Sample, by_event
from pyspark.sql import functions as F

from showerframe.operators import merging, targets
from showerframe.plans.score import Truth
from showerframe.plans.truth import truth_summary
from showerframe.session import keyed
from showerframe.sources import derived

SWALLOWED = {0: {0: 6.0, 1: 5.0}, 1: {1: 1.25}}


@pytest.fixture(scope="module")
def sample():
    s = Sample()
    s.event("apart", {0: {0: 7.0}, 1: {1: 2.0, 2: 2.0}})
    s.event("swallowed", SWALLOWED)
    s.event("signal_in_pileup", SWALLOWED, source={0: 3})
    s.event("one_collision", SWALLOWED, source={0: 3, 1: 3})
    s.event("two_collisions", SWALLOWED, source={0: 3, 1: 4})
    s.event("two_bunches", SWALLOWED, source={0: (-2, 3), 1: (1, 3)})
    s.event("leaning", {0: {0: 3.0, 1: 1.0}, 1: {0: 1.0, 1: 2.0}})
    s.event("heap", {0: {0: 1.5}, 1: {0: 1.25}, 2: {0: 1.0}, 3: {0: 0.25}})
    s.event("uncovered", {0: {0: 0.5, 1: 1.5, 2: 3.0}}, groups={0: {0: 1.0, 1: 1.0}})
    s.event("kinds", {u: {u: 2.0} for u in range(6)},
            kind={0: (111, 0), 1: (11, 0), 2: (2212, 0), 3: (211, 1), 4: (-22, 0), 5: (-211, 0)})
    s.event("hadron_leads", SWALLOWED, kind={1: (22, 0)})
    s.event("photon_leads", SWALLOWED, kind={0: (22, 0)})
    s.event("siblings", {0: {0: 2.0}, 1: {1: 5.0}}, unit={1: 0}, parent={1: 0})
    s.event("shadowed", {0: {0: 4.0, 1: 4.0}, 1: {1: 1.0}}, unit={1: 0}, parent={1: 0})
    s.event("under_pileup", {0: {0: 2.0}, 1: {1: 5.0}, 2: {0: 9.0, 1: 9.0}}, unit={1: 0, 2: 1}, parent={1: 0}, source={1: 5})
    s.event("ideal", {0: {0: 5.0, 1: 0.5}, 1: {1: 2.0}}, groups={0: {0: 1.0, 1: 1.0}})
    s.event("no_energy", {0: {0: 1.0}}, unit={0: 0}, source={0: "signal", 1: "signal"})
    # Unit 0 is hidden under others and flagged. Units 1 and 2 merge, then own cell 1 together, fail there and join
    # unit 0, and the three pass.
    s.event("flag_lost", {0: {0: 1.0, 1: 0.5}, 1: {1: 1.0, 2: 0.6}, 2: {1: 1.0, 2: 0.5}, 3: {1: 1.5}, 4: {0: 9.0}, 5: {1: 1.9}},
            source={u: v for u, v in enumerate([(0, 7), (0, 7), (0, 7), (0, 8), (0, 9), (0, 10)])})
    s.event("cycle_of_parents", {a: {0: 1.0} for a in range(3)}, unit={a: 0 for a in range(3)}, parent={0: 1, 1: 2, 2: 0})
    s.event("no_units", dark={0: 1.0})
    return s


@pytest.fixture(scope="module")
def built(spark, ws, sample):
    tables = sample.tables(spark, ws)
    b = targets.build(ws, tables)
    return dict(tables=tables, built=b, t=by_event(b.targets, "target"), u=by_event(b.unit_target, "unit"),
                rounds={r["event_id"]: r["n_iterations"] for r in b.rounds.collect()})


@pytest.fixture
def column(built, sample):
    """Values of one column of the targets of an event."""
    return lambda name, key: [r[key] for r in built["t"].get(sample.ids[name], [])]


@pytest.mark.parametrize("name,energies", [
    ("apart", [7, 4]), ("swallowed", [12.25]), ("signal_in_pileup", [11, 1.25]), ("one_collision", [12.25]),
    ("two_collisions", [11, 1.25]), ("two_bunches", [11, 1.25]), ("leaning", [4, 3]), ("heap", [4]), ("uncovered", [5]),
    ("siblings", [7]), ("no_energy", [1, 0]), ("no_units", [])])
def test_energies_of_targets(column, name, energies):
    assert column(name, "E") == pytest.approx(energies)


@pytest.mark.parametrize("name,flags", [
    ("apart", [False, False]), ("signal_in_pileup", [False, True]), ("two_collisions", [False, True]), ("no_energy", [False, True])])
def test_targets_that_fail_alone_are_flagged(column, name, flags):
    assert column(name, "unreachable") == flags


def test_quality_of_targets_that_lean_on_each_other(column):
    assert column("leaning", "completeness") == pytest.approx([3 / 4, 2 / 3])
    assert column("leaning", "purity") == pytest.approx([3 / 4, 2 / 3])


def test_merged_units_name_round_and_partner(built, sample):
    units = built["u"][sample.ids["swallowed"]]
    assert [(r["merged_at"], r["partner"]) for r in units] == [(-1, -1), (0, 0)]
    assert built["rounds"][sample.ids["apart"]] == 0 and built["t"][sample.ids["swallowed"]][0]["n_units"] == 2


@pytest.mark.parametrize("name,em", [("kinds", [True, True, False, True, True, False]), ("hadron_leads", [False]), ("photon_leads", [True])])
def test_class_of_the_hardest_unit(column, name, em):
    assert column(name, "em") == em


@pytest.mark.parametrize("name,pieces", [
    ("siblings", [2]), ("shadowed", [1]), ("under_pileup", [2, 1]), ("cycle_of_parents", [1]), ("no_energy", [1, 0])])
def test_natural_pieces(column, name, pieces):
    assert column(name, "n_pieces") == pieces


def test_flag_is_lost_when_another_object_joins(built, sample):
    ev = sample.ids["flag_lost"]
    assert [(r["target"], r["n_units"], r["unreachable"]) for r in built["t"][ev]] == [
        (0, 3, False), (3, 1, True), (4, 1, False), (5, 1, True)]
    assert built["rounds"][ev] == 2
    assert [r["merged_at"] for r in built["u"][ev]] == [-1, 0, 0, -1, -1, -1]


def test_ideal_labels_at_both_levels(built, sample, ws):
    truth, ev = Truth(ws, built["tables"], built=built["built"]), sample.ids["ideal"]
    assert [r["label"] for r in by_event(truth.ideal_labels("rh"), "idx")[ev]] == [0, 1]
    assert [r["label"] for r in by_event(truth.ideal_labels("lc"), "idx")[ev]] == [0]


def test_truth_summary_adds_up(built, sample):
    row = truth_summary(built["tables"], built["built"]).first()
    n = len(sample.ids)
    assert row["events"] == n
    assert row["targets"] * n == sum(len(v) for v in built["t"].values())
    assert row["units"] * n == sum(len(v) for v in built["u"].values())
    assert row["iterations"] * n == pytest.approx(sum(built["rounds"].values()))
    assert 0 < row["Phi_nat_signal"] < 1


def test_energy_is_conserved(spark, ws):
    """On a whole sample, targets and energy without truth make up every cell."""
    tables = derived.sample(spark, "/root/testdata/sf0.001")
    built = targets.build(ws, tables, pieces=False)
    cells = built.target_cell.groupBy("event_id", "rh").agg(F.sum("E").alias("truth"))
    off = (tables.rh.join(cells, ["event_id", "rh"], "left")
           .filter(F.abs(F.coalesce("truth", F.lit(0.0)) + F.col("noTruthE") - F.col("E")) > 1e-6 + 1e-4 * F.col("E")))
    assert off.count() == 0
    total = tables.rh.agg(F.sum("E"), F.sum("noTruthE")).first()
    assert built.targets.agg(F.sum("E")).first()[0] + total[1] == pytest.approx(total[0], rel=1e-9)


@pytest.mark.parametrize("heavy", [0, 2])
def test_large_events_take_the_other_loop_to_the_same_end(spark, ws, sample, built, monkeypatch, heavy):
    """With a bound of 0 every event is dealt out by cell and object, with 2 only those of three cell rows or more."""
    monkeypatch.setattr(merging, "HEAVY", heavy)
    other = targets.build(ws, built["tables"])
    for name in ("targets", "unit_target", "target_cell", "rounds"):
        one, two = (sorted((tuple(r) for r in getattr(b, name).select(sorted(getattr(b, name).columns)).collect()), key=repr)
                    for b in (built["built"], other))
        assert [[pytest.approx(v) if isinstance(v, float) else v for v in r] for r in one] == [list(r) for r in two]


def test_long_chains_of_links_are_doubled_again(spark, ws):
    """Twenty objects, each of which joins the next: more than one step of pointer doubling, and one name at the end."""
    n = 20
    rows = [(0, k, k + 1, True, True, k) for k in range(n - 1)] + [(0, n - 1, None, False, True, n - 1)]
    objects = spark.createDataFrame(rows, "event_id long, obj long, next long, fail boolean, live boolean, head long")
    with keyed(spark):
        bucketed, _ = ws.save_by(objects, "objects", "event_id", 4)
        moves = {r["obj"]: r for r in merging._all_moves(ws, bucketed, 4).collect()}
    assert {r["comp"] for r in moves.values()} == {0} and len(moves) == n and all(r["merged"] for r in moves.values())
    assert [moves[k]["next_head"] for k in range(n)] == [*range(1, n), None]


def test_what_a_round_says_is_added_up_by_hash(spark, ws):
    """the rows of a round, one or two for each cell and object, are not sorted by object to add them up."""
    sample = derived.sample(spark, "/root/testdata/sf0.001")
    cells = targets.unit_cells(sample.tra, sample.atom).withColumnRenamed("unit", "obj").join(
        sample.un.select("event_id", F.col("unit").alias("obj"), F.struct("bx", "evt").alias("grp")), ["event_id", "obj"])
    bases = sample.un.select("event_id", F.col("unit").alias("base"), F.struct("bx", "evt").alias("grp"), F.lit(None).cast("long").alias("pref"))
    rows = ws.save(merging._rows(cells, merging.start_members(cells, bases), ["rh"], F.lit(True).alias("live")), "rows")
    found = merging.judged(rows, ["rh"], 0.5, False)
    plan = found._jdf.queryExecution().executedPlan().toString()
    by_pair = [line.split("(keys=")[0].split()[-1] for line in plan.splitlines() if "(keys=[event_id#" in line and " t#" in line.split("functions")[0]]
    assert by_pair and set(by_pair) == {"HashAggregate"}
    plain = merging.quality(merging.start_members(cells, bases), merging.owners(cells, ["rh"]), 0.5)
    columns = ["event_id", "obj", "grp", "flag", "E", "head", "completeness", "purity", "fail"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))

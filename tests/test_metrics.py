"""Metrics against a direct evaluation of their definitions on random events, and values that follow by hand."""
import collections
import math

import numpy as np
import pytest
from conftest import Sample, by_event
from pyspark.sql import functions as F

from showerframe.functions.ranking import ordinals
from showerframe.operators import objects, scoring, summary
from showerframe.plans.score import Truth
from showerframe.schema import SUM_KEYS
from showerframe.sources import derived

LABELS = "event_id long, idx long, label long"


def shower_event(rng):
    """Showers as falling energies along a row of cells, with noise; most units are signal, some belong to pileup."""
    showers, source, kind = {}, {}, {}
    for u in range(int(rng.integers(2, 6))):
        start, length = int(rng.integers(0, 24)), int(rng.integers(1, 9))
        showers[u] = {start + k: float(rng.uniform(1, 8) * 0.7 ** k) for k in range(length)}
        source[u] = "signal" if rng.random() < 0.65 else int(rng.integers(1, 4))
        kind[u] = (22, 0) if rng.random() < 0.4 else (2212, 0)
    return showers, source, kind, {int(c): float(rng.uniform(0, 0.4)) for c in rng.integers(0, 34, 9)}


@pytest.fixture(scope="module")
def sample():
    s, s.labels, rng = Sample(), {"rh": [], "lc": []}, np.random.default_rng(20)

    def case(name, labels, *args, level="rh", **kw):
        number = s.event(name, *args, **kw)
        s.labels[level] += [(number, i, int(v)) for i, v in enumerate(labels)]

    for k in range(20):
        showers, source, kind, dark = shower_event(rng)
        n = 1 + max(c for left in [*showers.values(), dark] for c in left)
        case(f"random{k}", rng.integers(-1, 7, n), showers, source=source, kind=kind, dark=dark)
    pair = {0: {0: 6.0, 1: 2.0}, 1: {2: 3.0, 3: 1.0}}
    case("exact", [4, 4, 9, 9], pair)
    case("cut_once", [4, 5, 9, 9], pair)
    case("glued", [1, 1, 1, 1], pair)
    case("nothing", [-1, -1, -1, -1], pair)
    case("dim", [0, 0], {0: {0: 1.5}}, dark={1: 0.5})
    case("tie_goes_to_the_larger", [0, -1], {0: {0: 2.0}, 1: {0: 2.0, 1: 1.0}}, source={1: 6})
    case("tie_goes_to_the_first", [3], {0: {0: 2.0}, 1: {0: 2.0}}, source={0: 6, 1: 8})
    case("edges", [0, 1, 2, 3], {0: {0: 5.0}, 1: {1: 30.0}, 2: {2: 150.0}, 3: {3: 4.75}})
    halves = {0: {0: 1.0, 1: 0.5}, 1: {1: 0.5, 2: 1.0}}
    split = {0: {0: 4.0, 1: 3.0}, 1: {1: 1.0, 2: 6.0}}
    case("halves", [0, 1], split, groups=halves, level="lc")
    s.event("stored", split, groups={0: {0: 1.0}, 1: {1: 1.0}, 2: {2: 1.0}})
    s.collection("stored", "col", [{0: 1.0, 1: 0.5}, {1: 0.5, 2: 1.0}, {}])
    number = s.event("bare_group", {0: {0: 3.0}}, groups={0: {0: 1.0}, 1: {}})
    s.labels["lc"] += [(number, 0, 0), (number, 1, 1)]
    return s


@pytest.fixture(scope="module")
def run(spark, ws, sample):
    tables = sample.tables(spark, ws)
    truth = Truth(ws, tables)
    scored = {}
    for level, rows in sample.labels.items():
        labels = ws.save(spark.createDataFrame(rows, LABELS), "labels")
        events = labels.select("event_id").distinct()
        found = truth.targets.targets.join(events, "event_id", "left_semi")
        scored[level] = scoring.evaluate(ws, objects.from_labels(labels, level), truth.ledger(level), found, events)
    sums = ws.save(scored["rh"].sums(True).unionByName(scored["lc"].sums(True)), "sums")
    return dict(sums=sums, wide={r["event_id"]: r for r in summary.wide(sums, by=("event_id",)).collect()}, truth=truth,
                tables=tables, best=by_event(scoring.best_targets(scored["rh"].assigned), "obj"))


def by_definition(rows_t, cell_truth, cell_energy, labels):
    """eps, K and Phi of the signal, purity of pileup objects and counts of one event, straight from the definitions."""
    target = {r["target"]: r for r in rows_t}
    energy, share = collections.Counter(), collections.defaultdict(collections.Counter)
    for c, o in enumerate(labels):
        if o >= 0:
            energy[o] += cell_energy.get(c, 0.0)
            for t, e in cell_truth.get(c, {}).items():
                share[o][t] += e
    best = {o: max(share[o], key=lambda t: (share[o][t], target[t]["E"], -t)) if share[o] else None for o in set(labels) - {-1}}
    out = {}
    for m, empty in (("eps", 0.0), ("K", 1.0), ("Phi", 0.0)):
        halves = []
        for em in (True, False):
            ts = [t for t, r in target.items() if r["signal"] and r["em"] == em]
            own = {t: [o for o, b in best.items() if b == t] for t in ts}
            got = {t: sum(share[o][t] for o in own[t]) for t in ts}
            num, den = {"eps": (sum(got.values()), sum(target[t]["E"] for t in ts)),
                        "K": (sum(energy[o] - share[o][t] for t in ts for o in own[t]), sum(energy[o] for t in ts for o in own[t])),
                        "Phi": (sum(got.values()), sum(got[t] * len(own[t]) for t in ts))}[m]
            if den > 0:
                halves.append(1 - num / den if m == "Phi" else num / den)
        out[f"{m}_sig"] = sum(halves) / len(halves) if halves else empty
    pile = [o for o, b in best.items() if b is not None and not target[b]["signal"]]
    inside = sum(e for o in pile for t, e in share[o].items() if target[t]["signal"])
    total = sum(energy[o] for o in pile)
    out["K_pu"] = inside / total if total > 0 else math.nan
    out["noise_objects_per_event"] = sum(b is None for b in best.values())
    out["pileup_objects_per_event"] = len(pile)
    return out


def test_random_events_follow_the_definitions(run, sample):
    truth, tables = run["truth"].targets, run["tables"]
    found, parts = by_event(truth.targets, "target"), by_event(truth.target_cell, "rh")
    cells = by_event(tables.rh, "rh")
    for k in range(20):
        ev = sample.ids[f"random{k}"]
        shared = collections.defaultdict(dict)
        for r in parts[ev]:
            shared[r["rh"]][r["target"]] = r["E"]
        labels = [v for e, _, v in sorted(sample.labels["rh"]) if e == ev]
        want = by_definition(found[ev], shared, {r["rh"]: r["E"] for r in cells[ev]}, labels)
        got = run["wide"][ev]
        for m, v in want.items():
            assert got[m] == pytest.approx(v, abs=1e-9, nan_ok=True), (k, m)


@pytest.mark.parametrize("name,eps,k,phi", [
    ("exact", 1, 0, 0), ("cut_once", 1, 0, 1 - 12 / 20), ("glued", 8 / 12, 4 / 12, 0), ("nothing", 0, 1, 0), ("dim", 1, 0.25, 0),
    ("halves", (5.5 + 6.5) / 14, 2 / 14, 0)])
def test_values_by_hand(run, sample, name, eps, k, phi):
    row = run["wide"][sample.ids[name]]
    assert (row["eps_sig"], row["K_sig"], row["Phi_sig"]) == pytest.approx((eps, k, phi))


def test_lost_energy_goes_elsewhere_or_nowhere(run, sample):
    assert run["wide"][sample.ids["glued"]]["lost_other_HAD"] == pytest.approx(4 / 12)
    assert run["wide"][sample.ids["nothing"]]["lost_none_HAD"] == pytest.approx(1)


def test_ties(run, sample):
    assert run["best"][sample.ids["tie_goes_to_the_larger"]][0]["best"] == 1
    assert run["best"][sample.ids["tie_goes_to_the_first"]][0]["best"] == 0


def test_bin_edges_belong_to_the_upper_bin(run, sample):
    row = run["wide"][sample.ids["edges"]]
    assert [row[f"eps_HAD_{t}"] for t in ("E0-5", "E5-30", "E30-150", "E150-inf")] == [1, 1, 1, 1]
    assert run["wide"][sample.ids["bare_group"]]["noise_objects_per_event"] == 1
    assert math.isnan(run["wide"][sample.ids["dim"]]["K_EM"])


def test_groups_and_their_cells_give_the_same_sums(run, sample, spark, ws):
    ev = sample.ids["halves"]
    labels = spark.createDataFrame([(ev, 0, 0), (ev, 1, 1)], LABELS)
    cells = objects.to_cells(objects.from_labels(labels, "lc"), run["tables"].lch).filter(F.col("event_id") == ev)
    assert {(r["obj"], r["rh"]): r["w"] for r in cells.collect()} == {(0, 0): 1, (0, 1): 0.5, (1, 1): 0.5, (1, 2): 1}
    events = labels.select("event_id").distinct()
    found = run["truth"].targets.targets.join(events, "event_id", "left_semi")
    direct = scoring.evaluate(ws, objects.from_cell_weights(cells), run["truth"].ledger("rh"), found, events).sums()
    a, b = ({(r["cls"], r["ebin"]): [r[k] for k in SUM_KEYS] for r in df.collect()}
            for df in (direct, run["sums"].filter(F.col("event_id") == ev)))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_stored_collections_share_their_groups(run):
    row = summary.wide(run["truth"].score_collection("col").sums()).first()
    assert row["eps_sig"] == pytest.approx((5.5 + 6.5) / 14) and row["K_sig"] == pytest.approx(2 / 14)
    assert row["events"] == 1 and row["noise_objects_per_event"] == 1


@pytest.mark.parametrize("drop", [False, True])
def test_absent_collection_still_has_all_metrics(run, ws, drop):
    tables = run["tables"]
    if drop:
        tables = type(tables)(**{**tables.__dict__, "trackster_lc": None})
    absent = Truth(ws, tables, built=run["truth"].targets)
    absent._ledgers = {"lc": run["truth"].ledger("lc")}
    rows = {r["metric"]: r["value"] for r in summary.summary(absent.score_collection("absent").sums()).collect()}
    assert len(rows) == 46 and (rows["K_sig"], rows["eps_sig"], rows["Phi_sig"], rows["events"]) == (1, 0, 0, 0)


def test_no_events_give_a_grid_of_zeros(run):
    none = run["sums"].filter("false")
    assert {tuple(r) for r in scoring.combine(none).collect()} == {(c, b, *[0] * len(SUM_KEYS)) for c in range(2) for b in range(4)}
    rows = {r["metric"]: r["value"] for r in summary.summary(none).collect()}
    assert len(rows) == 46 and rows["events"] == 0 and rows["K_sig"] == 1 and math.isnan(rows["K_EM"])


def test_collected_and_lost_energy_make_up_the_targets(run):
    gap = F.abs(F.col("e_num") + F.col("lost_other") + F.col("lost_none") - F.col("e_den"))
    assert run["sums"].agg(F.max(gap)).first()[0] < 1e-9


def test_sums_of_parts_add_up(run):
    sums, odd = run["sums"], F.col("event_id") % 2 == 1
    whole = summary.wide(scoring.combine(sums)).first()
    parts = summary.wide(scoring.combine(scoring.combine(sums.filter(odd)), scoring.combine(sums.filter(~odd)))).first()
    assert list(whole) == pytest.approx(list(parts), rel=1e-12, nan_ok=True)
    assert whole["events"] == sums.select("event_id").distinct().count()


@pytest.fixture(scope="module")
def derived_truth(spark, ws):
    return Truth(ws, derived.sample(spark, "/root/testdata/sf0.001"))


def test_extreme_clusterings_of_a_whole_sample(derived_truth, ws):
    """Ideal clusterings do not fragment; one object per cell does; one object per side is hardly pure."""
    rh = derived_truth.tables.rh
    runs = {"ideal_rh": (derived_truth.ideal_labels("rh"), "rh"), "ideal_lc": (derived_truth.ideal_labels("lc"), "lc"),
            "cells": (rh.select("event_id", F.col("rh").alias("idx"), F.col("rh").alias("label")), "rh"),
            "sides": (rh.select("event_id", F.col("rh").alias("idx"), (F.col("z") > 0).cast("long").alias("label")), "rh")}
    got = {n: summary.wide(derived_truth.score_labels(ws.save(df, "labels"), lv).sums()).first() for n, (df, lv) in runs.items()}
    assert got["ideal_rh"]["Phi_sig"] == 0 and got["ideal_lc"]["Phi_sig"] == 0 and got["ideal_rh"]["eps_sig"] > 0.5
    assert got["cells"]["Phi_sig"] > 0.05 and got["cells"]["K_sig"] <= got["sides"]["K_sig"]
    assert got["sides"]["K_sig"] > 2 * got["ideal_rh"]["K_sig"], got["sides"]["K_sig"]


def test_samples_count_alike(spark):
    rows = [("p", "eps_sig", 0.25), ("q", "eps_sig", 0.5), ("r", "eps_sig", 0.75), ("p", "K_EM", math.nan), ("q", "K_EM", 0.125),
            ("r", "K_EM", math.inf), ("p", "K_pu", math.nan), ("p", "events", 3.0), ("q", "events", 40.0), ("r", "events", 500.0)]
    got = {r["metric"]: r["value"] for r in
           summary.mean_over_samples(spark.createDataFrame(rows, "sample string, metric string, value double")).collect()}
    assert math.isnan(got.pop("K_pu")) and got == {"eps_sig": 0.5, "K_EM": 0.125, "events": 543}


def test_summary_has_46_metrics():
    assert len(summary.metric_names()) == len(set(summary.metric_names())) == 46


def test_ordinals_rank_within_groups(spark):
    rows = [(1, v) for v in (0, 5, 7, 2**21, 2**21 + 3, 2**43, 2**43 + 1, 2**62)] + [(2, 9), (2, 2**30)]
    got = {(r["event_id"], r["v"]): r["n"] for r in
           ordinals(spark.createDataFrame(rows, "event_id long, v long"), ["event_id"], "v", "n").collect()}
    assert got == {**{r: i for i, r in enumerate(rows[:8])}, (2, 9): 0, (2, 2**30): 1}
    with pytest.raises(Exception, match="negative"):
        ordinals(spark.createDataFrame([(1, -3)], "event_id long, v long"), ["event_id"], "v", "n").collect()


def test_renumbered_objects_are_dense(spark):
    labels = spark.createDataFrame([(1, 0, 9), (1, 1, 4), (1, 2, -1), (2, 0, 7)], LABELS)
    got = objects.renumbered(objects.from_labels(labels, "rh"))
    assert {(r["event_id"], r["member"], r["obj"]) for r in got.weights.collect()} == {(1, 0, 1), (1, 1, 0), (2, 0, 0)}
    with pytest.raises(ValueError):
        objects.from_labels(labels, "cells")

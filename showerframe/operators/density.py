"""Density clustering: density, nearest higher point, chain to the seed, labels.

Points at one place (same X, Y, Z and sigma) share their neighbours, so both searches run between places: a place
brings its summed energy to the density search and its highest point to the nearest-higher search. Copies of a point,
however many, cost one row."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showerframe.functions.ranking import ordinals, top
from showerframe.functions.scalars import exact, real, units
from showerframe.operators.chains import roots
from showerframe.operators.crowding import sums_within
from showerframe.operators.lanes import Lanes, lane
from showerframe.operators.neighbours import HOT_CELL, range_join
from showerframe.params import DEFAULT, Params
from showerframe.session import cleaned, keyed
from showerframe.workspace import Workspace

EV = "event_id"
KEYS = [EV, "side"]
SPOT = [EV, "side", "X", "Y", "Z"]
PLACE = [*SPOT, "rel", "sig"]


def densities(ws: Workspace, coords: DataFrame, p: Params | Lanes) -> DataFrame:
    """``coords`` with rho (own energy plus half the energy within dc), dense and the reach eff of every point.

    Energies are added as whole numbers of a small unit and rounded once, so rho depends neither on the order in which
    rows arrive nor on what other events hold."""
    p = Lanes.of(p)
    shared = p.sharing()
    some = [k for k, lanes in enumerate(shared) if lanes]  # one lane for all with equal coordinates and radius
    own_lane = coords if len(some) == len(shared) else coords.filter(lane().isin(some))
    places = ws.save(own_lane.groupBy(*PLACE).agg(F.sum(units(F.col("E"))).alias("esum")), "density_places")
    near = sums_within(ws, places, p, [q.dc for q in p.all]).withColumn("near", exact(F.col("near")))
    if len(some) < len(shared):
        lanes = p.pick([F.array(*[F.lit(k) for k in own]).cast("array<int>") for own in shared])
        near = near.withColumn("l", F.explode(lanes)).withColumn("side", F.pmod(F.col("side"), F.lit(2)) + 2 * F.col("l")).drop("l")
    with keyed(ws.spark):
        near = ws.save(near, "near")  # a place with many copies is then a join key that can be split
    own = F.col("E").cast("double")
    out = coords.join(near, PLACE).withColumn("rho", real(own * 0.5 + F.col("near") * 0.5, p.f32))
    # pow in double, rounded once. On the axis the quotient is infinite, and the exponent decides.
    pivots = [q.rhocPivotRadius for q in p.all]
    on_axis = p.pick([F.lit(float("nan") if v == 0 else float("inf") if v > 0 else float("-inf")) for v in pivots])
    q = F.when(F.col("r") > 0, real(p.number(pivots) / F.col("r"), p.f32).cast("double")).otherwise(on_axis)
    power = real(F.pow(q, p.number(lambda s: s.rhocEtaExponent).cast("double")), p.f32)
    threshold = real(p.number(lambda s: s.rhoc) * power, p.f32)
    return (out.withColumn("dense", F.coalesce(F.col("rho") >= threshold, F.lit(False)))
            .withColumn("eff", F.when(F.col("dense"), p.number(lambda s: s.seedingDistance))
                        .otherwise(p.number(lambda s: s.outlierDistance)))
            .drop("near"))


def higher() -> Column:
    """The point with suffix 2 is higher: larger rho, or the same positive rho and a larger tag."""
    same = (F.col("rho2") == F.col("rho")) & (F.col("rho") > 0) & (F.col("tag2") > F.col("tag"))
    return (F.col("rho2") > F.col("rho")) | same


def nearest_higher(ws: Workspace, dens: DataFrame, p: Params | Lanes, radii: list | None = None,
                   hot_cell: int = HOT_CELL) -> DataFrame:
    """``dens`` with parent: the nearest higher point within eff, ties to the higher rho, then the higher tag, then
    the lower index; -1 if there is none.

    A point below the highest one of its position, whatever their sigmas, has that point at distance 0. Only the highest
    points search elsewhere, in growing radii, each as far as its own reach. Of two that search and differ in height, the
    lower one finds the other as soon as the radius covers their distance, so wide rounds start from few points even where
    points are crowded."""
    def tops(place: list[str]) -> DataFrame:
        return (dens.groupBy(*place).agg(F.max(F.struct("rho", "tag", (-F.col("idx")).alias("neg"))).alias("b"))
                .select(*place, F.col("b.rho").alias("rho"), F.col("b.tag").alias("tag"), (-F.col("b.neg")).alias("idx")))

    p = Lanes.of(p)
    places = ws.save(tops(PLACE), "places")
    spots = ws.save(tops(SPOT), "spots")
    cand = dens.select(*PLACE, "idx", "rho", "tag", "eff").join(
        spots.select(*SPOT, F.col("rho").alias("rho2"), F.col("tag").alias("tag2"), F.col("idx").alias("idx2")), SPOT)
    cand = ws.save(cand.withColumn("below", higher() & (F.lit(0) <= F.col("eff"))), "candidates")
    below = cand.filter("below").select(*KEYS, "idx", F.col("idx2").alias("parent"))
    # The others equal the highest point of their position but for sigma and reach: one search for each.
    level = cand.filter(~F.col("below"))
    one = ["idx", "sig", "eff"]
    search = ws.save(level.select(*PLACE, "rho", "tag", "eff", F.col("idx2").alias("idx")).distinct(), "search")
    links = []
    for radius in radii or search_radii(places, p, hot_cell):
        hit = (range_join(ws, search, places, p, radius, hot_cell, dealt=True)
               .filter(higher() & (F.col("d") <= F.col("eff")))
               .groupBy(*KEYS, *one)
               .agg(top(F.col("idx2"), -F.col("d"), F.col("rho2"), F.col("tag2"), -F.col("idx2")).alias("parent")))
        with keyed(ws.spark):
            links.append(ws.save(hit, "links"))
        if all(r >= reach for r, reach in zip(p.values(radius), p.reach)):
            break
        search = ws.save(search.filter(F.col("eff") > p.each(radius)).join(links[-1], [*KEYS, *one], "left_anti"), "search")
    linked = reduce(DataFrame.unionByName, links).withColumnRenamed("idx", "idx2")
    others = (level.select(*KEYS, "idx2", "sig", "eff", "idx").join(linked, [*KEYS, "idx2", "sig", "eff"], "left")
              .select(*KEYS, "idx", F.coalesce("parent", F.lit(-1)).alias("parent")))
    return dens.join(below.unionByName(others), [*KEYS, "idx"])


def search_radii(places: DataFrame, p: Params | Lanes, hot_cell: int = HOT_CELL) -> list:
    """Radii of the nearest-higher search: the full reach alone where cells are thinly filled; otherwise it starts at a
    radius whose fullest cell holds few places and doubles from there. With several lanes each radius is a list."""
    p = Lanes.of(p)
    halvings = 0
    if fullest_cell(places, p, p.reach) > hot_cell:
        while halvings < 20 and fullest_cell(places, p, [r / 2**halvings for r in p.reach]) > max(hot_cell // 32, 1):
            halvings += 1
    steps = [[r / 2**k for r in p.reach] for k in range(halvings, -1, -1)]
    return [s[0] if len(s) == 1 else s for s in steps]


def fullest_cell(places: DataFrame, p: Lanes, radius) -> int:
    """Largest number of places in one cell of twice ``radius``: one aggregate, one row back."""
    width = p.each([r * 2 for r in p.values(radius)])
    cells = places.groupBy(*KEYS, "sig", F.floor(F.col("X") / (width * F.col("rel"))).alias("cx"),
                           F.floor(F.col("Y") / (width * F.col("rel"))).alias("cy"),
                           F.floor(F.col("Z") / width).alias("cz")).count()
    with cleaned(places.sparkSession):
        return cells.agg(F.max("count").alias("n")).first()["n"] or 0


def seeds_and_roots(ws: Workspace, linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seeds: keys, idx) and (root of every point: keys, idx, root)."""
    return _seeds_and_roots(ws, ws.save(_forest(linked), "forest"))


def _forest(linked: DataFrame) -> DataFrame:
    return linked.select(*KEYS, "idx", "parent", (F.col("dense") & (F.col("parent") < 0)).alias("seed"))


def _seeds_and_roots(ws: Workspace, written: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (written.filter("seed").select(*KEYS, "idx"),
            roots(ws, written.select(*KEYS, "idx", "parent"), KEYS))


def number_clusters(ws: Workspace, seeds: DataFrame, rooted: DataFrame, p: Lanes, drop_small: bool) -> DataFrame:
    """Label of every seed: its rank on its side, side 1 continuing after all seeds of side 0, or -1 if its cluster is
    smaller than the cut. Numbers are given before the cut, so final labels have gaps."""
    ranked = ordinals(seeds, KEYS, "idx", "rank")
    before = (seeds.filter(F.pmod(F.col("side"), F.lit(2)) == 0).groupBy(*KEYS).agg(F.count("*").alias("shift"))
              .withColumn("side", (F.col("side") + 1).cast(seeds.schema["side"].dataType)))
    label = F.col("rank") + F.coalesce("shift", F.lit(0))
    out = ranked.join(before, KEYS, "left").select(*KEYS, F.col("idx").alias("root"), label.alias("label"))
    if drop_small:
        sizes = rooted.groupBy(*KEYS, "root").agg(F.count("*").alias("size"))
        out = (out.join(sizes, [*KEYS, "root"])
               .select(*KEYS, "root", F.when(F.col("size") < p.each(lambda s: s.minNumLayerCluster), -1).otherwise(F.col("label"))
                       .alias("label")))
    return ws.save(out, "cluster_labels")


def _labels(ws: Workspace, pts: DataFrame, p: Lanes, drop_small: bool, hot_cell: int) -> DataFrame:
    with ws.child() as tmp:
        coords = tmp.save(p.coordinates(pts), "coordinates")
        dens = ws.save(densities(tmp, coords, p), "densities")
    with ws.child() as tmp:
        forest = ws.save(_forest(nearest_higher(tmp, dens, p, hot_cell=hot_cell)), "forest")
    ws.release(dens)
    seeds, rooted = _seeds_and_roots(ws, forest)
    return rooted.join(number_clusters(ws, seeds, rooted, p, drop_small), [*KEYS, "root"], "left")


def cluster_all(ws: Workspace, pts: DataFrame, settings: dict[str, Params], drop_small: bool = True,
                hot_cell: int = HOT_CELL) -> DataFrame:
    """(setting, event_id, idx, label) of the points that have a cluster, for all named settings in one pass (one for each
    working precision)."""
    parts = []
    for f32 in sorted({p.f32 for p in settings.values()}):
        names = [n for n, p in settings.items() if p.f32 == f32]
        found = _labels(ws, pts, Lanes([settings[n] for n in names]), drop_small, hot_cell).filter(F.col("label") >= 0)
        name = F.element_at(F.array(*[F.lit(n) for n in names]), lane() + 1)
        parts.append(found.select(name.alias("setting"), EV, "idx", "label"))
    return reduce(DataFrame.unionByName, parts)


def cluster(ws: Workspace, pts: DataFrame, p: Params = DEFAULT, drop_small: bool = True,
            hot_cell: int = HOT_CELL) -> DataFrame:
    """Label of every point of the level: event_id, idx, label (-1: not active, outlier, or in a dropped cluster)."""
    labels = _labels(ws, pts, Lanes.of(p), drop_small, hot_cell)
    return (pts.select(EV, "idx").join(labels.select(EV, "idx", "label"), [EV, "idx"], "left")
            .select(EV, "idx", F.coalesce("label", F.lit(-1)).alias("label")))

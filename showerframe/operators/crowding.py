"""Sums over all places within a radius, without visiting every pair.

Where thousands of places crowd into one search radius, pairs of quadtree cells stand for pairs of places: a pair of
cells that lies within the radius as a whole contributes the sum of the one to the other, a pair that lies beyond it
nothing, and only the pairs that the radius cuts are divided further. What stays undecided once a pair of cells holds
few places is measured exactly, so the result is the same as that of the range join. Where no cell holds more than a few
places to begin with, places meet those of their neighbour cells at once."""
from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showerframe.operators.lanes import Lanes
from showerframe.operators.neighbours import distance
from showerframe.params import Params
from showerframe.session import keyed, parts_for
from showerframe.workspace import Workspace

EV = "event_id"
PLACE = [EV, "side", "X", "Y", "Z", "rel", "sig"]
CELL = [EV, "side", "sig", "Z", "cx", "cy"]
SMALL = 256  # pairs of places that a pair of cells may stand for without being divided


def _in_cells(places: DataFrame, p: Lanes, widths: list[float]) -> DataFrame:
    width = p.each(widths)
    return places.withColumns({"cx": F.floor(F.col("X").cast("double") / width),
                               "cy": F.floor(F.col("Y").cast("double") / width)})


def _cells(places: DataFrame, p: Lanes, widths: list[float]) -> DataFrame:
    return _in_cells(places, p, widths).groupBy(*CELL).agg(F.count("*").alias("n"), F.sum("esum").alias("s"))


def _as(df: DataFrame, suffix: str) -> DataFrame:
    """Columns of one side of a pair; event and side are shared."""
    return df.select(EV, "side", *[F.col(c).alias(c + suffix) for c in df.columns if c not in (EV, "side")])


def _threshold(p: Lanes, radius) -> Column:
    """Transverse distance that corresponds to ``radius`` for the sigmas of a pair of cells."""
    lanes = [F.array(*[F.array(*[F.lit(r * (a + b) / 2) for b in rel]) for a in rel]) for rel, r in zip(p.sigmas, p.values(radius))]
    return F.element_at(F.element_at(p.pick(lanes), F.col("sig_a") + 1), F.col("sig_b") + 1)


def _classify(pairs: DataFrame, p: Lanes, radius, widths: list[float], small: int) -> DataFrame:
    """``pairs`` with kind: 2 within the radius, 1 to be divided, 0 to be measured; pairs beyond it are dropped. The
    margins exceed what float32 rounding of a distance can add or remove."""
    near2, far2, width = F.lit(0.0), F.lit(0.0), p.each(widths)
    for axis in ("cx", "cy"):
        steps = F.abs(F.col(f"{axis}_a") - F.col(f"{axis}_b")).cast("double")
        gap, span = F.greatest(steps - 1, F.lit(0.0)) * width, (steps + 1) * width
        near2, far2 = near2 + gap * gap, far2 + span * span
    limit = _threshold(p, radius)
    outer, inner = limit * (1 + 1e-5) + 1e-6, limit * (1 - 1e-5) - 1e-6
    layers = F.abs(F.col("Z_a") - F.col("Z_b")) <= p.number(radius)
    return (pairs.filter(layers & (near2 <= outer * outer))
            .withColumn("kind", F.when((inner > 0) & (far2 <= inner * inner), 2)
                        .when(F.col("n_a") * F.col("n_b") > small, 1).otherwise(0)))


def around(cells: DataFrame) -> DataFrame:
    """Every cell once per block of 2 x 2 x 2 cells (gx, gy, gz) that it or one of its neighbours lies in: eight rows, where one
    for each neighbour would be 27."""
    steps = F.array(*[F.struct(*[F.shiftright(F.col(f"c{c}") + F.lit(d), 1).alias(f"g{c}") for c, d in zip("xyz", at)])
                      for at in product((-1, 1), repeat=3)])
    return cells.withColumn("g", F.explode(steps)).select(*cells.columns, "g.gx", "g.gy", "g.gz")


def touching(cells: DataFrame, parts: int | None = None) -> DataFrame:
    """Ordered pairs of cells (cx, cy, cz) at most one step apart on each axis, a cell with itself included. A cell lies in one
    block only, so each pair is met once.

    With ``parts``, for plans within ``session.keyed``, cells are first dealt out over so many tasks by tiles of 4 x 4 x 4 blocks, a cell
    to the one it lies in and to those its neighbours lie in, and repeated for the blocks by the task that joins them."""
    block = ["gx", "gy", "gz"]
    keys = [EV, "side", *block]
    first, second = cells, _as(cells, "_b")
    if parts:
        tile = [f"t{c}" for c in "xyz"]
        keys = [EV, "side", *tile, *block]
        second = second.withColumns({f"t{c}": F.shiftright(F.col(f"c{c}_b"), 3) for c in "xyz"}).repartition(parts, EV, "side", *tile)
        for c in "xyz":
            near = F.sequence(F.shiftright(F.col(f"c{c}") - 1, 3), F.shiftright(F.col(f"c{c}") + 1, 3))
            first = first.withColumn(f"t{c}", F.explode(near))
        first = around(first.repartition(parts, EV, "side", *tile)).filter(
            reduce(Column.__and__, [F.shiftright(F.col(f"g{c}"), 2) == F.col(f"t{c}") for c in "xyz"]))
    else:
        first = around(first)
    first = first.select(*keys, *[F.col(c).alias(f"{c}_a") for c in cells.columns if c not in (EV, "side")])
    second = second.withColumns({f"g{c}": F.shiftright(F.col(f"c{c}_b"), 1) for c in "xyz"})
    near = reduce(Column.__and__, [F.abs(F.col(f"c{c}_a") - F.col(f"c{c}_b")) <= 1 for c in "xyz"])
    return first.join(second, keys).filter(near).drop(*keys[2:], "cz_a", "cz_b")


def sums_within(ws: Workspace, places: DataFrame, p: Params | Lanes, radius, small: int = SMALL) -> DataFrame:
    """PLACE..., near: sum of ``esum`` over all places within ``radius`` (one, or one per lane), the place itself included.
    ``places`` is a written table of PLACE..., esum with each place once. Best planned within ``session.keyed`` (``touching``)."""
    p = Lanes.of(p)
    radii = p.values(radius)
    widths = [r * rel[-1] * (1 + 1e-4) + 1e-5 for r, rel in zip(radii, p.sigmas)]
    # layers farther apart than the radius never meet: the band of a layer is part of the key
    band = F.floor(F.col("Z").cast("double") / p.each([r * (1 + 1e-4) + 1e-5 for r in radii]))
    cells = ws.save(_cells(places, p, widths), "crowd_cells")
    seen = cells.agg(F.max("n").alias("fullest"), F.sum("n").alias("places"), F.count("*").alias("cells")).first()
    fullest = seen["fullest"] or 0
    if fullest * fullest <= small:  # no pair of cells would be divided
        located = _in_cells(places, p, widths).withColumn("cz", band)
        return _near(touching(located, parts_for(ws.spark, seen["places"] or 0)).withColumnsRenamed(
            {**{f"{c}_a": c for c in PLACE[2:]}, **{f"{c}_b": f"{c}2" for c in PLACE[2:]}}), p, radii)
    pairs = touching(cells.withColumn("cz", band), parts_for(ws.spark, seen["cells"]))
    parts = []
    while True:
        with keyed(ws.spark):
            rows, seen = ws.save_counting(_classify(pairs, p, radii, widths, small), "crowd_pairs",
                                          open=F.count_if(F.col("kind") == 1))
        located = _in_cells(places, p, widths)
        whole = ws.save(rows.filter("kind = 2").groupBy(EV, "side", *[F.col(f"{c}_a").alias(c) for c in CELL[2:]])
                        .agg(F.sum("s_b").alias("near")), "crowd_whole")
        parts.append(located.join(whole, CELL).select(*PLACE, "near"))
        parts.append(_measured(located, rows.filter("kind = 0"), p, radii))
        if not seen["open"]:
            break
        widths = [w / 2 for w in widths]
        children = ws.save(_cells(places, p, widths), "crowd_cells")
        half = {c: F.floor(F.col(c) / 2) for c in ("cx", "cy")}
        kids = children.withColumns({"px": half["cx"], "py": half["cy"]})
        pairs = rows.filter("kind = 1").select(EV, "side", "sig_a", "Z_a", F.col("cx_a").alias("px_a"),
                                               F.col("cy_a").alias("py_a"), "sig_b", "Z_b",
                                               F.col("cx_b").alias("px_b"), F.col("cy_b").alias("py_b"))
        for s in ("_a", "_b"):
            pairs = pairs.join(_as(kids, s), [EV, "side", *[f"{c}{s}" for c in ("sig", "Z", "px", "py")]])
        pairs = pairs.drop("px_a", "py_a", "px_b", "py_b")
    return reduce(DataFrame.unionByName, parts).groupBy(*PLACE).agg(F.sum("near").alias("near"))


def _measured(located: DataFrame, rows: DataFrame, p: Lanes, radius) -> DataFrame:
    """Exact sums over the undecided pairs of cells, aggregated before they move on."""
    links = rows.select(EV, "side", *[f"{c}_{s}" for c in CELL[2:] for s in "ab"])
    probes = links.join(_as(located, "_a").withColumnsRenamed({"X_a": "X", "Y_a": "Y", "rel_a": "rel"}),
                        [EV, "side", "sig_a", "Z_a", "cx_a", "cy_a"])
    others = _as(located, "_b").withColumnsRenamed({"X_b": "X2", "Y_b": "Y2", "rel_b": "rel2"})
    met = (probes.join(others, [EV, "side", "sig_b", "Z_b", "cx_b", "cy_b"])
           .withColumns({"Z": F.col("Z_a"), "Z2": F.col("Z_b"), "sig": F.col("sig_a")}))
    return _near(met, p, radius)


def _near(met: DataFrame, p: Lanes, radius) -> DataFrame:
    return (met.filter(distance(p) <= p.number(radius))
            .groupBy(*PLACE).agg(F.sum("esum_b").alias("near")))

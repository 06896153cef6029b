"""Range join of points with places under d = max(2 |dxy| / (rel_i + rel_j), |dz|) <= radius.

Spark has no spatial join, so the join is made an equi-join on grid cells. Each ordered pair of sigmas has its own
transverse cell width, twice the reach between the two: a probe then touches at most two cells per axis, places are
stored once per probing sigma, and the cell key alone guarantees that a pair is met once.

These copies of a row are made after the exchange: rows are dealt out by tiles of 4 x 4 x 4 of the widest cells, where a probe
lies in one tile and a place in all that its reach touches, mostly one."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showerframe.functions.scalars import number, real
from showerframe.operators.lanes import Lanes
from showerframe.params import Params
from showerframe.session import parts_for
from showerframe.workspace import Workspace

EV = "event_id"
TILE = [EV, "side", "tx", "ty", "tz"]
GRID = ["pair", "cx", "cy", "cz"]
HOT_CELL = 4096  # probes of one cell that one task handles; a tile with more pairs than four such cells have is split
MOST_SALTS = 100_000
FULL_TILE = 200_000  # places of a tile up to which its cells are kept in memory as a hash table


def distance(p: Params | Lanes) -> Column:
    """Metric distance of the columns X, Y, Z, rel and X2, Y2, Z2, rel2, rounded as the working precision does."""
    dx, dy = F.col("X") - F.col("X2"), F.col("Y") - F.col("Y2")
    flat = real(F.sqrt(dx * dx + dy * dy), p.f32) * number(2.0, p.f32)
    across = real(flat / (F.col("rel") + F.col("rel2")), p.f32)
    return F.greatest(across, F.abs(F.col("Z") - F.col("Z2")))


def _widths(rel: list[float], radius: float) -> list[list[float]]:
    """Cell width per (sigma, sigma), with a margin for rounding."""
    return [[2 * (radius * (a + b) / 2 * (1 + 1e-5) + 1e-6) for b in rel] for a in rel]


def _heights(p: Lanes, radius) -> Column:
    return p.each([2 * (r * (1 + 1e-5) + 1e-6) for r in p.values(radius)])


def _cell(c: Column, width: Column) -> Column:
    return F.floor(c.cast("double") / width)


def _choices(p: Lanes, radius, side: str) -> Column:
    """Array of (pair, width): the grids a row takes part in, chosen by its lane and ``sig``."""
    def of(widths: list[list[float]], s: int) -> Column:
        n = len(widths)
        pairs = [(s * n + o if side == "probe" else o * n + s, widths[s][o]) for o in range(n)]
        return F.array(*[F.struct(F.lit(k).alias("pair"), F.lit(w).alias("w")) for k, w in pairs])

    lanes = [_widths(rel, r) for rel, r in zip(p.sigmas, p.values(radius))]
    return F.element_at(p.pick([F.array(*[of(w, s) for s in range(len(w))]) for w in lanes]), F.col("sig") + 1)


def on_grid(df: DataFrame, p: Lanes, radius) -> DataFrame:
    """Every row once per grid it is searched in, at its own cell."""
    return (df.withColumn("g", F.explode(_choices(p, radius, "place")))
            .withColumns({"pair": F.col("g.pair"), "cx": _cell(F.col("X"), F.col("g.w")),
                          "cy": _cell(F.col("Y"), F.col("g.w")), "cz": _cell(F.col("Z"), _heights(p, radius))})
            .drop("g"))


def around_grid(df: DataFrame, p: Lanes, radius) -> DataFrame:
    """Every row once per cell that its search box touches."""

    def span(c: str, width: Column) -> Column:
        half = width / 2
        return F.sequence(_cell(F.col(c).cast("double") - half, width), _cell(F.col(c).cast("double") + half, width))

    out = df.withColumn("g", F.explode(_choices(p, radius, "probe")))
    for axis, name, width in (("X", "cx", F.col("g.w")), ("Y", "cy", F.col("g.w")), ("Z", "cz", _heights(p, radius))):
        out = out.withColumn(name, F.explode(span(axis, width)))
    return out.withColumn("pair", F.col("g.pair")).drop("g")


def _wide_cells(p: Lanes, radius) -> dict[str, Column]:
    """Width of the widest cell on each axis: twice the reach."""
    across = p.each([_widths(rel, r)[-1][-1] for rel, r in zip(p.sigmas, p.values(radius))])
    return {"X": across, "Y": across, "Z": _heights(p, radius)}


def _wide(c: str, width: Column) -> Column:
    return _cell(F.col(c), width)


def _tile(cell: Column) -> Column:
    return F.shiftright(cell, 2)


def in_tile(df: DataFrame, p: Lanes, radius) -> DataFrame:
    """Every row once, with the tile it lies in."""
    return df.withColumns({f"t{c.lower()}": _tile(_wide(c, w)) for c, w in _wide_cells(p, radius).items()})


def around_tiles(df: DataFrame, p: Lanes, radius) -> DataFrame:
    """Every row once per tile that its search box touches."""
    for c, w in _wide_cells(p, radius).items():
        low, high = (_tile(_cell(F.col(c).cast("double") + by, w)) for by in (-w / 2, w / 2))
        df = df.withColumn(f"t{c.lower()}", F.explode(F.sequence(low, high)))
    return df


def _tiles(ws: Workspace, probes: DataFrame, places: DataFrame, p: Lanes, radius, hot_cell: int) -> tuple[DataFrame, dict]:
    """TILE, salts: over how many tasks the probes of each tile are dealt out, so that none meets more pairs than four cells of
    ``hot_cell`` probes and places. With it the number of all rows, of those in the fullest tile and of tiles to be split."""
    def counted(df: DataFrame, **n) -> DataFrame:
        cells = {f"c{c.lower()}": _wide(c, w) for c, w in _wide_cells(p, radius).items()}
        return df.select(EV, "side", *[c.alias(k) for k, c in cells.items()], *[F.lit(v).alias(k) for k, v in n.items()])

    cells = (counted(probes, a=1, b=0).unionByName(counted(places, a=0, b=1)).groupBy(EV, "side", "cx", "cy", "cz")
             .agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    work = F.sum(F.col("a").cast("double") * F.col("b"))
    salts = F.greatest(F.least(F.ceil(work / (4.0 * hot_cell * hot_cell)), F.lit(MOST_SALTS)), F.lit(1)).cast("int")
    tiles = (cells.groupBy(EV, "side", *[_tile(F.col(f"c{c}")).alias(f"t{c}") for c in "xyz"])
             .agg(salts.alias("salts"),
                  F.sum(F.col("a") + F.col("b")).alias("n"), F.sum("b").alias("b")))
    return ws.save_counting(tiles, "tiles", rows=F.sum("n"), fullest=F.max("b"), split=F.count_if(F.col("salts") > 1))


def range_join(ws: Workspace, probes: DataFrame, places: DataFrame, p: Params | Lanes, radius,
               hot_cell: int = HOT_CELL, dealt: bool = False) -> DataFrame:
    """Pairs of probe and place rows at most ``radius`` (one, or one per lane) apart, with their distance ``d``; a probe also meets the place
    it lies on. ``probes`` need X, Y, Z, rel, sig; ``places`` the same plus any columns, all of which come out with
    a trailing 2. Nothing is collected or shuffled by pair: callers aggregate the pairs in the join's own stage.

    The work of a cell is probes x places, which adaptive execution cannot see in byte sizes. It is therefore counted first;
    the probes of a tile are dealt out over as many salts as it takes, one for all thin tiles, and its places are repeated
    once per salt.

    ``dealt`` is for plans within ``session.keyed``: rows are exchanged by tile, and repeated for the cells they touch by the task that
    joins them. Other plans would exchange what is repeated as well, so there the rows are repeated at once."""
    p = Lanes.of(p)
    tiles, seen = _tiles(ws, probes, places, p, radius, hot_cell)
    places = places.select(EV, "side", *[F.col(c).alias(f"{c}2") for c in places.columns if c not in (EV, "side")],
                           *[c for c in ("X", "Y", "Z", "sig")])
    probes, places, keys = in_tile(probes, p, radius), around_tiles(places, p, radius), TILE
    if seen["split"]:
        keys = [*TILE, "salt"]
        hot = tiles.filter("salts > 1").select(*TILE, "salts")
        count = F.coalesce("salts", F.lit(1))
        probes = (probes.join(hot, TILE, "left")
                  .withColumn("salt", F.pmod(F.xxhash64("X", "Y", "Z", "idx"), count).cast("int")).drop("salts"))
        places = (places.join(hot, TILE, "left")
                  .withColumn("salt", F.explode(F.sequence(F.lit(0), count - 1))).drop("salts"))
    if dealt:
        n = parts_for(ws.spark, seen["rows"])
        probes, places = probes.repartition(n, *keys), places.repartition(n, *keys)
    probes, places = around_grid(probes, p, radius), on_grid(places, p, radius).drop("X", "Y", "Z", "sig")
    # a cell has many rows on both sides: where places do not fit into memory, both are sorted
    how = "shuffle_hash" if dealt and seen["fullest"] <= FULL_TILE else "merge"
    pairs = probes.join(places.hint(how), [*keys, *GRID]).withColumn("d", distance(p)).filter(F.col("d") <= p.number(radius))
    return pairs.drop(*keys[2:], *GRID)


def pairs(ws: Workspace, coords: DataFrame, p: Params) -> DataFrame:
    """All ordered pairs of different points within the reach: event_id, side, i, j, d."""
    place = coords.select(EV, "side", "idx", "X", "Y", "Z", "rel", "sig")
    return (range_join(ws, place, place, p, p.reach).filter(F.col("idx") != F.col("idx2"))
            .select(EV, "side", F.col("idx").alias("i"), F.col("idx2").alias("j"), "d"))

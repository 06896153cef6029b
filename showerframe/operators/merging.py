"""The ideal-clustering test and the fixed point that merges the objects failing it.

The ideal clustering gives every cell to the object with most energy in it. An object passes if more than ``frac`` of
its energy lies in its own cells (completeness) and more than ``frac`` of the energy in those cells is its own
(purity). A failing object joins the object of its group that it is most confused with; one without such a partner is
flagged and not tested again unless something merges into it.

Objects are named by their smallest base column, which orders them as their ranks would."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from showerframe.functions.ranking import top
from showerframe.functions.scalars import guarded
from showerframe.operators.chains import components, doubled, named, started, unsettled
from showerframe.schema import DEFAULT_FRAC
from showerframe.session import keyed
from showerframe.workspace import Workspace

EV = "event_id"
#: Cell rows of an event that one task works on; larger events are dealt out by cell and object.
HEAVY = 5_000_000


def owners(cells: DataFrame, cell_keys: list[str]) -> DataFrame:
    """Owner of every cell: dom, its group and energy, the cell total and the number of objects in it. Cells where no
    object has energy have no owner and are left out. ``cells``: event_id, cell keys, obj, grp, E."""
    return (cells.groupBy(EV, *cell_keys)
            .agg(F.max(F.struct("E", (-F.col("obj")).alias("neg"), "grp")).alias("b"), F.sum("E").alias("tot"),
                 F.count("*").alias("n"))
            .filter(F.col("b.E") > 0)
            .select(EV, *cell_keys, (-F.col("b.neg")).alias("dom"), F.col("b.grp").alias("dom_grp"),
                    F.col("b.E").alias("top"), "tot", "n"))


def owned(owner_rows: DataFrame) -> DataFrame:
    """Per owning object: own energy in its cells and all energy in its cells."""
    return (owner_rows.groupBy(EV, F.col("dom").alias("obj"))
            .agg(F.sum("top").alias("own"), F.sum("tot").alias("in_cells")))


def confusion(cells: DataFrame, owner_rows: DataFrame, cell_keys: list[str], where: Column) -> DataFrame:
    """Energy of ``obj`` in the cells that ``dom`` owns, for the (dom, obj) pairs kept by ``where``."""
    return (cells.join(owner_rows, [EV, *cell_keys]).filter(where)
            .groupBy(EV, "dom", "obj").agg(F.sum("E").alias("v")))


def quality(members: DataFrame, owner_rows: DataFrame, frac: float) -> DataFrame:
    """Objects with energy, hardest base column, completeness, purity and whether they fail. Members and owned
    energies meet in one aggregate on the object.
    ``members``: event_id, base, obj, grp, pref, E_base, flag."""
    grp_type = members.schema["grp"].dataType
    none = F.lit(None)
    rows = (members.select(EV, "obj", "grp", "flag", F.col("E_base").alias("e"),
                           F.struct("E_base", (-F.col("base")).alias("neg"), "pref").alias("h"),
                           none.cast("double").alias("own"), none.cast("double").alias("in_cells")))
    more = owned(owner_rows).select(EV, "obj", none.cast(grp_type).alias("grp"), none.cast("boolean").alias("flag"),
                                    none.cast("double").alias("e"), none.cast(rows.schema["h"].dataType).alias("h"),
                                    "own", "in_cells")
    objects = (rows.unionByName(more).groupBy(EV, "obj")
               .agg(F.max("grp").alias("grp"), F.max("flag").alias("flag"), F.sum("e").alias("E"),
                    F.max("h").alias("h"), F.max("own").alias("own"), F.max("in_cells").alias("in_cells"))
               .select(EV, "obj", "grp", "flag", "E", (-F.col("h.neg")).alias("head"), F.col("h.pref").alias("pref"),
                       guarded(F.col("own"), F.col("E")).alias("completeness"),
                       guarded(F.col("own"), F.col("in_cells")).alias("purity")))
    fails = ((F.col("completeness") <= frac) | (F.col("purity") <= frac)) & ~F.col("flag")
    return objects.withColumn("fail", fails)


def best_partner(cells: DataFrame, owner_rows: DataFrame, failing: DataFrame, cell_keys: list[str]) -> DataFrame:
    """(event_id, obj, partner) for failing objects confused with another object of their group: the largest energy
    exchanged in either direction, then the lower index. Cells with one object and pairs across groups are dropped
    before anything is shuffled by object."""
    shared = owner_rows.filter(F.col("n") > 1)
    one_way = confusion(cells, shared, cell_keys,
                        (F.col("obj") != F.col("dom")) & (F.col("grp") == F.col("dom_grp")))
    ends = F.array(F.struct(F.col("dom").alias("obj"), F.col("obj").alias("t")),
                   F.struct(F.col("obj").alias("obj"), F.col("dom").alias("t")))
    both = one_way.select(EV, F.explode(ends).alias("p"), "v").select(EV, "p.obj", "p.t", "v")
    return (both.join(failing.select(EV, "obj"), [EV, "obj"], "left_semi")
            .groupBy(EV, "obj", "t").agg(F.sum("v").alias("v")).filter(F.col("v") > 0)
            .groupBy(EV, "obj").agg(top(F.col("t"), F.col("v"), -F.col("t")).alias("partner")))


def start_members(cells: DataFrame, bases: DataFrame) -> DataFrame:
    """Every base column as its own object, with its energy. ``bases``: event_id, base, grp, pref."""
    grp_type = bases.schema["grp"].dataType
    rows = bases.select(EV, "base", "grp", F.col("pref").cast("long").alias("pref"), F.lit(0.0).alias("E"))
    energy = cells.select(EV, F.col("obj").alias("base"), F.lit(None).cast(grp_type).alias("grp"),
                          F.lit(None).cast("long").alias("pref"), "E")
    return (rows.unionByName(energy).groupBy(EV, "base")
            .agg(F.max("grp").alias("grp"), F.max("pref").alias("pref"), F.sum("E").alias("E_base"))
            .select(EV, "base", F.col("base").alias("obj"), "grp", "pref", "E_base", F.lit(False).alias("flag"),
                    F.lit(-1).alias("merged_at"), F.lit(-1).cast("long").alias("partner")))


@dataclass(frozen=True)
class Separation:
    members: DataFrame   # event_id, base, obj, E_base, merged_at, partner
    objects: DataFrame   # event_id, obj, grp, E, head, completeness, purity, unreachable
    cells: DataFrame     # event_id, cell keys, obj, E
    rounds: DataFrame    # event_id, n_iterations


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def separate(ws: Workspace, cells: DataFrame, bases: DataFrame, cell_keys: list[str], frac: float = DEFAULT_FRAC,
             use_pref: bool = False, max_iterations: int = 100_000, heavy: int | None = None) -> Separation:
    """Merge base columns until every object passes or is flagged.

    ``cells``: event_id, cell keys, base, grp, E (duplicates are summed). ``bases``: event_id, base, grp, pref; they
    exist even without energy. With ``use_pref`` a failing object prefers the object that holds the ``pref`` column of
    its hardest base column, if that is another object of its group.

    All events advance together (``_frontier``). Events of more than ``heavy`` (``HEAVY``) cell rows would load one task; they
    advance in a loop whose every step is dealt out by cell or object instead (``_spread``). Both give the same result."""
    state = ws.save(cells.groupBy(EV, *cell_keys, F.col("base").alias("obj"), "grp").agg(F.sum("E").alias("E")),
                    "cells")
    large, seen = ws.save_counting(state.groupBy(EV).agg(F.count("*").alias("n")).filter(F.col("n") > (HEAVY if heavy is None else heavy)).select(EV), "heavy",
                                   events=F.count("*"))
    if not seen["events"]:
        return _frontier(ws, state, bases, cell_keys, frac, use_pref, max_iterations)
    parts = [
        _frontier(ws, state.join(large, EV, "left_anti"), bases.join(large, EV, "left_anti"), cell_keys, frac, use_pref, max_iterations),
        _spread(ws, ws.save(state.join(large, EV), "cells"), bases.join(large, EV), cell_keys, frac, use_pref, max_iterations)]
    return Separation(*(_union([getattr(p, f) for p in parts]) for f in ("members", "objects", "cells", "rounds")))


def _result(members, objects, cells, cell_keys) -> Separation:
    return Separation(
        members.select(EV, "base", "obj", "E_base", "merged_at", "partner"),
        objects.select(EV, "obj", "grp", "E", "head", "completeness", "purity",
                       (F.col("flag") | F.col("fail")).alias("unreachable")),
        cells.select(EV, *cell_keys, "obj", "E"),
        objects.groupBy(EV).agg((F.max("round") + F.max(F.col("fail").cast("int"))).alias("n_iterations")))


# ------------------------------------------------------------------ a frontier of events, bucketed

def _rows(cells: DataFrame, members: DataFrame, cell_keys: list[str], live) -> DataFrame:
    """Cells and members in one table, told apart by ``is_cell``."""
    absent = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for df in (cells, members) for f in df.schema}
    columns = ["base", "obj", "grp", "E", "pref", "flag", "merged_at", "partner"]

    def part(df: DataFrame, is_cell: bool) -> DataFrame:
        df = df if is_cell else df.withColumnRenamed("E_base", "E")
        return df.select(EV, live, F.lit(is_cell).alias("is_cell"),
                         *[F.col(c) if c in df.columns else absent[c] for c in (*cell_keys, *columns)])
    return part(cells, True).unionByName(part(members, False))


def _cells_of(rows: DataFrame, cell_keys: list[str]) -> DataFrame:
    return rows.filter("is_cell").select(EV, *cell_keys, "obj", "grp", "E")


def _members_of(rows: DataFrame) -> DataFrame:
    return rows.filter("not is_cell").select(EV, "base", "obj", "grp", "pref", F.col("E").alias("E_base"), "flag", "merged_at",
                                             "partner")


def judged(rows: DataFrame, cell_keys: list[str], frac: float, use_pref: bool) -> DataFrame:
    """``quality`` of all objects with ``next``, the object that each failing one joins (NULL if none), and ``live``, whether
    anything merges in the event. Written for rows that lie together by event: each cell is looked at once, where it says to
    its owner what it owns and to objects of one group what they share; members say what they are, and objects add that up.
    What is said is added up by hash before objects are: a greatest struct would sort all of it, so that a member is a key of
    its own, with its group, until only members and pairs are left."""
    cell = Window.partitionBy(EV, "is_cell", *cell_keys, "base")  # a member row is alone in its window
    seen = rows.select("*", F.max(F.struct("E", (-F.col("obj")).alias("neg"), "grp")).over(cell).alias("b"),
                       F.sum("E").over(cell).alias("tot"))
    types = {f.name: f.dataType for f in rows.schema}
    dom = -F.col("b.neg")
    kinds = {"obj": "long", "t": "long", "base": "long", "grp": types["grp"], "own": "double", "in_cells": "double", "v": "double", "e": "double",
             "pref": "long", "flag": "boolean", "member": "boolean"}

    def said(**values: Column) -> Column:
        return F.struct(*[values.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])

    obj, e = F.col("obj"), F.col("E")
    says = (F.when(~F.col("is_cell"), F.array(said(
        obj=obj, e=e, member=F.lit(True), **{c: F.col(c) for c in ("base", "grp", "pref", "flag")})))
            .when(F.col("b.E") <= 0, None)  # nobody has energy here
            .when(obj == dom, F.array(said(obj=obj, own=e, in_cells=F.col("tot"))))
            .when(F.col("grp") == F.col("b.grp"), F.array(said(obj=dom, t=obj, v=e), said(obj=obj, t=dom, v=e))))
    sums = (seen.select(EV, F.explode(says).alias("s")).select(EV, "s.*").groupBy(EV, "obj", "t", "base", "grp")
            .agg(*[F.sum(c).alias(c) for c in ("own", "in_cells", "v", "e")], *[F.max(c).alias(c) for c in ("pref", "flag", "member")]))
    hardest = F.when(F.col("member"), F.struct(F.col("e").alias("E_base"), (-F.col("base")).alias("neg"), "pref"))
    found = (sums.groupBy(EV, "obj")
             .agg(F.max("grp").alias("grp"), F.max("flag").alias("flag"), F.sum("e").alias("E"), F.max(hardest).alias("h"),
                  F.sum("own").alias("own"), F.sum("in_cells").alias("in_cells"),
                  F.max(F.when(F.col("v") > 0, F.struct("v", (-F.col("t")).alias("neg")))).alias("p"))
             .select(EV, "obj", "grp", "flag", "E", (-F.col("h.neg")).alias("head"), F.col("h.pref").alias("pref"),
                     guarded(F.col("own"), F.col("E")).alias("completeness"),
                     guarded(F.col("own"), F.col("in_cells")).alias("purity"), (-F.col("p.neg")).alias("partner")))
    found = found.withColumn("fail", ((F.col("completeness") <= frac) | (F.col("purity") <= frac)) & ~F.col("flag"))
    if use_pref:
        holders = _members_of(rows).select(EV, F.col("base").alias("pref"), F.col("obj").alias("p_obj"), F.col("grp").alias("p_grp"))
        usable = (F.col("p_obj") != F.col("obj")) & (F.col("p_grp") == F.col("grp"))
        found = (found.join(holders, [EV, "pref"], "left")
                 .withColumn("partner", F.when(usable, F.col("p_obj")).otherwise(F.col("partner"))))
    found = found.withColumn("next", F.when(F.col("fail"), F.col("partner")))
    live = F.max(F.col("next").isNotNull()).over(Window.partitionBy(EV)).alias("live")
    return found.select(EV, "obj", "grp", "flag", "E", "head", "completeness", "purity", "fail", "next", live)


def _frontier(ws: Workspace, state: DataFrame, bases: DataFrame, cell_keys: list[str], frac: float, use_pref: bool,
              max_iterations: int) -> Separation:
    """The loop over tables that are bucketed by event. A round reads only the frontier, the rows of events in which something
    still merges, and writes it once with the round's changes; rows of events that have settled are written there for the
    last time. Since all keys contain the event, a round is four jobs without an exchange: objects and what they join,
    components of these links, moves, and the next frontier."""
    spark = ws.spark
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with keyed(spark):
        state, bases = state.repartition(n, EV), bases.repartition(n, EV)
        rows, _ = ws.save_by(_rows(state, start_members(state, bases), cell_keys, F.lit(True).alias("live")), "frontier", EV, n)
        settled, done_objects = [], []
        for it in range(max_iterations):
            live = rows.filter("live")
            objects, seen = ws.save_by(judged(live, cell_keys, frac, use_pref), "objects", EV, n, merging=F.count("next"))
            done_objects.append(objects.filter("not live").withColumn("round", F.lit(it)))
            if not seen["merging"]:
                settled.append(rows)
                break
            settled.append(rows.filter("not live"))
            moves = _all_moves(ws, objects.filter("live"), n)
            rows, _ = ws.save_by(_moved(live, moves.drop("open"), cell_keys, it), "frontier", EV, n)
            ws.release(moves)
        else:
            raise RuntimeError("ideal-clustering test did not converge")
    everything = _union(settled)
    return _result(_members_of(everything), _union(done_objects), _cells_of(everything, cell_keys), cell_keys)


def _all_moves(ws: Workspace, objects: DataFrame, n: int) -> DataFrame:
    """``_moves`` of the objects of live events, written; links are doubled again in the rare round that has long chains."""
    failing = objects.filter("fail")
    heads = objects.select(EV, F.col("obj").alias("next"), F.col("head").alias("next_head"))
    edges = failing.select(EV, "obj", "next").join(heads, [EV, "next"], "left").drop("next")
    state = started(failing.filter(F.col("next").isNotNull()))
    while True:
        step, _ = ws.save_by(doubled(doubled(state)), "components", EV, n)
        still = unsettled(step).withColumn("open", F.lit(True))
        written, seen = ws.save_by(_moves(edges.join(still, [EV, "obj"], "left"), named(step)), "moves", EV, n,
                                   open=F.count_if("open"))
        if not seen["open"]:
            ws.release(step)
            return written
        ws.release(written)
        state = step


def _moved(live: DataFrame, moves: DataFrame, cell_keys: list[str], it: int) -> DataFrame:
    """The rows of the next round; ``live`` are those of events in which something merged in this one."""
    active = moves.filter("merged").select(EV, F.lit(True).alias("goes_on")).distinct()
    goes_on = F.coalesce("goes_on", F.lit(False)).alias("live")
    cells = (_cells_of(live, cell_keys).join(moves.select(EV, "obj", "comp"), [EV, "obj"], "left")
             .groupBy(EV, *cell_keys, F.coalesce("comp", "obj").alias("obj"), "grp").agg(F.sum("E").alias("E")))
    return _rows(cells.join(active, EV, "left"), _move_members(_members_of(live), moves, it).join(active, EV, "left"), cell_keys, goes_on)


# ------------------------------------------------------------------ events too large for one task

def _spread(ws: Workspace, state: DataFrame, bases: DataFrame, cell_keys: list[str], frac: float, use_pref: bool,
            max_iterations: int) -> Separation:
    """The loop with every step dealt out by cell or object. An event leaves in the round in which none of its objects merges."""
    members = ws.save(start_members(state, bases), "members")
    done_members, done_objects, done_cells = [], [], []
    for it in range(max_iterations):
        owner_rows = ws.save(owners(state, cell_keys), "owners")
        objects, seen = ws.save_counting(quality(members, owner_rows, frac), "objects", failing=F.count_if("fail"))
        objects = objects.withColumn("round", F.lit(it))
        if not seen["failing"]:
            done_members.append(members), done_objects.append(objects), done_cells.append(state)
            break
        edges, seen = ws.save_counting(
            _edges(state, owner_rows, objects, members, cell_keys, use_pref), "edges",
            merging=F.count("next"))
        ws.release(owner_rows)
        if not seen["merging"]:
            done_members.append(members), done_objects.append(objects), done_cells.append(state)
            break
        active = ws.save(edges.filter(F.col("next").isNotNull()).select(EV).distinct(), "active")
        for parts, df in ((done_members, members), (done_objects, objects), (done_cells, state)):
            parts.append(df.join(active, EV, "left_anti"))
        with ws.child() as tmp:
            joined = edges.filter(F.col("next").isNotNull()).select(EV, "obj", "next")
            moves = ws.save(_moves(edges, components(tmp, joined)), "moves")
        members = ws.save(_move_members(members.join(active, EV, "left_semi"), moves, it), "members")
        state = ws.save(
            state.join(active, EV, "left_semi")
            .join(moves.filter(F.col("comp") != F.col("obj")).select(EV, "obj", "comp"), [EV, "obj"], "left")
            .groupBy(EV, *cell_keys, F.coalesce("comp", "obj").alias("obj"), "grp").agg(F.sum("E").alias("E")),
            "cells")
        ws.release(edges, moves)
    else:
        raise RuntimeError("ideal-clustering test did not converge")
    finished = _union(done_objects)
    return _result(_union(done_members), finished, _union(done_cells), cell_keys)


def _edges(state, owner_rows, objects, members, cell_keys, use_pref) -> DataFrame:
    """One row per failing object: the object it joins (NULL if none) and that object's hardest base column."""
    failing = objects.filter("fail")
    edges = failing.join(best_partner(state, owner_rows, failing, cell_keys), [EV, "obj"], "left")
    if use_pref:
        holders = members.select(EV, F.col("base").alias("pref"), F.col("obj").alias("p_obj"),
                                 F.col("grp").alias("p_grp"))
        usable = (F.col("p_obj") != F.col("obj")) & (F.col("p_grp") == F.col("grp"))
        edges = (edges.join(holders, [EV, "pref"], "left")
                 .withColumn("partner", F.when(usable, F.col("p_obj")).otherwise(F.col("partner"))))
    heads = objects.select(EV, F.col("obj").alias("next"), F.col("head").alias("next_head"))
    return (edges.select(EV, "obj", F.col("partner").alias("next")).join(heads, [EV, "next"], "left")
            .select(EV, "obj", "next", "next_head"))


def _moves(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """What happens to every touched object: its new name, whether it is lone, the head of the object it joined. ``edges``:
    event_id, obj, next_head (and more) of failing objects; ``comps``: the components of those that join one. A lone failing
    object that others join is a merged object, not a lone one."""
    return (edges.drop("next").join(comps, [EV, "obj"], "full")
            .withColumns({"merged": F.col("comp").isNotNull(), "comp": F.coalesce("comp", "obj")}))


def _move_members(members: DataFrame, moves: DataFrame, it: int) -> DataFrame:
    first = F.col("next_head").isNotNull() & (F.col("merged_at") < 0)
    return (members.join(moves, [EV, "obj"], "left")
            .select(EV, "base", F.coalesce("comp", "obj").alias("obj"), "grp", "pref", "E_base",
                    F.coalesce(~F.col("merged"), F.col("flag")).alias("flag"),
                    F.when(first, it).otherwise(F.col("merged_at")).alias("merged_at"),
                    F.when(first, F.col("next_head")).otherwise(F.col("partner")).alias("partner")))

"""Reference SQL of the named queries, composed of common table expressions.

Every expression is written from the definitions, for an engine that runs on one machine: windows where the Spark plans
aggregate, pair joins within an event where they use grid cells, and a fixed number of merging rounds."""
from __future__ import annotations

import functools
import re

NOISE = 2_000_000_000_000
EMPTY = 3_000_000_000_000
SUMS = ("k_num k_den k_floor e_num e_den f_c f_cn lost_other lost_none n_targets n_targets_obj n_obj pu_sig pu_den "
        "pu_eps_num pu_eps_den n_pu_obj n_noise_obj events").split()
WHOLE = {"n_targets", "n_targets_obj", "n_obj", "n_pu_obj", "n_noise_obj", "events"}
TAGS = ("E0-5", "E5-30", "E30-150", "E150-inf")

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def render(select: str, *names: str) -> str:
    """WITH clause of the wanted expressions and everything they mention, in order of definition."""
    wanted, todo = set(), [select, *names]
    while todo:
        text = todo.pop()
        new = _mentioned(CTES.get(text, text)) - wanted
        wanted |= new
        todo += [CTES[name] for name in new]
    head = ",\n".join(f"{n} AS ({s})" for n, s in CTES.items() if n in wanted)
    return f"WITH RECURSIVE {head}\n{select}"


@functools.cache
def _mentioned(text: str) -> frozenset[str]:
    """Names of the expressions that a text mentions."""
    return frozenset(re.findall(r"(?<![\w.])\w+", text)) & CTES.keys()


# The sample

cte("q_line", """SELECT l_orderkey % 30 AS event_id, l_suppkey AS unit, l_suppkey * 2 + l_partkey % 4 AS rh,
  l_suppkey * 3 + (l_partkey // 4) % 3 AS atom,
  l_quantity * (CASE l_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 32 END) / 64::DOUBLE AS E,
  CASE WHEN l_linenumber = 1 THEN 1::DOUBLE / 64::DOUBLE ELSE 0::DOUBLE END AS no_truth FROM lineitem""")
cte("q_event", "SELECT DISTINCT event_id FROM q_line")
cte("q_tra", "SELECT event_id, rh, atom, sum(E) AS E FROM q_line GROUP BY ALL")
cte("q_rh0", f"""SELECT event_id, rh, sum(E) + sum(no_truth) AS E, sum(no_truth) AS no_truth FROM q_line GROUP BY event_id, rh
  UNION ALL SELECT DISTINCT event_id, {NOISE} + unit, 1::DOUBLE, 1::DOUBLE FROM q_line WHERE unit % 5 = 0""")


def _place(cell: str) -> str:
    g = f"({cell} // 8)"
    layer = f"(1 + ({g} % 8) * 5 + {cell} % 8)"
    return f"""(30 + 4 * ({g} % 61))::FLOAT AS x, (30 + 4 * (({g} // 61) % 61))::FLOAT AS y,
  (CASE WHEN {g} % 2 = 1 THEN 350 + {layer} ELSE -350 - {layer} END)::FLOAT AS z,
  {layer}::INTEGER AS layer, ({g} % 2)::INTEGER AS side, (8 + {g} % 3)::INTEGER AS det"""


cte("q_rh", f"SELECT event_id, rh, E, no_truth, rh + 5000 AS id, {_place('rh')} FROM q_rh0")
cte("q_lch", f"""SELECT event_id, CASE WHEN rh >= {NOISE} THEN rh ELSE rh // 3 END AS lc, rh,
    CASE WHEN rh < {NOISE} AND rh % 3 = 2 THEN 0.75::DOUBLE ELSE 1::DOUBLE END AS frac, E FROM q_rh0
  UNION ALL SELECT event_id, rh // 3 + 1, rh, 0.25::DOUBLE, E FROM q_rh0 WHERE rh < {NOISE} AND rh % 3 = 2""")
cte("q_lc0", "SELECT event_id, lc, sum(frac * E) AS E FROM q_lch GROUP BY event_id, lc")
cte("q_lc1", f"SELECT *, CASE WHEN lc >= {NOISE} THEN lc ELSE lc * 3 END AS cell FROM q_lc0")
cte("q_lc", f"""SELECT event_id, lc, E, {_place('cell')}, 6 + lc % 4 AS algo, lc + 1000 AS seed,
  CASE WHEN lc % 5 = 0 THEN 0 ELSE 1 END AS mask FROM q_lc1""")
cte("q_unit", "SELECT event_id, unit, sum(E) AS dep FROM q_line GROUP BY event_id, unit")
cte("q_un", """SELECT event_id, unit, dep,
  CASE s_nationkey % 5 WHEN 0 THEN 22 WHEN 1 THEN 11 WHEN 2 THEN 111 WHEN 3 THEN 211 ELSE 13 END AS pdg,
  CASE WHEN unit % 7 = 0 THEN 1 ELSE 0 END AS kind,
  (unit % 5 <> 4 AND (unit // 5) % 2 = 0) AS signal,
  CASE WHEN unit % 5 = 4 THEN unit + 1000 ELSE unit // 5 END AS evt
  FROM q_unit JOIN supplier ON unit = s_suppkey""")
cte("q_atom", """SELECT event_id, atom, unit, coalesce(lag(atom) OVER (PARTITION BY event_id, unit ORDER BY atom), -1) AS parent
  FROM (SELECT DISTINCT event_id, unit, atom FROM q_line)""")
cte("q_ts", f"""SELECT event_id, 'main' AS collection, lc // 2 AS ts, lc, 0.5::DOUBLE AS weight FROM q_lc0
    WHERE lc < {NOISE} AND lc > 0 AND lc % 2 = 0
  UNION ALL SELECT event_id, 'main', lc // 2 - 1, lc, 0.5::DOUBLE FROM q_lc0 WHERE lc < {NOISE} AND lc > 0 AND lc % 2 = 0
  UNION ALL SELECT event_id, 'main', CASE WHEN lc >= {NOISE} THEN lc ELSE lc // 2 END, lc, 1::DOUBLE FROM q_lc0
    WHERE NOT (lc < {NOISE} AND lc > 0 AND lc % 2 = 0)
  UNION ALL SELECT event_id, 'wide', lc // 4, lc, 1::DOUBLE FROM q_lc0 WHERE event_id % 3 = 0 AND lc < {NOISE}
  UNION ALL SELECT event_id, 'main', {EMPTY}, NULL, 1::DOUBLE FROM q_event""")
cte("q_lab_rh", f"""SELECT event_id, rh AS idx, CASE WHEN rh >= {NOISE} THEN rh WHEN rh % 11 = 0 THEN -1 ELSE rh // 4 END AS label
  FROM q_rh0""")
cte("q_lab_lc", f"""SELECT event_id, lc AS idx, CASE WHEN lc >= {NOISE} THEN lc WHEN lc % 7 = 0 THEN -1 ELSE lc // 2 END AS label
  FROM q_lc0""")

# Units as objects: the first round of the merging

cte("q_ucell", "SELECT event_id, rh, unit, sum(E) AS E FROM q_tra JOIN q_atom USING (event_id, atom) GROUP BY ALL")
cte("q_ucell2", """SELECT *, row_number() OVER (PARTITION BY event_id, rh ORDER BY E DESC, unit) AS pos,
  first_value(unit) OVER (PARTITION BY event_id, rh ORDER BY E DESC, unit) AS dom FROM q_ucell""")
cte("q_uconf", "SELECT event_id, dom, unit AS obj, sum(E) AS v FROM q_ucell2 GROUP BY ALL")

# Interaction targets

cte("q_given", "SELECT event_id, unit, CASE WHEN unit % 5 = 4 THEN unit ELSE evt * 5 END AS target FROM q_un")

cte("q_moved", """SELECT event_id, atom, CASE WHEN parent >= 0 THEN parent ELSE atom - 3 END AS parent,
  CASE WHEN unit % 3 = 0 THEN unit ELSE target END AS target FROM q_atom JOIN q_given USING (event_id, unit)""")


def _em(pdg: str, kind: str) -> str:
    return f"(abs({pdg}) IN (11, 22, 111) OR {kind} = 1)"


def _bin(e: str) -> str:
    return f"CASE WHEN {e} < 5 THEN 0 WHEN {e} < 30 THEN 1 WHEN {e} < 150 THEN 2 ELSE 3 END"


def target_ctes(p: str, assignment: str) -> None:
    """Attributes, cells and ledgers of the targets of an assignment (event_id, unit, target)."""
    cte(f"{p}_tu", f"""SELECT event_id, target, unit, coalesce(dep, 0) AS dep, signal, {_em('pdg', 'kind')} AS em
      FROM {assignment} JOIN q_un USING (event_id, unit)""")
    cte(f"{p}_t0", f"""SELECT event_id, target, sum(dep) AS E, bool_or(signal) AS signal, count(*) AS n_units,
      arg_max(em, (dep, -unit)) AS em, arg_max(unit, (dep, -unit)) AS lead_unit FROM {p}_tu GROUP BY event_id, target""")
    cte(f"{p}_t", f"""SELECT *, CASE WHEN em THEN 0 ELSE 1 END AS cls, {_bin('E')} AS ebin FROM {p}_t0""")
    cte(f"{p}_cell", f"""SELECT event_id, rh, target, sum(E) AS E FROM q_ucell JOIN {assignment} USING (event_id, unit)
      GROUP BY ALL""")
    cte(f"{p}_most", f"SELECT event_id, rh, max(E) AS most FROM {p}_cell GROUP BY ALL")
    cte(f"{p}_floor", f"""SELECT event_id, rh, E, coalesce(most, 0) AS most, E - coalesce(most, 0) AS floor
      FROM q_rh0 LEFT JOIN {p}_most USING (event_id, rh)""")


def scored_ctes(s: str, p: str, weights: str, roster: str, events: str = "q_event") -> None:
    """Scores of objects: ``weights`` (event_id, obj, rh, w) and ``roster`` (event_id, obj) against targets ``p``."""
    cte(f"{s}_share", f"""SELECT event_id, obj, target, sum(w * E) AS share FROM {weights} JOIN {p}_cell USING (event_id, rh)
      GROUP BY ALL""")
    cte(f"{s}_en", f"""SELECT event_id, obj, sum(w * E) AS E, sum(w * floor) AS floor FROM {weights}
      JOIN {p}_floor USING (event_id, rh) GROUP BY ALL""")
    cte(f"{s}_ranked", f"""SELECT s.*, t.signal, row_number() OVER (PARTITION BY s.event_id, obj
      ORDER BY share DESC, t.E DESC, s.target) AS pos FROM {s}_share s JOIN {p}_t t USING (event_id, target)""")
    cte(f"{s}_insig", f"""SELECT event_id, obj, sum(CASE WHEN signal THEN share ELSE 0 END) AS in_signal FROM {s}_ranked
      GROUP BY ALL""")
    cte(f"{s}_obj", f"""SELECT r.event_id, r.obj, coalesce(b.target, -1) AS best, coalesce(b.share, 0) AS own,
      coalesce(e.E, 0) AS E, coalesce(e.floor, 0) AS floor, coalesce(i.in_signal, 0) AS in_signal, t.signal, t.cls, t.ebin
      FROM {roster} r LEFT JOIN (SELECT * FROM {s}_ranked WHERE pos = 1) b USING (event_id, obj)
      LEFT JOIN {s}_en e USING (event_id, obj) LEFT JOIN {s}_insig i USING (event_id, obj)
      LEFT JOIN {p}_t t ON t.event_id = r.event_id AND t.target = b.target""")
    cte(f"{s}_any", f"SELECT event_id, target, sum(share) AS in_any FROM {s}_share GROUP BY ALL")
    cte(f"{s}_own", f"""SELECT event_id, best AS target, sum(own) AS c, count(*) AS n FROM {s}_obj WHERE best >= 0
      GROUP BY ALL""")
    cte(f"{s}_col", f"""SELECT t.*, coalesce(c, 0) AS c, coalesce(n, 0) AS n, coalesce(in_any, 0) AS in_any FROM {p}_t t
      JOIN {events} USING (event_id)
      LEFT JOIN {s}_own USING (event_id, target) LEFT JOIN {s}_any USING (event_id, target)""")
    obj = {"k_num": ("signal", "E - own"), "k_den": ("signal", "E"), "k_floor": ("signal", "floor"),
           "n_obj": ("signal", "1"), "pu_sig": ("NOT signal", "in_signal"), "pu_den": ("NOT signal", "E"),
           "n_pu_obj": ("NOT signal", "1"), "n_noise_obj": ("best < 0", "1")}
    tgt = {"e_num": ("signal", "c"), "e_den": ("signal", "E"), "f_c": ("signal", "c"), "f_cn": ("signal", "c * n"),
           "lost_other": ("signal", "in_any - c"), "lost_none": ("signal", "E - in_any"), "n_targets": ("signal", "1"),
           "n_targets_obj": ("signal AND n > 0", "1"), "pu_eps_num": ("NOT signal", "c"),
           "pu_eps_den": ("NOT signal", "E")}

    def columns(terms: dict) -> str:
        return ", ".join(f"CASE WHEN {terms[k][0]} THEN {terms[k][1]} ELSE 0 END AS {k}" if k in terms else f"0 AS {k}"
                         for k in SUMS if k != "events")

    cte(f"{s}_rows", f"""SELECT event_id, coalesce(cls, 0) AS cls, coalesce(ebin, 0) AS ebin, {columns(obj)}, 0 AS events FROM {s}_obj
      UNION ALL SELECT event_id, cls, ebin, {columns(tgt)}, 0 FROM {s}_col
      UNION ALL SELECT event_id, k % 2, k // 2, {columns({})}, CASE WHEN k = 0 THEN 1 ELSE 0 END
        FROM {events}, range(8) AS g(k)""")
    total = ", ".join(f"sum({k})::{'BIGINT' if k in WHOLE else 'DOUBLE'} AS {k}" for k in SUMS)
    cte(f"{s}_sums", f"SELECT event_id, cls::INTEGER AS cls, ebin::INTEGER AS ebin, {total} FROM {s}_rows GROUP BY 1, 2, 3")


def total_sums(s: str, keys: list[str]) -> str:
    total = ", ".join(f"sum({k})::{'BIGINT' if k in WHOLE else 'DOUBLE'} AS {k}" for k in keys)
    return f"SELECT cls, ebin, {total} FROM {s}_sums GROUP BY cls, ebin"


def metric_sql(sums: str, by: str = "") -> str:
    """Long summary (by, metric, value) of a relation of sums."""
    names = {"K": ("k_num", "k_den"), "eps": ("e_num", "e_den"), "Phi": ("f_c", "f_cn")}

    def part(key: str, c: int | None = None, b: int | None = None) -> str:
        cond = " AND ".join([f"cls = {c}"] * (c is not None) + [f"ebin = {b}"] * (b is not None)) or "true"
        return f"coalesce(sum({key}) FILTER ({cond}), 0)::DOUBLE"

    def ratio(n: str, d: str, phi: bool = False) -> str:
        value = f"1 - ({n}) / ({d})" if phi else f"({n}) / ({d})"
        return f"CASE WHEN ({d}) > 0 THEN {value} ELSE 'NaN'::DOUBLE END"

    out: dict[str, str] = {}
    for m, (n, d) in names.items():
        for c, name in enumerate(("EM", "HAD")):
            out[f"{m}_{name}"] = ratio(part(n, c), part(d, c), m == "Phi")
            for b, tag in enumerate(TAGS):
                out[f"{m}_{name}_{tag}"] = ratio(part(n, c, b), part(d, c, b), m == "Phi")
    for c, name in enumerate(("EM", "HAD")):
        out[f"K_floor_{name}"] = ratio(part("k_floor", c), part("k_den", c))
        out[f"lost_other_{name}"] = ratio(part("lost_other", c), part("e_den", c))
        out[f"lost_none_{name}"] = ratio(part("lost_none", c), part("e_den", c))
    out["K_pu"] = ratio(part("pu_sig"), part("pu_den"))
    out["eps_pu"] = ratio(part("pu_eps_num"), part("pu_eps_den"))
    for metric, key in (("signal_objects", "n_obj"), ("pileup_objects", "n_pu_obj"), ("noise_objects", "n_noise_obj"),
                        ("signal_targets", "n_targets")):
        out[f"{metric}_per_event"] = f"{part(key)} / greatest({part('events')}, 1)"
    out["events"] = part("events")
    inner = ", ".join(f'{sql} AS "{name}"' for name, sql in out.items())
    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    base = f"(SELECT {key}{inner} FROM {sums} {group})"

    def mean(m: str, empty: float) -> str:
        a, b = f'"{m}_EM"', f'"{m}_HAD"'
        return (f"CASE WHEN isnan({a}) AND isnan({b}) THEN {empty}::DOUBLE WHEN isnan({a}) THEN {b} "
                f"WHEN isnan({b}) THEN {a} ELSE ({a} + {b}) / 2 END AS {m}_sig")

    return (f"SELECT {key}metric, value FROM (UNPIVOT (SELECT *, {mean('K', 1)}, {mean('eps', 0)}, {mean('Phi', 0)} "
            f"FROM {base}) ON COLUMNS(* EXCLUDE ({by})) INTO NAME metric VALUE value)" if by else
            f"SELECT metric, value FROM (UNPIVOT (SELECT *, {mean('K', 1)}, {mean('eps', 0)}, {mean('Phi', 0)} "
            f"FROM {base}) ON COLUMNS(*) INTO NAME metric VALUE value)")


target_ctes("g", "q_given")
cte("w_rh", "SELECT event_id, label AS obj, idx AS rh, 1::DOUBLE AS w FROM q_lab_rh WHERE label >= 0")
cte("w_lc", """SELECT event_id, label AS obj, rh, sum(frac) AS w FROM q_lab_lc JOIN q_lch USING (event_id)
  WHERE q_lch.lc = idx AND label >= 0 GROUP BY ALL""")
cte("w_ts", """SELECT t.event_id, ts AS obj, rh, sum(weight * frac) AS w FROM q_ts t JOIN q_lch m
  ON t.event_id = m.event_id AND t.lc = m.lc WHERE collection = 'main' GROUP BY ALL""")
cte("r_rh", "SELECT DISTINCT event_id, label AS obj FROM q_lab_rh WHERE label >= 0")
cte("r_lc", "SELECT DISTINCT event_id, label AS obj FROM q_lab_lc WHERE label >= 0")
cte("r_ts", "SELECT DISTINCT event_id, ts AS obj FROM q_ts WHERE collection = 'main'")
for _s, _k in (("c", "rh"), ("l", "lc"), ("s", "ts")):
    scored_ctes(f"g{_s}", "g", f"w_{_k}", f"r_{_k}")


# Merging, unrolled

def merging_ctes(p: str, cells: str, bases: str, keys: str, rounds: int, use_pref: bool) -> None:
    """``rounds`` rounds of the merging of ``cells`` (event_id, keys, base, E) with ``bases`` (event_id, base, grp, pref).
    Fails if more rounds are needed. Leaves {p}_m (members), {p}_o (objects) and {p}_it (rounds per event)."""
    cte(f"{p}_m0", f"""SELECT b.event_id, b.base, b.base AS obj, grp, pref, coalesce(e.E, 0) AS Eb, false AS flag,
      -1 AS merged_at, -1::BIGINT AS partner FROM {bases} b
      LEFT JOIN (SELECT event_id, base, sum(E) AS E FROM {cells} GROUP BY ALL) e USING (event_id, base)""")
    for k in range(rounds + 1):
        m = f"{p}_m{k}"
        cte(f"{p}_c{k}", f"""SELECT event_id, {keys}, obj, grp, sum(E) AS E FROM {cells} JOIN {m} USING (event_id, base)
          GROUP BY ALL""")
        cte(f"{p}_d{k}", f"""SELECT *, CASE WHEN max(E) OVER w > 0 THEN first_value(obj) OVER w END AS dom,
          CASE WHEN max(E) OVER w > 0 THEN first_value(grp) OVER w END AS dgrp FROM {p}_c{k}
          WINDOW w AS (PARTITION BY event_id, {keys} ORDER BY E DESC, obj)""")
        cte(f"{p}_k{k}", f"""SELECT event_id, dom AS obj, sum(E) AS in_cells, sum(CASE WHEN dom = obj THEN E ELSE 0 END) AS own
          FROM {p}_d{k} WHERE dom IS NOT NULL GROUP BY event_id, dom""")
        cte(f"{p}_o{k}", f"""SELECT o.*, CASE WHEN E > 0 THEN coalesce(own, 0) / E ELSE 0 END AS completeness,
          CASE WHEN in_cells > 0 THEN own / in_cells ELSE 0 END AS purity FROM (
            SELECT event_id, obj, any_value(grp) AS grp, bool_or(flag) AS flag, sum(Eb) AS E,
              arg_max(base, (Eb, -base)) AS head, first(pref ORDER BY Eb DESC, base) AS pref FROM {m} GROUP BY event_id, obj) o
          LEFT JOIN {p}_k{k} USING (event_id, obj)""")
        cte(f"{p}_f{k}", f"""SELECT * FROM {p}_o{k} WHERE (completeness <= 0.5::DOUBLE OR purity <= 0.5::DOUBLE) AND NOT flag""")
        cte(f"{p}_x{k}", f"""SELECT event_id, a, b, sum(v) AS v FROM (
          SELECT event_id, dom AS a, obj AS b, E AS v FROM {p}_d{k} WHERE dom <> obj AND dgrp = grp
          UNION ALL SELECT event_id, obj, dom, E FROM {p}_d{k} WHERE dom <> obj AND dgrp = grp) GROUP BY ALL HAVING sum(v) > 0""")
        pref = "CASE WHEN h.obj <> f.obj AND h.grp = f.grp THEN h.obj END" if use_pref else "NULL"
        cte(f"{p}_e{k}", f"""SELECT f.event_id, f.obj, coalesce({pref}, x.b) AS nxt FROM {p}_f{k} f
          LEFT JOIN {m} h ON h.event_id = f.event_id AND h.base = f.pref
          LEFT JOIN (SELECT event_id, a, b, row_number() OVER (PARTITION BY event_id, a ORDER BY v DESC, b) AS pos FROM {p}_x{k}) x
            ON x.event_id = f.event_id AND x.a = f.obj AND x.pos = 1""")
        if k == rounds:
            break
        cte(f"{p}_g{k}", f"""SELECT event_id, obj AS a, nxt AS b FROM {p}_e{k} WHERE nxt IS NOT NULL
          UNION SELECT event_id, nxt, obj FROM {p}_e{k} WHERE nxt IS NOT NULL""")
        cte(f"{p}_r{k}", f"""SELECT event_id, a, a AS b FROM {p}_g{k}
          UNION SELECT r.event_id, r.a, g.b FROM {p}_r{k} r JOIN {p}_g{k} g ON g.event_id = r.event_id AND g.a = r.b""")
        cte(f"{p}_y{k}", f"SELECT event_id, a AS obj, min(b) AS comp FROM {p}_r{k} GROUP BY ALL")
        cte(f"{p}_m{k + 1}", f"""SELECT m.event_id, base, coalesce(comp, m.obj) AS obj, m.grp, m.pref, Eb,
          CASE WHEN comp IS NOT NULL THEN false WHEN e.obj IS NOT NULL THEN true ELSE m.flag END AS flag,
          CASE WHEN e.nxt IS NOT NULL AND merged_at < 0 THEN {k} ELSE merged_at END AS merged_at,
          CASE WHEN e.nxt IS NOT NULL AND merged_at < 0 THEN o.head ELSE partner END AS partner
          FROM {m} m LEFT JOIN {p}_e{k} e ON e.event_id = m.event_id AND e.obj = m.obj
          LEFT JOIN {p}_y{k} y ON y.event_id = m.event_id AND y.obj = m.obj
          LEFT JOIN {p}_o{k} o ON o.event_id = m.event_id AND o.obj = e.nxt""")
    # an object that still has something to join would make the unrolled rounds too few: that is an error, not an answer
    cte(f"{p}_more", f"SELECT count(nxt) AS n FROM {p}_e{rounds}")
    cte(f"{p}_m", f"""SELECT * REPLACE (CASE WHEN (SELECT n FROM {p}_more) > 0 THEN error('more rounds are needed')
      ELSE obj END AS obj) FROM {p}_m{rounds}""")
    cte(f"{p}_o", f"SELECT *, flag AS unreachable FROM {p}_o{rounds}")
    failing = " UNION ALL ".join(f"SELECT event_id, {k + 1} AS it FROM {p}_f{k}" for k in range(rounds))
    cte(f"{p}_it", f"SELECT event_id, coalesce(max(it), 0) AS n_iterations FROM q_event LEFT JOIN ({failing}) USING (event_id) GROUP BY ALL")


cte("u_cells", "SELECT event_id, rh, unit AS base, E FROM q_ucell")
cte("u_bases", "SELECT event_id, unit AS base, evt AS grp, NULL::BIGINT AS pref FROM q_un")
merging_ctes("u", "u_cells", "u_bases", "rh", 3, False)
cte("u_assign", "SELECT event_id, base AS unit, obj AS target FROM u_m")
target_ctes("v", "u_assign")
cte("p_atom", "SELECT event_id, atom, parent, target FROM q_atom JOIN u_assign USING (event_id, unit)")
cte("p_cells", """SELECT event_id, rh, target, atom AS base, sum(E) AS E FROM q_tra JOIN p_atom USING (event_id, atom)
  GROUP BY ALL""")
cte("p_bases", """SELECT a.event_id, a.atom AS base, a.target AS grp, b.atom AS pref FROM p_atom a
  LEFT JOIN p_atom b ON b.event_id = a.event_id AND b.atom = a.parent AND b.target = a.target""")
merging_ctes("p", "p_cells", "p_bases", "rh, target", 5, True)
cte("p_count", "SELECT event_id, grp AS target, count(*) AS n_pieces FROM p_o GROUP BY ALL")
for _s, _k in (("c", "rh"), ("l", "lc"), ("s", "ts")):
    scored_ctes(f"v{_s}", "v", f"w_{_k}", f"r_{_k}")
cte("i_rh", """SELECT event_id, rh AS idx, coalesce(target, -1) AS label FROM q_rh0 LEFT JOIN (
  SELECT * FROM v_cell WHERE E > 0 QUALIFY row_number() OVER (PARTITION BY event_id, rh ORDER BY E DESC, target) = 1)
  USING (event_id, rh)""")
cte("i_lct", """SELECT event_id, lc, target, sum(frac * c.E) AS E FROM q_lch m JOIN v_cell c USING (event_id, rh) GROUP BY ALL""")
cte("i_lc", """SELECT event_id, lc AS idx, coalesce(target, -1) AS label FROM q_lc0 LEFT JOIN (
  SELECT * FROM i_lct WHERE E > 0 QUALIFY row_number() OVER (PARTITION BY event_id, lc ORDER BY E DESC, target) = 1)
  USING (event_id, lc)""")


# Density clustering

#: Settings of ``score_many_settings`` besides the default and the wide one: radii, thresholds and the size cut.
MANY = (dict(dc=0.8), dict(dc=1.5), dict(rhoc=1.2), dict(outlier=2.0), dict(seeding=2.2, outlier=3.2), dict(minimum=3))


def clustering_ctes(p: str, points: str, dc: float = 1.0, rhoc: float = 0.8, outlier: float = 2.8, seeding: float = 2.8,
                    minimum: int = 2, kind: str = "FLOAT") -> None:
    """Labels {p}_raw and {p}_final of ``points`` (event_id, idx, E, x, y, z, layer, side, det, tag, active), computed in numbers
    of ``kind``."""
    def f(v) -> str:
        return f"{v}::FLOAT"

    def cte(name: str, sql: str) -> None:
        CTES[name] = sql.replace("::FLOAT", f"::{kind}")

    cte(f"{p}_a", f"""SELECT event_id, side, idx, tag, E::FLOAT AS E, x::FLOAT AS x, y::FLOAT AS y, {f(1)} / abs(z::FLOAT) AS inv,
      (CASE det WHEN 8 THEN 0.003 WHEN 9 THEN 0.006 ELSE 0.012 END)::FLOAT / {f(0.003)} AS rel,
      (layer - 1 + side * 47)::FLOAT AS zl, CASE WHEN side = 1 THEN {f(2)} * {f(max(dc, outlier))} ELSE {f(0)} END AS gap
      FROM {points} WHERE active""")
    cte(f"{p}_p", f"""SELECT event_id, side, idx, tag, E, rel, (x * inv)::FLOAT * ({f(1)} / {f(0.003)})::FLOAT AS gx,
      (y * inv)::FLOAT * ({f(1)} / {f(0.003)})::FLOAT AS gy, (zl * ({f(1)} / {f(6)})::FLOAT)::FLOAT + gap AS gz,
      (sqrt(x * x + y * y)::FLOAT * inv)::FLOAT AS r FROM {p}_a""")
    cte(f"{p}_q", f"""SELECT a.event_id, a.side, a.idx AS i, b.idx AS j, b.E AS ej,
      greatest(((sqrt((a.gx - b.gx) * (a.gx - b.gx) + (a.gy - b.gy) * (a.gy - b.gy))::FLOAT * {f(2)})::FLOAT
        / (a.rel + b.rel))::FLOAT, abs(a.gz - b.gz)) AS d
      FROM {p}_p a JOIN {p}_p b ON a.event_id = b.event_id AND a.side = b.side AND a.idx <> b.idx""")
    cte(f"{p}_n", f"SELECT * FROM {p}_q WHERE d <= {f(max(dc, outlier, seeding))}")
    cte(f"{p}_s", f"""SELECT event_id, side, i, sum(0.5::DOUBLE * ej::DOUBLE) AS s FROM {p}_n WHERE d <= {f(dc)} GROUP BY ALL""")
    cte(f"{p}_h", f"""SELECT p.*, (p.E::DOUBLE + coalesce(s, 0))::FLOAT AS rho,
      ({f(rhoc)} * pow(({f(0.42)} / r)::FLOAT::DOUBLE, 2::DOUBLE)::FLOAT)::FLOAT AS need FROM {p}_p p
      LEFT JOIN {p}_s s ON s.event_id = p.event_id AND s.side = p.side AND s.i = p.idx""")
    cte(f"{p}_up", f"""SELECT n.event_id, n.side, n.i, n.j FROM {p}_n n
      JOIN {p}_h a ON a.event_id = n.event_id AND a.side = n.side AND a.idx = n.i
      JOIN {p}_h b ON b.event_id = n.event_id AND b.side = n.side AND b.idx = n.j
      WHERE (b.rho > a.rho OR (b.rho = a.rho AND b.rho > 0 AND b.tag > a.tag))
        AND d <= CASE WHEN a.rho >= a.need THEN {f(seeding)} ELSE {f(outlier)} END
      QUALIFY row_number() OVER (PARTITION BY n.event_id, n.side, n.i ORDER BY d, b.rho DESC, b.tag DESC, n.j) = 1""")
    cte(f"{p}_l", f"""SELECT h.event_id, h.side, h.idx, coalesce(u.j, -1) AS parent, h.rho >= h.need AS dense FROM {p}_h h
      LEFT JOIN {p}_up u ON u.event_id = h.event_id AND u.side = h.side AND u.i = h.idx""")
    cte(f"{p}_w", f"""SELECT event_id, side, idx, idx AS root FROM {p}_l WHERE parent < 0
      UNION ALL SELECT l.event_id, l.side, l.idx, w.root FROM {p}_l l JOIN {p}_w w
        ON w.event_id = l.event_id AND w.side = l.side AND w.idx = l.parent""")
    cte(f"{p}_z", f"""SELECT event_id, side, idx AS root,
      row_number() OVER (PARTITION BY event_id ORDER BY side, idx) - 1 AS label FROM {p}_l WHERE parent < 0 AND dense""")
    cte(f"{p}_zz", f"""SELECT w.event_id, w.idx, label, count(*) OVER (PARTITION BY w.event_id, label) AS size FROM {p}_w w
      JOIN {p}_z z ON z.event_id = w.event_id AND z.side = w.side AND z.root = w.root""")
    for name, cond in (("raw", "true"), ("final", f"size >= {minimum}")):
        cte(f"{p}_{name}", f"""SELECT event_id, idx, coalesce(label, -1) AS label FROM (SELECT event_id, idx FROM {points})
          LEFT JOIN (SELECT * FROM {p}_zz WHERE {cond}) USING (event_id, idx)""")


cte("e_pts", """SELECT 0::BIGINT AS event_id, vec_id AS idx, ((1 + 2 * (vec_id % 7)) / 16::DOUBLE)::FLOAT AS E,
  embedding[1] * 200::FLOAT + 150::FLOAT AS x, embedding[2] * 200::FLOAT + 0::FLOAT AS y,
  CASE WHEN vec_id % 2 = 1 THEN 350::FLOAT ELSE -350::FLOAT END AS z, 1 + 4 * label AS layer, (vec_id % 2)::INTEGER AS side,
  8 + (vec_id // 2) % 3 AS det, 1000 + vec_id AS tag, true AS active FROM embeddings""")
cte("pts_lc", """SELECT event_id, lc AS idx, E, x, y, z, layer, side, det, seed AS tag,
  mask > 0 AND det IN (8, 9, 10) AS active FROM q_lc""")
cte("pts_lc_all", """SELECT event_id, lc AS idx, E, x, y, z, layer, side, det, seed AS tag,
  det IN (8, 9, 10) AND (mask > 0 OR algo IN (6, 7, 8)) AS active FROM q_lc""")
cte("pts_rh", """SELECT event_id, rh AS idx, E, x, y, z, layer, CASE WHEN z > 0 THEN 1 ELSE 0 END AS side, det, id AS tag,
  det IN (8, 9, 10) AND E > 0 AS active FROM q_rh""")
for _p, _t in (("ec", "e_pts"), ("kl", "pts_lc"), ("ka", "pts_lc_all"), ("kr", "pts_rh")):
    clustering_ctes(_p, _t)
clustering_ctes("kw", "pts_lc", dc=1.5, outlier=4.0, seeding=3.5)
clustering_ctes("ed", "e_pts", kind="DOUBLE")
for _k, _changes in enumerate(MANY):
    clustering_ctes(f"km{_k}", "pts_lc", **_changes)

# Partitions

cte("q_assign", "SELECT event_id, lc AS idx, CASE WHEN lc % 5 = 0 THEN -1 ELSE lc // 2 END AS label FROM q_lc0")
cte("q_wide", """SELECT event_id, lc AS idx, coalesce(max(ts), -1) AS label FROM q_lc0 LEFT JOIN (SELECT * FROM q_ts
  WHERE collection = 'wide') USING (event_id, lc) WHERE event_id IN (SELECT event_id FROM q_ts WHERE collection = 'wide')
  GROUP BY ALL""")


def compare_ctes(p: str, a: str, b: str, seen: str) -> None:
    cte(f"{p}_ab", f"""SELECT a.event_id, a.idx, a.label AS a, b.label AS b FROM {a} a JOIN {b} b USING (event_id, idx)
      JOIN {seen} s USING (event_id, idx) WHERE s.active""")
    cte(f"{p}_ca", f"""SELECT *, CASE WHEN a >= 0 THEN min(idx) OVER (PARTITION BY event_id, a) ELSE -1 END AS ca,
      CASE WHEN b >= 0 THEN min(idx) OVER (PARTITION BY event_id, b) ELSE -1 END AS cb,
      count(*) OVER (PARTITION BY event_id, a) AS na, count(*) OVER (PARTITION BY event_id, b) AS nb FROM {p}_ab""")
    cte(f"{p}_ok", f"""SELECT *, CASE WHEN a < 0 THEN b < 0 ELSE
      bool_and(ca = cb AND na = nb) OVER (PARTITION BY event_id, a) END AS same FROM {p}_ca""")
    cte(f"{p}_ev", f"""SELECT event_id, count(*) AS n_lc, count(*) FILTER (same) AS lc_agree,
      count(DISTINCT a) FILTER (a >= 0) AS clusters_a, count(DISTINCT b) FILTER (b >= 0) AS clusters_b,
      count(DISTINCT a) FILTER (a >= 0 AND same) AS identical_clusters,
      count(*) FILTER (a < 0 AND b >= 0) AS outliers_a, count(*) FILTER (b < 0 AND a >= 0) AS outliers_b,
      count(*) FILTER (same) / count(*)::DOUBLE AS lc_agree_frac FROM {p}_ok GROUP BY event_id""")
    counters = ("n_lc", "lc_agree", "clusters_a", "clusters_b", "identical_clusters", "outliers_a", "outliers_b")
    total = ", ".join(f"sum({c})::BIGINT AS {c}" for c in counters)
    cte(f"{p}_all", f"""SELECT {total}, count(*) FILTER (lc_agree = n_lc) AS events_identical, count(*) AS events,
      sum(lc_agree)::DOUBLE / sum(n_lc)::DOUBLE AS lc_agree_frac FROM {p}_ev""")


compare_ctes("xs", "q_lab_lc", "q_assign", "pts_lc_all")
compare_ctes("xr", "kl_raw", "q_assign", "pts_lc")
compare_ctes("xf", "kl_final", "q_wide", "pts_lc")

# Full scoring

for _s, _lab, _cells in (("d", "kl_final", True), ("w", "kw_final", True), ("ir", "i_rh", False), ("il", "i_lc", True),
                         *((f"m{_k}", f"km{_k}_final", True) for _k in range(len(MANY)))):
    if _cells:
        cte(f"w_{_s}", f"""SELECT a.event_id, label AS obj, rh, sum(frac) AS w FROM {_lab} a JOIN q_lch m
          ON m.event_id = a.event_id AND m.lc = a.idx WHERE label >= 0 GROUP BY ALL""")
    else:
        cte(f"w_{_s}", f"SELECT event_id, label AS obj, idx AS rh, 1::DOUBLE AS w FROM {_lab} WHERE label >= 0")
    cte(f"r_{_s}", f"SELECT DISTINCT event_id, label AS obj FROM {_lab} WHERE label >= 0")
    scored_ctes(f"f{_s}", "v", f"w_{_s}", f"r_{_s}")


def _settings(pairs: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS setting, metric, value FROM ({metric_sql(f'{s}_sums')})"
                              for name, s in pairs.items())


def _select(columns: str, table: str, where: str = "") -> str:
    return f"SELECT {columns} FROM {table}" + (f" WHERE {where}" if where else "")


def _metric_names() -> list[str]:
    """Names of the 46 metrics."""
    bins = ["E0-5", "E5-30", "E30-150", "E150-inf"]
    per_class = ["K", "eps", "Phi", "K_floor", "lost_other", "lost_none"]
    names = [f"{m}_{c}" for c in ("EM", "HAD") for m in per_class]
    names += [f"{m}_{c}_{b}" for c in ("EM", "HAD") for b in bins for m in per_class[:3]]
    counts = [f"{k}_per_event" for k in ("signal_objects", "pileup_objects", "noise_objects", "signal_targets")]
    return names + ["K_sig", "eps_sig", "Phi_sig", "K_pu", "eps_pu", "events"] + counts


def oracles() -> dict[str, str]:
    pts = "event_id, idx, E, x, y, z, layer, side, det, tag, active"
    sums = ", ".join(SUMS)
    totals = ", ".join(f"sum({k})::{'BIGINT' if k in WHOLE else 'DOUBLE'} AS {k}" for k in SUMS)
    flat = {
        "scan_truth_cells": "SELECT event_id, rh, atom, E FROM q_tra",
        "trackster_select": _select("event_id, collection, ts, lc, weight", "q_ts", "collection IN ('wide', 'absent')"),
        "event_slice": """SELECT event_id, count(*) AS n_cells, sum(E) AS E FROM q_rh0 WHERE event_id IN (
          SELECT event_id FROM q_event ORDER BY event_id // 10, event_id % 10 LIMIT 12 OFFSET 5) GROUP BY event_id""",
        "event_counts": """SELECT event_id, what, count(*) AS n FROM (SELECT event_id, 'lc' AS what FROM q_lc0
          UNION ALL SELECT event_id, 'rh' FROM q_rh0 UNION ALL SELECT event_id, 'unit' FROM q_un
          UNION ALL SELECT event_id, collection FROM (SELECT DISTINCT event_id, collection, ts FROM q_ts)) GROUP BY ALL""",
        "event_union": """SELECT t.event_id + k * 17592186044416 AS event_id, t.event_id // 10 + k * 4096 AS file_ordinal,
          count(*) AS n, sum(t.E) AS E FROM q_tra t JOIN q_atom a ON a.event_id = t.event_id AND a.atom = t.atom,
          range(2) r(k) GROUP BY t.event_id, k""",
        "absent_collection": f"""SELECT metric, CASE WHEN metric = 'K_sig' THEN 1.0 WHEN metric LIKE '%per_event' OR metric IN
          ('eps_sig', 'Phi_sig', 'events') THEN 0.0 ELSE 'NaN'::DOUBLE END::DOUBLE AS value
          FROM unnest({_metric_names()}) m(metric) WHERE (SELECT count(*) FROM q_event) > 0""",
        "trackster_offsets": """SELECT event_id, collection, ts, n_lc, (coalesce(sum(n_lc) OVER (PARTITION BY event_id, collection
          ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset"
          FROM (SELECT event_id, collection, ts, count(lc) AS n_lc FROM q_ts GROUP BY ALL)""",
        "trackster_owner": """SELECT event_id, collection, row_number() OVER (PARTITION BY event_id, collection ORDER BY ts, lc) - 1
          AS flat, ts, lc FROM q_ts WHERE lc IS NOT NULL""",
        "trackster_weights": """SELECT event_id, collection, lc, CASE WHEN count(*) > 1 THEN 1 / (count(*) - 1)::DOUBLE ELSE 1 END
          AS weight FROM q_ts WHERE lc IS NOT NULL GROUP BY ALL""",
        "trackster_events": "SELECT DISTINCT event_id FROM q_ts WHERE collection = 'wide'",
        "trackster_labels": "SELECT event_id, idx, label FROM q_wide",
        "points_lc": _select(pts, "pts_lc"), "points_lc_all": _select(pts, "pts_lc_all"),
        "points_rh": _select(pts, "pts_rh"),
        "unit_cells": "SELECT event_id, rh, unit, E FROM q_ucell",
        "unit_energy": "SELECT event_id, unit, dep AS E FROM q_unit",
        "target_cells": "SELECT event_id, rh, target, E FROM g_cell",
        "target_energy": "SELECT event_id, target, E FROM g_t",
        "target_units": "SELECT event_id, target, n_units FROM g_t",
        "target_signal": "SELECT event_id, target, signal FROM g_t",
        "target_class": "SELECT event_id, target, em FROM g_t",
        "target_lead_unit": "SELECT event_id, target, lead_unit FROM g_t",
        "atom_target": "SELECT event_id, atom, target FROM q_atom JOIN q_given USING (event_id, unit)",
        "atom_parent_pruned": """SELECT a.event_id, a.atom, coalesce(b.atom, -1) AS parent, a.target FROM q_moved a LEFT JOIN q_moved b
            ON b.event_id = a.event_id AND b.atom = a.parent AND b.target = a.target""",
        "confusion_matrix": "SELECT event_id, dom, obj, v FROM q_uconf",
        "confusion_symmetric": """SELECT event_id, dom, obj, sum(v) AS v FROM (SELECT * FROM q_uconf UNION ALL
          SELECT event_id, obj, dom, v FROM q_uconf) GROUP BY ALL""",
        "ideal_quality": "SELECT event_id, obj AS unit, E, completeness, purity FROM u_o0",
        "dominant_target": "SELECT event_id, rh, dom, E FROM q_ucell2 WHERE pos = 1",
        "cell_floor": 'SELECT event_id, rh, E, most AS top, floor FROM g_floor',
        "merge_round0_fail": "SELECT event_id, obj AS unit FROM u_f0",
        "merge_round0_partner": "SELECT event_id, obj AS unit, nxt AS partner FROM u_e0 WHERE nxt IS NOT NULL",
        "merge_components": "SELECT event_id, obj, comp FROM u_y0",
        "merged_targets": """SELECT event_id, target, v_t.E, signal, em, unreachable, n_units, completeness, purity
          FROM v_t JOIN (SELECT event_id, obj AS target, unreachable, completeness, purity FROM u_o) USING (event_id, target)""",
        "merged_units": "SELECT event_id, base AS unit, obj AS target, merged_at, partner FROM u_m",
        "merge_rounds": "SELECT event_id, n_iterations::BIGINT AS n_iterations FROM u_it",
        "natural_pieces": "SELECT event_id, target, n_pieces FROM p_count",
        "truth_totals": """SELECT * FROM (SELECT count(*) / 30::DOUBLE AS targets,
            count(*) FILTER (signal) / 30::DOUBLE AS signal_targets, count(*) FILTER (unreachable) / 30::DOUBLE AS unreachable,
            count(*) FILTER (unreachable AND signal) / 30::DOUBLE AS signal_unreachable,
            sum(CASE WHEN signal THEN v_t.E ELSE 0 END) / 30::DOUBLE AS E_signal,
            sum(CASE WHEN signal THEN 0 ELSE v_t.E END) / 30::DOUBLE AS E_pileup,
            1 - sum(CASE WHEN signal THEN v_t.E ELSE 0 END) / sum(CASE WHEN signal THEN v_t.E * n_pieces ELSE 0 END)
              AS Phi_nat_signal
            FROM v_t JOIN (SELECT event_id, obj AS target, unreachable FROM u_o) USING (event_id, target)
            JOIN p_count USING (event_id, target)),
          (SELECT count(*) / 30::DOUBLE AS units, count(*) FILTER (merged_at >= 0) / 30::DOUBLE AS merged_units FROM u_m),
          (SELECT sum(n_iterations) / 30::DOUBLE AS iterations FROM u_it),
          (SELECT sum(no_truth) / 30::DOUBLE AS E_no_truth FROM q_rh0), (SELECT count(*) AS events FROM q_event)""",
        "ideal_labels_rh": "SELECT event_id, idx, label FROM i_rh",
        "ideal_labels_lc": "SELECT event_id, idx, label FROM i_lc",
        "objects_rh": """SELECT event_id, dense_rank() OVER (PARTITION BY event_id ORDER BY label) - 1 AS obj, idx AS rh
          FROM q_lab_rh WHERE label >= 0""",
        "objects_lc": "SELECT event_id, obj, rh, w FROM w_lc",
        "objects_tracksters": "SELECT event_id, obj, rh, w FROM w_ts",
        "lc_truth": """SELECT event_id, lc, target, sum(frac * c.E) AS E FROM q_lch m JOIN g_cell c USING (event_id, rh)
          GROUP BY ALL""",
        "shares": "SELECT event_id, obj, target, share FROM gc_share",
        "assign_best": "SELECT event_id, obj, best, own FROM gc_obj",
        "object_energy": "SELECT event_id, obj, E FROM gc_obj",
        "object_floor": "SELECT event_id, obj, floor FROM gc_obj",
        "object_signal_energy": "SELECT event_id, obj, in_signal FROM gc_obj",
        "eval_objects": "SELECT event_id, obj, best, own, E, signal, cls, ebin FROM gl_obj WHERE best >= 0",
        "noise_objects": "SELECT event_id, obj FROM gs_obj WHERE best < 0",
        "target_collected": "SELECT event_id, target, c, n FROM gc_col",
        "target_in_any": "SELECT event_id, target, in_any FROM gc_col",
        "sums_signal_objects": total_sums("gc", ["k_num", "k_den", "k_floor", "n_obj"]),
        "sums_pileup_objects": total_sums("gc", ["pu_sig", "pu_den", "n_pu_obj"]),
        "sums_signal_targets": total_sums("gc", ["e_num", "e_den", "f_c", "f_cn", "lost_other", "lost_none", "n_targets",
                                                 "n_targets_obj"]),
        "sums_pileup_targets": total_sums("gc", ["pu_eps_num", "pu_eps_den"]),
        "sums_counters": "SELECT sum(n_noise_obj)::BIGINT AS n_noise_obj, sum(events)::BIGINT AS events FROM gc_sums",
        "evaluate_sums": f"SELECT event_id, cls, ebin, {sums} FROM gc_sums",
        "combine_sums": f"SELECT cls, ebin, {totals} FROM gc_sums GROUP BY cls, ebin",
        "stored_sums": f"SELECT cls, ebin, {totals} FROM gc_sums GROUP BY cls, ebin",
        "summary_metrics": metric_sql("gc_sums"),
        "mean_over_samples": f"""SELECT metric, CASE WHEN metric = 'events' THEN sum(value)
            WHEN count(*) FILTER (NOT isnan(value)) > 0 THEN sum(value ORDER BY sample) FILTER (NOT isnan(value)) / count(*) FILTER (NOT isnan(value))
            ELSE 'NaN'::DOUBLE END AS value
          FROM ({metric_sql('(SELECT event_id % 3 AS sample, * FROM gc_sums)', 'sample')}) GROUP BY metric""",
        "summary_pivot": f"""SELECT metric, max(value) FILTER (setting = 'cells') AS cells, max(value) FILTER (setting = 'groups')
          AS groups, max(value) FILTER (setting = 'stored') AS stored
          FROM ({_settings(dict(cells='gc', groups='gl', stored='gs'))}) GROUP BY metric""",
        "summary_merged": _settings(dict(cells="vc", groups="vl", stored="vs")),
        "point_coordinates": "SELECT event_id, side, idx, gx, gy, gz, rel, r FROM ec_p",
        "neighbour_pairs": "SELECT event_id, side, i, j, d FROM ec_n",
        "density_points": "SELECT event_id, side, idx, rho, rho >= need AS dense FROM ec_h",
        "nearest_higher": "SELECT event_id, side, idx, parent FROM ec_l",
        "chain_root": "SELECT event_id, side, idx, root FROM ec_w",
        "cluster_labels": "SELECT event_id, idx, label FROM ec_raw",
        "cluster_labels_final": "SELECT event_id, idx, label FROM ec_final",
        "cluster_labels_double": "SELECT event_id, idx, label FROM ed_final",
        "cluster_labels_lc": "SELECT event_id, idx, label FROM kl_final",
        "cluster_labels_lc_all": "SELECT event_id, idx, label FROM ka_final",
        "cluster_labels_rh": "SELECT event_id, idx, label FROM kr_final",
        "canonical_labels": """SELECT event_id, idx, CASE WHEN label >= 0 THEN min(idx) OVER (PARTITION BY event_id, label)
          ELSE -1 END AS label FROM q_lab_lc""",
        "partition_compare": "SELECT * FROM xs_ev", "closure_agg": "SELECT * FROM xs_all",
        "closure_raw": "SELECT * FROM xr_all", "closure_final": "SELECT * FROM xf_all",
        "score_many_settings": _settings({"default": "fd", "wide": "fw"} | {f"many{k}": f"fm{k}" for k in range(len(MANY))}
                                         | {"ideal_rh": "fir", "ideal_lc": "fil"}),
        "score_settings": _settings({"default": "fd", "wide": "fw", "ideal_rh": "fir", "ideal_lc": "fil",
                                     "stored:main": "vs"}),
    }
    return {name: render(sql) for name, sql in flat.items()}

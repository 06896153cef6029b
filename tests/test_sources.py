"""Nested records, stored samples, settings files and the command line."""
import json
import math

import pytest
from conftest import Sample
from pyspark.sql import functions as F

from showerframe import Params
from showerframe.cli import main
from showerframe.operators.closure import collection_labels
from showerframe.plans.score import Truth
from showerframe.sources import files, settings

REAL = {"E": "float", "x": "float", "y": "float", "z": "float", "mask": "float", "noTruthE": "float", "depE": "float", "frac": "double",
        "mult": "double"}


def record(event, extra=True):
    """One nested record: four cells, four groups of one cell, two atoms in two units."""
    n = 4
    row = {"event": event}
    for f in files.GROUPS["lc"]:
        row[f"lc_{f}"] = {"E": [2.0, 2.0, 1.0, 3.0], "x": [150.0] * n, "y": [0.0] * n, "z": [351.0, 352.0, 353.0, 354.0],
                          "layer": [1, 2, 3, 4], "side": [1] * n, "det": [8] * n, "algo": [6] * n,
                          "seed": [1000, 1001, 1002, 1003], "mask": [1.0] * n}[f]
    for f in files.GROUPS["rh"]:
        row[f"rh_{f}"] = {"id": [1, 2, 3, 4], "lc": [0, 1, 2, 3], "noTruthE": [0.0] * n}.get(f, row.get(f"lc_{f}"))
    row |= {"lch_lc": [0, 1, 2, 3], "lch_rh": [0, 1, 2, 3], "lch_frac": [1.0] * n}
    row |= {"at_id": [7, 8], "at_pdg": [211, 22], "at_parent": [-1, 0], "at_unit": [0, 1]}
    row |= {f"un_{f}": [v, w] for f, v, w in (("id", 70, 80), ("pdg", 211, 22), ("kind", 0, 0), ("signal", 1, 1),
                                              ("bx", 0, 0), ("evt", 0, 1), ("depE", 4.0, 4.0))}
    row |= {"tra_rh": [0, 1, 2, 3], "tra_at": [0, 0, 1, 1], "tra_E": [2.0, 2.0, 1.0, 3.0]}
    if extra:
        row[files.ASSIGNMENT] = [0, 0, 0, -1]
        row |= {"ts_b_nLC": [2, 0, 2], "ts_b_lc": [0, 1, 1, 2], "ts_b_mult": [1.0, 2.0, 2.0, 0.0]}
        row |= {"ts_a_nLC": [4], "ts_a_lc": [0, 1, 2, 3], "ts_a_mult": [1.0] * 4}
    return row


def records(spark, rows):
    kind = {n: "bigint" if not isinstance(v, list) else f"array<{REAL.get(n.split('_')[-1], 'bigint')}>" for n, v in rows[0].items()}
    return spark.createDataFrame([tuple(r[n] for n in kind) for r in rows], ", ".join(f"{n} {t}" for n, t in kind.items()))


@pytest.fixture(scope="module")
def nested(spark):
    return records(spark, [record(11), record(12)])


@pytest.fixture(scope="module")
def folder(nested, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sample") / "s")
    files.write_tables(files.from_records(nested), path)
    return path


def test_records_become_tables(nested):
    t = files.from_records(nested)
    assert t.rh.count() == 8 and t.tra.columns == ["event_id", "rh", "atom", "E"]
    assert [tuple(r) for r in t.atom.filter("event_id = 11").orderBy("atom").collect()] == [
        (11, 0, 7, 211, -1, 0), (11, 1, 8, 22, 0, 1)]
    assert [r["label"] for r in t.assign.filter("event_id = 12").orderBy("lc").collect()] == [0, 0, 0, -1]


def test_ragged_collections(nested):
    assert files.collections_of(nested) == ["a", "b"]
    t = files.from_records(nested)
    rows = t.trackster_lc.filter("event_id = 11 AND collection = 'b'").orderBy("ts", "pos").collect()
    assert [(r["ts"], r["pos"], r["lc"], r["weight"]) for r in rows] == [
        (0, 0, 0, 1.0), (0, 1, 1, 0.5), (1, None, None, 1.0), (2, 0, 1, 0.5), (2, 1, 2, 1.0)]
    off = files.offsets(t.trackster_lc).filter("event_id = 11 AND collection = 'b'").orderBy("ts").collect()
    assert [(r["ts"], r["n_lc"], r["offset"]) for r in off] == [(0, 2, 0), (1, 0, 2), (2, 2, 2)]
    own = files.owner_rows(t.trackster_lc).filter("event_id = 11 AND collection = 'b'").orderBy("flat").collect()
    assert [(r["flat"], r["ts"], r["lc"]) for r in own] == [(0, 0, 0), (1, 0, 1), (2, 2, 1), (3, 2, 2)]


def test_shared_group_keeps_the_last_trackster(nested):
    t = files.from_records(nested)
    got = collection_labels(t.lc, t.trackster_lc, "b").filter("event_id = 11").orderBy("idx").collect()
    assert [r["label"] for r in got] == [0, 2, 2, -1]


def test_selected_collections_and_missing_parts(nested, spark):
    some = files.from_records(nested, collections=["b", "absent"])
    assert [r[0] for r in some.trackster_lc.select("collection").distinct().collect()] == ["b"]
    bare = files.from_records(records(spark, [record(1, extra=False)]))
    assert bare.assign is None and bare.trackster_lc is None
    with pytest.raises(ValueError, match="lc_E.*lc_z.*\\.\\.\\."):
        files.from_records(nested.drop(*[f"lc_{f}" for f in files.GROUPS["lc"]]))


def test_stored_samples_round_trip(spark, folder):
    t = files.read_tables(spark, folder)
    assert t.tra.count() == 8 and t.assign is not None
    both = files.read_tables(spark, folder, folder)
    assert both.event.select("event_id").distinct().count() == both.event.count() == 4
    assert both.event.select("file_ordinal").distinct().count() == 2
    joined = both.tra.join(both.atom, ["event_id", "atom"])
    assert joined.count() == 16 and joined.agg(F.sum("E")).first()[0] == 2 * t.tra.agg(F.sum("E")).first()[0]
    plan = t.trackster_lc.filter("collection = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(collection" in plan


def test_equal_event_numbers_stay_apart(spark, folder, ws):
    """Two samples with the same numbers score as the sum of both."""
    one, two = (files.read_tables(spark, *[folder] * k) for k in (1, 2))
    sums = [Truth(ws, t).score_collection("b").sums() for t in (one, two)]
    a, b = ({(r["cls"], r["ebin"]): r.asDict() for r in s.collect()} for s in sums)
    assert all(b[k][c] == pytest.approx(2 * v) for k, row in a.items() for c, v in row.items() if c not in ("cls", "ebin"))
    rows = [{**record(7), "file_ordinal": k, "entry": 0} for k in (0, 1)]
    t = files.from_records(records(spark, rows))
    assert t.event.select("event_id").distinct().count() == 2 and [r[0] for r in t.event.select("number").collect()] == [7, 7]
    with pytest.raises(ValueError, match="several records"):
        files.from_records(records(spark, [record(7), record(7)]))


def test_event_ranges_follow_file_order(spark, folder):
    t = files.read_tables(spark, folder)
    assert files.take_events(t) is t
    assert [r[0] for r in files.take_events(t, 1).event.select("event_id").collect()] == [11]
    later = files.take_events(t, 0, 1)
    assert [r[0] for r in later.event.select("event_id").collect()] == [12] and later.rh.count() == 4


def test_many_folders_are_one_scan_per_table(spark, folder):
    paths = [folder] * 40
    t = files.read_tables(spark, *paths)
    assert t.event.count() == t.event.select("event_id").distinct().count() == 80 and t.tra.count() == 40 * 8
    for df in (t.tra, t.rh, t.assign):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parquet") == 1 and "Union" not in plan
    assert t.trackster_lc.filter("collection = 'b'").count() == 40 * files.read_tables(spark, folder).trackster_lc.filter(
        "collection = 'b'").count()
    rows = {r["ordinal"]: r for r in files.manifest(spark, *paths).collect()}
    assert len(rows) == 40 and (rows[7]["before"], rows[7]["events"], rows[7]["first_id"], rows[7]["last_id"]) == (14, 2, 11, 12)


def test_ranges_read_only_their_folders(spark, folder, tmp_path):
    other = str(tmp_path / "with space")
    files.write_tables(files.from_records(records(spark, [record(3), record(4), record(5)])), other)
    full = files.read_tables(spark, folder, other, folder)
    order = [r[0] for r in full.event.orderBy("file_ordinal", "entry").collect()]
    assert len(order) == 7 and order == sorted(order)
    for start, n in ((0, 3), (1, 3), (2, 3), (4, 0), (6, 5), (9, 2)):
        some = files.read_tables(spark, folder, other, folder, max_events=n, start=start)
        want = order[start:start + n] if n else order[start:]
        assert sorted(r[0] for r in some.event.select("event_id").collect()) == want
        assert some.rh.select("event_id").distinct().count() == len(want)
        same = files.take_events(full, n, start)
        assert sorted(r[0] for r in same.event.select("event_id").collect()) == want
    read = files.read_tables(spark, folder, other, folder, max_events=2, start=3).rh.inputFiles()
    assert read and all("with%20space" in f for f in read)


def test_event_ranges_of_ids_out_of_order(spark):
    """Ids that do not follow the order of files: a range of ids is not enough."""
    t = files.from_records(records(spark, [record(k) for k in range(6)]))
    moved = F.col("event_id")
    file, entry = (moved % 3).cast("long"), (moved * 5 % 6).cast("long")
    t = type(t)(**{**t.__dict__, "event": t.event.withColumns({"file_ordinal": file, "entry": entry})})
    order = sorted(range(6), key=lambda k: (k % 3, k * 5 % 6))
    for start, n in ((0, 1), (0, 4), (1, 2), (1, 4), (5, 3), (3, 0)):
        some = files.take_events(t, n, start)
        want = sorted(order[start:start + n] if n else order[start:])
        assert sorted(r[0] for r in some.event.select("event_id").collect()) == want
        assert sorted(r[0] for r in some.rh.select("event_id").distinct().collect()) == want
    plan = files.take_events(t, 2, 0).rh._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "event_id" in plan


def test_more_files_than_twelve_bits_tell(spark):
    rows = [{**record(7), "file_ordinal": k, "entry": e} for k, e in ((0, 0), (9_999, 3), (70_000, 2))]
    t = files.from_records(records(spark, rows))
    assert t.event.select("event_id").distinct().count() == 3 and t.tra.join(t.event, "event_id").count() == 12
    for bad in ((-1, 0), (1 << 40, 1 << 30)):
        with pytest.raises(ValueError, match="44 bits"):
            files.from_records(records(spark, [{**record(7), "file_ordinal": bad[0], "entry": bad[1]}]))


def test_file_ordinals_of_large_folders_stay_apart(spark, tmp_path):
    path = str(tmp_path / "wide")
    files.write_tables(files.from_records(records(spark, [{**record(7), "file_ordinal": k, "entry": 0} for k in (0, 4_096)])), path)
    both = files.read_tables(spark, path, path)
    assert [r[0] for r in both.event.orderBy("event_id").select("file_ordinal").collect()] == [0, 4_096, 8_192, 12_288]


def test_settings_files(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps([{"name": "a", "dc": 2.0, "sigmaT": [1, 2, 3]}, {}]))
    listed = settings.read_settings(str(path))
    assert Params.from_setting(listed[0]) == Params(dc=2.0, sigmaT=(1, 2, 3)) and Params.from_setting({}) == Params()
    assert Params().with_(dc=3.0).as_dict()["dc"] == 3.0
    path.write_text(json.dumps([{"radius": 1}]))
    with pytest.raises(TypeError):
        settings.read_settings(str(path))


def test_command_line(spark, folder, tmp_path, capsys):
    out = tmp_path / "out.json"
    conf = tmp_path / "s.json"
    conf.write_text(json.dumps([{"name": "near"}]))
    main(["score", folder, "--level", "rh", "--settings", str(conf), "--collection", "b", "-o", str(out)], spark)
    table = json.loads(out.read_text())
    assert list(table) and set(table) == {"near", "ideal_rh", "ideal_lc", "stored:b"}
    assert table["ideal_rh"]["eps_sig"] == 1 and table["near"]["events"] == 2 and len(table["near"]) == 46
    assert table["stored:b"]["noise_objects_per_event"] == 1 and math.isnan(table["near"]["K_pu"])
    text = capsys.readouterr().out
    head = text.splitlines()[0].split(" | ")
    assert "K_EM" in text and "K_EM_E0-5" not in text and len(text.splitlines()) == 6 and len(head) == 1 + 46 - 24
    main(["truth", folder, "--nev", "1"], spark)
    assert json.loads(capsys.readouterr().out)["events"] == 1
    main(["closure", folder, "--collection", "b"], spark)
    raw, final = map(json.loads, capsys.readouterr().out.splitlines())
    assert (raw["result"], raw["n_lc"], final["result"]) == ("raw", 8, "final:b")
    main(["score", folder, "--collection", "absent", "-o", str(out)], spark)
    assert json.loads(out.read_text())["stored:absent"]["K_sig"] == 1
    with pytest.raises(SystemExit, match="several collections"):
        main(["closure", folder], spark)
    with pytest.raises(SystemExit):
        main(["score", folder, "--level", "cells"], spark)


def test_columns_of_tables_are_checked(spark, ws):
    s = Sample()
    s.event("any", {0: {0: 1.0}})
    tables = s.tables(spark, ws)
    with pytest.raises(ValueError, match="tra: missing columns \\['E'\\]"):
        type(tables)(**{**tables.__dict__, "tra": tables.tra.drop("E")})


def test_workspace_folder_and_cleanup(spark, tmp_path):
    from showerframe import Workspace

    with Workspace(spark, str(tmp_path / "shared")) as ws:
        a = ws.save(spark.range(3), "a")
        with ws.child() as tmp:
            b, seen = tmp.save_counting(a.filter("id > 0"), "b", n=F.count("*"))
            assert b.count() == 2 and seen == {"n": 2} and tmp.path.startswith(ws.path)
            folder = tmp.path
        assert not (tmp_path / folder).exists() and a.count() == 3
        ws.release(a)
        assert not list((tmp_path / "shared").glob("*/0001-a"))
    assert not list((tmp_path / "shared").iterdir())


def test_new_folders_alone_are_scored(spark, folder, tmp_path, ws, monkeypatch):
    from showerframe.plans import increments
    from showerframe.plans.score import score

    other, state = str(tmp_path / "other"), str(tmp_path / "state")
    files.write_tables(files.from_records(records(spark, [record(3)])), other)
    seen = []
    read = files.read_tables
    monkeypatch.setattr(increments.files, "read_tables", lambda spark, *paths: seen.append(paths) or read(spark, *paths))
    conf = [{"name": "near"}]

    def values(df):
        return {(r["setting"], r["metric"]): r["value"] for r in df.collect()}

    first, done = increments.score_folders(spark, state, [folder], conf, collection="b")
    first = values(first)
    assert len(done) == 1 and first[("near", "events")] == 2
    again, done = increments.score_folders(spark, state, [folder, f"{folder}/"], conf, collection="b")
    assert not done and values(again) == pytest.approx(first, nan_ok=True)
    both, done = increments.score_folders(spark, state, [folder, other], conf, collection="b")
    assert [d.rsplit("/", 1)[1] for d in done] == ["other"] and len(seen) == 2
    whole = values(score(ws, read(spark, folder, other), conf, collection="b"))
    assert whole[("near", "events")] == 3 and values(both) == pytest.approx(whole, nan_ok=True)


def test_stored_sums_survive_interruption_and_change(spark, tmp_path):
    from showerframe.operators.partials import PartialSums
    from showerframe.schema import SUM_KEYS

    kept = PartialSums(spark, str(tmp_path / "s"))
    assert kept.total() is None and kept.samples() == []

    def sums(n):
        return lambda: spark.range(1).select(F.lit(0).alias("cls"), F.lit(0).alias("ebin"), *[F.lit(float(n)).alias(k) for k in SUM_KEYS])

    def total():
        return kept.total().first()["events"]

    assert kept.add("a", "1", sums(1)) and kept.add("b", "1", sums(10)) and not kept.add("b", "1", sums(99))
    assert total() == 11 and kept.samples() == ["a", "b"]
    assert kept.add("a", "2", sums(2)) and total() == 12  # a changed sample takes the place of its former self
    done = list((tmp_path / "s").glob("*/*/*/_SUCCESS"))
    done[0].unlink()
    assert total() in (2, 10) and len(kept.samples()) == 1  # what was not written to the end does not count
    assert kept.add("a", "2", sums(2)) != kept.add("b", "1", sums(10)) and total() == 12
    other = PartialSums(spark, str(tmp_path / "s"), "something else")
    assert other.total() is None and other.add("a", "2", sums(5)) and total() == 12

"""Stored samples: long Parquet tables, and nested records with one row per event."""
from __future__ import annotations

import hashlib
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from showerframe.functions.ranking import totals_before
from showerframe.functions.scalars import share_weight
from showerframe.schema import OPTIONAL, REQUIRED, SCHEMAS, EventTables, check_columns

EV = "event_id"

# Fixed names of the nested record: group prefix, its fields, and the table each becomes.
GROUPS = {
    "lc": ("E", "x", "y", "z", "layer", "side", "det", "algo", "seed", "mask"),
    "rh": ("id", "E", "x", "y", "z", "layer", "det", "lc", "noTruthE"),
    "lch": ("lc", "rh", "frac"),
    "at": ("id", "pdg", "parent", "unit"),
    "un": ("id", "pdg", "kind", "signal", "bx", "evt", "depE"),
    "tra": ("rh", "at", "E"),
}
ASSIGNMENT = "clue_assignment"
_COLLECTION = re.compile("collection=")
BRANCHES = [f"{g}_{f}" for g, fields in GROUPS.items() for f in fields] + ["event"]
INDEX = {"lc": "lc", "rh": "rh", "at": "atom", "un": "unit"}  # groups whose array position is the key
RENAMED = {("tra", "at"): "atom"}

# An event is an entry of a file: its id is made of the ordinals of folder, file and entry. The number that an event
# carries may repeat from file to file and is kept as an attribute only. How many of the bits below FOLDER_BITS tell files
# and how many tell entries follows from the records.
FOLDER_BITS = 44
FOLDER_STEP = 1 << FOLDER_BITS
FILE_STEP = 4096  # file ordinals of one folder, or the next power of two that holds them


def write_tables(tables: EventTables, path: str) -> None:
    """One Parquet folder per table; collections are partitions, so selecting one prunes files."""
    for name in REQUIRED + OPTIONAL:
        df = getattr(tables, name)
        if df is not None:
            writer = df.write.partitionBy("collection") if name == "trackster_lc" else df.write
            writer.parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, *paths: str, max_events: int = 0, start: int = 0) -> EventTables:
    """Sample stored by ``write_tables``; several folders make one sample, in the order given. The ids of each folder's
    events move to a range of its own, so events of different folders stay apart whatever ids they were stored with.
    Optional tables are those that every folder has; columns are those of the first folder. A table is one scan, however
    many folders there are (``trackster_lc``: one for each collection).

    With ``max_events`` or ``start`` only that range of events is kept (``take_events``), and folders outside it are not
    read."""
    if len(paths) == 1:
        return take_events(EventTables(**{n: spark.read.parquet(f"{paths[0]}/{n}") for n in REQUIRED + OPTIONAL
                                          if n in REQUIRED or _subfolders(spark, f"{paths[0]}/{n}") is not None}), max_events, start)
    listed = manifest(spark, *paths).collect()  # a row for each path of this call
    step = max([FILE_STEP] + [1 << (r["files"] - 1).bit_length() for r in listed if r["files"] > 0])
    stop = start + max_events if max_events else float("inf")
    inside = sorted(((r["ordinal"], r["before"]) for r in listed if r["before"] < stop and r["before"] + r["events"] > start))
    some = (inside or [(0, 0)]) if max_events or start else [(k, 0) for k in range(len(paths))]
    kept, skipped = [(k, paths[k]) for k, _ in some], some[0][1]
    found = {}
    for name in REQUIRED + OPTIONAL:
        parts = {k: _subfolders(spark, f"{path}/{name}") for k, path in enumerate(paths)} if name in OPTIONAL else {}
        if None in parts.values():
            continue
        if name != "trackster_lc":
            df = _moved(_scan(spark, [(k, f"{path}/{name}") for k, path in kept], f"{paths[0]}/{name}"), step)
        else:
            homes: dict[str, list] = {}
            for k, path in kept:
                for part in filter(_COLLECTION.match, parts[k]):
                    homes.setdefault(part, []).append((k, f"{path}/{name}/{part}"))
            stored = [_moved(_scan(spark, places, places[0][1]), step).withColumn("collection", F.lit(_unescaped(spark, part)))
                      for part, places in sorted(homes.items())]
            df = reduce(DataFrame.unionByName, stored or [spark.createDataFrame([], SCHEMAS[name])])
        found[name] = df
    return take_events(EventTables(**found), max_events, start - skipped)


def manifest(spark: SparkSession, *paths: str) -> DataFrame:
    """(ordinal, folder, events, files, first_id, last_id, before) of every path, in one scan of the event tables: how many
    events it stores, one more than its largest file ordinal, its range of stored ids, and the events of all paths before it."""
    places = [(k, f"{path}/event") for k, path in enumerate(paths)]
    rows = _scan(spark, places, places[0][1])
    file = F.col("file_ordinal") if "file_ordinal" in rows.columns else F.lit(0)
    found = rows.groupBy("_ordinal").agg(F.count("*").alias("events"), (F.max(file) + 1).alias("files"),
                                         F.min(EV).alias("first_id"), F.max(EV).alias("last_id"))
    named = _local(spark, _ordinal=list(range(len(paths))), folder=list(paths))
    all_of = named.join(found, "_ordinal", "left").select(
        F.col("_ordinal").alias("ordinal"), "folder", F.coalesce("events", F.lit(0)).alias("events"),
        F.coalesce("files", F.lit(0)).cast("long").alias("files"), "first_id", "last_id")
    return totals_before(all_of, [], "ordinal", "events", "before")


def _scan(spark: SparkSession, places: list[tuple[int, str]], first: str) -> DataFrame:
    """One scan of Parquet folders, each row with the ordinal of its folder as ``_ordinal``, found by the name of its file.
    A folder listed twice gives its rows twice. The columns are those of ``first``."""
    homes = [_uri(spark, folder) for _, folder in places]
    known = _local(spark, _home=homes, _ordinal=[k for k, _ in places])
    path, file = F.col("_metadata.file_path"), F.col("_metadata.file_name")
    home = F.substr(path, F.lit(1), F.length(path) - F.length(file) - 1)
    home = F.when(home.startswith("file:///"), F.concat(F.lit("file:/"), F.substr(home, F.lit(9)))).otherwise(home)
    rows = spark.read.schema(spark.read.parquet(first).schema).parquet(*dict(zip(homes, [f for _, f in places])).values())
    columns = rows.columns
    ordinal = F.coalesce("_ordinal", F.raise_error(F.concat(F.lit("no folder of this sample: "), F.col("_home"))).cast("long"))
    return rows.select("*", home.alias("_home")).join(known, "_home", "left").select(*columns, ordinal.alias("_ordinal"))


def _full(spark: SparkSession, folder: str):
    """(file system, full path) of a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs, fs.makeQualified(p)


def _uri(spark: SparkSession, folder: str) -> str:
    return _full(spark, folder)[1].toUri().toString().replace("file:///", "file:/", 1)


def address(spark: SparkSession, folder: str) -> str:
    """One name for each folder, however it was written."""
    return _full(spark, folder)[1].toString()


def fingerprint(spark: SparkSession, folder: str) -> str:
    """Changes with any file of a folder: names, lengths and times of its files."""
    fs, p = _full(spark, folder)
    found, listed = [], fs.listFiles(p, True)
    while listed.hasNext():
        f = listed.next()
        found.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def _moved(rows: DataFrame, step: int) -> DataFrame:
    """Rows of ``_scan`` with the event ids and file ordinals of each folder in a range of its own."""
    fits = F.col(EV).between(0, FOLDER_STEP - 1)
    moved = F.when(fits, F.col(EV) + F.col("_ordinal") * FOLDER_STEP).otherwise(
        F.raise_error(F.lit(f"event ids of one folder have to lie below {FOLDER_STEP}")).cast("long"))
    rows = rows.withColumn(EV, moved)
    if "file_ordinal" in rows.columns:
        rows = rows.withColumn("file_ordinal", (F.col("file_ordinal") + F.col("_ordinal") * step).cast("long"))
    return rows.drop("_ordinal")


def _local(spark: SparkSession, **columns: list) -> DataFrame:
    """A table of the driver, whose size the planner knows: it is broadcast only below ``autoBroadcastJoinThreshold``."""
    return spark.createDataFrame(pa.table(columns))


def _subfolders(spark: SparkSession, path: str) -> list[str] | None:
    """Names in a folder, None if it does not exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else None


def _unescaped(spark: SparkSession, part: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(part.split("=", 1)[1])


def take_events(tables: EventTables, max_events: int = 0, start: int = 0) -> EventTables:
    """Events ``start`` to ``start + max_events`` in file order (file ordinal, entry, id); 0 keeps all.

    Files are counted first. Those wholly inside are taken as they are; only the first and the last file are sorted. Every
    table is then read by a range of ids, which prunes files of stored tables; where that range holds other events too,
    the chosen ones are joined."""
    if not max_events and not start:
        return tables
    event = tables.event
    file = F.col("file_ordinal") if "file_ordinal" in event.columns else F.lit(0)
    event = event.withColumn("_file", F.coalesce(file, F.lit(0)).cast("long"))
    order = [c for c in ("entry", EV) if c in event.columns]
    counted = totals_before(event.groupBy("_file").agg(F.count("*").alias("n")), [], "_file", "n", "before")
    touched = counted.filter(F.col("before") + F.col("n") > start)
    if max_events:
        touched = touched.filter(F.col("before") < start + max_events)
    place = F.struct("_file", "before", "n")
    ends = touched.agg(F.min(place).alias("first"), F.max(place).alias("last")).first()
    first, last = ends["first"], ends["last"]
    if first is None:
        return tables.only_events(event.filter(F.lit(False)))
    stop = start + max_events if max_events else last["before"] + last["n"]
    head = event.filter(F.col("_file") == first["_file"]).orderBy(*order)
    if start > first["before"]:
        head = head.offset(start - first["before"])
    if stop < first["before"] + first["n"]:
        head = head.limit(stop - max(start, first["before"]))
    chosen = head
    if last["_file"] != first["_file"]:
        tail = event.filter(F.col("_file") == last["_file"]).orderBy(*order)
        if stop < last["before"] + last["n"]:
            tail = tail.limit(stop - last["before"])
        chosen = head.union(event.filter((F.col("_file") > first["_file"]) & (F.col("_file") < last["_file"]))).union(tail)
    ids = chosen.agg(F.min(EV).alias("low"), F.max(EV).alias("high"), F.count("*").alias("n")).first()
    within = F.col(EV).between(ids["low"], ids["high"])
    ranged = tables.filtered(within)
    return ranged if event.filter(within).count() == ids["n"] else ranged.only_events(chosen)


def collections_of(record: DataFrame) -> list[str]:
    """Names of the trackster collections that a nested record stores, found by column pattern."""
    return sorted(c[3:-3] for c in record.columns if c.startswith("ts_") and c.endswith("_lc"))


def from_records(record: DataFrame, collections: list[str] | None = None) -> EventTables:
    """Long tables of nested records (one row per event, one array per field). ``collections`` keeps the named ones;
    names that are not stored are ignored.

    Records are told apart by ``file_ordinal`` and ``entry``; without the latter, by the event number. Two records with
    the same pair are an error. Any number of files fits, as long as ordinals and entries together need 44 bits."""
    check_columns(record, BRANCHES, "event record")
    if "entry" not in record.columns:
        record = record.withColumn("entry", F.col("event").cast("long"))
    if "file_ordinal" not in record.columns:
        record = record.withColumn("file_ordinal", F.lit(0).cast("long"))
    places = record.groupBy("file_ordinal", "entry").count()
    seen = places.agg(*[f("file_ordinal").alias(f"file_{n}") for n, f in (("low", F.min), ("high", F.max))],
                      *[f("entry").alias(f"entry_{n}") for n, f in (("low", F.min), ("high", F.max))],
                      F.max_by(F.struct("file_ordinal", "entry", "count"), "count").alias("most"),
                      F.count_if(F.col("file_ordinal").isNull() | F.col("entry").isNull()).alias("nulls")).first()
    if seen["most"] and seen["most"]["count"] > 1:
        raise ValueError(f"several records at file_ordinal {seen['most'][0]}, entry {seen['most'][1]}: give each its own entry")
    bits = (seen["entry_high"] or 0).bit_length()
    if seen["nulls"] or min(seen["file_low"] or 0, seen["entry_low"] or 0) < 0 or (seen["file_high"] or 0) >> (FOLDER_BITS - min(bits, FOLDER_BITS)):
        raise ValueError(f"file_ordinal and entry must be known, not negative, and together no longer than {FOLDER_BITS} bits")
    record = record.withColumn(EV, F.col("file_ordinal").cast("long") * (1 << bits) + F.col("entry").cast("long"))
    tables = {"event": record.select(EV, "file_ordinal", "entry", F.col("event").cast("long").alias("number"))}
    for group, fields in GROUPS.items():
        name = {"at": "atom"}.get(group, group)
        rows = record.select(EV, F.posexplode(F.arrays_zip(*[F.col(f"{group}_{f}").alias(f) for f in fields])))
        types = {f.name: f.dataType for f in SCHEMAS[name]}
        columns: list[Column] = [F.col("pos").cast("long").alias(INDEX[group])] if group in INDEX else []
        columns += [F.col(f"col.{f}").cast(types[RENAMED.get((group, f), f)]).alias(RENAMED.get((group, f), f))
                    for f in fields]
        tables[name] = rows.select(EV, *columns)
    if ASSIGNMENT in record.columns:
        tables["assign"] = record.select(EV, F.posexplode(ASSIGNMENT).alias("lc", "label")).select(
            EV, F.col("lc").cast("long"), F.col("label").cast("long"))
    names = [n for n in collections_of(record) if collections is None or n in collections]
    if names:
        stored = _collection(record, names[0])
        for name in names[1:]:
            stored = stored.unionByName(_collection(record, name))
        tables["trackster_lc"] = stored
    return EventTables(**tables)


def _collection(record: DataFrame, name: str) -> DataFrame:
    """Ragged lists: the counts say how many entries of the flat arrays belong to each trackster in turn. A trackster
    of count 0 keeps one row without entry."""
    counts, flat, mult = (F.col(f"ts_{name}_{s}") for s in ("nLC", "lc", "mult"))
    entries = record.select(EV, F.posexplode(F.arrays_zip(flat.alias("lc"), mult.alias("mult"))).alias("flat", "e"))
    lists = record.select(EV, F.posexplode(counts).alias("ts", "n")).select(
        EV, F.col("ts").cast("long").alias("ts"), F.col("n").cast("long").alias("n"))
    slots = (totals_before(lists, [EV], "ts", "n", "offset")
             .withColumn("pos", F.explode_outer(F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n") - 1))))
             .withColumn("flat", F.col("offset") + F.col("pos")))
    return slots.join(entries, [EV, "flat"], "left").select(
        EV, F.lit(name).alias("collection"), "ts", "pos", F.col("e.lc").cast("long").alias("lc"),
        share_weight(F.col("e.mult")).alias("weight"))


def offsets(trackster_lc: DataFrame) -> DataFrame:
    """(event_id, collection, ts, n_lc, offset): where every trackster starts in the flat list of its event."""
    counts = trackster_lc.groupBy(EV, "collection", "ts").agg(F.count("lc").alias("n_lc"))
    return totals_before(counts, [EV, "collection"], "ts", "n_lc", "offset")


def owner_rows(trackster_lc: DataFrame) -> DataFrame:
    """(event_id, collection, flat, ts, lc): the trackster that owns every entry of the flat list."""
    held = trackster_lc.filter(F.col("lc").isNotNull())
    within = totals_before(held.select(EV, "collection", "ts", "pos", "lc", F.lit(1).cast("long").alias("one")),
                           [EV, "collection", "ts"], "pos", "one", "k")
    return (within.join(offsets(trackster_lc), [EV, "collection", "ts"])
            .select(EV, "collection", (F.col("offset") + F.col("k")).alias("flat"), "ts", "lc"))
